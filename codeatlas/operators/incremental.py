"""Fingerprints of projects, and which of them changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def project_fingerprint(files: DataFrame) -> DataFrame:
    """MD5 of all "path:size" of a project in path order. Only paths and sizes are shuffled."""
    listed = F.sort_array(F.collect_list(F.struct("path", "size")))
    joined = F.array_join(F.transform(listed, lambda f: F.concat(f["path"], F.lit(":"), f["size"].cast("string"))), "")
    return files.groupBy("project_id").agg(F.md5(joined).alias("fingerprint"))


def changed_projects(current: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Projects to index: new, changed, without chunks, or all with ``force``; ``stored`` has total_chunks too."""
    old = stored.select("project_id", F.col("fingerprint").alias("_old"), "total_chunks")
    rows = current.join(old, "project_id", "left")
    if not force:
        rows = rows.filter(~F.col("fingerprint").eqNullSafe(F.col("_old")) | (F.coalesce("total_chunks", F.lit(0)) == 0))
    return rows.select("project_id", "fingerprint")


def digest_leaves(files: DataFrame, buckets: int = 256) -> DataFrame:
    """(project_id, bucket, n, total, mix): sums that do not depend on the order of the files of a hashed part of a project.

    They are added up before the shuffle, so a project of any size is at most ``buckets`` rows a task and no list of its files is made.
    """
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket")
    one, two = F.xxhash64("path", "size"), F.xxhash64("size", F.lit("|"), "path")
    return files.groupBy("project_id", bucket).agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("total"), F.bit_xor(two).alias("mix"))


def digest_roots(leaves: DataFrame) -> DataFrame:
    """(project_id, n_files, digest) from the leaves: another aggregation over at most as many rows as a project has buckets."""
    part = F.struct("bucket", F.concat_ws(":", "bucket", "n", F.col("total").cast("string"), "mix").alias("text"))
    listed = F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"])
    return leaves.groupBy("project_id").agg(F.sum("n").alias("n_files"), F.sha2(F.array_join(listed, ","), 256).alias("digest"))


def changed_files(current: DataFrame, stored: DataFrame, current_leaves: DataFrame, stored_leaves: DataFrame, buckets: int = 256) -> DataFrame:
    """(project_id, path, change): files that were added, changed or removed. Only the files of buckets whose leaves differ are compared."""
    key = ["project_id", "bucket"]
    differ = current_leaves.join(stored_leaves.select(*key, *[F.col(c).alias(f"_{c}") for c in ("n", "total", "mix")]), key, "full")
    same = F.lit(True)
    for c in ("n", "total", "mix"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    differ = differ.filter(~same).select(*key)

    def within(files: DataFrame, size: str) -> DataFrame:
        placed = files.select("project_id", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket"), "path", F.col("size").alias(size))
        return placed.join(differ, key, "left_semi").select("project_id", "path", F.struct(size).alias(size))

    both = within(current, "now").join(within(stored, "before"), ["project_id", "path"], "full").filter(~F.col("now.now").eqNullSafe(F.col("before.before")) | F.col("now").isNull() | F.col("before").isNull())
    change = F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.select("project_id", "path", change.alias("change"))
