"""Exact dedup: 128-bit content hash, then bytes.

Texts are grouped by their MD5 and compared byte for byte inside a hash group, all in hash
aggregates with map-side combining: a text that a third of all rows share leaves each map task
as one row. Only hashes, ids and counts are joined back to the documents, so the text is
shuffled once; the join is many-to-one and AQE splits its hot keys. Should different texts share a hash, only the
rows of such hashes are joined on their texts too.

Defined results: a null text counts as empty, empty texts are equal to each other; of equal
texts the row with the largest (or smallest) id stays; ids are unique keys, so rows that repeat
an id and its text are one document and get the same answer; a null id never beats another
id, and a group of null ids only has a null ``keep_id`` and keeps its rows. All columns of the caller come back with their values,
whatever their names (a new column whose name is taken gets an underscore); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.arrow import free_name
from codeatlas.sources.scratch import durable


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _groups(docs: DataFrame, keep: str, hash_key) -> tuple[DataFrame, DataFrame | None]:
    """(hash, texts, keep_id, group_size) of every hash, and (hash, body, keep_id, group_size) of those that different texts share."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    best = F.max if keep == "largest" else F.min
    body = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(hash_key(body).alias("hash"), body.alias("body"), docs["doc_id"].alias("id"))
    texts = texts.groupBy("hash", "body").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = durable(groups, "exact-groups")
    shared = groups.filter("texts > 1").select("hash")
    return groups, None if shared.isEmpty() else durable(texts.join(shared, "hash", "left_semi"), "exact-collisions")


def _hashed(docs: DataFrame, hash_key) -> tuple[DataFrame, str]:
    """``docs`` with their hash in a column of a free name, so that a join on it moves no text that nobody needs."""
    name = free_name(docs, "hash")
    return docs.withColumn(name, hash_key(F.coalesce(docs["text"], F.lit("")))), name


def with_groups(docs: DataFrame, keep: str = "largest", hash_key=md5_key) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` and ``kept`` after its own columns."""
    groups, collisions = _groups(docs, keep, hash_key)
    names = [free_name(docs, c) for c in ("keep_id", "group_size", "kept")]
    keyed, key = _hashed(docs, hash_key)

    def joined(found, more=None):
        on = keyed[key] == found["hash"]
        made = keyed.join(found, on if more is None else on & more)
        new = [found["keep_id"], found["group_size"], keyed["doc_id"].eqNullSafe(found["keep_id"])]
        return made.select(*[keyed[c] for c in docs.columns], *[c.alias(n) for c, n in zip(new, names)])

    made = joined(groups.filter("texts = 1"))
    if collisions is not None:
        made = made.unionByName(joined(collisions, F.coalesce(keyed["text"], F.lit("")) == collisions["body"]))
    return made


def drop_copies(docs: DataFrame, keep: str = "largest", hash_key=md5_key) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    groups, collisions = _groups(docs, keep, hash_key)
    keyed, key = _hashed(docs, hash_key)
    best = lambda found: (keyed[key] == found["hash"]) & keyed["doc_id"].eqNullSafe(found["keep_id"])
    single = groups.filter("texts = 1")
    made = keyed.join(single, best(single), "left_semi")
    if collisions is not None:
        made = made.unionByName(keyed.join(collisions, best(collisions) & (F.coalesce(keyed["text"], F.lit("")) == collisions["body"]), "left_semi"))
    return made.drop(key)


def report(docs: DataFrame) -> DataFrame:
    """One row for each document, dropped ones too."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")  # before the join, which then moves no text
    return with_groups(docs.select("doc_id", "text", digest)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
