"""Source files: listings and texts."""

from __future__ import annotations

import itertools
import os
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions import rules, text
from codeatlas.sources.scratch import durable, shared_dir

#: Schemes that tasks open themselves; files in other stores come through Spark's reader.
OPENED = ("file", "hdfs", "s3", "s3a", "gs")
#: Entries that a task lists before it gives folders back, rows of a batch, and tries at a store that fails.
ENTRIES, ROWS, TRIES = 20_000, 5_000, 3
KINDS = (pa.string(), pa.string(), pa.int64(), pa.string())


def filter_files(listing: DataFrame) -> DataFrame:
    """Rows of a listing (project_id, path, relative, ...) with a known extension and outside of ignored folders."""
    ext = rules.extension_of(F.col("relative"))
    return listing.filter(ext.isin(rules.EXTENSIONS) & ~rules.in_ignored_dir(F.col("relative"))).withColumn("extension", ext)


def store_of(root: str) -> tuple[stores.FileSystem, str]:
    """Where ``root`` is, and its path there."""
    if "://" not in root:
        return stores.LocalFileSystem(), os.path.abspath(root.removeprefix("file:"))
    return stores.FileSystem.from_uri(root.replace("s3a://", "s3://"))


def _tried(call, *args):
    """What ``call`` gives; errors of the store are tried again, what is not there or not allowed is not."""
    for k in range(TRIES):
        try:
            return call(*args)
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            raise
        except OSError:
            if k == TRIES - 1:
                raise
            time.sleep(0.2 * 2**k)


def _open_folders(batches: Iterator[pa.RecordBatch], root: str, entries: int) -> Iterator[pa.RecordBatch]:
    """Lists the folders of ``batches`` and those below them until it has seen ``entries`` entries; folders left over are given back."""
    store, base = store_of(root)
    names = ["path", "kind", "size", "error"]
    waiting, rows, seen = [], [], 0
    for folder in (f for batch in batches for f in batch.column(0).to_pylist()):
        waiting.append(folder)
        while waiting:
            folder = waiting.pop()
            if seen >= entries:
                rows.append((folder, "open", 0, None))
                continue
            try:
                found = _tried(store.get_file_info, stores.FileSelector(folder))
            except OSError as e:
                rows.append((folder, "error", 0, str(e)))
                continue
            seen += len(found) + 1
            for entry in found:
                if entry.type != stores.FileType.Directory:
                    rows.append((entry.path, "file", entry.size or 0, None))
                elif entry.base_name not in rules.IGNORED_DIRS and not os.path.islink(entry.path):
                    waiting.append(entry.path)
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), KINDS)], names)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), KINDS)], names)


def walk(spark: SparkSession, root: str, entries: int = ENTRIES) -> DataFrame:
    """(path, relative, kind, size, error): all files below ``root``, and the folders that cannot be listed as errors; stored.

    The folders yet to be opened are a table. In each round it is dealt to the tasks, a task goes down its folders until it has seen ``entries`` entries,
    and what it has not opened is the next round's table: a small tree is listed in one round, and a large one spreads over more tasks each round, however
    its folders are nested. The driver sees one number a round.
    """
    store, base = store_of(root)
    if store.get_file_info(base).type != stores.FileType.Directory:
        raise NotADirectoryError(root)
    place, schema = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}", "path string, kind string, size bigint, error string"
    frontier, n, spread = spark.createDataFrame([(base,)], "path string"), 1, 4 * spark.sparkContext.defaultParallelism
    for k in itertools.count():
        found = frontier.repartition(min(n, spread)).mapInArrow(lambda batches: _open_folders(batches, root, entries), schema)
        found.write.parquet(f"{place}/round={k}")
        frontier = spark.read.schema(schema).parquet(f"{place}/round={k}").filter("kind = 'open'").select("path")
        if not (n := frontier.count()):
            break
    rows = spark.read.schema(schema + ", round int").parquet(place).filter("kind <> 'open'")
    return rows.select("path", F.expr(f"ltrim('/', substring(path, {len(base) + 1}))").alias("relative"), "kind", "size", "error")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, size) of all files under ``root``."""
    return walk(spark, root).filter("kind = 'file'").select("path", "relative", "size")


def _with_content(files: DataFrame, root: str) -> DataFrame:
    """``files`` plus ``content`` and ``error``, opened in tasks; a file that cannot be read has an error and no content."""

    def read(store, path):
        with store.open_input_stream(path) as f:
            return f.read()

    def run(batches):
        store, _ = store_of(root)
        for batch in batches:
            for k in range(batch.num_rows):
                row, content, error = batch.slice(k, 1), None, None
                try:
                    content = _tried(read, store, row.column("path")[0].as_py())
                except OSError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([error], pa.string())], names=[*row.schema.names, "content", "error"])

    columns = ", ".join(f"{c} {t}" for c, t in files.dtypes)
    spread = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(spread, "path").mapInArrow(run, f"{columns}, content binary, error string")


def read_files(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Texts of a listing (project_id, path, relative, extension, size), stored, and (project_id, path, error) of the files that could not be
    read, which have an empty text."""
    opened = _with_content(files, root)
    stored = durable(read_text(opened, keep=("error",)).withColumn("source", F.coalesce("source", F.lit(""))), "scanned")
    return stored.drop("error"), stored.filter("error IS NOT NULL").select("project_id", "path", "error")


def _project_files(listed: DataFrame, project_id: str) -> DataFrame:
    return filter_files(listed.withColumn("project_id", F.lit(project_id))).select("project_id", "path", "relative", "extension", "size")


def scan(spark: SparkSession, root: str, project_id: str) -> tuple[DataFrame, DataFrame]:
    """The files under ``root`` with their texts, and (project_id, path, error) of the folders and files that could not be read. Both are stored."""
    found = walk(spark, root)
    files, errors = read_files(_project_files(found.filter("kind = 'file'"), project_id), root)
    return files, errors.unionByName(found.filter("kind = 'error'").select(F.lit(project_id).alias("project_id"), "path", "error"))


def scan_files(spark: SparkSession, root: str, project_id: str, with_source: bool = True) -> DataFrame:
    """Files under ``root``: project_id, path, relative, extension, size, and their text if wanted ('' if it cannot be read; ``scan`` says why).

    Only files that are kept are opened, each by the task that has its row. In stores that only Spark's reader reaches, names that begin
    with ``_`` or ``.`` are skipped, since that reader does so.
    """
    if root.split(":")[0] in OPENED or "://" not in root:
        rows = _project_files(listing(spark, root), project_id)
        return read_text(_with_content(rows, root)).withColumn("source", F.coalesce("source", F.lit(""))) if with_source else rows
    names = "*{" + ",".join(rules.EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    relative = F.expr(f"substring(path, length('{root.rstrip('/')}') + 2)")
    rows = filter_files(files.select(F.lit(project_id).alias("project_id"), "path", relative.alias("relative"), F.col("length").alias("size"), *["content"] * with_source))
    return read_text(rows) if with_source else rows.select("project_id", "path", "relative", "extension", "size")


def read_text(files: DataFrame, max_chars: int = text.MAX_SOURCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``content`` bytes as ``source`` text."""
    return files.select("project_id", "path", "relative", "extension", "size", text.read_text(F.col("content"), max_chars).alias("source"), *keep)
