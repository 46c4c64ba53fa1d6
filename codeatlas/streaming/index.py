"""Indexing as files arrive: a file stream is parsed and chunked, and each micro-batch is merged into the index.

Parsing and chunking are stateless projections, so the same functions serve streams and tables. A batch writes its own chunks and the names
of its files (``sources.deltas``), and a batch that runs twice is applied once. Of several versions of a file in a
batch the one modified last counts; a version without a text (null) takes the file out of the index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.operators import chunk, parse
from codeatlas.sources import deltas
from codeatlas.sources.scratch import durable

FILES = "project_id string, path string, relative string, extension string, size bigint, modified timestamp, source string"


def file_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Parquet listings of source files with their texts, as they are dropped into ``path``."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", max_files).parquet(path)


def start_index(files: DataFrame, index_path: str, checkpoint: str, available_now: bool = False, compact_every: int = 50):
    """A running query that keeps the chunk index of the projects in ``files`` up to date.

    Each micro-batch is one change of the index, known by the checkpoint and its number; after ``compact_every`` changes the index is compacted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("project_id", "path").agg(F.max_by(F.struct("relative", "extension", "size", "source"), F.struct("modified", F.col("source").isNotNull(), "size", "source")).alias("f")).select("project_id", "path", "f.*")
        latest = durable(latest, "index-batch")  # read for the files' names and for each kind of chunk
        deltas.apply(chunk.chunk_files(parse.parse_files(latest)), latest.select("project_id", F.col("path").alias("file_path")), index_path, checkpoint, number)
        rows = deltas.commits(spark, index_path)
        base = rows.filter("kind = 'base'").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        if rows.filter(F.col("version") > base).count() >= compact_every:
            deltas.compact(spark, index_path)

    writer = files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_index(spark: SparkSession, index_path: str) -> DataFrame | None:
    return deltas.read(spark, index_path)
