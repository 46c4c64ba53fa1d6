"""Stored tables: chunk index, graph, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.operators import graph
from codeatlas.sources import deltas
from codeatlas.sources.scratch import durable


def write_index(chunks: DataFrame, path: str, mode: str = "replace") -> None:
    """``replace`` writes the whole index, ``projects`` only the partitions of the projects in ``chunks``."""
    writer = chunks.repartition("project_id", F.pmod(F.hash("id"), F.lit(16))).write.mode("overwrite").partitionBy("project_id")
    (writer.option("partitionOverwriteMode", "dynamic") if mode == "projects" else writer).parquet(path)


def upsert_chunks(existing: DataFrame, incoming: DataFrame, key: str | list[str] = "id", latest: str | None = None) -> DataFrame:
    """``existing`` with the rows of ``incoming`` in place of those with the same key; of incoming repeats one stays."""
    keys = [key] if isinstance(key, str) else list(key)
    if latest:
        others = [c for c in incoming.columns if c not in keys and c != latest]
        best = incoming.groupBy(*keys).agg(F.max(F.struct(latest, *others)).alias("x"))
        incoming = best.select(*keys, "x.*").select(*incoming.columns)
    else:
        incoming = incoming.dropDuplicates(keys)
    return existing.join(incoming, keys, "left_anti").unionByName(incoming)


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    return chunks.drop("content", "embedding")


def chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n"))


NODES, EDGES = ["project_id", "label", "key"], ["project_id", "rel", "src_key"]
ORDERS = {"nodes": NODES, "edges": EDGES, "called": ["project_id", "wanted"], "known": ["project_id", "wanted"]}


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, called: DataFrame | None = None, known: DataFrame | None = None) -> None:
    """Nodes and edges of the projects in them, in place of all that those projects had (labels and types that are gone too).

    A change writes its own projects only, in files that are ranges of project and label or relation (``sources.deltas``). With ``called`` and ``known``
    (``graph.build_parts``) the CALLS edges are stored as these two tables and need not be in ``edges``.
    """
    touched = durable(nodes.select("project_id").union(edges.select("project_id")).distinct(), "graph-projects")
    for name, df in zip(ORDERS, (nodes, edges, called, known)):
        if df is None and (df := _stored(nodes.sparkSession, path, name)) is not None:
            df = df.limit(0)  # the projects' former calls go
        if df is not None:
            deltas.apply(df, touched, f"{path}/{name}", key=["project_id"], order=ORDERS[name])


def _stored(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    return deltas.read(spark, f"{path}/{name}", key=["project_id"])


def read_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """Nodes, edges, called and known as they were written; the last two are None if no change had them."""
    return tuple(_stored(spark, path, name) for name in ORDERS)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and all edges."""
    nodes, edges, called, known = read_parts(spark, path)
    return nodes, edges if called is None else graph.with_calls(edges, called, known)


def compact_graph(spark: SparkSession, path: str) -> None:
    for name, order in ORDERS.items():
        deltas.compact(spark, f"{path}/{name}", key=["project_id"], order=order)
        deltas.vacuum(spark, f"{path}/{name}")


HISTORY = (
    "projects map<string, struct<last_accessed: string, stats: struct<total_files: bigint, total_chunks: bigint, parsed: bigint, chunks: bigint>>>, chats map<string, array<struct<role: string, content: string>>>"
)


def load_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, chats) of one JSON history document (a ``.json`` file), or of a folder that ``save_history`` wrote."""
    doc = spark.read.schema(HISTORY).option("multiLine", path.endswith(".json")).json(path)
    runs = doc.select(F.explode("projects").alias("project_path", "p")).select("project_path", F.to_timestamp("p.last_accessed").alias("last_accessed"), "p.stats.*")
    chats = doc.select(F.explode("chats").alias("project_path", "turns")).select("project_path", F.posexplode("turns").alias("turn", "t")).select("project_path", "turn", "t.role", "t.content")
    return runs, chats


def save_history(runs: DataFrame, chats: DataFrame, path: str) -> None:
    """A folder with one JSON document a project and line, in the shape of the whole document."""
    stamp = F.date_format("last_accessed", "yyyy-MM-dd'T'HH:mm:ss")
    projects = runs.select("project_path", F.create_map("project_path", F.struct(stamp.alias("last_accessed"), F.struct("total_files", "total_chunks").alias("stats"))).alias("projects"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    spoken = chats.groupBy("project_path").agg(listed.alias("turns")).select("project_path", F.create_map("project_path", "turns").alias("chats"))
    projects.join(spoken, "project_path", "full").drop("project_path").write.mode("overwrite").json(path)
