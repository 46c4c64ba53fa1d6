"""A vector index in clusters, and exact cosine top-K that leaves out what cannot be among the best.

Angles between unit vectors obey the triangle inequality: a row at angle ``a`` from its cluster's pivot is at least ``|t - a|`` away from a query
at angle ``t`` from that pivot. The index keeps each row's cluster and angle, is partitioned by cluster and ordered by angle, and has a small table of
its pivots and their ranges of angles.

A search first looks only at the clusters that may hold the nearest rows of each query, which gives every query the distance of its k-th best so far. With these, whole
clusters are not read, of the others only the angles that some query can need, and in a task each block of rows meets only the queries that
it can serve. What is left out has a bound beyond the k-th best, so the result is that of ``vectors.search_many``.

Pivots are a hashed sample of ``pivots`` rows, moved to their clusters' means in ``ROUNDS`` rounds. Rows without a direction (null, all zeros, nulls in them) or of
another length than most are kept in cluster -1, which every search reads whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.operators import vectors
from codeatlas.operators.vectors import Asked, Nearest, directions
from codeatlas.sources.scratch import durable

ROUNDS, SEEDS, SLACK, CONDITIONS = 2, 2, 1e-6, 256


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _pivots(index: DataFrame, size: int, count: int, id_column: str) -> np.ndarray:
    """Unit vectors: of a sample, then of the means of what is nearest to each."""
    sample = index.filter(F.size("embedding") == size).orderBy(F.xxhash64(id_column), id_column).select("embedding").limit(count).toArrow()  # count vectors
    _, pivots = directions(sample["embedding"].combine_chunks(), size)
    for _ in range(ROUNDS if len(pivots) else 0):
        shared = index.sparkSession.sparkContext.broadcast(pivots)

        def sums(batches):
            total = np.zeros((len(shared.value), size))
            for batch in batches:
                _, v = directions(batch.column(0), size)
                np.add.at(total, angles(v, shared.value).argmin(axis=1), v)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["cluster", "total"])

        parts = index.select("embedding").mapInArrow(sums, "cluster int, total array<double>")
        summed = parts.select("cluster", F.posexplode("total")).groupBy("cluster", "pos").agg(F.sum("col").alias("x"))
        moved = np.zeros_like(pivots)
        for r in summed.toPandas().itertuples():  # count * size numbers
            moved[r.cluster, r.pos] = r.x
        norms = np.linalg.norm(moved, axis=1)
        pivots = np.where(norms[:, None] > 0, moved / np.maximum(norms, 1e-300)[:, None], pivots)
    return pivots


def write_clusters(index: DataFrame, path: str, pivots: int = 64, id_column: str = "id") -> None:
    """Writes ``index`` (id, embedding and any columns) to ``path``."""
    spark = index.sparkSession
    size = index.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    size = size[0].n if size else 0
    shared = spark.sparkContext.broadcast(_pivots(index, size, pivots, id_column))
    names = [f"c{k}" for k in range(len(index.columns))]
    place = index.columns.index("embedding")
    renamed = index.toDF(*names)

    def run(batches):
        for batch in batches:
            cluster, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            at, v = directions(batch.column(place), size)
            if len(at) and len(shared.value):
                away = angles(v, shared.value)
                cluster[at] = away.argmin(axis=1)
                angle[at] = away.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(angle)], [*names, "_cluster", "_angle"])

    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, renamed.dtypes))
    made = renamed.mapInArrow(run, f"{schema}, _cluster int, _angle double").toDF(*index.columns, "_cluster", "_angle")
    rows = made.repartitionByRange("_cluster", "_angle").sortWithinPartitions("_cluster", "_angle")
    rows.write.mode("overwrite").partitionBy("_cluster").parquet(f"{path}/rows")
    if not spark.read.schema(rows.schema).parquet(f"{path}/rows").limit(1).count():
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/rows")  # no folder of a cluster: the schema is kept by a file
    ranges = spark.read.parquet(f"{path}/rows").groupBy(F.col("_cluster").alias("cluster")).agg(F.min("_angle").alias("low"), F.max("_angle").alias("high"), F.count(F.lit(1)).alias("rows"))
    known = spark.createDataFrame([(k, list(map(float, p))) for k, p in enumerate(shared.value)], "cluster int, pivot array<double>")
    ranges.join(known, "cluster", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/clusters")  # a row for each pivot


class Ranges:
    """Pivots, their clusters' ranges of angles, and the angles of the queries of a block to them."""

    def __init__(self, rows: list, asked: Asked):
        self.clusters = [r.cluster for r in rows if r.pivot is not None]
        self.low, self.high = (np.array([r[c] for r in rows if r.pivot is not None]) for c in ("low", "high"))
        pivots = np.array([r.pivot for r in rows if r.pivot is not None] or np.zeros((0, 0)))
        self.usable = len(self.clusters) > 0 and pivots.shape[1] == asked.vectors.shape[1]
        self.angles = angles(asked.vectors, pivots) if self.usable else np.zeros((len(asked.top), 0))
        self.place = {c: k for k, c in enumerate(self.clusters)}

    def bounds(self, k: int | slice, low, high) -> np.ndarray:
        """The least angle of each query to rows of cluster(s) ``k`` at ``low`` to ``high`` from the pivot."""
        t = self.angles[:, k]
        return np.maximum(0, np.maximum(t - high, low - t))


def reach(limits: np.ndarray) -> np.ndarray:
    """The angle of a distance."""
    return np.where(np.isfinite(limits), np.arccos(np.clip(1 - np.where(np.isfinite(limits), limits, 0), -1, 1)), np.pi) + SLACK


def search_clusters(spark: SparkSession, path: str, queries: DataFrame, filters: tuple[str, ...] = (), id_column: str = "id", counters: dict | None = None) -> DataFrame:
    """Ranked rows (query_id, id, distance, rank), as ``search_many`` gives them.

    ``counters`` gets accumulators: ``rows`` read and ``pairs`` of a query and a row that were compared, over both passes.
    """
    index, known = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/clusters").collect()  # a row for each pivot
    schema, types = vectors.result_schema(index, queries, id_column)
    count = counters if counters is not None else {}
    for name in ("rows", "pairs"):
        count.setdefault(name, spark.sparkContext.accumulator(0))
    n_rows, n_pairs = count["rows"], count["pairs"]

    def scan(rows: DataFrame, shared, only=None) -> DataFrame:
        """``only``: for each cluster the queries that look at it, in the first pass."""

        def run(batches):
            asked, ranges, limits = shared.value
            best = Nearest(asked, limits)
            for batch in batches:
                n_rows.add(batch.num_rows)
                clusters = batch.column(2).to_numpy(zero_copy_only=False)
                cuts = [0, *(np.flatnonzero(clusters[1:] != clusters[:-1]) + 1), batch.num_rows]
                for start, end in zip(cuts[:-1], cuts[1:]):
                    for s in range(start, end, vectors.ROW_BLOCK):
                        part = batch.slice(s, min(vectors.ROW_BLOCK, end - s))
                        active, k = np.arange(len(asked.top)), ranges.place.get(int(clusters[s]))
                        if k is not None and ranges.usable:
                            away = part.column(3).to_numpy()
                            bound = ranges.bounds(k, away.min(), away.max())
                            active = active[bound <= reach(best.limits)] if only is None else np.intersect1d(only.get(k, []), active).astype(np.int64)
                        at, v = directions(part.column(1), asked.vectors.shape[1])
                        if len(at) and len(active):
                            n_pairs.add(len(at) * len(active))
                            taken = pa.array(at)
                            best.see(part.column(0).take(taken), v, [part.column(4 + i).take(taken) for i in range(len(filters))], active)
            yield from best.found(types)

        return rows.select(id_column, "embedding", "_cluster", "_angle", *filters).mapInArrow(run, schema)

    def block(asked: Asked) -> DataFrame:
        ranges = Ranges(known, asked)
        limits, context = np.full(len(asked.top), np.inf), spark.sparkContext
        if not ranges.usable or not len(asked.top):
            return scan(index, context.broadcast((asked, ranges, limits)))
        seeds = np.argsort(ranges.bounds(slice(None), ranges.low, ranges.high) + ranges.angles * 1e-3, axis=1)[:, :SEEDS]
        only = {int(k): np.flatnonzero((seeds == k).any(axis=1)) for k in np.unique(seeds)}
        first = scan(index.filter(F.col("_cluster").isin([ranges.clusters[k] for k in only])), context.broadcast((asked, ranges, limits)), only)
        place = {name: j for j, name in enumerate(asked.names)}
        for r in vectors.ranked(first).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("most")).toLocalIterator():
            if r.n >= asked.top[place[r.query_id]]:
                limits[place[r.query_id]] = r.most
        far = reach(limits)
        needed = ranges.bounds(slice(None), ranges.low, ranges.high) <= far[:, None]
        tests = [F.col("_cluster") == -1]
        for k in np.flatnonzero(needed.any(axis=0)).tolist():
            t, f = ranges.angles[needed[:, k], k], far[needed[:, k]]
            within = F.col("_angle").between(float((t - f).min()), float((t + f).max())) if len(ranges.clusters) <= CONDITIONS else F.lit(True)
            tests.append((F.col("_cluster") == ranges.clusters[k]) & within)
        rows = index.filter(F.col("_cluster").isin([-1] + [ranges.clusters[k] for k in np.flatnonzero(needed.any(axis=0))]))
        if len(ranges.clusters) <= CONDITIONS:
            while len(tests) > 1:  # a flat tree of ORs
                tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2 :]
            rows = rows.filter(tests[0])
        return scan(rows, context.broadcast((asked, ranges, limits)))

    return vectors.ranked(vectors.in_turn(vectors.query_blocks(queries, filters, more=8 * len(known)), block))
