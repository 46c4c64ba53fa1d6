"""Embedding and exact cosine top-K over chunk vectors.

Many queries run in one pass over the index: a block of queries of bounded size is sent to all tasks, a matrix product gives
the distances of a batch of rows, each task keeps its k best rows of each query, and only these are shuffled. The index itself is not. Scores
are never all kept. More queries than a block holds take another pass for each block, one after the other. ``operators.clusters`` has an index
that lets most rows out of most passes.

A vector that is null, holds nulls, has another length than the query or is all zeros has no direction: it has no distance to
anything, and is in no result.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeatlas.sources.scratch import durable

# Batch of the embedding calls, and results of a search.
BATCH, TOP_K = 16, 8
#: Bytes of query vectors sent to the tasks at once, and rows and queries of one matrix product.
QUERY_BYTES, ROW_BLOCK, QUERY_BLOCK = 64_000_000, 4096, 512


def embed(chunks: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], batch_size: int = BATCH, text: str = "content") -> DataFrame:
    """``chunks`` plus ``embedding``, from calls with ``batch_size`` texts in order."""

    @F.pandas_udf("array<float>")
    def embedded(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        return pd.Series([list(map(float, v)) for s in range(0, len(rows), batch_size) for v in embed_fn(rows[s : s + batch_size])])

    return chunks.withColumn("embedding", embedded(F.col(text)))


def hashing_embedder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedding of word counts, for tests and where no model is at hand."""
    import zlib

    def run(texts):
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in t.split():
                h = zlib.crc32(w.encode())
                out[i, h % dimensions] += 1 if h & 0x80000000 else -1
        return out.tolist()

    return run


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|), in built-in functions."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def where(index: DataFrame, equal: dict | None = None, contains: str | None = None, text: str = "content") -> DataFrame:
    """Rows that meet all equalities and whose text holds ``contains``."""
    tests = [F.col(k) == v for k, v in (equal or {}).items()] + ([F.col(text).contains(contains)] if contains else [])
    return reduce(DataFrame.filter, tests, index)


def search(index: DataFrame, query: list[float], top_k: int = TOP_K, equal: dict | None = None, id_column: str = "id") -> DataFrame:
    """The ``top_k`` nearest rows with ``distance``, ties by id."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    usable = (F.size("embedding") == len(query)) & ~F.exists("embedding", lambda x: x.isNull()) & F.exists("embedding", lambda x: x != 0)
    if not any(query):
        usable = F.lit(False)
    rows = where(index, equal).filter(usable).withColumn("distance", cosine_distance(F.col("embedding"), vector))
    return rows.orderBy("distance", id_column).limit(top_k)


def directions(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors in ``column``, their unit vectors)."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    flat = pc.list_flatten(column.take(pa.array(at)))
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), size)
    norms = np.linalg.norm(values, axis=1)
    fine = np.isfinite(norms) & (norms > 0)
    return at[fine], values[fine] / norms[fine, None]


def _best(found: pd.DataFrame) -> pd.DataFrame:
    """The rows of each query that can be among its best."""
    kept = found.sort_values(["query", "distance", "id"])
    return kept[kept.groupby("query").cumcount() < kept["top_k"]]


class Asked:
    """The queries of a block that have a direction: unit vectors, how many results, and what each filter wants as codes (-1: anything)."""

    def __init__(self, rows: pa.Table, filters: tuple[str, ...]):
        size = int(pc.max(pc.list_value_length(rows["embedding"])).as_py() or 0)
        at, self.vectors = directions(rows["embedding"].combine_chunks(), size)
        self.top, self.names = rows["top_k"].to_numpy()[at], rows["query_id"].take(pa.array(at)).to_pylist()
        self.wanted = []
        for c in filters:
            values = rows[c].take(pa.array(at)).combine_chunks().dictionary_encode()
            self.wanted.append((values.dictionary.to_pylist(), pc.fill_null(values.indices, -1).to_numpy(zero_copy_only=False)))


class Nearest:
    """The best rows of each query so far, and ``limits``, the distance beyond which a row is none of them."""

    def __init__(self, asked: Asked, limits: np.ndarray | None = None):
        self.asked, self.limits = asked, np.full(len(asked.top), np.inf) if limits is None else limits.copy()
        self.kept = pd.DataFrame({"query": [], "id": [], "distance": [], "top_k": []})

    def see(self, ids: pa.Array, vectors: np.ndarray, columns: list[pa.Array], active: np.ndarray | None = None) -> None:
        """Rows with a direction; ``active``: the queries that look at them."""
        asked, parts, tests = self.asked, [self.kept], []
        for (values, codes), column in zip(asked.wanted, columns):  # a filter's values become numbers once for all rows and queries
            held = column.dictionary_encode()
            place = {x: k for k, x in enumerate(held.dictionary.to_pylist())}
            number = np.array([place.get(x, -2) for x in values] + [-1])  # -1: anything, -2: no row here
            tests.append((number[codes], pc.fill_null(held.indices, -3).to_numpy(zero_copy_only=False)))
        names = ids.to_pandas().to_numpy()
        active = np.arange(len(asked.top)) if active is None else active
        for f in range(0, len(active), QUERY_BLOCK):
            some = active[f : f + QUERY_BLOCK]
            distance = 1 - asked.vectors[some] @ vectors.T
            for number, held in tests:
                n = number[some][:, None]
                distance[(n != -1) & (n != held[None, :])] = np.inf
            k = min(int(asked.top[some].max()), distance.shape[1])
            cut = np.partition(distance, k - 1, axis=1)[:, k - 1 : k]
            j, i = np.nonzero((distance <= np.minimum(cut, self.limits[some][:, None] + 1e-9)) & np.isfinite(distance))
            parts.append(pd.DataFrame({"query": some[j], "id": names[i], "distance": distance[j, i], "top_k": asked.top[some[j]]}))
        if any(len(p) for p in parts[1:]):
            self.kept = _best(pd.concat([p for p in parts if len(p)]))
            full = self.kept.groupby("query").agg(n=("id", "size"), most=("distance", "max"), top=("top_k", "first"))
            full = full[full["n"] >= full["top"]]
            at = full.index.to_numpy(np.int64)
            self.limits[at] = np.minimum(self.limits[at], full["most"].to_numpy())

    def found(self, types: list[pa.DataType]) -> list[pa.RecordBatch]:
        kept, names = self.kept, ["query_id", "id", "distance", "top_k"]
        columns = [[self.asked.names[int(j)] for j in kept["query"]], kept["id"].tolist(), kept["distance"].tolist(), kept["top_k"].astype(int).tolist()]
        return [pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=names)] if len(kept) else []


def result_schema(index: DataFrame, queries: DataFrame, id_column: str) -> tuple[str, list[pa.DataType]]:
    id_type, query_type = (df.schema[c].dataType.simpleString() for df, c in ((index, id_column), (queries, "query_id")))
    schema = f"query_id {query_type}, id {id_type}, distance double, top_k int"
    return schema, [f.type for f in to_arrow_schema(T._parse_datatype_string(schema))]


def query_blocks(queries: DataFrame, filters: tuple[str, ...], more: int = 0) -> Iterator[Asked]:
    """The queries in blocks of ``QUERY_BYTES`` at most (``more``: bytes that a query costs besides its vector), one at a time on the driver."""
    rows = durable(queries.select("query_id", "embedding", F.col("top_k").cast("int").alias("top_k"), *filters), "queries")
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.size("embedding"), F.lit(0)) * 8 + 64 + more), F.lit(0))).first()[0]
    blocks = max(1, -(-size // QUERY_BYTES))
    for k in range(blocks):
        yield Asked(rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).toArrow(), filters)


def ranked(found: DataFrame) -> DataFrame:
    placed = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return placed.filter("rank <= top_k").drop("top_k")


def search_many(index: DataFrame, queries: DataFrame, filters: tuple[str, ...] = (), id_column: str = "id") -> DataFrame:
    """Ranked rows (query_id, id, distance, rank) for many queries.

    ``queries`` has query_id, embedding, top_k and a column for each of ``filters``, null where it does not filter. More blocks of queries than one are
    run in turn, and their results stored.
    """
    schema, types = result_schema(index, queries, id_column)

    def block(asked: Asked) -> DataFrame:
        shared = index.sparkSession.sparkContext.broadcast(asked)

        def run(batches):
            asked = shared.value
            best = Nearest(asked)
            for batch in batches:
                for s in range(0, batch.num_rows, ROW_BLOCK):
                    part = batch.slice(s, ROW_BLOCK)
                    rows, v = directions(part.column(1), asked.vectors.shape[1])
                    if len(rows):
                        best.see(part.column(0).take(pa.array(rows)), v, [part.column(2 + k).take(pa.array(rows)) for k in range(len(filters))])
            yield from best.found(types)

        return index.select(id_column, "embedding", *filters).mapInArrow(run, schema)

    return ranked(in_turn(query_blocks(queries, filters), block))


def in_turn(blocks: Iterator[Asked], search: Callable[[Asked], DataFrame]) -> DataFrame:
    """The results of all blocks; each but a single one is finished and stored before the next begins."""
    found, first = [], next(blocks)
    for asked in itertools.chain(blocks, [None]):
        found.append(search(first) if asked is None and not found else durable(search(first), "found"))
        first = asked
    return reduce(DataFrame.unionByName, found)


def distinct_contexts(specs: DataFrame, retrieve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Retrieval once for each distinct (layer_filter, top_k), given to every category that shares it.

    ``retrieve`` maps the distinct rows (context_id, layer_filter, top_k) to rows with context_id.
    """
    key = F.concat_ws("/", F.coalesce("layer_filter", F.lit("*")), F.col("top_k").cast("string"))
    keyed = specs.withColumn("context_id", key)
    distinct = keyed.select("context_id", "layer_filter", "top_k").dropDuplicates(["context_id"])
    return keyed.join(retrieve(distinct), "context_id")
