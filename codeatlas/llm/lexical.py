"""Ranked lexical search: exact top k by impact scores, with norm buckets.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters; only A-Z are lower-cased. A document's
vector has a coordinate for each term of the questions, its impact ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``;
a question's vector counts its terms; the score is their product, all in 64-bit integers.

1. One pass over the documents keeps the counts of the questions' terms and the length of each text. N, L and df are sums
   over what it stored.
2. Impact vectors are put in order of their length (the Euclidean norm) by range partitions, ties by id, and stored.
3. The longest vectors give each question a first threshold, the score of its k-th best among them.
4. Every task reads its range in buckets, longest first. With a threshold t a question skips a bucket whose longest vector l has
   ``|q| * l < t`` (Cauchy-Schwarz); rows below that for every question are not read at all, since the filter reaches the stored
   statistics. A bucket is also skipped if the largest value of each coordinate could not reach t.
5. Inside a bucket the fewest coordinates are taken without which t is out of reach; a row must have one of them, and goes if
   its product over them plus a bound of the rest (by coordinates, and by Cauchy-Schwarz over what is left of both lengths) stays below t.
6. Survivors are scored exactly in integers. Thresholds rise as a task goes on; a task returns at most k rows a question.

Bounds are floats with a margin far above their rounding; rows that tie with the threshold are kept.
Questions are taken in blocks of ``BLOCK_BYTES`` and ``BLOCK_ITEMS``, so that what is sent to the tasks does not grow with their
number; each block reads the documents once.

Defined results: null and empty texts have no terms, are not counted in N and never returned; a question without terms, or
whose terms are in no document, has no rows; repeated questions are questions of their own; rows that repeat an id rank as rows of
their own; a row without an id comes after those with the same score. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from codeatlas.llm.arrow import map_slices
from codeatlas.sources.scratch import durable

K = 10
BLOCK_BYTES, BLOCK_ITEMS = 4_000_000, 5_000
BUCKET, LEAD, SALTS = 1024, 0.02, 64
NO_ID = np.iinfo(np.int64).max
#: Upper-case letters to lower case, every other ASCII character that is not in a term to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(FOLD).split() if raw else []


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Questions:
    """Questions as sparse rows over a vocabulary of their own."""

    def __init__(self, rows: list[tuple[int, bytes | None]]):
        counted = [(item, Counter(terms_of(raw))) for item, raw in rows]
        self.index = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in counted))))}
        self.items = np.array([item for item, _ in counted], np.int64)
        self.rows = [(np.array([self.index[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for _, c in counted]


def count_terms(docs: DataFrame, index) -> DataFrame:
    """doc_id, n (all terms), and ``terms`` and ``tfs`` (little-endian int32) of the terms in the shared ``index``."""

    def make():
        known = index.value

        def call(texts):
            n, terms, tfs = [], [], []
            for raw in texts:
                words = terms_of(raw)
                found = [(known[t], c) for t, c in Counter(words).items() if t in known]
                n.append(len(words))
                terms.append(np.array([t for t, _ in found], "<i4").tobytes())
                tfs.append(np.array([c for _, c in found], "<i4").tobytes())
            return n, terms, tfs

        return call

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_slices(rows, ["doc_id"], ["text"], "n long, terms binary, tfs binary", make)


def _joined(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64)


def document_frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """df of each term: counted in a task, then summed."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch.column(0)), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    summed = counts.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out[summed["term"].to_numpy(np.int64)] = summed["df"].to_numpy(np.int64)
    return out


def impact_vectors(counts: DataFrame, w: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, norm, terms and impacts (int64), longest first in range partitions."""
    shared = counts.sparkSession.sparkContext.broadcast(w)

    def make():
        w = shared.value

        def call(terms, tfs, ns):
            kept_terms, impacts, norms = [], [], []
            for t, f, n in zip(terms, tfs, ns):
                t, f = np.frombuffer(t, "<i4"), np.frombuffer(f, "<i4").astype(np.int64)
                m = 25 + (75 * n * n_docs) // n_terms
                value = w[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m))
                some = value > 0
                kept_terms.append(t[some].tobytes())
                impacts.append(value[some].astype("<i8").tobytes())
                norms.append(float(np.sqrt(np.square(value.astype(np.float64)).sum())))
            return kept_terms, impacts, norms

        return call

    made = map_slices(counts.withColumnRenamed("terms", "held"), ["doc_id"], ["held", "tfs", "n"], "terms binary, impacts binary, norm double", make)
    return made.filter("norm > 0").repartitionByRange(F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm"))


class Bucket:
    """Rows of similar length, by row and by coordinate."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
        lengths = np.array([len(t) // 4 for t in batch.column(1).to_pylist()], np.int64)
        self.terms, self.impacts = _joined(batch.column(1)), np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i8")
        self.norms = batch.column(3).to_numpy()
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        order = np.argsort(self.terms, kind="stable")
        self.rows, self.values = np.repeat(np.arange(len(lengths)), lengths)[order], self.impacts[order]
        self.columns, first = np.unique(self.terms[order], return_index=True)
        self.ends = np.append(first, len(order))
        self.largest = np.maximum.reduceat(self.values, first) if len(first) else np.zeros(0, np.int64)

    def column(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.columns, term)
        if k == len(self.columns) or self.columns[k] != term:
            return self.rows[:0], self.values[:0]
        return self.rows[self.ends[k] : self.ends[k + 1]], self.values[self.ends[k] : self.ends[k + 1]]

    def scores(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact products of some rows with a question."""
        lengths = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return np.add.reduceat(dense[self.terms[at]] * self.impacts[at], np.concatenate([[0], np.cumsum(lengths)[:-1]]))


class Search:
    """The best rows of each question so far."""

    def __init__(self, questions: Questions, w: np.ndarray, thresholds: np.ndarray, k: int):
        self.k, self.size, self.thresholds = k, len(questions.index), thresholds.copy()
        self.queries = [(t[w[t] > 0], f[w[t] > 0]) for t, f in questions.rows]
        self.norms = np.array([math.sqrt(float(np.square(f.astype(np.float64)).sum())) for _, f in self.queries])
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.queries]

    def see(self, bucket: Bucket) -> None:
        highest = np.zeros(self.size)
        highest[bucket.columns] = bucket.largest
        for q in np.flatnonzero((self.norms > 0) & (self.norms * bucket.norms.max() * (1 + 1e-9) >= self.thresholds)):
            self._question(int(q), bucket, highest)

    def _question(self, q: int, bucket: Bucket, highest: np.ndarray) -> None:
        (terms, counts), threshold = self.queries[q], self.thresholds[q]
        most = counts * highest[terms]
        order = np.argsort(-most, kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)  # what the coordinates from each on can give
        if rest[0] * (1 + 1e-9) < threshold or rest[0] == 0:
            return
        within = (rest * (1 + 1e-9) < threshold) if threshold > 0 else rest == 0
        focus = int(np.argmax(within))  # a row without one of these coordinates is below the threshold
        dot, square, seen = np.zeros(len(bucket.ids)), np.zeros(len(bucket.ids)), np.zeros(len(bucket.ids), bool)
        for j in order[:focus]:
            rows, values = bucket.column(terms[j])
            dot[rows] += counts[j] * values
            square[rows] += np.square(values.astype(np.float64))
            seen[rows] = True
        rows = np.flatnonzero(seen)
        left = math.sqrt(float(np.square(counts[order[focus:]].astype(np.float64)).sum()))
        tail = np.minimum(rest[focus], left * np.sqrt(np.maximum(np.square(bucket.norms[rows]) * (1 + 1e-9) - square[rows], 0)))
        rows = rows[(dot[rows] + tail) * (1 + 1e-9) >= threshold]
        if not len(rows):
            return
        dense = np.zeros(self.size, np.int64)
        dense[terms] = counts
        scores = bucket.scores(rows, dense)
        some = (scores > 0) & (scores >= threshold)
        scores, ids = np.concatenate([self.best[q][0], scores[some]]), np.concatenate([self.best[q][1], bucket.ids[rows[some]]])
        first = np.lexsort((ids, -scores))[: self.k]
        self.best[q] = scores[first], ids[first]
        if len(first) == self.k:
            self.thresholds[q] = max(threshold, int(scores[first[-1]]))

    def found(self, items: np.ndarray) -> pa.RecordBatch:
        scores, ids = (np.concatenate([np.zeros(0, np.int64), *(b[i] for b in self.best)]) for i in (0, 1))
        whose = np.repeat(items, [len(b[0]) for b in self.best])
        return pa.RecordBatch.from_arrays([pa.array(whose), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["item", "doc_id", "score"])


def _scan(vectors: DataFrame, shared, thresholds: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): the k best rows of each question in each task."""
    start = vectors.sparkSession.sparkContext.broadcast(thresholds)

    def run(batches):
        questions, w = shared.value
        search = Search(questions, w, start.value, k)
        for batch in batches:
            for s in range(0, batch.num_rows, BUCKET):
                search.see(Bucket(batch.slice(s, BUCKET)))
        yield search.found(questions.items)

    return vectors.select("doc_id", "terms", "impacts", "norm").mapInArrow(run, "item long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k first rows of each item: of slices of its rows, then of what they leave."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    cut = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("rank") <= k)
    return cut(cut(found.withColumn("slice", F.spark_partition_id() % SALTS), "item", "slice").drop("rank", "slice"), "item")


def _block(docs: DataFrame, rows: list[tuple[int, bytes | None]], k: int) -> DataFrame:
    """item, rank, doc_id and score for one block of questions."""
    spark = docs.sparkSession
    questions = Questions(rows)
    counts = durable(count_terms(docs, spark.sparkContext.broadcast(questions.index)), "lexical-counts")
    n_docs, n_terms = counts.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(counts, len(questions.index))
    w = weights(df, n_docs)
    vectors = durable(impact_vectors(counts.filter(F.octet_length("terms") > 0), w, n_docs, max(n_terms, 1)), "lexical-vectors")
    shared = spark.sparkContext.broadcast((questions, w))
    thresholds = np.zeros(len(rows), np.int64)
    lead = vectors.agg(F.percentile_approx("norm", 1 - LEAD, 1000)).first()[0]
    if lead is not None:
        at = {int(i): j for j, i in enumerate(questions.items)}
        first = _best(_scan(vectors.filter(F.col("norm") >= lead), shared, thresholds, k), k)
        for item, score in first.filter(F.col("rank") == k).select("item", "score").collect():
            thresholds[at[item]] = score
    norms = Search(questions, w, thresholds, k).norms
    shortest = min([t / n for t, n in zip(thresholds.tolist(), norms.tolist()) if n > 0], default=0.0)
    return _best(_scan(vectors.filter(F.col("norm") >= shortest * (1 - 1e-9)), shared, thresholds, k), k)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of every row of ``items`` (item_id, text)."""
    asked = durable(items.select("item_id", F.col("text").cast("binary").alias("text")).withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    size, count = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil(size / BLOCK_BYTES), math.ceil(count / BLOCK_ITEMS))
    found = None
    for b in range(blocks):
        rows = [(r.item, None if r.text is None else bytes(r.text)) for r in asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").collect()]
        part = _block(docs.select("doc_id", "text"), rows, k)
        found = part if found is None else found.unionByName(part)
    return found.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The same from all terms, without vectors and bounds.
SQL = r"""
WITH q AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS qf FROM q GROUP BY item, item_id, term),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
held AS (SELECT row, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM held),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM held) GROUP BY row, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(total.docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
scored AS (SELECT asked.item, asked.item_id, tf.row, tf.doc_id, CAST(sum(asked.qf * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * tf.n * total.docs) // total.terms)))) AS BIGINT) AS score
 FROM asked JOIN tf ON tf.term = asked.term JOIN w ON w.term = asked.term CROSS JOIN total GROUP BY asked.item, asked.item_id, tf.row, tf.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
