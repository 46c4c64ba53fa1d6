"""N-gram Jaccard join with Bayesian candidate pruning.

Two documents are linked if the sets of their word shingles (five words, split at ASCII white
space; a shorter text is one shingle) have a Jaccard similarity of 0.8 or more.

1. Each text becomes its set of 64-bit shingle hashes, that set's 128-bit key and 128 MinHash values. Documents with the same
   set form a class with one representative row; copies are never compared.
2. Representatives that agree in 4 MinHash values of one of 32 bands are candidates. A pair of similarity 0.8
   shares no band with probability (1 - 0.8^4)^32 = 5e-8.
3. MinHash values of a candidate pair are compared 16 at a time. With m of n equal the similarity has the
   posterior Beta(1 + m, 1 + n - m); a pair goes when its chance of reaching the threshold is under
   ``TOLERANCE``.
4. What is left is verified on the whole shingle sets. Only documents with a candidate are read again for that, their sets are stored once, and no
   text is shuffled after.
5. Links are counted for each document, and connected classes get one id. Classes are known by their set throughout, ids of
   documents come in at the end.

Skew: a bucket of up to ``SMALL`` representatives is joined to itself; a larger one is cut into
blocks of bounded rows and shingles, a task sees two blocks at a time, and returns link counts and
the edges of a spanning forest, never the pairs. A pair belongs to the first band that it agrees in,
so nothing is counted twice and no pair list is made distinct. Exact link counts inside a group of g different
texts take g * g / 2 comparisons, spread over the blocks' tasks.

Defined results: a null text counts as empty; a text without words has no shingles, is linked to nothing
and is a class of its own (``class_id`` is its id); rows without an id are returned with a null class
and no links; rows that repeat an id are rows of their own: with the same text they are copies, with different texts they may be
in different classes; ties need no rule, since the smallest id names a class.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.arrow import map_slices
from codeatlas.sources.scratch import durable

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, ROWS, STEP = 32, 4, 16
HASHES = BANDS * ROWS
SMALL, BLOCK_ROWS, BLOCK_SHINGLES, TILE = 16, 400, 400_000, 256
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
MEMO = 200_000


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word):
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = WORDS.findall(text or "")
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    n = max(1, len(words) - SHINGLE + 1)
    out = np.full(n, len(words) if len(words) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def minhash_parameters() -> np.ndarray:
    return np.random.default_rng(20_240_601).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """For each odd multiplier the smallest upper half of multiplier * shingle, mixed."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(shingles), 4096):
        x = shingles[s : s + 4096, None] * odd[None, :]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out = np.minimum(out, (x >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key and signature (both null without words)."""

    def make():
        hashes, odd = WordHash(), minhash_parameters()

        def call(texts):
            sets = [shingle_set(t, hashes) for t in texts]
            some = lambda f: [f(s) if len(s) else None for s in sets]
            return [len(s) for s in sets], some(set_key), some(lambda s: minhash(s, odd).tobytes())

        return call

    return map_slices(keyed(docs), ["doc_id", "text_key"], ["text"], "n_shingles long, set_key binary, signature binary", make)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key: rows that repeat an id are told apart by their texts."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the representatives in ``wanted`` (rep, set_key, source_id, source_key)."""

    def make():
        hashes = WordHash()

        def call(texts, keys):
            sets = [shingle_set(t, hashes) for t in texts]
            return ([s.tobytes() if set_key(s) == k else None for s, k in zip(sets, keys)],)

        return call

    rows = keyed(docs).join(wanted, (F.col("doc_id") == F.col("source_id")) & (F.col("text_key") == F.col("source_key")))
    return map_slices(rows, ["rep"], ["text", "set_key"], "shingles binary", make).filter("shingles IS NOT NULL")


def least_matches() -> list[int]:
    """For n = STEP, 2 STEP, ...: the fewest equal values with which a pair goes on."""

    def chance(m, n):  # P(J >= THRESHOLD) under Beta(1 + m, 1 + n - m): a binomial tail
        return sum(math.comb(n + 1, j) * THRESHOLD**j * (1 - THRESHOLD) ** (n + 1 - j) for j in range(m + 1))

    return [next(m for m in range(n + 1) if chance(m, n) >= TOLERANCE) for n in range(STEP, HASHES + 1, STEP)]


def surviving(a: np.ndarray, b: np.ndarray, band: np.ndarray | int, least: list[int]) -> np.ndarray:
    """Which rows of the signatures ``a`` and ``b`` first agree in ``band`` and pass every step."""
    same = a == b
    bands = same.reshape(len(same), BANDS, ROWS).all(axis=2)
    alive = bands.any(axis=1) & (bands.argmax(axis=1) == band)
    matches = np.zeros(len(same), np.int32)
    for k, need in enumerate(least):
        at = np.flatnonzero(alive)
        if not len(at):
            break
        matches[at] += same[at, k * STEP : (k + 1) * STEP].sum(axis=1, dtype=np.int32)
        alive[at[matches[at] < need]] = False
    return alive


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < THRESHOLD * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= THRESHOLD * (len(a) + len(b) - both) - 1e-9


def _hashes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _signatures(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint32).reshape(len(raw), HASHES)


def _small(pairs: DataFrame) -> DataFrame:
    """(a, b, band, signatures) -> pairs that survive."""

    def run(batches):
        least = least_matches()
        for batch in batches:
            for s in range(0, batch.num_rows, 4096):
                part = batch.slice(s, 4096)
                a, b = _signatures(part.column(3).to_pylist()), _signatures(part.column(4).to_pylist())
                kept = pa.array(surviving(a, b, part.column(2).to_numpy(), least))
                yield part.select(["a", "b"]).filter(kept)

    return pairs.select("a", "b", "band", "sig_a", "sig_b").mapInArrow(run, pairs.select("a", "b").schema)


def _verified(pairs: DataFrame) -> DataFrame:
    """(a, b, copies and shingles) -> a row for each end of each pair that is similar."""
    make = lambda: lambda left, right: ([similar(_hashes(x), _hashes(y)) for x, y in zip(left, right)],)
    linked = map_slices(pairs, ["a", "b", "copies_a", "copies_b"], ["shingles_a", "shingles_b"], "linked boolean", make).filter("linked")
    ends = F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("peer"), F.col("copies_b").alias("doc_links")), F.struct(F.col("b").alias("rep"), F.col("a").alias("peer"), F.col("copies_a").alias("doc_links")))
    return linked.select(F.inline(ends)).select("rep", "peer", F.lit(1).cast("long").alias("text_links"), "doc_links")


def _tile_links(rows: np.ndarray, cols: np.ndarray, ok: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Of the pairs marked in ``ok`` (rows x cols), those whose sets are similar."""
    out = np.zeros_like(ok)
    at = np.argwhere(ok)
    if len(at) <= 512:
        for i, j in at:
            out[i, j] = similar(sets[rows[i]], sets[cols[j]])
        return out
    used_r, used_c = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    mine, other = [sets[rows[i]] for i in used_r], [sets[cols[j]] for j in used_c]
    vocabulary = np.intersect1d(np.concatenate(mine), np.concatenate(other))
    both = np.zeros((len(mine), len(other)), np.float32)
    for s in range(0, len(vocabulary), 8192):  # shingles on both sides, a few at a time: intersections by product
        part = vocabulary[s : s + 8192]
        sides = []
        for group in (mine, other):
            m = np.zeros((len(group), len(part)), np.float32)
            for k, x in enumerate(group):
                m[k, np.searchsorted(part, x[(x >= part[0]) & (x <= part[-1])])[np.isin(x[(x >= part[0]) & (x <= part[-1])], part, assume_unique=True)]] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    n_r, n_c = np.array([len(x) for x in mine])[:, None], np.array([len(x) for x in other])[None, :]
    out[np.ix_(used_r, used_c)] = both >= THRESHOLD * (n_r + n_c - both) - 1e-4
    return out & ok


def _block_links(pdf, least):
    """Link counts and forest edges of the pairs of two blocks (or of one) of a large bucket."""
    import pandas as pd

    sets = [_hashes(x) for x in pdf["shingles"]]
    sig, band = _signatures(list(pdf["signature"])), int(pdf["band"].iloc[0])
    reps, copies, block = pdf["rep"].to_list(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
    low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    text_links, doc_links, root = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    for s in range(0, len(left), TILE):
        for t in range(s if low == high else 0, len(right), TILE):
            rows, cols = left[s : s + TILE], right[t : t + TILE]
            i, j = np.meshgrid(np.arange(len(rows)), np.arange(len(cols)), indexing="ij")
            pair = np.ones(i.shape, bool) if low != high else rows[i] < cols[j]
            i, j = i[pair], j[pair]
            ok = np.zeros((len(rows), len(cols)), bool)
            for c in range(0, len(i), 16_384):
                x, y = i[c : c + 16_384], j[c : c + 16_384]
                ok[x, y] = surviving(sig[rows[x]], sig[cols[y]], band, least)
            linked = _tile_links(rows, cols, ok, sets)
            text_links[rows] += linked.sum(axis=1)
            text_links[cols] += linked.sum(axis=0)
            doc_links[rows] += linked @ copies[cols]
            doc_links[cols] += linked.T @ copies[rows]
            for x, y in np.argwhere(linked):
                a, b = find(int(rows[x])), find(int(cols[y]))
                if a != b:
                    root[max(a, b)] = min(a, b)
    at = np.flatnonzero(text_links)
    return pd.DataFrame({"rep": [reps[k] for k in at], "peer": [reps[find(int(k))] for k in at], "text_links": text_links[at], "doc_links": doc_links[at]})


def links(classes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """Rows (rep, peer, text_links, doc_links): partial link counts of a representative, and an edge to ``peer``.

    ``repeated``: some rows repeat an id with its text.
    """
    keys = F.array(*[F.xxhash64(F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS), F.lit(k)) for k in range(BANDS)])
    bands = classes.select("rep", "n_shingles", F.posexplode(keys).alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles")).filter("members > 1")
    members = durable(bands.join(buckets, ["band", "key"]), "ngram-members")
    small = members.filter(F.col("members") <= SMALL).select("band", "key", "rep")
    pairs = small.alias("x").join(small.alias("y"), ["band", "key"]).filter("x.rep < y.rep")
    pairs = pairs.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(F.min("band").alias("band"))
    sigs = classes.select("rep", "signature")
    pairs = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
    pairs = durable(_small(pairs), "ngram-pairs")

    large = members.filter(F.col("members") > SMALL)
    blocks = F.ceil(F.greatest(F.col("shingles") / BLOCK_SHINGLES, F.col("members") / BLOCK_ROWS)).cast("int")
    large = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    units = large.select("rep", "band", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    units = units.select("rep", "band", "key", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))

    wanted = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(large.select("rep")).distinct()
    wanted = classes.select("rep", "set_key", "source_id", "source_key").join(wanted, "rep")
    sets = shingle_sets(docs, wanted)
    if repeated:  # such rows give their set once
        sets = sets.dropDuplicates(["rep"])
    whole = durable(sets.join(classes.select("rep", "copies", "signature"), "rep"), "ngram-shingles")
    side = lambda x: whole.select(F.col("rep").alias(x), F.col("copies").alias(f"copies_{x}"), F.col("shingles").alias(f"shingles_{x}"))
    found = _verified(pairs.join(side("a"), "a").join(side("b"), "b"))

    least = least_matches()
    blocks = units.join(whole, "rep").groupBy("band", "key", "low", "high").applyInPandas(lambda pdf: _block_links(pdf, least), "rep long, peer long, text_links long, doc_links long")
    return durable(found.unionByName(blocks), "ngram-links")


def settled(edges: DataFrame) -> bool:
    """Whether edges (u, v) with u > v, all different, are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("outs"), F.count(F.lit(1)).alias("ends"))
    return nodes.filter("outs > 0 AND ends > 1").agg(F.count(F.lit(1))).first()[0] == 0


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(rep, root): the smallest node that each end of the edges (u, v) is connected to.

    Rounds of large-star and small-star steps; each node's neighbours are only ever reduced to their
    smallest, never collected. Edges that are stars need no round more.
    """
    current = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs if small else pairs.select(F.inline(F.array(pair("u", "v"), pair("v", "u"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        to = F.array(pair("v", "m"), pair("u", "m"))  # a node's own pair comes with each neighbour, and once after the distinct
        return both.join(least, "u").select(F.inline(to if small else F.filter(to, lambda x: x["u"] >= F.col("u")))).filter("u <> v").distinct()

    for _ in range(max_rounds):
        if settled(current):
            return current.select(F.col("u").alias("rep"), F.col("v").alias("root"))
        current = durable(star(star(current, small=False), small=True), "cc")
    raise RuntimeError("components did not settle")


def join(docs: DataFrame) -> DataFrame:
    """One row for each document: class_id, set_id, n_shingles, n_links and n_text_links.

    ``set_id`` is the smallest id with the same shingle set, ``n_links`` counts all other linked documents
    (copies too), ``n_text_links`` the linked classes with other shingle sets.
    """
    sets = durable(sketch(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id()), "ngram-sets")
    usable = sets.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    grouped = usable.groupBy("set_key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("copies"))
    classes = durable(grouped.join(sets.select(F.col("row").alias("rep"), F.col("doc_id").alias("source_id"), F.col("text_key").alias("source_key"), "n_shingles", "signature"), "rep"), "ngram-classes")
    repeated = usable.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count() > 0
    found = links(classes, docs, repeated)
    counts = found.groupBy("rep").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("peer").alias("v")))
    known = classes.select("set_key", "rep", "set_id", "copies").join(counts, "rep", "left").join(groups, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    names = known.groupBy("root").agg(F.min("set_id").alias("class_id"))
    known = known.join(names, "root")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    owned = F.col("doc_id").isNotNull()
    return sets.select("doc_id", "n_shingles", "set_key").join(known, "set_key", "left").select(
        "doc_id",
        F.when(owned, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(owned, F.coalesce("set_id", "doc_id")).alias("set_id"),
        "n_shingles",
        F.when(owned, zero("doc_links") + F.greatest(zero("copies") - 1, F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(owned, zero("text_links")).otherwise(0).cast("long").alias("n_text_links"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each class the document with the smallest id, with the columns of ``docs``; rows without an id stay.

    An id goes when none of its rows names its class (rows that repeat an id with different texts stand or fall together).
    """
    found = join(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("class_id")).alias("gone"))
    gone = found.filter("gone").select(F.col("doc_id").alias("_id"))
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


#: The same on small tables, from all shared shingles: no sketch and no candidates.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS shingles FROM w),
k AS (SELECT doc_id, len(shingles) AS n, CASE WHEN len(shingles) > 0 THEN md5(array_to_string(list_sort(shingles), chr(10))) END AS key, shingles FROM s),
classes AS (SELECT key, min(doc_id) AS set_id, count(*) AS copies, any_value(shingles) AS shingles, any_value(n) AS n FROM k WHERE key IS NOT NULL AND doc_id IS NOT NULL GROUP BY key),
x AS (SELECT key, n, unnest(shingles) AS shingle FROM classes),
near AS (SELECT a.key AS a, b.key AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.key < b.key GROUP BY a.key, b.key HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
linked AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
counts AS (SELECT l.a AS key, count(*) AS text_links, CAST(sum(c.copies) AS BIGINT) AS doc_links FROM linked l JOIN classes c ON c.key = l.b GROUP BY l.a),
reach(key, other) AS (SELECT key, key FROM classes UNION SELECT r.key, l.b FROM reach r JOIN linked l ON l.a = r.other),
named AS (SELECT r.key, min(c.set_id) AS class_id FROM reach r JOIN classes c ON c.key = r.other GROUP BY r.key)
SELECT k.doc_id, CASE WHEN k.doc_id IS NOT NULL THEN coalesce(m.class_id, k.doc_id) END AS class_id, CASE WHEN k.doc_id IS NOT NULL THEN coalesce(c.set_id, k.doc_id) END AS set_id, k.n AS n_shingles,
 CASE WHEN k.doc_id IS NOT NULL THEN coalesce(n.doc_links, 0) + greatest(coalesce(c.copies, 0) - 1, 0) ELSE 0 END AS n_links, CASE WHEN k.doc_id IS NOT NULL THEN coalesce(n.text_links, 0) ELSE 0 END AS n_text_links
FROM k LEFT JOIN classes c ON c.key = k.key LEFT JOIN counts n ON n.key = k.key LEFT JOIN named m ON m.key = k.key
"""
