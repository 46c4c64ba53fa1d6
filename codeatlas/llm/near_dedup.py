"""MinHash near-dedup with tensored banding.

Documents are linked if the sets of their word shingles (three words, A-Z lower-cased, split at ASCII white space; a
shorter text is one shingle) share at least 85 of every 100 shingles that either has. Linked documents form components.

1. Each text becomes its set of 64-bit shingle hashes, that set's 128-bit key and two collections of ``SIDE`` tuples of ``ROWS`` MinHash
   values. Documents with the same set form a class with one representative; copies are never compared.
2. Table (i, j) is keyed by tuple i of the first collection with tuple j of the second: ``SIDE * SIDE`` tables of keys of ``2 * ROWS`` values from
   ``2 * SIDE * ROWS`` values, where plain bands of that width would compute ``SIDE`` times as many. A pair shares no table
   with probability at most 2 (1 - s^ROWS)^SIDE: 3e-6 at similarity 0.85, 2e-8 at 0.9.
   A tuple that only one representative has cannot be part of a shared key, so keys are formed from shared tuples alone.
3. Each member of a bucket is compared with the bucket's hub. Links make components; buckets inside one component are done.
4. What is left is compared with a second hub, and then exhaustively, between components only: buckets of up to ``SMALL`` members as pairs;
   members of larger ones meet by the tuple of the first collection that is part of the key, and those outside of the main component are compared
   with all, in blocks of bounded rows and shingles, two blocks to a task, each pair at the first tuple that it shares. Tasks return a
   spanning forest of the links, never the pairs.
5. Every link is confirmed on the full sets, in integers; the signature only drops pairs that have so few equal values as a
   linked pair has once in ``1 / TOLERANCE``.

Defined results: a null text counts as empty; a text without words has an empty set, is linked with nothing and is kept; rows
without an id have a null component and are kept; rows that repeat an id are rows of their own; ties need no rule, since the smallest id
names a component. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.arrow import map_slices
from codeatlas.llm.ngram_join import _mix, components, set_key
from codeatlas.sources.scratch import durable

SHINGLE, SHARE = 3, 85
SIDE, ROWS, TOLERANCE = 14, 3, 1e-9
HASHES = 2 * SIDE * ROWS
SMALL, BLOCK_ROWS, BLOCK_SHINGLES, TILE = 16, 400, 400_000, 256
MEMO = 200_000


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(raw: bytes | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text in UTF-8."""
    words = raw.lower().split() if raw else []  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    width = min(SHINGLE, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def multipliers() -> np.ndarray:
    return np.random.default_rng(20_240_912).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(shingles), 2048):
        x = shingles[s : s + 2048, None] * odd[None, :]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out = np.minimum(out, (x >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def texts_of(docs: DataFrame) -> DataFrame:
    raw = F.col("text").cast("binary")
    return docs.select("doc_id", raw.alias("raw"), F.xxhash64(raw).alias("text_key"))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key and signature (both null without words)."""

    def make():
        hashes, odd = WordHash(), multipliers()

        def call(texts):
            sets = [shingle_set(t, hashes) for t in texts]
            some = lambda f: [f(s) if len(s) else None for s in sets]
            return [len(s) for s in sets], some(set_key), some(lambda s: minhash(s, odd).tobytes())

        return call

    return map_slices(texts_of(docs), ["doc_id", "text_key"], ["raw"], "n_shingles long, set_key binary, signature binary", make)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and shingles, for ``wanted`` (rep, set_key, source_id, source_key: a document and its text)."""

    def make():
        hashes = WordHash()

        def call(texts, keys):
            sets = [shingle_set(t, hashes) for t in texts]
            return ([s.tobytes() if set_key(s) == k else None for s, k in zip(sets, keys)],)

        return call

    rows = texts_of(docs).join(wanted, (F.col("doc_id") == F.col("source_id")) & (F.col("text_key") == F.col("source_key")))
    return map_slices(rows, ["rep"], ["raw", "set_key"], "shingles binary", make).filter("shingles IS NOT NULL")


def tables(classes: DataFrame) -> DataFrame:
    """(rep, table, key) of the tables' keys that two representatives or more have, with their number and two hubs."""
    tuples = F.array(*[F.xxhash64(F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS), F.lit(k)) for k in range(2 * SIDE)])
    halves = classes.select("rep", F.posexplode(tuples).alias("at", "half"))
    shared = halves.groupBy("at", "half").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    side = lambda test: F.collect_list(F.when(test, F.struct("at", "half")))  # noqa: E731  at most SIDE entries
    both = halves.join(shared, ["at", "half"]).groupBy("rep").agg(side(F.col("at") < SIDE).alias("left"), side(F.col("at") >= SIDE).alias("right"))
    keys = both.select("rep", "right", F.explode("left").alias("x")).select("rep", "x", F.explode("right").alias("y"))
    keys = keys.select("rep", (F.col("x.at") * SIDE + F.col("y.at") - SIDE).cast("int").alias("table"), F.xxhash64("x.half", "y.half").alias("key"))
    buckets = keys.groupBy("table", "key").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("hub"), F.max("rep").alias("hub2")).filter("members > 1")
    return keys.join(buckets, ["table", "key"])


def least_matches() -> int:
    """The most equal values below which a pair at the threshold falls with probability ``TOLERANCE`` at most."""
    p, tail, m = SHARE / 100, 0.0, 0
    while (tail := tail + math.comb(HASHES, m) * p**m * (1 - p) ** (HASHES - m)) <= TOLERANCE:
        m += 1
    return m


def _linked(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    return 100 * both >= SHARE * (a + b - both)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    return bool(_linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))


def _read(raw: bytes, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(raw, kind)


def confirmed(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose full sets are linked."""
    least = least_matches()

    def linked(s, t, x, y):
        return int((_read(x, np.uint32) == _read(y, np.uint32)).sum()) >= least and similar(_read(s), _read(t))

    make = lambda: lambda *columns: ([linked(*row) for row in zip(*columns)],)
    side = lambda x: whole.select(F.col("rep").alias(x), F.col("signature").alias(f"signature_{x}"), F.col("shingles").alias(f"shingles_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    return map_slices(rows, ["a", "b"], ["shingles_a", "shingles_b", "signature_a", "signature_b"], "linked boolean", make).filter("linked").select("a", "b")


def tile_links(mine: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Which of two groups' sets are linked: intersections as products over the shingles that both groups have."""
    vocabulary = np.intersect1d(np.concatenate(mine), np.concatenate(other))
    both = np.zeros((len(mine), len(other)), np.float64)
    for s in range(0, len(vocabulary), 8192):
        part, sides = vocabulary[s : s + 8192], []
        for group in (mine, other):
            m = np.zeros((len(group), len(part)), np.float32)
            for k, x in enumerate(group):
                at = np.searchsorted(part, x)
                m[k, at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == x)]] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    return _linked(both.astype(np.int64), np.array([len(x) for x in mine])[:, None], np.array([len(x) for x in other])[None, :])


def _first_tuple(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first tuple of the first collection that each pair of signatures shares, -1 without any."""
    same = (a[:, : SIDE * ROWS] == b[:, : SIDE * ROWS]).reshape(len(a), SIDE, ROWS).all(axis=2)
    return np.where(same.any(axis=1), same.argmax(axis=1), -1)


def _block_links(pdf, least: int):
    """Forest edges of the links between a block of a bucket and some of its members outside of its main component."""
    import pandas as pd

    sets, place = [_read(x) for x in pdf["shingles"]], int(pdf["at"].iloc[0])
    sig = np.frombuffer(b"".join(pdf["signature"]), np.uint32).reshape(-1, HASHES)
    reps, acts = pdf["rep"].to_numpy(), pdf["acts"].to_numpy()
    _, group = np.unique(pdf["root"].to_numpy(), return_inverse=True)
    root, edges = list(range(int(group.max()) + 1)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = np.flatnonzero(~acts), np.flatnonzero(acts)
    for s in range(0, len(left), TILE):
        for t in range(0, len(right), TILE):
            rows, cols = left[s : s + TILE], right[t : t + TILE]
            now = np.array([find(x) for x in range(len(root))])[group]
            i, j = np.nonzero(now[rows][:, None] != now[cols][None, :])
            ok = np.zeros((len(rows), len(cols)), bool)
            for c in range(0, len(i), 16_384):
                x, y = i[c : c + 16_384], j[c : c + 16_384]
                a, b = sig[rows[x]], sig[cols[y]]
                ok[x, y] = ((a == b).sum(axis=1) >= least) & (_first_tuple(a, b) == place)
            r, c = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
            if not len(r):
                continue
            linked = np.zeros_like(ok)
            linked[np.ix_(r, c)] = tile_links([sets[rows[k]] for k in r], [sets[cols[k]] for k in c])
            for x, y in np.argwhere(linked & ok):
                a, b = find(int(group[rows[x]])), find(int(group[cols[y]]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((int(reps[rows[x]]), int(reps[cols[y]])))
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _between(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component, with their ``root``."""
    roots = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = members.drop("root").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    open_ = named.groupBy("table", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("table", "key")
    return durable(named.join(open_, ["table", "key"]), "near-open")


def links(classes: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """Edges (a, b) between representatives that connect all that is linked. ``repeated``: some rows repeat an id with its text."""
    members = durable(tables(classes), "near-members")
    wanted = classes.select("rep", "set_key", "source_id", "source_key").join(members.select("rep").distinct(), "rep")
    sets = shingle_sets(docs, wanted)
    if repeated:  # such rows give their set once
        sets = sets.dropDuplicates(["rep"])
    whole = durable(sets.join(classes.select("rep", "signature"), "rep"), "near-shingles")

    def star(rows: DataFrame, hub: str) -> DataFrame:
        return confirmed(rows.filter(F.col("rep") != F.col(hub)).select(F.col("rep").alias("a"), F.col(hub).alias("b")).distinct(), whole)

    edges = durable(star(members, "hub"), "near-links")
    rest = _between(members, edges)
    edges = durable(edges.unionByName(star(rest, "hub2")), "near-links")
    rest = _between(rest, edges)

    small = rest.filter(F.col("members") <= SMALL).select("table", "key", "rep", "root")
    pairs = small.alias("x").join(small.alias("y"), ["table", "key"]).filter("x.rep < y.rep AND x.root <> y.root").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    found = edges.unionByName(confirmed(pairs, whole))

    # members of the larger ones meet by their tuple of the first collection, of which the pairs in a table share at least one
    large = rest.filter(F.col("members") > SMALL).select("rep", "root", F.floor(F.col("table") / SIDE).cast("int").alias("at")).distinct()
    large = large.join(classes.select("rep", "n_shingles", "signature"), "rep")
    large = large.withColumn("half", F.xxhash64(F.expr(f"substring(signature, {4 * ROWS} * at + 1, {4 * ROWS})"))).drop("signature")
    blocks = lambda test: F.ceil(F.greatest(F.sum(F.when(test, F.col("n_shingles"))) / BLOCK_SHINGLES, F.count(F.when(test, 1)) / BLOCK_ROWS)).cast("int")
    mains = large.groupBy("at", "half", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("at", "half").agg(F.max(F.struct("n", "root"))["root"].alias("main"))
    large = large.join(mains, ["at", "half"]).withColumn("other", F.col("root") != F.col("main"))
    large = large.join(large.groupBy("at", "half").agg(blocks(F.lit(True)).alias("of_all"), blocks(F.col("other")).alias("of_others")), ["at", "half"])
    # every block of all members meets every block of those outside of the main component
    dealt = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["rep", "root", "at", "half"]
    all_ = large.filter("of_others > 0").select(*columns, F.lit(False).alias("acts"), dealt("of_all").alias("low"), each("of_others").alias("high"))
    others = large.filter("other").select(*columns, F.lit(True).alias("acts"), dealt("of_others").alias("high"), each("of_all").alias("low"))
    units = all_.unionByName(others)
    least = least_matches()
    blocks = units.join(whole, "rep").groupBy("at", "half", "low", "high").applyInPandas(lambda pdf: _block_links(pdf, least), "a long, b long")
    return durable(found.unionByName(blocks), "near-links")


def report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept."""
    made = sketch(docs.select("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    sets = durable(made, "near-sets")
    usable = sets.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    grouped = usable.groupBy("set_key").agg(F.min("row").alias("rep"), F.min("doc_id").alias("set_id"), F.min(F.struct("doc_id", "text_key")).alias("source"))
    repeated = usable.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count() > 0
    sigs = sets.select(F.col("row").alias("rep"), "n_shingles", "signature")
    classes = grouped.join(sigs, "rep").select("rep", "set_key", "set_id", "n_shingles", "signature", F.col("source.doc_id").alias("source_id"), F.col("source.text_key").alias("source_key"))
    classes = durable(classes, "near-classes")
    groups = components(links(classes, docs, repeated).select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = classes.select("set_key", "rep", "set_id").join(groups, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    names = known.groupBy("root").agg(F.min("set_id").alias("component_id"))
    known = known.join(names, "root").select("set_key", "component_id")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    found = sets.select("doc_id", "n_shingles", "set_key").join(known, "set_key", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same from all shared shingles: no sketch and no candidates.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) END AS shingles FROM w),
k AS (SELECT doc_id, len(shingles) AS n, CASE WHEN len(shingles) > 0 THEN md5(array_to_string(list_sort(shingles), chr(10))) END AS key, shingles FROM s),
classes AS (SELECT key, min(doc_id) AS set_id, any_value(shingles) AS shingles, any_value(n) AS n FROM k WHERE key IS NOT NULL AND doc_id IS NOT NULL GROUP BY key),
x AS (SELECT key, n, unnest(shingles) AS shingle FROM classes),
near AS (SELECT a.key AS a, b.key AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.key < b.key GROUP BY a.key, b.key HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
linked AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(key, other) AS (SELECT key, key FROM classes UNION SELECT r.key, l.b FROM reach r JOIN linked l ON l.a = r.other),
named AS (SELECT r.key, min(c.set_id) AS component_id FROM reach r JOIN classes c ON c.key = r.other GROUP BY r.key)
SELECT k.doc_id, k.n AS n_shingles, CASE WHEN k.doc_id IS NOT NULL THEN coalesce(m.component_id, k.doc_id) END AS component_id,
 k.doc_id IS NULL OR k.doc_id = coalesce(m.component_id, k.doc_id) AS kept FROM k LEFT JOIN named m ON m.key = k.key
"""
