"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, other documents the unlabelled texts; negatives are
never named. A linear model on hashed word features minimises the class-prior-corrected risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the bracket turns negative the step goes
the other way (the non-negative form). The prior is the toxic share of all labelled training rows.

Features of a text are its distinct words and their openings of 4 to 7 characters, hashed to
2^22 slots. Training sees at most ``max_positive`` and ``max_unlabelled`` rows, those with the
smallest hashed id, and of these, in that order, as many as fit ``max_bytes`` of slots, so the driver holds a bounded matrix at any corpus
size and any length of texts; slots seen in ``MIN_DOCS`` positives or more, and oftener than in unlabelled texts, get a weight. Scoring is one pass
without a shuffle over whole texts; the broadcast weights are at most 2^22 pairs of numbers.

Defined results: a null text counts as empty and gets the score of the bias alone; labels that
are null count as not labelled; a document labelled more than once is toxic if any label says
so; without positives every score is 0. Ids only choose the fold.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.llm.arrow import free_name, map_slices
from codeatlas.sources.scratch import durable

SLOTS, MIN_DOCS = 1 << 22, 4
WORD = re.compile(r"\w+")
MEMO = 400_000


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_slots(word: str) -> list[int]:
    """The word and its openings of 4 to 7 characters, each in its own hash space."""
    raw = word.casefold()
    return [zlib.crc32(b"w" + raw.encode()) % SLOTS] + [
        zlib.crc32(b"%d" % n + raw[:n].encode()) % SLOTS for n in range(4, 8) if len(raw) > n
    ]


class Slots(dict):
    """Slots of words, remembered up to a bound."""

    def __missing__(self, word):
        if len(self) > MEMO:
            self.clear()
        found = self[word] = word_slots(word)
        return found


def text_slots(text: str | None, memo: dict) -> np.ndarray:
    return np.unique(np.array([s for w in set(WORD.findall(text or "")) for s in memo[w]], "<u4"))


def sample(docs: DataFrame, labels: DataFrame, max_positive: int, max_unlabelled: int, max_bytes: int) -> tuple[list, float]:
    """Rows (toxic, slots) of the bounded training sample, and the class prior."""
    said = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = said.agg(F.avg("toxic")).first()[0] or 0.0
    order = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id")
    positive = order(said.filter("toxic = 1").select("doc_id")).limit(max_positive).withColumn("toxic", F.lit(1))
    ids = docs.filter(~held_out(F.col("doc_id"))).select("doc_id")
    unlabelled = order(ids).limit(max_unlabelled).withColumn("toxic", F.lit(0))
    chosen = F.broadcast(positive.unionByName(unlabelled))  # at most max_positive + max_unlabelled ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", F.xxhash64("doc_id").alias("place"), "text")

    def make():
        memo = Slots()
        return lambda texts: ([text_slots(t, memo).tobytes() for t in texts],)

    made = durable(map_slices(rows, ["toxic", "place"], ["text"], "slots binary", make), "toxicity-sample")
    sums = made.select("place", F.sum(F.length("slots").cast("long")).over(Window.orderBy("place")).alias("bytes"))  # as many rows as the sample has
    last = sums.filter(F.col("bytes") <= max_bytes).agg(F.max("place")).first()[0]
    within = F.lit(False) if last is None else F.col("place") <= last
    return made.filter(within).select("toxic", "slots").collect(), prior


def fit(rows: list, prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots, their weights, and the bias, by full-batch Adam on the non-negative risk."""
    bags = [(r[0], np.frombuffer(r[1], "<u4")) for r in rows]
    positive = [b for y, b in bags if y == 1]
    if not positive or not 0 < prior < 1 or len(positive) == len(bags):
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), -20.0
    unlabelled = [b for y, b in bags if y == 0]

    def seen(bag):
        counts = np.zeros(SLOTS, np.int32)
        for b in bag:
            counts[b] += 1  # slots of a text are distinct
        return counts

    in_p, in_u = seen(positive), seen(unlabelled)
    slots = np.flatnonzero((in_p >= MIN_DOCS) & (in_p * (len(unlabelled) + 1) > 1.5 * len(positive) * (in_u + 1)))
    place = np.full(SLOTS, -1, np.int32)
    place[slots] = np.arange(len(slots))

    def matrix(bag):
        kept = [place[b][place[b] >= 0] for b in bag]
        return np.concatenate(kept), np.repeat(np.arange(len(bag), dtype=np.int32), [len(k) for k in kept]), len(bag)

    sides = {1: matrix(positive), 0: matrix(unlabelled)}
    w, bias = np.zeros(len(slots)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(slots) + 1), np.zeros(len(slots) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    softplus = lambda z: np.logaddexp(0, z)

    def side(key):
        cols, at, n = sides[key]
        return np.bincount(at, weights=w[cols], minlength=n) + bias

    def gradient(key, each):
        cols, at, n = sides[key]
        return np.append(np.bincount(cols, weights=each[at], minlength=len(w)), each.sum()) / n

    for t in range(1, rounds + 1):
        zp, zu = side(1), side(0)
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        g_negative = gradient(0, sigmoid(zu)) - prior * gradient(1, sigmoid(zp))
        g = -g_negative if negative < 0 else g_negative + prior * gradient(1, sigmoid(zp) - 1)
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    used = np.abs(w) > 1e-3
    return slots[used].astype(np.uint32), w[used].astype(np.float32), float(bias)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns and ``name``, a double in 0..1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        slots, given, bias = shared.value
        weights = np.zeros(SLOTS, np.float32)
        weights[slots] = given
        memo: dict[str, float] = {}

        def weight(word):
            if len(memo) > MEMO:
                memo.clear()
            x = memo[word] = sum(float(weights[s]) for s in word_slots(word))
            return x

        def one(text):
            z = bias + sum(memo[w] if w in memo else weight(w) for w in sorted(set(WORD.findall(text or ""))))
            return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))

        return lambda texts: ([one(t) for t in texts],)

    return map_slices(docs, keep, ["text"], f"{name} double", make)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 6000, max_bytes: int = 64_000_000) -> tuple[np.ndarray, np.ndarray, float]:
    return fit(*sample(docs, labels, max_positive, max_unlabelled, max_bytes))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score stays under ``threshold``, with their own columns."""
    own, name = docs.columns, free_name(docs, "toxicity")
    return score(docs, train(docs, labels), own, name).filter(F.col(name) < threshold).select(*own)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    found = score(docs.select("doc_id", "text"), train(docs, labels), ["doc_id"])
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
