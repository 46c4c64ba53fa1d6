import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codeatlas.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            scored += [(-score, doc is None, doc)] * (score > 0)
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(scored[:k], 1)]
    return Counter(out)


def corpus(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "éa", "B2", "日本"]
    return [(i, " ".join(r.choice(vocabulary[: r.choice([5, 40, 304])]) for _ in range(r.choice([1, 3, 40, 400])))) for i in range(n)]


@pytest.mark.parametrize("bucket, lead", [(7, 0.02), (1024, 0.5)])
def test_search_equals_brute_force(spark, odd_docs, monkeypatch, bucket, lead):
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "LEAD", lead)
    rows = corpus(300, 3) + [(1000 + i, "w1 w2 rare") for i in range(40)] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    asked = [(1, "W1 w2 w2 RARE"), (2, "éa Éa"), (3, None), (4, ""), (5, "nowhere"), (1, "w1 w2 w2 rare"), (None, "x alpha1"), (7, " ".join(f"w{i}" for i in range(0, 300, 7)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lexical.search(docs, spark.createDataFrame(asked, "item_id long, text string"))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert Counter(map(tuple, got.collect())) == brute(rows, asked)


def test_blocks_of_questions_and_empty_tables(spark, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha1 beta2", "a b c", "x"])], "item_id long, text string")
    want = Counter(map(tuple, lexical.search(odd_docs, items).collect()))
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 1)
    assert Counter(map(tuple, lexical.search(odd_docs, items).collect())) == want and want
    assert lexical.search(no_docs, items).count() == 0 and lexical.search(odd_docs, items.limit(0)).count() == 0


def test_buckets_are_skipped():
    """A bucket that cannot reach the threshold is not scored, by its length or by its coordinates."""
    questions = lexical.Questions([(0, b"a b")])
    batch = lambda impacts: pa.RecordBatch.from_arrays([pa.array([1]), pa.array([np.arange(2, dtype="<i4").tobytes()]), pa.array([np.array(impacts, "<i8").tobytes()]), pa.array([float(np.linalg.norm(impacts))])], ["doc_id", "terms", "impacts", "norm"])
    for impacts, threshold, best in (([30, 40], 71, 0), ([50, 0], 51, 0), ([30, 40], 70, 1)):
        search, scored = lexical.Search(questions, np.ones(2, np.int64), np.array([threshold]), 10), []
        bucket = lexical.Bucket(batch(impacts))
        bucket.scores = lambda *x, f=bucket.scores: scored.append(1) or f(*x)
        search.see(bucket)
        assert len(search.best[0][0]) == best == len(scored)
