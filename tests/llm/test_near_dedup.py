import itertools
import random
import re

import numpy as np

from codeatlas.llm import near_dedup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute(rows):
    sets, root = [(i, shingles(t)) for i, t in rows if i is not None], {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            root[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(sets):
        first[find(k)] = min(i, first.get(find(k), i))
    return sorted((i, len(s), first[find(k)], i == first[find(k)]) for k, (i, s) in enumerate(sets))


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = rng.choices(vocabulary, k=150)

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = rng.choice(vocabulary)
        return words

    rows = [" ".join(edited(base, rng.randrange(9))) for _ in range(90)]  # copies of a base, many of them too far from each other
    for _ in range(40):  # pairs and chains around the threshold
        words = rng.choices(vocabulary, k=rng.randrange(30, 200))
        for _ in range(3):
            rows.append(" ".join(words))
            words = edited(words, max(1, len(words) // rng.choice([30, 38, 45])))
    rows += [r.upper() for r in rows[:4]] + rows[:5] + ["a b", "A\tb", "a b c", "", None, "a"]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


def test_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 2500)  # several blocks
    monkeypatch.setattr(nd, "BLOCK_ROWS", 15)
    monkeypatch.setattr(nd, "SMALL", 6)
    monkeypatch.setattr(nd, "TILE", 8)
    rows = corpus()
    got = nd.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_links_that_no_hub_has(spark):
    """Members far from the smallest and the largest of their bucket, near each other; blocks find them."""
    rng = random.Random(2)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(120), 4):
            words[at] = f"u{i}x{at}"
        rows += [(i, " ".join(words)), (1000 - i, " ".join(words[:-1]))]
    assert sorted(map(tuple, nd.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = nd.report(odd_docs).collect()
    assert len(got) == len(rows) and sorted(tuple(r) for r in got if r.doc_id is not None) == brute(rows)
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(1, None, True)]
    assert nd.report(no_docs).count() == 0


def test_many_rows_of_one_id(spark):
    rng = random.Random(4)
    base = rng.choices([f"w{k}" for k in range(900)], k=120)
    rows = [(7 if i % 2 else i, " ".join([*base[:k], f"x{i % 90}", *base[k + 1 :]])) for i in range(300) for k in [i % 90]]
    assert sorted(map(tuple, nd.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_sketch_bounds():
    assert 2 * (1 - 0.85**nd.ROWS) ** nd.SIDE < 4e-6
    least = nd.least_matches()
    rng = np.random.default_rng(1)
    assert nd.HASHES // 2 < least < 0.85 * nd.HASHES and (rng.binomial(nd.HASHES, 0.85, 200_000) >= least).all()
    x, y = np.arange(100, dtype=np.uint64), np.arange(15, 100, dtype=np.uint64)
    assert nd.similar(x, y) and not nd.similar(x, y[1:]) and nd.tile_links([x, y], [y, y[1:]]).tolist() == [[True, False], [True, True]]
