import itertools
import random
import time

from codeatlas.llm import ngram_join as nj
from tests.conftest import SMALL


def brute(rows):
    def shingles(t):
        w = nj.WORDS.findall(t or "")
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    near = lambda a, b: a and b and len(a & b) >= nj.THRESHOLD * len(a | b) - 1e-12
    links, texts, root = {k: 0 for k in range(len(sets))}, {k: set() for k in range(len(sets))}, list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if near(sets[a][1], sets[b][1]):
            links[a] += 1
            links[b] += 1
            if sets[a][1] != sets[b][1]:
                texts[a].add(sets[b][1])
                texts[b].add(sets[a][1])
            root[find(a)] = find(b)
    classes = {}
    for k, (i, _) in enumerate(sets):
        classes[find(k)] = min(i, classes.get(find(k), i))
    return sorted((i, classes[find(k)], links[k], len(texts[k])) for k, (i, _) in enumerate(sets))


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = rng.choices(vocabulary, k=160)
    rows = []
    for k in range(60):  # one group of near copies that is a bucket of its own
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    for _ in range(40):  # pairs around the threshold
        words = rng.choices(vocabulary, k=rng.randrange(30, 200))
        rows.append(" ".join(words))
        for cut in (1, 6):
            rows.append(" ".join(words[: len(words) - len(words) * cut // 40] + rng.choices(vocabulary, k=2)))
    passage = " ".join(base[:50])
    rows += [passage + " " + " ".join(rng.choices(vocabulary, k=60)) for _ in range(30)] + rows[:5] + ["a b c", "a b c", "", None, "x y z w"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i + 1, rows[k]) for i, k in enumerate(order)]


def test_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SHINGLES", 3000)  # several blocks
    monkeypatch.setattr(nj, "BLOCK_ROWS", 25)
    rows = corpus()
    got = nj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in got.collect()) == brute(rows)


def test_given_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in nj.join(docs).collect()) == brute(rows)


def test_rows_that_repeat_an_id_stand_for_themselves(spark):
    w, v = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, w, "a"), (1, v, "b"), (2, w, "c"), (3, v, "d"), (4, v + " x", "e"), (4, "other words here", "f"), (None, w, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_key string")
    got = sorted((r.doc_id, r.class_id, r.set_id, r.n_links) for r in nj.join(docs).collect() if r.doc_id)
    assert got == [(1, 1, 1, 1), (1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1), (4, 4, 4, 0), (4, 4, 4, 0)]
    later = spark.createDataFrame([(1, w), (2, w), (2, v), (3, v), (5, w)], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in nj.join(later).collect()) == [(1, 1), (2, 1), (2, 2), (3, 2), (5, 1)]
    assert sorted(tuple(r) for r in nj.keep_first(later).collect()) == [(1, w), (2, w), (2, v)]
    kept = nj.keep_first(docs).collect()
    assert sorted(r.set_key for r in kept) == ["a", "b", "e", "f", "g"]


def test_many_rows_of_one_id_cost_what_many_ids_cost(spark):
    """Near copies under one id, some of them twice: links as by brute force, and no product of the rows of the id."""
    rng = random.Random(6)
    base = rng.choices([f"w{k}" for k in range(900)], k=120)
    rows = [(7 if i % 2 else i, " ".join([*base[:k], f"x{i % 90}", *base[k + 1 :]])) for i in range(200) for k in [i % 90]]
    got = nj.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in got.collect()) == brute(rows)

    def took(one_id):
        texts = [(5 if one_id else i, " ".join(rng.choices(base, k=40) + base[:80] + [f"y{i}"])) for i in range(2000)]
        begun = time.time()
        nj.join(spark.createDataFrame(texts, "doc_id long, text string")).write.format("noop").mode("overwrite").save()
        return time.time() - begun

    apart = took(False)
    assert took(True) < 2 * apart + 10


def test_odd_rows(odd_docs, no_docs):
    got = nj.join(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert (by[4].class_id, by[4].set_id, by[4].n_links) == (3, 3, 1) and by[5].n_links == 1
    assert (by[1].class_id, by[1].n_links) == (1, 0) and by[2].class_id == 2 and by[None].class_id is None
    assert nj.join(no_docs).count() == 0
    kept = nj.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "5", "5", "6", "7", "8", "9", "None"])


def test_pruning_keeps_pairs_at_the_threshold():
    least = nj.least_matches()
    assert len(least) == nj.HASHES // nj.STEP and all(m <= 0.8 * n for m, n in zip(least, range(nj.STEP, nj.HASHES + 1, nj.STEP))) and least[-1] > 64


def test_components_end_when_edges_are_stars(spark, monkeypatch):
    """Rounds are tables of as many files and tasks as there are partitions, all of which the driver keeps account of."""
    written = []
    monkeypatch.setattr(nj, "durable", lambda df, name, keep=nj.durable: written.append(name) or keep(df, name))

    def found(edges):
        written.clear()
        return dict(map(tuple, nj.components(spark.createDataFrame(edges, "u long, v long")).collect())), len(written)

    stars = [(k, k % 3) for k in range(3, 40)] + [(2, 2), (5, 2), (2, 8)]
    assert found(stars) == ({k: k % 3 for k in range(3, 40)}, 1)
    assert found([(1, 1)]) == ({}, 1)
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(30)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    root = {k: k for e in edges for k in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    roots, tables = found(edges)
    assert roots == {k: r for k, r in root.items() if k != r}
    assert tables < 8
