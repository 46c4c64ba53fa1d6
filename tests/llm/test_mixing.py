import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeatlas.llm import mixing


def fill(children, budget):
    """{name: (capacity, weight)} -> shares: fill up whoever is short, again and again."""
    share, open_ = {}, {k for k, (_, w) in children.items() if w > 0}
    left = budget
    while open_:
        total = sum(children[k][1] for k in open_)
        short = {k for k in open_ if children[k][0] <= left * children[k][1] / total + 1e-9}
        if not short:
            return share | {k: left * children[k][1] / total for k in open_}
        for k in short:
            share[k] = children[k][0]
            left -= children[k][0]
        open_ -= short
    return share


def plain(rows, weights, budget, max_epochs, seed):
    leaves = defaultdict(list)
    for i, d, l, s, n in rows:
        leaves[d, l, s].append((i, n))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weigh = lambda level, name: weights.get(level, {}).get(name, 1.0)
    cap = lambda *path: max_epochs * sum(n for k, n in size.items() if k[: len(path)] == path)
    top = fill({d: (cap(d), weigh("domain", d)) for d in {k[0] for k in size}}, min(budget, cap()))
    out = {}
    for d in top:
        second = fill({k[1]: (cap(d, k[1]), weigh("language", k[1])) for k in size if k[0] == d}, top[d])
        for l in second:
            third = fill({k[2]: (cap(d, l, k[2]), weigh("leaf_source", k[2])) for k in size if k[:2] == (d, l)}, second[l])
            for s, b in third.items():
                b, t = int(b + 1e-6), size[d, l, s]
                epochs = b // t if t else 0
                rest, sum_ = b - epochs * t, 0
                order = sorted(leaves[d, l, s], key=lambda x: hashlib.md5(f"{seed}:{epochs}:{x[0]}".encode()).hexdigest())
                for i, n in order:
                    sum_ += n
                    out[i] = epochs + int(sum_ <= rest and epochs < max_epochs)
    return out


@pytest.mark.parametrize(("share", "epochs"), [(0.3, 1), (0.5, 2), (1.7, 3), (9.0, 2)])
def test_select_matches_plain_budgets(spark, monkeypatch, share, epochs):
    monkeypatch.setattr(mixing, "SLICE", 3)
    rows = [(i, f"d{i % 2}", ["en", "de", "fr"][i % 5 % 3], f"s{i % 7 % 4}", (i * 37) % 50 + (400 if i % 41 == 0 else 1)) for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), d, l, s) for i, d, l, s, n in rows], "doc_id long, text string, dom string, lang string, source string")
    total = sum(r[4] for r in rows)
    weights = {"domain": {"d0": 3.0}, "language": {"en": 2.0, "fr": 0.5}, "leaf_source": {"s1": 4.0}}
    got = mixing.select(docs, F.col("dom"), weights, lambda t: F.floor(t * share).cast("double"), max_epochs=epochs, seed=5)
    assert {r.doc_id: r.copies for r in got.collect()} == plain(rows, weights, int(total * share), epochs, 5)


def test_odd_rows(odd_docs, no_docs):
    got = mixing.report(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r.n_tokens for r in got if r.doc_id in (1, 2, 7, 9)} == {0}
    assert mixing.report(no_docs).count() == 0
    assert mixing.keep_selected(odd_docs).columns == odd_docs.columns
