import random
import zlib

from codeatlas.llm import toxicity


def test_held_out_documents_are_told_apart(spark):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(800)]
    docs, labels = [], []
    for k in range(1500):
        bad = k % 8 == 0
        text = rng.choices(words, k=60) + (rng.sample(["scumbag", "idiotic", "trashy", "vile"], 3) if bad else [])
        docs.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.report(d, y).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    wrong = [r for r in held if r.predicted != int(r.doc_id % 8 == 0)]
    assert len(wrong) <= 0.02 * len(held)
    assert {r.doc_id % 8 for r in toxicity.reject(d, y).filter("doc_id % 8 = 0").limit(3).collect()} <= {0}


def test_odd_rows_and_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.report(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score < 0.7 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(3, None), (5, 1), (5, 0), (6, 0)], "doc_id long, toxic int")
    assert toxicity.report(odd_docs, some).count() == odd_docs.count()
    assert toxicity.report(no_docs, some).count() == 0
    assert toxicity.reject(odd_docs, none).columns == odd_docs.columns


def test_fit_and_score_equal_plain_loops(spark):
    """Risk, gradient, steps and scores by loops over words, one number at a time."""
    import math

    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    texts = [(int(k % 4 == 0), " ".join(rng.choices(words[: 20 if k % 4 else 40], k=12) + ["bad", "worse"] * (k % 4 == 0))) for k in range(60)]
    bags = [(y, sorted(set(toxicity.text_slots(t, toxicity.Slots()).tolist()))) for y, t in texts]
    prior, rounds, rate, decay = 0.3, 40, 0.05, 2e-4
    sides = {1: [b for y, b in bags if y], 0: [b for y, b in bags if not y]}
    held = {y: {} for y in sides}
    for y, side in sides.items():
        for b in side:
            for s in b:
                held[y][s] = held[y].get(s, 0) + 1
    slots = sorted(s for s, n in held[1].items() if n >= toxicity.MIN_DOCS and n * (len(sides[0]) + 1) > 1.5 * len(sides[1]) * (held[0].get(s, 0) + 1))
    w, m, v = ({s: 0.0 for s in [*slots, "bias"]} for _ in range(3))
    w["bias"] = math.log(prior / (1 - prior))
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    raw = lambda b: w["bias"] + sum(w[s] for s in b if s in w)
    mean = lambda y, f: sum(f(raw(b)) for b in sides[y]) / len(sides[y])
    softplus = lambda z: math.log1p(math.exp(-abs(z))) + max(z, 0)
    for t in range(1, rounds + 1):
        negative = mean(0, softplus) - prior * mean(1, softplus)
        g = {}
        for s in w:
            part = lambda y, f: sum(f(raw(b)) for b in sides[y] if s == "bias" or s in b) / len(sides[y])  # noqa: E731, B023
            back = part(0, sigmoid) - prior * part(1, sigmoid)
            g[s] = (-back if negative < 0 else back + prior * part(1, lambda z: sigmoid(z) - 1)) + (0 if s == "bias" else decay * w[s])
        for s in w:
            m[s], v[s] = 0.9 * m[s] + 0.1 * g[s], 0.999 * v[s] + 0.001 * g[s] ** 2
            w[s] -= rate * (m[s] / (1 - 0.9**t)) / (math.sqrt(v[s] / (1 - 0.999**t)) + 1e-8)
    rows = [(y, toxicity.text_slots(t, toxicity.Slots()).tobytes()) for y, t in texts]
    model = toxicity.fit(rows, prior, rounds, rate, decay)
    assert len(slots) > 5 and abs(model[2] - w["bias"]) < 5e-3  # a vanishing gradient is all rounding, and steps are normalised
    got = dict(zip(model[0].tolist(), model[1].tolist()))
    assert all(abs(got.get(s, 0.0) - w[s]) < 2e-3 for s in slots)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)] + [(98, ""), (99, None)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    plain = lambda t: sigmoid(model[2] + sum(got.get(s, 0.0) for word in set(t.split()) for s in toxicity.word_slots(word)))
    assert all(abs(found[k] - plain(t)) < 1e-6 for k, (_, t) in enumerate(texts)) and abs(found[98] - sigmoid(model[2])) < 1e-9 and found[98] == found[99]
