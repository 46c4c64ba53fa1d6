import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from codeatlas.llm import secrets

HEX, ALNUM, ANY = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP0123456789!@$%#&*?"
PROSE = "the of and to in is that for it with as was on are by this be from at which or have an they you were their one all we can her has there been if more when will would who so no said what up its about into than them only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def made(seed, n):
    """(rows, truth): documents with planted secrets of four kinds in three places, and values that look like them."""
    rng = random.Random(seed)
    draw = lambda a, k: "".join(rng.choices(a, k=k))
    rows, truth = [], {}
    for i in range(n):
        before, after = " ".join(rng.choices(PROSE, k=30)), " ".join(rng.choices(PROSE, k=30))
        secret = rng.random() < 0.5
        if secret:
            value = [draw(HEX, 40), draw(ALNUM, rng.randrange(20, 40)), draw(ANY, rng.randrange(10, 16)), draw(ALNUM[:52], 24)][i % 4]
            place = rng.randrange(3) if i % 4 != 2 else rng.randrange(2)
            text = ['token = "{}"', "password: {}", "we saw {}"][place].format(value)
        else:
            value = ["your_token_goes_here", draw("123456789", 16), "_".join(rng.choices(PROSE, k=5)), f"{rng.choice(PROSE)}.{i}@mail{i}.example.com", "-".join(rng.choices(PROSE, k=4)) + "/index.html", "".join(rng.choices(PROSE, k=4)).ljust(16, "s")][i % 6]
            text = ['api_key = "{}"', "card {}", "secret: {}", "write to {} now", "open {} there", "say {} again"][i % 6].format(value)
        rows.append((i, f"{before} {text} {after}", "src1"))
        truth[i] = secret
    return rows, truth


def test_forest_finds_planted_secrets_and_leaves_others(spark):
    rows, truth = made(1, 1600)
    found = secrets.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    flagged = {r.doc_id for r in found if r.is_secret}
    real = {i for i, s in truth.items() if s}
    assert len(flagged & real) >= 0.9 * len(real) and len(flagged & real) >= 0.9 * len(flagged)
    open_ = {r.doc_id for r in found if r.named and not r.quoted}  # the rule says nothing about these
    assert len(open_ & real) > 100 and len(open_ - real) > 50
    assert len(flagged & real & open_) >= 0.9 * len(open_ & real) and len(flagged & open_ - real) <= 0.1 * len(open_ - real)


def test_judged_findings_train_the_forest(spark):
    rows, truth = made(2, 1200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spots = [(i, a, int(truth[i])) for i, t, _ in rows[:600] for a, *_ in secrets.candidates(t)]
    found = secrets.scan(docs, spark.createDataFrame(spots, "doc_id long, start int, label int")).collect()
    new = [(r.score >= 0.5, truth[r.doc_id]) for r in found if r.doc_id >= 600]
    hit = sum(a and b for a, b in new)
    assert hit >= 0.9 * sum(b for _, b in new) and hit >= 0.9 * sum(a for a, _ in new)
    one = secrets.scan(docs, spark.createDataFrame([(i, a, 1) for i, a, _ in spots], "doc_id long, start int, label int"))
    assert {r.score for r in one.collect()} == {1.0}


def test_features_match_plain_counts():
    rng = random.Random(3)
    words = sorted(set(PROSE))
    words_of = secrets.Dictionary(words)
    for _ in range(300):
        value = "".join(rng.choices("abcxyzABC019_-/.", k=rng.randrange(6, 60)))
        text = f"the house {value} of gold"
        got = dict(zip(secrets.FEATURES, secrets.features(text, 10, 10 + len(value), 10, "a/test/b", words_of)))
        kind = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in value]
        assert got["length"] == len(value) and got["test_path"] == 1 and got["words_near"] == 4
        assert math.isclose(got["transitions"], sum(x != y for x, y in zip(kind, kind[1:])) / len(value))
        assert math.isclose(got["entropy"], sum(-n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()))
        assert math.isclose(got["digits"], len(re.findall("[0-9]", value)) / len(value)) and math.isclose(got["uppers"], len(re.findall("[A-Z]", value)) / len(value))
        assert 0 <= got["coverage"] <= 1 and math.isclose(got["known_near"], sum(w in words for w in ("the", "house", "of", "gold")) / 4)


def test_candidates():
    text = 'password = "Sommer24!" token: abc$def x' + "Q" * 16 + " api_key='a b c d' pwd = short \"abcdefghijklmnop1\""
    assert [(text[a:b], n, q) for a, b, n, q, _ in secrets.candidates(text)] == [
        ("Sommer24!", True, True), ("abc$def", True, False), ("x" + "Q" * 16, False, False), ("a b c d", True, True), ("abcdefghijklmnop1", False, True),
    ]


def test_odd_rows(spark, odd_docs, no_docs):
    assert secrets.report(no_docs).count() == 0
    assert {r.doc_id for r in secrets.report(odd_docs).collect()} <= {6, 8}
    long = spark.createDataFrame([(1, "A1b2" * 200_000, None, 7, "v"), (2, 'token = "deadbeef01" ' * 20_000, "s", 8, "w"), (3, None, None, 9, "x")], "doc_id long, text string, source string, start int, value string")
    got = secrets.scan(long.withColumn("label", F.lit("mine")), keep=("doc_id", "source", "label"))
    assert got.groupBy("doc_id").count().orderBy("doc_id").collect() == [(1, 1), (2, 20_000)]
    assert got.columns[:3] == ["doc_id", "source", "label"] and got.first().label == "mine"


def test_long_values_are_looked_at_whole():
    rng = random.Random(7)
    passphrase, odd = " ".join(rng.choices(PROSE, k=450))[:2000], "".join(rng.choices(ANY + " ", k=206))
    text = f'password = "{passphrase}" token: \'{odd}\' api_key="{odd[:100]}'
    assert [(text[a:b], n, q) for a, b, n, q, _ in secrets.candidates(text)][:2] == [(passphrase, True, True), (odd, True, True)]
    words = secrets.Dictionary([*PROSE, "internationalization"])
    of = lambda v: dict(zip(secrets.FEATURES, secrets.features(v, 0, len(v), 0, "", words)))
    ends, low, high = "the" * 90, "the" * 100, "".join(rng.choices("QXZ019", k=300))
    assert of(ends + low + ends)["coverage"] == 1 and of(ends + high + ends)["coverage"] < 0.9 and of(ends + low + ends)["entropy"] < of(ends + high + ends)["entropy"] - 0.5
    assert secrets.coverage("internationalization", words) == 1


def test_each_language_has_its_dictionary(spark, monkeypatch):
    """Fifty languages of 300 words: the dictionaries see each, and secrets in them are found; joined or sent, the same."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k}": ["".join(rng.choices(letters, k=rng.randrange(4, 18))) for _ in range(300)] for k in range(50)}
    rows, truth = [], {}
    for i in range(2000):
        lang = f"l{i % 50}"
        pick = lambda n, w=words[lang]: rng.choices(w, k=n)
        truth[i] = i % 3 == 0
        value = "".join(rng.choices(ALNUM, k=30)) if truth[i] else "_".join(pick(3)).ljust(16, "a")
        rows.append((i, " ".join(pick(40)) + (f' token = "{value}" ' if truth[i] and i % 2 else f" see {value} ") + " ".join(pick(40)), "src", lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    sizes = {r.lang: len(r.words) for r in secrets.dictionaries(docs).collect()}
    assert len(sizes) == 50 and min(sizes.values()) > 280
    found = secrets.report(docs).collect()
    flagged, real = {r.doc_id for r in found if r.is_secret}, {i for i, s in truth.items() if s}
    assert len(flagged & real) >= 0.9 * len(real) and len(flagged & real) >= 0.9 * len(flagged)
    monkeypatch.setattr(secrets, "BROADCAST_WORDS", 10)
    assert sorted(secrets.report(docs).collect(), key=str) == sorted(found, key=str)
