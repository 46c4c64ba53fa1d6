import math
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from codeatlas.llm import quality
from tests.conftest import SMALL


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(marked)


def test_counts_and_verdicts(spark, odd_docs, no_docs):
    prose = "the cat sat on the mat and the dog lay by the door while rain fell on the roof of the old house near the sea. " * 2
    rows = [(200 + k, prose.replace("cat", f"c{k}").replace("dog", f"d{k}").replace("roof", f"r{k}"), "en") for k in range(40)]
    rows += [(300, "#$% &&& *** " * 40, "en"), (301, "a b c d e f g\na b c d e f g\n\n x", "en")]
    docs = odd_docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        want = plain(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (g.base_failed and g.kept)
    assert not got[300].kept
    assert quality.report(no_docs).count() == 0


def kind(c):
    if c in ".,;:!?'\"-":
        return "stop"
    if c in "\n\r":
        return "line"
    if c == "\t":
        return "blank"
    given = unicodedata.category(c)
    return {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lm": "letter", "Lo": "letter", "Nd": "digit", "Nl": "number", "No": "number", "Zs": "blank", "Zl": "line", "Zp": "line"}.get(given) or {"M": "mark", "P": "punctuation", "S": "symbol"}.get(given[0], "other")


def divergence(p, q):
    """Square root of the Jensen-Shannon divergence of two histograms by name."""
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return 0.0
    part = lambda x, y: sum(v * math.log2(2 * v / (v + y.get(k, 0))) for k, v in x.items() if v)
    x, y = {k: v / a for k, v in p.items()}, {k: v / b for k, v in q.items()}
    return math.sqrt(max(0.0, (part(x, y) + part(y, x)) / 2))


def test_distances_and_verdicts_match_plain_counts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    chars, words = defaultdict(Counter), defaultdict(Counter)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for r in rows:
        chars[r.lang].update(map(kind, r.text or ""))
        words[r.lang].update(map(str.lower, split(r.text)))
    common = {k: {w: n for w, n in v.items() if n * quality.COMMON >= v.total()} for k, v in words.items()}
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    for r in rows:
        known, total = common[r.lang], words[r.lang].total()
        rest = {**known, None: total - sum(known.values())}
        seen = Counter(w if w in known else None for w in map(str.lower, split(r.text)))
        g, d_words, d_chars = got[r.doc_id], divergence(seen, rest), divergence(Counter(map(kind, r.text or "")), chars[r.lang])
        assert math.isclose(g.char_distance, d_chars, abs_tol=1e-6) and math.isclose(g.word_distance, d_words, abs_tol=1e-6)
        far = len(r.text or "") >= 200 and chars[r.lang].total() >= quality.LANGUAGE_CHARS and d_chars > quality.MAX_CHARS
        far = far or len(split(r.text)) >= 50 and total >= quality.LANGUAGE_WORDS and d_words > quality.MAX_WORDS
        assert g.kept == (not g.base_failed and not far)


def test_many_small_languages_keep_their_verdicts(spark):
    import random

    rng = random.Random(7)
    vocabulary = [[f"w{lang}x{k}" for k in range(60)] for lang in range(100)]
    text = lambda lang: " ".join(rng.choices(vocabulary[lang], k=600))
    rows = [(10 * lang + k, text(lang), f"l{lang}") for lang in range(100) for k in range(9)] + [(10 * lang + 9, text((lang + 1) % 100), f"l{lang}") for lang in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    assert all(got[i].kept == (i % 10 != 9) for i in got)
    alone = {r.doc_id: r for r in quality.report(docs.filter("lang = 'l3'")).collect()}
    assert all(r == got[i] for i, r in alone.items())


def test_distance_bounds():
    import numpy as np

    assert quality.distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality.distance(np.array([1.0, 3]), np.array([2.0, 6])) == pytest.approx(0)


def test_small_languages_have_their_own_reference(spark, monkeypatch):
    import random

    rng = random.Random(3)
    letters = [chr(0x4E00 + k) for k in range(60)]
    chinese = lambda: " ".join("".join(rng.choices(letters, k=3)) for _ in range(80))
    english = lambda n: " ".join(rng.choice("the of and to in a house rain door old sea cat".split()) + rng.choice(["", "", "s", "x", "y."]) for _ in range(n))
    rows = [(k, english(5000), "en") for k in range(80)] + [(100 + k, chinese(), "zh") for k in range(70)] + [(300 + k, chinese(), "yue") for k in range(3)]
    rows += [(400, " ".join(f"word{k}" for k in range(90)), "zh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.report(docs).collect()
    assert all(r.kept for r in got if 100 <= r.doc_id < 400) and not next(r for r in got if r.doc_id == 400).kept
    alone = {r.doc_id: r for r in quality.report(docs.filter("lang <> 'en'")).collect()}
    assert all(r == alone[r.doc_id] for r in got if r.doc_id >= 100)
    monkeypatch.setattr(quality, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 0)
    assert sorted(quality.report(docs).collect()) == sorted(got)
