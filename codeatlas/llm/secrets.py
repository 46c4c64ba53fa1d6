"""Secret scan with a random forest that removes false positives.

1. Candidates, found in whole texts: runs of 16 or more token characters, and any quoted or assigned value of 6 characters or more after a
   secret's name, whatever its characters.
2. Each has features: length; character transitions (changes between lower, upper, digit and sign, and how surprising each character
   is after the one before it); entropy and shares of digits, capitals, hex digits and vowels; dictionary coverage (the part of its letters
   that common words of the corpus cover); the path (words in the document's source that mark tests or samples); and the neighbouring words
   (how many there are, and how many of them are in the dictionary).
3. A forest of ``TREES`` trees is trained from labelled findings, at most ``MAX_FINDINGS`` of each label (those with the
   smallest hash), weighted so that both labels count the same, and scores every candidate.

Labelled findings come from a table (doc_id, start, label) or, without one, from ``confirmed``, which looks only at what is not a feature:
a quoted value assigned to a secret's name is 1 (unless it says itself that it is an example), a value without name or quotes is 0. All
else is left open, and since the forest sees neither name, assignment nor quotes, it decides by what values look like. Label 0 then means only that nothing says 1, so
scores are divided by the mean score of the ones (the share of secrets that carry a label, for what looks like one): an example value after a name is
turned down, a bare secret in running text is found, whatever the rule said about it.

Every language (the ``lang`` of a document) has a dictionary and a table of character pairs of its own, from all its documents: words with at least
1/``DICTIONARY`` of its words, so at most that many. Dictionaries go to the tasks by broadcast while they hold at most ``BROADCAST_WORDS`` words
in all (measured on the written table), else a document is joined to that of its language. The documents are read twice, for
the dictionaries and for the candidates, which are stored.

Defined results: a null text has no candidates; a null source is an empty path; a null language (or none at all) is a language; values of any length are
candidates and are looked at whole; a candidate is a row of its own,
so a value that occurs twice is found twice and repeated rows repeat their findings; with labelled findings of one
kind only, or none, the share of positives (0 without any) is every candidate's score; columns in ``keep`` come back whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.arrow import map_slices
from codeatlas.sources.scratch import durable

TREES, DEPTH, MAX_FINDINGS, DICTIONARY, MIN_SHARE = 40, 8, 10_000, 2000, 0.5
NEAR, BROADCAST_WORDS, BROADCAST_LANGUAGES = 40, 200_000, 20_000
# Runs of token characters; names of secrets; what assigns a value; words of example values and of paths that hold no live secrets.
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
NAME = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api_?key|access_?key|auth|credential|private_?key)s?"
NAMED = re.compile(NAME + r"[\"']?[ \t]*(?::=|=>|[=:])[ \t]*(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"'<>]{6,}))", re.I)
EXAMPLES = r"(?i)example|sample|dummy|placeholder|change_?me|your[_-]|xxxx|0{8}|1234567"
PATHS = re.compile(r"test|spec|mock|fixture|sample|example|docs?\b", re.I)
FEATURES = ["length", "transitions", "surprise", "entropy", "digits", "uppers", "hex", "vowels", "signs", "coverage", "test_path", "words_near", "known_near"]


def kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


class Dictionary(set):
    """The common words of a language, what its letter pairs cost, and the lengths of its words from the longest."""

    def __init__(self, words: list[str]):
        super().__init__(words)
        self.costs, self.lengths = pair_costs(words), sorted({len(w) for w in words if len(w) > 2}, reverse=True)


def coverage(value: str, dictionary: Dictionary) -> float:
    """Part of the letters that dictionary words of three letters or more cover, longest first from the left."""
    letters = covered = 0
    for run in re.findall(r"[a-z]+", value.lower()):
        letters += len(run)
        at = 0
        while at < len(run):
            n = next((n for n in dictionary.lengths if n <= len(run) - at and run[at : at + n] in dictionary), 0)
            covered += n
            at += n or 1
    return covered / letters if letters else 0.0


def pair_costs(words: list[str]) -> dict[str, float]:
    """How many bits a letter costs after the letter before it in dictionary words; 8 for pairs that they do not have."""
    pairs = Counter(a + b for w in words for a, b in zip(w, w[1:]))
    firsts = Counter(p[0] for p in pairs.elements())
    return {p: -math.log2(n / firsts[p[0]]) for p, n in pairs.items()}


def candidates(text: str) -> list[tuple[int, int, bool, bool, int]]:
    """(start, end, named, quoted, where its name begins) in order; a run that meets a named value belongs to it."""
    found = []
    for m in NAMED.finditer(text):
        k = 1 if m[1] else 2 if m[2] else 3
        found.append((*m.span(k), True, k < 3, m.start()))
    spans = sorted(found)
    at = 0
    for m in RUN.finditer(text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at == len(spans) or spans[at][0] >= m.end():
            before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
            found.append((*m.span(), False, before in ("'", '"') and before == after, m.start()))
    return sorted(found)


def features(text: str, start: int, end: int, left: int, path: str, dictionary: Dictionary) -> list[float]:
    """The name and what assigns the value are not looked at: neighbours are the words before ``left`` and after the value."""
    value, before, after = text[start:end], text[max(0, left - NEAR) : left], text[end : end + NEAR]
    kinds, n, low, costs = [kind_of(c) for c in value], len(value), value.lower(), dictionary.costs
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    around = re.findall(r"[^\W\d_]{2,}", (before + " " + after).lower())
    return [
        float(end - start), sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum(costs.get(a + b, 8.0) for a, b in zip(low, low[1:])) / max(1, n - 1), entropy,
        kinds.count(2) / n, kinds.count(1) / n, sum(c in "0123456789abcdef" for c in low) / n, sum(c in "aeiou" for c in low) / n, kinds.count(3) / n, coverage(value, dictionary),
        float(bool(PATHS.search(path))), float(len(around)), sum(w in dictionary for w in around) / max(1, len(around)),
    ]


def dictionaries(docs: DataFrame) -> DataFrame:
    """(lang, words): the common words of three letters or more of each language, from all documents; stored."""
    words = docs.select(language(docs).alias("lang"), F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")).alias("word")).filter("length(word) > 2")
    counted = durable(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    total = durable(counted.groupBy("lang").agg(F.sum("n").alias("total")), "secret-totals")
    total = F.broadcast(total) if total.count() <= BROADCAST_LANGUAGES else total  # words stay where they are: a language may hold most of them
    common = counted.join(total, "lang").filter(F.col("n") * DICTIONARY >= F.col("total"))  # at most DICTIONARY words a language
    return durable(common.groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("words")), "secret-dictionaries")


def language(docs: DataFrame) -> Column:
    return F.coalesce("lang", F.lit("")) if "lang" in docs.columns else F.lit("")


def findings(docs: DataFrame, common: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each candidate: ``keep``, start, end, value, named, quoted, features. ``common`` has the dictionaries (lang, words)."""
    known, inputs = {}, ["text", "source", "_lang"]
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), "text", "source", language(docs).alias("_lang"))
    if (common.agg(F.sum(F.size("words"))).first()[0] or 0) <= BROADCAST_WORDS:
        known = {r.lang: r.words for r in common.collect()}  # at most BROADCAST_WORDS words
    else:
        rows, inputs = rows.join(common.select(F.col("lang").alias("_of"), F.col("words").alias("_words")), F.col("_lang") == F.col("_of"), "left"), [*inputs, "_words"]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        ready: dict[str, Dictionary] = {}

        def dictionary_of(lang, sent):
            if lang not in ready:
                if len(ready) > 200:
                    ready.clear()
                ready[lang] = Dictionary(sent or shared.value.get(lang, []))
            return ready[lang]

        def one(text, path, lang, sent=None):
            found = candidates(text or "")
            columns = list(zip(*found))[:4] or [(), (), (), ()]
            words = dictionary_of(lang, sent) if found else None
            return *columns, [text[a:b] for a, b, *_ in found], [features(text, a, b, left, path or "", words) for a, b, *_, left in found]

        return lambda *columns: list(zip(*map(one, *columns)))

    made = "start array<int>, end array<int>, named array<boolean>, quoted array<boolean>, value array<string>, features array<array<double>>"
    found = map_slices(rows, ["kept"], inputs, made, make)
    return found.filter(F.size("start") > 0).select("kept", F.inline(F.arrays_zip("start", "end", "named", "quoted", "value", "features")))


def confirmed(found: DataFrame) -> DataFrame:
    """The candidates whose neighbourhood says what they are, with ``label``."""
    example = F.col("value").rlike(EXAMPLES)
    return found.withColumn("label", F.when(F.col("named") & F.col("quoted") & ~example, 1.0).when(~F.col("named") & ~F.col("quoted"), 0.0)).filter("label IS NOT NULL")


def scored(found: DataFrame, labelled: DataFrame, judged: bool, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """``found`` with ``score`` 0..1; unless the labels are ``judged``, 0 only means that nothing says 1."""
    order = [F.xxhash64("value", "start"), F.col("value"), F.col("start")]
    sides = [labelled.filter(F.col("label") == k).orderBy(*order).limit(max_findings).select("label", "features") for k in (0.0, 1.0)]
    sample = durable(sides[0].unionByName(sides[1]), "secret-sample")  # at most max_findings rows of each label
    counts = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return found.withColumn("score", F.lit(float(min(counts, default=0.0))))
    weight = F.when(F.col("label") == 1, float(counts[0.0] / counts[1.0])).otherwise(1.0)
    sample = sample.select("label", weight.alias("weight"), array_to_vector("features").alias("vector"))
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="sqrt", minInstancesPerNode=2, minWeightFractionPerNode=0.005
    ).fit(sample)
    chance = vector_to_array("probability")[1]
    known = 1.0 if judged else forest.transform(sample.filter("label = 1")).agg(F.avg(chance)).first()[0]
    made = forest.transform(found.withColumn("vector", array_to_vector("features")))
    return made.withColumn("score", F.least(F.lit(1.0), chance / known)).select(*found.columns, "score")


def scan(docs: DataFrame, labels: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All candidates with their scores; ``labels`` (doc_id, start, label) are findings that somebody has judged."""
    found = durable(findings(docs, dictionaries(docs), list(dict.fromkeys([*keep, "doc_id"]))), "secret-findings")
    if labels is None:
        labelled = confirmed(found)
    else:
        judged = labels.groupBy("doc_id", "start").agg(F.max("label").cast("double").alias("label"))
        labelled = found.join(judged, (found["kept.doc_id"] == judged["doc_id"]) & (found["start"] == judged["start"])).select(*[found[c] for c in found.columns], "label")
    return scored(found, labelled, labels is not None).select(*[F.col(f"kept.{c}") for c in keep], "start", "end", "value", "named", "quoted", "features", "score")


def report(docs: DataFrame) -> DataFrame:
    """A row for each candidate; the value itself is shown only as a digest."""
    found = scan(docs.select("doc_id", "text", "source", *["lang"] * ("lang" in docs.columns)))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", (F.col("score") >= MIN_SHARE).alias("is_secret"), "named", "quoted")
