"""Quality rules: how far a document's characters and common words are from its language's.

References come from all documents in one pass, whose tasks count characters and words before they are shuffled: each language's shares
of the character classes, and its common words, those with at least 1/``COMMON`` of the language's words
(so at most ``COMMON`` words a language, whatever the corpus holds). Every language has its own reference, whatever its
share of the corpus. A second pass compares each document with its reference by Jensen-Shannon distance (base 2, 0 to
1). References go to the tasks by broadcast while they hold at most ``BROADCAST_WORDS`` entries in all (measured on the written
table), else by a join on the language.

A document is rejected by the base rules (under 10 words, or over a fifth of its words in repeated windows) or by
the method: its character distance is over ``MAX_CHARS`` with at least ``MIN_CHARS`` characters, or its word
distance is over ``MAX_WORDS`` with at least ``MIN_WORDS`` words. Shorter texts pass that guard, and so do all texts of a language with
less than ``LANGUAGE_CHARS`` characters (for the first) or ``LANGUAGE_WORDS`` words (for the second) in all: they are
too few for a verdict; their distances are reported.

Defined results: a null text counts as empty, has no words and fails the base; a null language is a
language of its own (``''``); the rows are independent of each other apart from the references, in which
repeated rows count as often as they occur; with an empty table there are no references and no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.arrow import map_slices
from codeatlas.sources.scratch import durable

COMMON, WINDOW = 400, 5
MEMO, FLUSH = 200_000, 50_000
BROADCAST_WORDS, BROADCAST_LANGUAGES = 200_000, 10_000
LANGUAGE_CHARS, LANGUAGE_WORDS = 20_000, 10 * COMMON
MIN_CHARS, MAX_CHARS = 200, 0.25
MIN_WORDS, MAX_WORDS = 50, 0.45
WORDS, SYMBOLS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")
CLASSES = ["lower", "upper", "letter", "mark", "digit", "number", "blank", "line", "stop", "punctuation", "symbol", "other"]


def character_classes() -> np.ndarray:
    """The class of every code point, from its Unicode category."""
    by_category = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Mn": 3, "Mc": 3, "Me": 3, "Nd": 4, "Nl": 5, "No": 5, "Zs": 6, "Zl": 7, "Zp": 7, "Sm": 10, "Sc": 10, "Sk": 10, "So": 10}
    table = np.array([by_category.get(c, 9 if c[0] == "P" else 11) for c in map(unicodedata.category, map(chr, range(0x110000)))], np.uint8)
    table[[ord(c) for c in "\t"]], table[[ord(c) for c in "\n\r"]], table[[ord(c) for c in ".,;:!?'\"-"]] = 6, 7, 8
    return table


def class_counts(text: str, table: np.ndarray) -> np.ndarray:
    return np.bincount(table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=len(CLASSES))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, base 2."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())  # noqa: E731
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def counts(rows: DataFrame) -> DataFrame:
    """(lang, class, word, n) of ``rows`` (lang, text): counts of the character classes (word null) and of the words (class null)."""

    def run(batches):
        table = character_classes()
        chars, words = defaultdict(lambda: np.zeros(len(CLASSES), np.int64)), defaultdict(Counter)
        names = ["lang", "class", "word", "n"]

        def flushed():
            for lang, n in chars.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(range(len(n)), pa.int32()), pa.nulls(len(n), pa.string()), pa.array(n, pa.int64())], names=names)
            for lang, seen in words.items():
                items = list(seen.items())
                for s in range(0, len(items), FLUSH):
                    part = items[s : s + FLUSH]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.nulls(len(part), pa.int32()), pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=names)
            chars.clear()
            words.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                chars[lang] += class_counts(text, table)
                words[lang].update(map(str.lower, WORDS.findall(text)))
                if sum(map(len, words.values())) > MEMO:
                    yield from flushed()
        yield from flushed()

    found = rows.select("lang", "text").mapInArrow(run, "lang string, class int, word string, n long")
    return found.groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))


def references(docs: DataFrame) -> DataFrame:
    """A row for each language ('' for null): class counts ``chars``, all ``n_words``, the common ``words`` and their ``shares``."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    counted = durable(counts(rows), "quality-counts")
    chars = counted.groupBy("lang").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)).cast("double") for k in range(len(CLASSES))]).alias("chars"),
        F.coalesce(F.sum(F.when(F.col("class").isNull(), F.col("n"))), F.lit(0)).alias("n_words"),
    )
    chars = durable(chars, "quality-chars")
    small = F.broadcast if chars.count() <= BROADCAST_LANGUAGES else lambda x: x
    common = counted.filter("word IS NOT NULL").join(small(chars.select("lang", "n_words")), "lang").filter(F.col("n") * COMMON >= F.col("n_words"))  # at most COMMON rows a language
    common = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", (F.col("n") / F.col("n_words")).alias("share")))).alias("common"))
    found = chars.join(common, "lang", "left").withColumn("common", F.coalesce("common", F.array().cast("array<struct<word:string,share:double>>")))
    return durable(found.select("lang", "chars", "n_words", F.col("common.word").alias("words"), F.col("common.share").alias("shares")), "quality-references")


def repeated_words(words: list[str]) -> int:
    """Words inside five-word windows that occur twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(windows):
        if seen[w] > 1:
            marks[i] += 1
            marks[i + WINDOW] -= 1
    return int((np.cumsum(marks)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the counts, the distances, ``base_failed`` and ``kept``."""
    reference = F.struct("chars", "n_words", "words", "shares").alias("_reference")
    side, more = found.select(F.col("lang").alias("_lang"), reference), []
    known = {}
    if (found.agg(F.sum(F.size("words") + 1)).first()[0] or 0) <= BROADCAST_WORDS:
        known = {r["_lang"]: r["_reference"].asDict() for r in side.collect()}  # at most BROADCAST_WORDS entries
    else:
        docs, more = docs.join(side, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left"), ["_reference"]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def make():
        table = character_classes()
        refs = {}

        def reference_of(lang, sent):
            if lang not in refs:
                if len(refs) > 500:
                    refs.clear()
                r = sent or shared.value[lang]
                refs[lang] = (np.array(r["chars"]), r["n_words"], {w: k for k, w in enumerate(r["words"])}, np.append(r["shares"], max(0.0, 1 - sum(r["shares"]))))
            return refs[lang]

        def one(text, lang, sent=None):
            text = text or ""
            words = WORDS.findall(text)
            chars, n_words, places, shares = reference_of(lang or "", sent)
            used = Counter(map(places.get, map(str.lower, words)))
            seen = np.zeros(len(shares))
            for k, n in used.items():
                seen[-1 if k is None else k] += n
            d_chars, d_words = distance(class_counts(text, table), chars), distance(seen, shares) if places else 0.0
            repeats = repeated_words(words)
            failed = len(words) < 10 or 100 * repeats > 20 * len(words)
            far = len(text) >= MIN_CHARS and chars.sum() >= LANGUAGE_CHARS and d_chars > MAX_CHARS
            far = far or len(words) >= MIN_WORDS and n_words >= LANGUAGE_WORDS and d_words > MAX_WORDS
            return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), repeated_lines(text), repeats, round(d_chars, 6), round(d_words, 6), failed, not (failed or bool(far))

        return lambda *columns: list(zip(*map(one, *columns)))

    out = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"
    return map_slices(docs, keep, ["text", "lang", *more], out, make)


def report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    made = judge(docs, references(docs), ["doc_id"])
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


_SPLIT = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
# Fixed values: the character classes as regular expressions, in the order of CLASSES; the last one is what is left.
_IN_CLASS = [r"\p{Ll}", r"\p{Lu}\p{Lt}", r"\p{Lm}\p{Lo}", r"\p{M}", r"\p{Nd}", r"\p{Nl}\p{No}", r"\p{Zs}\t", r"\p{Zl}\p{Zp}\n\r", r".,;:!?''\"\-", None, r"\p{S}"]


def _oracle() -> str:
    """The report in SQL, from all words and windows as rows."""
    stops = "length(regexp_replace(t, '[^.,;:!?''\"\\-]', '', 'g'))"
    counted = [f"length(regexp_replace(t, '[^{c}]', '', 'g'))" if c else f"length(regexp_replace(t, '[^\\p{{P}}]', '', 'g')) - {stops}" for c in _IN_CLASS]
    listed = f"[{', '.join(counted)}]"
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"  # noqa: E731
    distance = f"round(sqrt(greatest(0, sum({part('p', 'q')} + {part('q', 'p')}) / 2)), 6)"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents), w AS (SELECT rid, lang, t, {_SPLIT} AS ws FROM d),
word AS (SELECT rid, lang, lower(ws[i]) AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
win AS (SELECT rid, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
often AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS n FROM win) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM often, range(0, {WINDOW}) r(k) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-]') GROUP BY rid),
classed AS (SELECT rid, lang, length(t) AS size, list_append(c, length(t) - list_sum(c)) AS c FROM (SELECT rid, lang, t, {listed} AS c FROM d)),
chars AS (SELECT rid, lang, size, k, c[k] AS n FROM (SELECT *, unnest(range(1, {len(CLASSES) + 1})) AS k FROM classed)),
whole AS (SELECT lang, k, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS of FROM chars GROUP BY lang, k),
d_chars AS (SELECT rid, {distance} AS x, any_value(of) AS of FROM (SELECT c.rid, c.n / c.size AS p, v.n / v.of AS q, v.of FROM chars c JOIN whole v ON c.lang = v.lang AND c.k = v.k WHERE c.size > 0) GROUP BY rid),
counts AS (SELECT lang, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS of FROM word GROUP BY lang, word),
common AS (SELECT lang, word, n / of AS q FROM counts WHERE n * {COMMON} >= of),
reference AS (SELECT lang, word, q FROM common UNION ALL SELECT lang, NULL, greatest(0, 1 - sum(q)) FROM common GROUP BY lang),
sizes AS (SELECT lang, any_value(of) AS of FROM counts GROUP BY lang),
seen AS (SELECT w.rid, w.lang, c.word, count(*) AS n FROM word w LEFT JOIN common c ON w.lang = c.lang AND w.word = c.word GROUP BY w.rid, w.lang, c.word),
shares AS (SELECT w.rid, r.word, coalesce(s.n, 0) / w.n AS p, r.q FROM (SELECT rid, lang, count(*) AS n FROM word GROUP BY rid, lang) w JOIN reference r ON r.lang = w.lang LEFT JOIN seen s ON s.rid = w.rid AND s.word IS NOT DISTINCT FROM r.word),
d_words AS (SELECT rid, {distance} AS x FROM shares GROUP BY rid),
judged AS (SELECT d.doc_id, len(w.ws) AS n_words, CAST(coalesce(list_sum(list_transform(w.ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines,
 coalesce(r.n, 0) AS n_repeat_words, length(d.t) AS size, coalesce(c.x, 0.0) AS char_distance, coalesce(v.x, 0.0) AS word_distance, coalesce(c.of, 0) AS of_chars, coalesce(s.of, 0) AS of_words
 FROM d JOIN w ON w.rid = d.rid LEFT JOIN lines l ON l.rid = d.rid LEFT JOIN repeats r ON r.rid = d.rid LEFT JOIN d_chars c ON c.rid = d.rid LEFT JOIN d_words v ON v.rid = d.rid LEFT JOIN sizes s ON s.lang = d.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, char_distance, word_distance,
 NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR (size >= {MIN_CHARS} AND of_chars >= {LANGUAGE_CHARS} AND char_distance > {MAX_CHARS}) OR (n_words >= {MIN_WORDS} AND of_words >= {LANGUAGE_WORDS} AND word_distance > {MAX_WORDS})) AS kept FROM judged
"""


SQL = _oracle()
