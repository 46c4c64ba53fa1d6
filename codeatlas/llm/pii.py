"""Personal data: regular expressions propose, checksums confirm, context words adjust.

All of it is built-in functions inside one projection; there is no shuffle. Offsets (code points, end exclusive) are running
sums of the pieces that the matches cut a text into, and patterns enter a run of digits or address characters only at its start,
so that the work is linear in the text: a megabyte of numbers or of letters takes seconds.

Kinds, in their fixed order: ``email``, ``ip``, ``card``, ``phone`` (the base, whose failing matches are dropped without another try),
then ``iban`` (mod 97) and ``ssn``. An IBAN ends where its country's length says (for other countries at the last capital or digit of
the run), and is looked for at every country code, whatever failed before it. A span's score in 0..1 is the kind's prior, plus
0.3 for a confirmed checksum, plus 0.3 for a context word in the 48 characters before or after; the base kinds stay whatever their
score, the others need 0.6 (so an ``ssn`` needs a context word, and an ``iban`` its checksum).

Defined results: a null or empty text has no spans; other columns are untouched (a column of the caller's named ``spans`` keeps its
values, the operator's is then ``spans_``); each row is judged alone, so ties and repeated rows need no rule; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.spans import let, starts, texts_after, texts_before
from codeatlas.llm.arrow import free_name

# Patterns of the kinds, as they are defined.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9]+(?:[\x20-][0-9]+)*",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
#: The same matches without a second look at a run: it is entered at its start (or where the last match ended), possessive forms do
#: not step back, and runs of digits that are no card's length are passed over.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![0-9])(?![\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}",
    "ssn": PLAIN["ssn"],
}
#: The fewest characters of a match and the gap before it.
LEAST = {"email": 5, "ip": 7, "card": 14, "phone": 4, "iban": 4, "ssn": 11}
KINDS = list(PATTERNS)
# The countries' IBAN lengths, and IBANs at the start of a text.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(c for cs in IBAN_LENGTHS.values() for c in cs.split())
IBAN = r"^(?:" + "".join(rf"(?:{cs.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}|" for n, cs in IBAN_LENGTHS.items()) + rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})\b"
BASE = KINDS[:4]
# What a text must hold for a kind's pattern to be tried.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]"}
# Words that make a kind likelier, and the kinds' priors.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "address|host|server|ip",
    "card": "card|credit|visa|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
PRIOR = {"email": 0.6, "ip": 0.4, "card": 0.4, "phone": 0.4, "iban": 0.3, "ssn": 0.3}
CHECKED = ("ip", "card", "iban")
MIN_SCORE, WINDOW, LONGEST_IBAN = 0.6, 48, 68


def find_spans(text: Column, kind: str) -> tuple[Column, Column]:
    """Leftmost matches that do not overlap, and what lies between them."""
    none = F.array().cast("array<string>")
    wanted = text.rlike(NEEDS[kind])
    return F.when(wanted, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none), F.when(wanted, F.split(text, PATTERNS[kind], -1)).otherwise(none)


def _placed(kind: str, found: Column, gaps: Column) -> Column:
    """The confirmed matches as (start, value, before, after)."""

    def placed(f, g):
        after = texts_after(f, g, max(WINDOW, LONGEST_IBAN if kind == "iban" else 0), LEAST[kind])
        zipped = F.arrays_zip(starts(f, g).alias("start"), f.alias("value"), texts_before(f, g, WINDOW, LEAST[kind]).alias("before"), after.alias("after"))
        return _whole_ibans(zipped) if kind == "iban" else F.filter(zipped, lambda x: _confirmed(kind, x["value"]))

    return let(found, lambda f: let(gaps, lambda g: placed(f, g)))


def _whole_ibans(heads: Column) -> Column:
    """The IBANs that start at the heads and have a valid checksum; of overlapping ones the first."""

    def whole(x):
        text = F.concat(x["value"], x["after"])
        value = F.regexp_extract(text, IBAN, 0)
        return F.struct(x["start"].alias("start"), value.alias("value"), x["before"].alias("before"), F.substring(text, F.length(value) + 1, F.lit(WINDOW)).alias("after"))

    near = LONGEST_IBAN // LEAST["iban"]

    def apart(valid):
        ends = lambda y: y["start"] + F.length(y["value"])
        return F.filter(valid, lambda x, i: ~F.exists(F.slice(valid, F.greatest(i - near, F.lit(0)) + 1, F.least(i, F.lit(near))), lambda y: ends(y) > x["start"]))

    return let(F.filter(F.transform(heads, whole), lambda x: _confirmed("iban", x["value"])), apart)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn sum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    add = lambda a, x: a + F.when(x["i"] % 2 == 0, x["d"]).otherwise(x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0))
    return F.aggregate(each, F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 modulo 97."""
    turned = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        packed = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(packed).between(15, 34), mod97(packed)).otherwise(False)
    return F.lit(True)


def _scored(kind: str, found: Column, gaps: Column) -> Column:
    def one(x):
        near = F.lower(F.concat_ws("\n", x["before"], F.left(x["after"], F.lit(WINDOW))))
        score = F.lit(PRIOR[kind] + 0.3 * (kind in CHECKED)) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})"), 0.3).otherwise(0.0)
        return F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (x["start"] + F.length(x["value"])).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"), F.round(F.least(F.lit(1.0), score), 2).alias("score")
        )

    out = F.transform(_placed(kind, found, gaps), one)
    return out if kind in BASE else F.filter(out, lambda x: x["score"] >= MIN_SCORE)


def detect(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``spans``: array of (start, kind_no, end, kind, value, score), by start, then kind."""
    name = free_name(docs, "spans")
    text, found, gaps = (free_name(docs, x) for x in ("_text", "_found", "_gaps"))
    made = docs.withColumn(text, F.coalesce("text", F.lit("")))
    pieces = {k: find_spans(F.col(text), k) for k in KINDS}
    made = made.withColumns({f"{found}{k}": p[0] for k, p in pieces.items()} | {f"{gaps}{k}": p[1] for k, p in pieces.items()})
    every = F.array_sort(F.concat(*[_scored(k, F.col(f"{found}{k}"), F.col(f"{gaps}{k}")) for k in KINDS]))
    return made.select(*[docs[c] for c in docs.columns], F.when(F.col(text).rlike("[0-9@]"), every).alias(name))


def _named(spans: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","), F.lit(""))


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, all spans as text, and their scores in the same order."""
    found = detect(docs.select("doc_id", "text")).select("doc_id", "spans")
    count = lambda k: F.coalesce(F.size(F.filter("spans", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    counts = [F.greatest(F.lit(0), count(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda x: x["kind_no"] < len(BASE))
    scores = F.array_join(F.transform("spans", lambda x: x["score"].cast("decimal(3,2)").cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"), F.coalesce(scores, F.lit("")).alias("scores"))


def _oracle() -> str:
    """The report in SQL: the patterns in plain form, the checksums as folds over digits, IBANs cut to their country's length."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"(SELECT sum(CASE WHEN i % 2 = 0 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END) % 10 = 0 FROM (SELECT unnest(range(0, length({digits}))) AS i, CAST(unnest(string_split(reverse({digits}), '')) AS INT) AS d))"
    turned = "concat(substr(replace(v, ' ', ''), 5), substr(replace(v, ' ', ''), 1, 4))"
    number = f"array_to_string(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
    mod = f"list_reduce(list_transform(string_split({number}, ''), lambda c: CAST(c AS INT)), lambda a, d: (a * 10 + d) % 97) = 1"
    lengths = "CASE " + " ".join(f"WHEN list_contains({cs.split()}, substr(v, 1, 2)) THEN {n - 4}" for n, cs in IBAN_LENGTHS.items()) + " END"
    whole = f"regexp_extract(substr(t, CAST(s AS BIGINT) + 1, {LONGEST_IBAN}), concat('^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{', coalesce(CAST({lengths} AS VARCHAR), '11,30'), '}}\\b'), 0)"
    valid = {
        "email": "TRUE", "ip": "len(list_filter(string_split(v, '.'), lambda x: TRY_CAST(x AS HUGEINT) IS NULL OR CAST(x AS HUGEINT) > 255)) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 14 AND 19 THEN {luhn} ELSE FALSE END", "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"CASE WHEN length(replace(v, ' ', '')) BETWEEN 15 AND 34 THEN {mod} ELSE FALSE END", "ssn": "TRUE",
    }
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda x: length(x))), 0)"
    near = f"lower(concat(substr(t, greatest(1, s + 1 - {WINDOW}), least({WINDOW}, s)), chr(10), substr(t, s + length(v) + 1, {WINDOW})))"

    def rows(n, k):
        pattern = PLAIN.get(k, PATTERNS["iban"])
        placed = f"SELECT doc_id, t, m[i] AS v, CAST({total('g[1:i]')} + {total('m[1:i-1]')} AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM docs))"
        placed = f"SELECT doc_id, t, s, {whole} AS v FROM ({placed})" if k == "iban" else placed
        score = f"least(1.0, {PRIOR[k] + 0.3 * (k in CHECKED)} + CASE WHEN regexp_matches({near}, '\\b(?:{CONTEXT[k]})') THEN 0.3 ELSE 0 END)"
        return f"SELECT doc_id, {n} AS n, '{k}' AS kind, s, s + length(v) AS e, CAST({score} AS DECIMAL(3, 2)) AS score FROM ({placed}) WHERE {valid[k]}"

    found = " UNION ALL ".join(rows(n, k) for n, k in enumerate(KINDS))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    named = "string_agg(concat(kind, ':', CAST(s AS VARCHAR), ':', CAST(e AS VARCHAR)), ',' ORDER BY s, n)"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), proposed AS ({found}),
found AS (SELECT * FROM proposed x WHERE (n < {len(BASE)} OR score >= {MIN_SCORE}) AND NOT (kind = 'iban' AND EXISTS (SELECT 1 FROM proposed y WHERE y.kind = 'iban' AND y.doc_id = x.doc_id AND y.s < x.s AND y.e > x.s)))
SELECT d.doc_id, {counts}, sha256(coalesce({named} FILTER (n < {len(BASE)}), '')) AS base_sha256, coalesce({named} FILTER (n IS NOT NULL), '') AS spans,
 coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, n) FILTER (n IS NOT NULL), '') AS scores
FROM docs d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""


SQL = _oracle()
