"""Audit findings: parsing answers, ranking, scores, reports, and rules over source lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions import spans, specs
from codeatlas.functions.text import strip
from codeatlas.sources.scratch import durable

# Defaults of a finding and of an answer that cannot be read.
DEFAULTS = {"severity": "INFO", "title": "Untitled finding", "location": "Unknown", "description": "", "recommendation": ""}
UNREAD = ("INFO", "Scan Results (unstructured)", "N/A", "Review the findings above manually.")
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)```"
MAX_UNREAD = 2000
BROADCAST_NAMES = 200_000
FINDING = "struct<severity: string, title: string, location: string, description: string, recommendation: string>"


def severity_rank(severity: Column) -> Column:
    ranks = [x for i, s in enumerate(specs.SEVERITIES) for x in (F.lit(s), F.lit(i))]
    return F.coalesce(F.create_map(*ranks)[severity], F.lit(len(specs.SEVERITIES) - 1))


def known_severity(severity: Column) -> Column:
    upper = strip(F.upper(severity))
    return F.when(upper.isin(list(specs.SEVERITIES)), upper).otherwise("INFO")


def _normal(element: Column) -> Column:
    """One finding from a JSON object's text; an absent key gets its default, a JSON null the word None."""

    def value(key):
        given = F.get_json_object(element, f"$.{key}")
        null = element.rlike(rf'"{key}"\s*:\s*null')
        return strip(F.coalesce(given, F.when(null, "None"), F.lit(DEFAULTS[key])))

    return F.struct(known_severity(value("severity")).alias("severity"), *[value(k).alias(k) for k in list(DEFAULTS)[1:]])


def parse_findings(raw: Column) -> Column:
    """Array of findings in a model's answer: a JSON list, a single object, or the text as one INFO finding."""
    text = strip(raw)
    fenced = F.regexp_extract(text, FENCE, 1)
    text = F.when(text.rlike(FENCE), strip(fenced)).otherwise(text)
    listed = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<string>")
    alone = F.when(text.rlike(r"(?s)\A\{.*\}\z") & F.try_parse_json(text).isNotNull(), F.array(text))
    elements = F.coalesce(listed, alone)
    objects = F.transform(F.filter(elements, lambda x: x.rlike(r"(?s)\A\s*\{")), _normal)
    unread = F.struct(*[F.lit(v).alias(k) for k, v in zip(("severity", "title", "location"), UNREAD)], F.substring(text, 1, MAX_UNREAD).alias("description"), F.lit(UNREAD[3]).alias("recommendation"))
    empty = F.array().cast(f"array<{FINDING}>")
    return F.when(elements.isNotNull(), objects).when((text != "") & (text != "[]"), F.array(unread)).otherwise(empty)


def findings_of(responses: DataFrame) -> DataFrame:
    """A row for each finding of the answers: project_id, category, display_name, pos and the five fields."""
    found = responses.withColumn("_f", parse_findings(F.col("raw_response")))
    return found.select("project_id", "category", "display_name", F.posexplode("_f").alias("pos", "f")).select("project_id", "category", "display_name", "pos", "f.*")


def normalize_findings(findings: DataFrame) -> DataFrame:
    filled = {k: strip(F.coalesce(F.col(k), F.lit(v))) for k, v in DEFAULTS.items()}
    return findings.withColumns(filled | {"severity": known_severity(F.coalesce("severity", F.lit("INFO")))})


def order_findings(findings: DataFrame) -> DataFrame:
    """By category, severity rank, then the order in which they were found."""
    return findings.orderBy("project_id", "category", severity_rank(F.col("severity")), "pos")


def health_score(counts: dict[str, Column]) -> Column:
    lost = sum((counts[s] * n for s, n in specs.SEVERITIES.items()), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)).cast("int")


def health_grade(score: Column) -> Column:
    out = F
    for grade, least in specs.GRADES:
        out = out.when(score >= least, grade)
    return out.otherwise("F")


def scan_summary(results: DataFrame, findings: DataFrame) -> DataFrame:
    """One row for each project: totals, counts by severity, categories scanned and clean, score and grade.

    ``results`` has a row for each scanned category (project_id, category, error).
    """
    by = {s: F.count_if(F.upper("severity") == s) for s in specs.SEVERITIES}
    counted = findings.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_findings"), *[c.alias(f"n_{s.lower()}") for s, c in by.items()])
    per = findings.groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("n"))
    clean = (F.coalesce("n", F.lit(0)) == 0) & (F.coalesce("error", F.lit("")) == "")
    scanned = results.join(per, ["project_id", "category"], "left").groupBy("project_id").agg(F.count(F.lit(1)).alias("categories_scanned"), F.count_if(clean).alias("categories_clean"))
    rows = scanned.join(counted, "project_id", "left").fillna(0)
    score = health_score({s: F.col(f"n_{s.lower()}") for s in specs.SEVERITIES})
    return rows.withColumn("health_score", score).withColumn("health_grade", health_grade(F.col("health_score")))


def findings_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("project_id", "display_name").agg(F.count(F.lit(1)).alias("n"))


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """All five severities of every project, zero where there is none."""
    counted = findings.groupBy("project_id", F.upper("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    every = findings.select("project_id").distinct().withColumn("severity", F.explode(F.array(*map(F.lit, specs.SEVERITIES))))
    return every.join(counted, ["project_id", "severity"], "left").fillna(0, ["n"])


def scan_report(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(project_id, report): a text with the summary, the severity table and the findings in category order."""
    place = [x for i, c in enumerate(specs.CATEGORIES) for x in (F.lit(c[0]), F.lit(i))]
    order = F.create_map(*place)
    summary = scan_summary(results, findings)
    table = F.concat_ws("\n", *[F.when(F.col(f"n_{s.lower()}") > 0, F.concat(F.lit(f"| {s} | "), F.col(f"n_{s.lower()}"), F.lit(" |"))) for s in specs.SEVERITIES])
    head = F.concat(
        F.lit("# Security & Code Quality Report\n\n**Health Score:** "), F.col("health_score"), F.lit("/100 (Grade: **"), F.col("health_grade"), F.lit("**)\n\n**Total Findings:** "), F.col("total_findings"),
        F.lit("  |  **Categories Scanned:** "), F.col("categories_scanned"), F.lit("  |  **Clean Categories:** "), F.col("categories_clean"), F.lit("\n\n## Severity Breakdown\n\n| Severity | Count |\n|---|---|\n"), table,
    )
    line = lambda prefix, c, suffix="": F.when(F.col(c) != "", F.concat(F.lit(prefix), F.col(c), F.lit(suffix + "\n\n")))
    body = F.concat_ws("", F.concat(F.lit("["), F.col("severity"), F.lit("] "), F.col("title"), F.lit("\n\n")), line("**Location:** `", "location", "`"), line("", "description"), line("**Recommendation:** ", "recommendation"))
    listed = F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("r"), "pos", body.alias("b"))))
    numbered = F.array_join(F.transform(listed, lambda x, i: F.concat(F.lit("### "), i + 1, F.lit(". "), x["b"])), "---\n\n")
    sections = results.join(findings.groupBy("project_id", "category").agg(numbered.alias("text")), ["project_id", "category"], "left")
    shown = F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit("> **Error:** "), F.col("error"), F.lit("\n"))).otherwise(F.coalesce("text", F.lit("No issues found.\n")))
    sections = sections.select("project_id", F.struct(order[F.col("category")].alias("o"), F.concat(F.lit("## "), F.col("display_name"), F.lit("\n\n"), shown).alias("t")).alias("s"))
    whole = sections.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "\n").alias("sections"))
    return summary.select("project_id", head.alias("head")).join(whole, "project_id").select("project_id", F.concat("head", F.lit("\n\n---\n\n"), "sections").alias("report"))


def rule_table(spark: SparkSession, rules: list[tuple] = specs.RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_id string, category string, severity string, pattern string, title string, recommendation string")


def rule_scan(sources: DataFrame, rules: list[tuple] = specs.RULES) -> DataFrame:
    """Findings of the rules on each line of ``sources`` (project_id, path, source).

    Every rule's pattern is a constant in one projection: no join. A text is tagged once with the rules that it meets anywhere (a search for a
    fixed text comes before a pattern, ``specs.NEEDS``), and its lines are held against these only.
    """
    needed = lambda r, low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in specs.NEEDS.get(r[0], [])] or [F.lit(True)])
    tags = spans.let(F.lower("source"), lambda low: F.array_compact(F.array(*[F.when(needed(r, low) & F.col("source").rlike(r[3]), F.lit(i)) for i, r in enumerate(rules)])))
    tagged = sources.select("project_id", "path", "source", tags.alias("tags"))
    lines = tagged.select("project_id", "path", "tags", F.posexplode(F.when(F.size("tags") > 0, F.split("source", "\n"))).alias("n", "line"))
    made = lambda r: F.struct(*[F.lit(v).alias(k) for k, v in zip(("rule_id", "category", "severity", "title", "recommendation"), (*r[:3], *r[4:]))])
    met = [F.when(F.array_contains("tags", i) & F.col("line").rlike(r[3]), made(r)) for i, r in enumerate(rules)]
    return lines.select("project_id", "path", (F.col("n") + 1).alias("line_number"), F.inline(F.array_compact(F.array(*met))))


def unused_permissions(manifests: DataFrame, sources: DataFrame) -> DataFrame:
    """Permissions of each project whose short name is in none of its code.

    Words that are no permission's name are dropped before anything is shuffled: the names go to the tasks while there are at most ``BROADCAST_NAMES`` (counted first).
    """
    wanted = manifests.select("project_id", F.explode("permissions").alias("permission")).distinct()
    wanted = durable(wanted.withColumn("short", F.element_at(F.split("permission", r"\."), -1)), "permissions")
    names = wanted.select("short").distinct()
    names = F.broadcast(names) if names.count() <= BROADCAST_NAMES else names
    words = sources.select("project_id", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"\w+"), F.lit(0)))).alias("short"))
    words = words.join(names, "short", "left_semi").distinct()
    return wanted.join(words, ["project_id", "short"], "left_anti").select("project_id", "permission")


def assemble_report(sections: DataFrame, heading: str = "# Project Documentation\n") -> DataFrame:
    """(project_id, report) from (project_id, key, content): the sections in their order under their titles."""
    place = [x for i, s in enumerate(specs.SECTIONS) for x in (F.lit(s[0]), F.struct(F.lit(i).alias("i"), F.lit(s[1]).alias("title")))]
    rows = sections.withColumn("_s", F.create_map(*place)[F.col("key")]).filter("_s IS NOT NULL")
    part = F.struct(F.col("_s.i").alias("i"), F.concat(F.lit("## "), F.col("_s.title"), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("t"))
    listed = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"])
    return rows.groupBy("project_id").agg(F.array_join(F.concat(F.array(F.lit(heading)), listed), "\n---\n\n").alias("report"))
