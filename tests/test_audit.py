from codeatlas.operators import audit
from pyspark.sql import functions as F


def findings(spark, *answers):
    df = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, raw string")
    return [[(f.severity, f.title, f.location) for f in r.f] for r in df.select("k", audit.parse_findings(F.col("raw")).alias("f")).orderBy("k").collect()]


def test_forms_of_answers(spark):
    one = '{"severity": " high ", "title": "T"}'
    got = findings(spark, f"[{one}]", f"```json\n[{one}]\n```", f"text [{one}] more", one, f"[{one}, 7]", '[{"title": null, "severity": null}]', "[Service error: x]", "[]", "")
    good = [("HIGH", "T", "Unknown")]
    assert got[:5] == [good] * 5 and got[5] == [("INFO", "None", "Unknown")]
    assert got[6] == [("INFO", "Scan Results (unstructured)", "N/A")] and got[7:] == [[], []]


def test_summary_score_and_report(spark):
    results = spark.createDataFrame([("p", "hardcoded_secrets", "Secrets", None), ("p", "performance", "Perf", None), ("p", "memory_leaks", "Leaks", "failed")], "project_id string, category string, display_name string, error string")
    found = spark.createDataFrame([("p", "performance", "Perf", 0, "LOW", "slow", "f", "", "fix"), ("p", "performance", "Perf", 1, "CRITICAL", "bad", "", "d", "")], "project_id string, category string, display_name string, pos int, severity string, title string, location string, description string, recommendation string")
    row = audit.scan_summary(results, found).first()
    assert (row.health_score, row.health_grade, row.categories_scanned, row.categories_clean, row.total_findings) == (83, "B", 3, 1, 2)
    report = audit.scan_report(results, found).first().report
    assert report.index("### 1. [CRITICAL] bad") < report.index("### 2. [LOW] slow") and "**Error:** failed" in report and "No issues found." in report


def test_rules_on_lines(spark):
    source = 'x\ntoken = "abcdefghij"\ncatch (Exception e) { }'
    rows = audit.rule_scan(spark.createDataFrame([("p", "a", source), ("p", "b", None)], "project_id string, path string, source string")).collect()
    assert {(r.line_number, r.rule_id) for r in rows} == {(2, "secret_value"), (3, "empty_catch"), (3, "generic_catch")}
