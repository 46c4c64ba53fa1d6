import duckdb
import pytest

import __spark_entry__ as entry
from codeatlas.plans import registry
from tests.conftest import SMALL

FEW = ["a2_components_by_layer", "k2_class_chunks", "g12_calls", "q7_pack_context", "f4_f5_scan_summary", "v5_search_many", "h1_latest_runs", "i2_changed_projects", "s1_scan_files", "s7_write_and_read_graph", "s8_history_round_trip", "f6_scan_report", "v5_search_chunks", "g19_graph_summary", "d7_errors_of_other_kinds", "g13_members_beside_literals", "f7_span_scan", "i2_changed_files"]


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES) and len(registry.QUERIES) > 80
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FEW)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SMALL), con.sql(registry.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_prompts_hold_what_was_retrieved(spark):
    rows = registry.QUERIES["q12_audit_prompts"](spark, SMALL).collect()
    assert len(rows) == 10 and all("### [CLASS]" in r.prompt and "STRUCTURAL CONTEXT" in r.prompt and r.prompt.endswith("ANSWER:\n") for r in rows)
    assert {r.query_id for r in rows if "TASK: Find what is slow." in r.prompt} == {"performance"} and any("You are deepseek-coder" in r.prompt for r in rows)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
