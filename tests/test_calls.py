"""CALLS edges are as many as callers times definitions: they are joined where they are asked for, and stored and counted by name."""

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import chunk, graph, maintain, parse
from codeatlas.plans import corpus
from codeatlas.sources import store
from codeatlas.sources.scratch import durable
from codeatlas.streaming import index
from tests.conftest import SMALL

MANY = 30


@pytest.fixture(scope="module")
def parsed(spark):
    text = "package x;\nclass A{k} { A{k} a; void go() { run(); } void run() { other(); } }"
    return parse.parse_files(spark.createDataFrame([("p", f"/A{k}.java", f"A{k}.java", ".java", 1, None, text.replace("{k}", str(k))) for k in range(MANY)], index.FILES))


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_neighbours_of_classes_make_no_calls(spark):
    nodes, edges = corpus.stored_graph(spark, SMALL)
    names = nodes.filter("label = 'Class' AND name LIKE '%Repository'").select("project_id", "name")
    for found in (graph.class_dependencies(nodes, edges, names), graph.class_dependents(nodes, edges, names)):
        assert "definitions-" not in "".join(found.inputFiles()) and found.count()
    assert edges.filter("rel = 'CALLS'").count()


def test_calls_are_stored_and_counted_by_name(spark, parsed, tmp_path):
    nodes, edges, called, known = graph.build_parts(parsed)
    store.write_graph(nodes, edges, str(tmp_path), called, known)
    kinds = ("nodes", "edges", "called", "known")
    assert sum(spark.read.parquet(f"{tmp_path}/{k}/delta/*/rows").count() for k in kinds) < 20 * MANY
    again, links = store.read_graph(spark, str(tmp_path))
    assert _rows(links.select(*graph.EDGE)) == _rows(graph.build_graph(parsed)[1].select(*graph.EDGE)) and links.filter("rel = 'CALLS'").count() == MANY * MANY
    assert graph.call_counts(*store.read_parts(spark, str(tmp_path))[2:]).collect() == [("p", MANY * MANY)]
    summary = lambda df: _rows(df.select("kind", "name", "count", "place"))
    assert summary(graph.graph_summary(nodes, edges, called, known)) == summary(graph.graph_summary(again, links))
    store.write_graph(nodes.filter("label = 'File'"), edges.filter("rel = 'DEFINED_IN'"), str(tmp_path))  # the project anew, without calls
    assert {r.rel for r in store.read_graph(spark, str(tmp_path))[1].select("rel").distinct().collect()} == {"DEFINED_IN"}


def test_calls_are_made_in_many_tasks(spark, parsed):
    """The callers of one name are in several tasks, whatever their bytes."""
    made = graph.calls(parsed["code"])
    assert made.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 3


def _nodes_of(plan):
    """All operators of a physical plan that has run."""
    kind, below = plan.getClass().getSimpleName(), []
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(k) for k in range(plan.children().size())]
    return [(kind, plan), *[x for p in below for x in _nodes_of(p)]]


def test_calls_are_joined_in_blocks(spark, monkeypatch):
    """The join gives a row for each block of definitions, not for each edge; no edge is lost or doubled, and a method that calls its name is not linked to itself."""
    known = [("p", n, f"x.A{k}.{n}") for n in ("run", "go") for k in range(200)] + [("q", "run", "x.A0.run")]
    called = [(p, s, w) for p, _, s in known for w in ("run", "none")] + [("p", "x.A1.rerun", "run"), ("p", "y.run", "run")]
    wanted = sorted((p, "Method", s, "CALLS", "Method", d) for p, s, w in called for q, n, d in known if (p, w) == (q, n) and s != d)
    for size in (graph.BLOCK, 7):
        monkeypatch.setattr(graph, "BLOCK", size)
        made = graph.call_edges(spark.createDataFrame(called, "project_id string, src string, wanted string"), spark.createDataFrame(known, "project_id string, wanted string, dst string"))
        assert _rows(made) == wanted
        joins = [p.metrics().apply("numOutputRows").value() for kind, p in _nodes_of(made._jdf.queryExecution().executedPlan()) if "Join" in kind]
        assert joins and max(joins) < len(wanted) / 3


def test_all_edges_come_together_in_blocks(spark, monkeypatch):
    """What goes through the union of all edges are blocks and not every CALLS edge; no edge is lost or doubled, and only CALLS edges from a method to itself are left out."""
    known = [("p", n, f"x.A{k}.{n}") for n in ("run", "go") for k in range(150)] + [("q", "run", "x.A0.run")]
    called = [(p, s, w) for p, _, s in known for w in ("run", "none")] + [("p", "x.A1.rerun", "run"), ("p", "y.run", "run")]
    plain = [("p", "Class", f"x.A{k}", "INHERITS_FROM", "Class", f"x.A{k // 2}") for k in range(9)] + [("q", "Class", "x.A0", "HAS_METHOD", "Method", "x.A0.run")]
    wanted = sorted(plain + [(p, "Method", s, "CALLS", "Method", d) for p, s, w in called for q, n, d in known if (p, w) == (q, n) and s != d])
    frames = [spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names)) for rows, names in ((plain, graph.EDGE), (called, ["project_id", "src", "wanted"]), (known, ["project_id", "wanted", "dst"]))]
    for size in (graph.BLOCK, 7):
        monkeypatch.setattr(graph, "BLOCK", size)
        made = graph.with_calls(*frames)
        assert _rows(made) == wanted
        (union,) = [p for kind, p in _nodes_of(made._jdf.queryExecution().executedPlan()) if kind == "UnionExec"]
        counts = [p.metrics().apply("numOutputRows").value() for _, p in _nodes_of(union) if p.metrics().contains("numOutputRows")]
        assert counts and max(counts) < len(wanted) / 3
        assert _rows(made.filter("rel <> 'CALLS'")) == sorted(plain) and made.groupBy("rel").count().count() == 3


def test_walks_are_dealt_over_tasks(spark, parsed):
    """Paths by names are those by edges, and the paths over one name are made in several tasks."""
    called, known = graph.method_calls(parsed["code"]), graph.definitions(parsed["code"])
    starts = spark.createDataFrame([("p", "x.A0.go"), ("p", "x.A1.go")], "project_id string, key string")
    found = graph.expand_walks(graph.call_walks(called, known, starts, 2), called, known, 2)
    assert _rows(found) == _rows(graph.call_chain(graph.calls(parsed["code"]), starts, 2))
    assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1


def test_last_steps_of_walks_are_joined_in_blocks(spark, monkeypatch):
    """What is joined for the last step are blocks and not every path; paths that come back over an edge or to their own method are as by edges."""
    known = [("p", n, f"x.A{k}.{n}") for n in ("run", "go") for k in range(20)]
    called = [("p", s, w) for _, n, s in known for w in ("run", "go", "none") if w != n]
    called, known = spark.createDataFrame(called, "project_id string, src string, wanted string"), spark.createDataFrame(known, "project_id string, wanted string, dst string")
    starts = spark.createDataFrame([("p", "x.A0.run"), ("p", "x.A3.go")], "project_id string, key string")
    edges = durable(graph.call_edges(called, known), "walk-edges")
    for size, depth, classes in ((graph.BLOCK, 3, 20), (7, 3, 20), (3, 4, 6)):
        monkeypatch.setattr(graph, "BLOCK", size)
        few = lambda df, *names: df.filter(" AND ".join(f"CAST(regexp_extract({c}, '[.]A([0-9]+)[.]', 1) AS INT) < {classes}" for c in names))  # noqa: B023, E731
        made = graph.expand_walks(graph.call_walks(few(called, "src"), few(known, "dst"), starts, depth), few(called, "src"), few(known, "dst"), depth)
        got = _rows(made)
        assert got == _rows(graph.call_chain(few(edges, "src_key", "dst_key"), starts, depth))
        joins = [p.metrics().apply("numOutputRows").value() for kind, p in _nodes_of(made._jdf.queryExecution().executedPlan()) if "Join" in kind]
        assert joins and max(joins) < len(got) / 3


def test_maintained_calls_are_joined_when_read(spark, parsed, tmp_path):
    code = parsed["code"]
    maintain.update_edges(code, code.select("project_id", "path"), str(tmp_path))
    assert not spark.read.parquet(f"{tmp_path}/edges/delta/*/rows").filter("rel = 'CALLS'").count()
    gone = code.filter("path = '/A0.java'").select("project_id", "path")
    maintain.update_edges(code.limit(0), gone, str(tmp_path))
    left = maintain.read_edges(spark, str(tmp_path))
    assert left.filter("rel = 'CALLS'").count() == (MANY - 1) ** 2 and not left.filter("src_key LIKE 'x.A0.%' OR dst_key LIKE 'x.A0.%'").count()


def test_a_change_reads_each_file_once(spark, parsed, tmp_path):
    """References, names and direct edges of a change come from one pass over its files."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    code = durable(parsed["code"], "read-once")
    seen = code.withColumn("package", counted.asNondeterministic()("package"))
    maintain.update_edges(seen, code.select("project_id", "path"), str(tmp_path))
    assert read.value == MANY
    assert _rows(maintain.read_edges(spark, str(tmp_path)).select(*graph.EDGE)) == _rows(graph.build_graph(parsed)[1].select(*graph.EDGE))


def test_method_texts_are_made_once(spark):
    source = "class A {\n" + "".join(f"    void m{k}(int a) {{ if (a > {k}) {{ go(); }} }}\n" for k in range(3)) + "}\n"
    files = spark.createDataFrame([("p", f"/src/p/A{k}.java", source if k % 7 else "class A { }") for k in range(600)], "project_id string, path string, source string")
    code = durable(parse.parse_code(files), "bodies-test")
    rows = chunk.with_bodies(code).filter("length(body) > 10").select("path", "pos", "name", "body")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted((f"/src/p/A{k}.java", m, f"m{m}", f"void m{m}(int a) {{ if (a > {m}) {{ go(); }} }}") for k in range(600) if k % 7 for m in range(3))
