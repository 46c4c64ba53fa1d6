import json
import math
import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeatlas.operators import chunk, clusters, diagrams, graph, incremental, parse, vectors
from codeatlas.sources import deltas, files, store
from codeatlas.streaming import index


def test_scan_reads_known_files_and_skips_ignored_folders(spark, tmp_path):
    for name, text in {"src/A.java": "class A {}\r\nx", "build/B.java": "class B {}", "notes.txt": "no", "x/C.KT": "class C", "_B.java": "b", ".github/C.kt": "c", "src/_gen/.D.kt": "", ".gradle/E.kt": "e", "_F.java/.git/G.kt": "g"}.items():
        path = tmp_path / "app" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode() + (b"\xff" if name.endswith("KT") else b""))
    got = {r.relative: r for r in files.scan_files(spark, str(tmp_path / "app"), "p").collect()}
    assert set(got) == {"src/A.java", "x/C.KT", "_B.java", ".github/C.kt", "src/_gen/.D.kt"} and got["src/A.java"].source == "class A {}\nx" and got["x/C.KT"].source.endswith("�") and got["x/C.KT"].extension == ".kt"


def test_index_graph_and_history_round_trips(spark, tmp_path):
    chunks = spark.createDataFrame([("p", "1", "a"), ("q", "2", "b")], "project_id string, id string, content string")
    store.write_index(chunks, str(tmp_path / "i"))
    store.write_index(spark.createDataFrame([("p", "3", "c")], chunks.schema), str(tmp_path / "i"), mode="projects")
    assert {(r.project_id, r.id) for r in spark.read.parquet(str(tmp_path / "i")).collect()} == {("p", "3"), ("q", "2")}
    (tmp_path / "h.json").write_text(json.dumps({"projects": {"/a": {"last_accessed": "2024-01-02T03:04:05", "stats": {"total_files": 2, "chunks": 7}}}, "chats": {"/a": [{"role": "user", "content": "hi"}]}}))
    runs, chats = store.load_history(spark, str(tmp_path / "h.json"))
    assert runs.first().total_files == 2 and [(r.turn, r.role, r.content) for r in chats.collect()] == [(0, "user", "hi")]
    more = runs.unionByName(runs.withColumn("project_path", F.lit("/b")))
    store.save_history(more, chats, str(tmp_path / "out"))
    again, talk = store.load_history(spark, str(tmp_path / "out"))
    assert {r.last_accessed for r in again.collect()} == {runs.first().last_accessed} and again.count() == 2 and talk.count() == 1


def test_graph_of_a_project_is_replaced_as_a_whole(spark, tmp_path):
    node, edge = "project_id string, label string, key string, name string", "project_id string, src_label string, src_key string, rel string, dst_label string, dst_key string"
    nodes = spark.createDataFrame([("p", "File", "f", "f"), ("p", "Class", "c", "c"), ("q", "Class", "d", "d")], node)
    edges = spark.createDataFrame([("p", "Class", "c", "DEFINED_IN", "File", "f"), ("p", "Class", "c", "IMPORTS", "Class", "c"), ("q", "Class", "d", "IMPORTS", "Class", "d")], edge)
    path = str(tmp_path / "g")
    store.write_graph(nodes, edges, path)
    store.write_graph(nodes.filter("label = 'File'"), edges.filter("rel = 'DEFINED_IN'"), path)
    kept, links = store.read_graph(spark, path)
    assert {(r.project_id, r.label) for r in kept.collect()} == {("p", "File"), ("q", "Class")}
    assert {(r.project_id, r.rel) for r in links.collect()} == {("p", "DEFINED_IN"), ("q", "IMPORTS")}
    store.compact_graph(spark, path)
    kept, links = store.read_graph(spark, path)
    assert {(r.project_id, r.rel) for r in links.collect()} == {("p", "DEFINED_IN"), ("q", "IMPORTS")} and kept.count() == 2


def test_files_of_a_stored_graph_are_ranges(spark, tmp_path):
    """Rows of a project and relation are in few files, and the filter on them reaches the scan."""
    rows = [(f"p{k % 20:02}", "Class", f"c{k}", ["CALLS", "IMPORTS", "OF_TYPE"][k % 3], "Class", f"d{k}") for k in range(6000)]
    edges = spark.createDataFrame(rows, "project_id string, src_label string, src_key string, rel string, dst_label string, dst_key string")
    nodes = edges.select("project_id", F.lit("Class").alias("label"), F.col("src_key").alias("key"), F.col("src_key").alias("name"))
    path = str(tmp_path / "g")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_graph(nodes, edges, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mine = store.read_graph(spark, path)[1].filter("project_id = 'p07' AND rel = 'IMPORTS'")
    stored = spark.read.parquet(f"{path}/edges/delta/*/rows")
    held = lambda df: df.select(F.input_file_name()).distinct().count()
    assert mine.count() == 100 and held(stored.filter("project_id = 'p07' AND rel = 'IMPORTS'")) <= 2 < held(stored)
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(project_id,p07)" in plan and "EqualTo(rel,IMPORTS)" in plan


def test_stream_keeps_the_index_up_to_date(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "index")
    listing = lambda *rows: spark.createDataFrame([("p", n, n, ".java", len(t or ""), datetime(2024, 1, day), t) for n, t, day in rows], index.FILES)
    drops = ([("A.java", "class A {}  ", 1), ("B.java", "class B {}", 1), ("C.java", "class C {}", 1)], [("A.java", "class A2 {}        ", 2), ("A.java", "class A3 {}", 3), ("C.java", None, 2)])
    for rows in drops:
        listing(*rows).coalesce(1).write.mode("append").parquet(str(source))
        index.start_index(index.file_stream(spark, str(source)), out, str(tmp_path / "ck"), available_now=True).awaitTermination(120)
        spark.catalog.clearCache()
    assert {r.component_name for r in index.read_index(spark, out).collect()} == {"A3", "B"}


def _size(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_deltas_grow_with_the_change_and_replays_are_applied_once(spark, tmp_path):
    path, schema = str(tmp_path / "i"), "project_id string, file_path string, id string, content string"
    many = spark.createDataFrame([("p", f"f{k}", f"i{k}", f"text {k} " * 20) for k in range(2000)], schema)
    assert deltas.read(spark, path) is None and deltas.compact(spark, path) is None
    assert deltas.apply(many, many.select("project_id", "file_path"), path, "s", 0) == 1
    whole = _size(tmp_path / "i" / "delta")
    one = spark.createDataFrame([("p", "f7", "i7", "new"), ("p", "f7", "i7b", "more")], schema)
    touched = spark.createDataFrame([("p", "f7"), ("p", "f8"), ("q", "none")], "project_id string, file_path string")
    assert deltas.apply(one, touched, path, "s", 1) == 2 and deltas.apply(one, touched, path, "s", 1) is None and deltas.apply(many, touched, path, "s", 0) is None
    assert _size(tmp_path / "i" / "delta") - whole < whole / 10
    alive = lambda v=None: {(r.file_path, r.content) for r in deltas.read(spark, path, v).collect()}
    want = alive()
    assert len(want) == 2000 and {("f7", "new"), ("f7", "more")} < want and not any(f == "f8" for f, _ in want) and len(alive(1)) == 2000 and ("f8", "text 8 " * 20) in alive(1)
    assert deltas.compact(spark, path) == 3 and deltas.compact(spark, path) is None and alive() == want
    (tmp_path / "i" / "delta" / "9-broken" / "rows").mkdir(parents=True)
    assert deltas.vacuum(spark, path) == 3 and alive() == want
    assert deltas.apply(one.limit(0), touched.limit(1), path) == 4 and len(alive()) == 1998


def test_a_wide_folder_and_a_chain_are_listed_in_rounds(spark, tmp_path):
    (tmp_path / "t" / "flat").mkdir(parents=True)
    for k in range(3000):
        (tmp_path / "t" / "flat" / f"F{k}.java").write_text("")
    deep = tmp_path / "t"
    for k in range(30):
        deep = deep / "down"
        deep.mkdir()
        (deep / f"D{k}.java").write_text("x")
    (tmp_path / "t" / "loop").symlink_to(tmp_path / "t")
    found = files.walk(spark, str(tmp_path / "t"), entries=10)
    assert found.groupBy("kind").count().collect() == [("file", 3030)] and found.filter("size = 1").count() == 30
    assert found.agg(F.max(F.length("relative"))).first()[0] == len("down/" * 30 + "D29.java")
    texts = files.scan_files(spark, str(tmp_path / "t"), "p")
    assert texts.select(F.spark_partition_id()).distinct().count() > 2 and texts.count() == 3030
    with pytest.raises(OSError):
        files.walk(spark, str(tmp_path / "none"))


def test_what_cannot_be_read_is_a_row_of_the_errors(spark, tmp_path, monkeypatch):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "A.java").write_text("class A {}")
    rows, errors = files.scan(spark, str(tmp_path / "t"), "p")
    assert [r.source for r in rows.collect()] == ["class A {}"] and errors.count() == 0
    lost = rows.drop("source").withColumns({"relative": F.lit("B.java"), "path": F.lit(str(tmp_path / "t" / "B.java"))})
    rows, errors = files.read_files(rows.drop("source").unionByName(lost), str(tmp_path / "t"))
    assert {(r.relative, r.source) for r in rows.collect()} == {("A.java", "class A {}"), ("B.java", "")}
    assert [(r.project_id, r.path.rpartition("/")[2]) for r in errors.collect()] == [("p", "B.java")] and errors.first().error
    gone = list(files._open_folders([pa.RecordBatch.from_pydict({"path": [str(tmp_path / "gone"), str(tmp_path / "t")]})], str(tmp_path), 100))
    assert sorted(r["kind"] for b in gone for r in b.to_pylist()) == ["error", "file"]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "there"

    monkeypatch.setattr(files.time, "sleep", lambda s: None)
    assert files._tried(flaky) == "there" and len(calls) == 3


def test_digest_tree_names_changed_files(spark):
    schema = "project_id string, path string, size long"
    rng = random.Random(3)
    old = {(f"p{k % 3}", f"/f{k}"): rng.randrange(100) for k in range(900)}
    new = {f: n + (i % 97 == 0) for i, (f, n) in enumerate(old.items()) if i % 101}
    new |= {("p1", "/new"): 5, ("p9", "/only"): 1}
    table = lambda files: spark.createDataFrame([(*f, n) for f, n in files.items()], schema)
    leaves = [incremental.digest_leaves(table(x)) for x in (new, old)]
    want = {(*f, "added" if f not in old else "removed" if f not in new else "changed") for f in old | new if old.get(f) != new.get(f)}
    assert {tuple(r) for r in incremental.changed_files(table(new), table(old), *leaves).collect()} == want and len(want) > 15
    roots = {r.project_id: r.digest for r in incremental.digest_roots(leaves[0]).collect()}
    again = {r.project_id: r.digest for r in incremental.digest_roots(incremental.digest_leaves(table(new).repartition(7))).collect()}
    assert roots == again and len(set(roots.values())) == 4
    assert {r.project_id for r in incremental.digest_roots(leaves[1]).collect() if r.digest == roots[r.project_id]} == set()
    assert incremental.changed_files(table(old), table(old), leaves[1], leaves[1]).count() == 0


def test_embed_and_search(spark):
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(["red blue", "green", "red red", "blue"])], "id long, content string")
    stored = vectors.embed(chunks, vectors.hashing_embedder(16), batch_size=3)
    query = vectors.hashing_embedder(16)(["red"])[0]
    assert vectors.search(stored, query, top_k=1).first().id == 2
    many = vectors.search_many(stored, spark.createDataFrame([(7, query, 2)], "query_id long, embedding array<double>, top_k int"))
    assert [(r.query_id, r.id) for r in many.orderBy("rank").collect()][0] == (7, 2)


def test_search_leaves_out_vectors_without_a_direction(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [0.0, 0.0], "x"), (3, None, "x"), (4, [1.0], "x"), (5, [None, 1.0], "y"), (6, [0.9, 0.1], "y"), (7, [2.0, 0.0], "y"), (8, [-1.0, 0.0], "x")]
    stored = spark.createDataFrame(rows, "id long, embedding array<double>, kind string")
    asked = [(1, [1.0, 0.0], 3, None), (2, [1.0, 0.0], 9, "y"), (3, [0.0, 0.0], 3, None), (4, None, 3, None), (5, [0.0, 5.0], 2, "none")]
    many = vectors.search_many(stored, spark.createDataFrame(asked, "query_id long, embedding array<double>, top_k int, kind string"), filters=("kind",))
    found = [(r.query_id, r.rank, r.id) for r in many.orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, 1), (1, 2, 7), (1, 3, 6), (2, 1, 7), (2, 2, 6)]
    assert [r.id for r in vectors.search(stored, [1.0, 0.0], 3).collect()] == [1, 7, 6] and vectors.search(stored, [0.0, 0.0], 3).count() == 0
    none = vectors.search_many(stored.limit(0), spark.createDataFrame(asked, "query_id long, embedding array<double>, top_k int, kind string"))
    assert none.count() == 0


@pytest.mark.parametrize("limit", [64_000_000, 4000])
def test_search_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(vectors, "QUERY_BYTES", limit)  # the smaller one takes several passes
    monkeypatch.setattr(vectors, "ROW_BLOCK", 50)
    rng = random.Random(5)
    rows = [(f"i{k}", [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)], rng.choice("ab")) for k in range(400)]
    asked = [(k, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(4)], rng.randrange(1, 30), rng.choice(["a", "b", None])) for k in range(60)]
    stored = spark.createDataFrame(rows, "id string, embedding array<float>, kind string").repartition(5)
    many = vectors.search_many(stored, spark.createDataFrame(asked, "query_id long, embedding array<float>, top_k int, kind string"), filters=("kind",)).collect()
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    for q, v, k, kind in asked:
        near = sorted((round(1 - sum(a * b for a, b in zip(unit(v), unit(w))), 9), i) for i, w, c in rows if any(w) and kind in (None, c))[:k]
        got = sorted((r.rank, round(r.distance, 9)) for r in many if r.query_id == q)
        assert [d for _, d in got] == pytest.approx([d for d, _ in near], abs=1e-8)


@pytest.mark.parametrize("limit, conditions", [(64_000_000, 256), (9000, 2)])
def test_clusters_give_what_a_full_scan_gives_and_compare_less(spark, tmp_path, monkeypatch, limit, conditions):
    monkeypatch.setattr(vectors, "QUERY_BYTES", limit)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 32)
    monkeypatch.setattr(clusters, "CONDITIONS", conditions)
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    near = lambda: [x + rng.gauss(0, 0.15) for x in rng.choice(centres)]
    rows = [(f"i{k}", near(), rng.choice("ab")) for k in range(1500)] + [("zero", [0.0] * 8, "a"), ("null", None, "a"), ("short", [1.0, 2.0], "b"), ("hole", [None] + [1.0] * 7, "a")] + [(f"c{k}", centres[0], "b") for k in range(30)]
    asked = [(k, near(), rng.randrange(1, 12), rng.choice(["a", "b", None])) for k in range(40)] + [(50, centres[0], 5, None), (51, [0.0] * 8, 5, None), (52, None, 5, None), (53, near(), 4, "none"), (54, near(), 2000, None)]
    stored = spark.createDataFrame(rows, "id string, embedding array<float>, kind string").repartition(5)
    queries, path, counters = spark.createDataFrame(asked, "query_id long, embedding array<float>, top_k int, kind string"), str(tmp_path / "c"), {}
    clusters.write_clusters(stored, path, pivots=12)
    assert spark.read.parquet(f"{path}/rows").count() == len(rows)
    got = clusters.search_clusters(spark, path, queries, ("kind",), counters=counters).collect()
    want = vectors.search_many(stored, queries, ("kind",)).collect()
    key = lambda r: (r.query_id, r["rank"], round(r.distance, 7))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 1500
    assert counters["pairs"].value < 0.5 * len(rows) * len(asked)
    clusters.write_clusters(stored.limit(0), path)
    assert clusters.search_clusters(spark, path, queries, ("kind",)).count() == 0


def test_steps_of_any_depth(spark):
    step = {"label": "deep"}
    for _ in range(20):
        step = {"step_type": "decision", "yes_steps": [step], "no_steps": [{"label": "n"}, {"label": "m"}]}
    docs = spark.createDataFrame([(1, "activity_diagram", json.dumps({"steps": [step]})), (2, "activity_diagram", "{}")], "diagram_id int, diagram_type string, json string")
    rows = diagrams.parse_steps(docs).collect()
    assert len(rows) == 61 and max(r.depth for r in rows) == 20 and sum(r.label == "deep" for r in rows) == 1 and diagrams.parse_steps(docs.limit(0)).count() == 0


def test_summary_counts_calls_without_making_them(spark):
    text = "package x;\nclass A{k} { void go() { run(); go(); } void run() { go(); } }"
    rows = [("p", f"/A{k}.java", f"A{k}.java", ".java", 1, None, text.replace("{k}", str(k))) for k in range(4)]
    parsed = parse.parse_files(spark.createDataFrame(rows, index.FILES))
    summary = lambda df: {(r.kind, r.name): r["count"] for r in df.collect()}
    assert summary(graph.summary_of(parsed)) == summary(graph.graph_summary(*graph.build_graph(parsed)))


def test_graph_edges_end_in_nodes(spark):
    rows = [("p", f"/{n}.java", f"{n}.java", ".java", 1, None, t) for n, t in {"A": "package x;\nclass A extends B implements I {\n void go() { B b; helpMe(); }\n}", "B": "package y;\nimport x.A;\nclass B { A a; void helpMe() { go(); } }"}.items()]
    nodes, edges = graph.build_graph(parse.parse_files(spark.createDataFrame(rows, index.FILES)))
    known, links = {(r.label, r.key) for r in nodes.collect()}, edges.collect()
    assert all((e.src_label, e.src_key) in known and (e.dst_label, e.dst_key) in known for e in links)
    found = {(e.rel, e.src_key, e.dst_key) for e in links}
    assert {("INHERITS_FROM", "x.A", "y.B"), ("IMPLEMENTS", "x.A", "I"), ("IMPORTS", "y.B", "x.A"), ("CALLS", "x.A.go", "y.B.helpMe"), ("CALLS", "y.B.helpMe", "x.A.go")} <= found
    paths = graph.call_chain(edges, spark.createDataFrame([("p", "x.A.go")], "project_id string, key string"), 3).collect()
    assert sorted(r.length for r in paths) == [1, 2]


def test_diagram_references_and_errors(spark):
    sequence = {"participants": [{"name": "UserRepository", "alias": "repo"}, {"name": "View"}], "messages": [{"sender": "UR", "receiver": "REPO", "label": "x"}, {"sender": "view", "receiver": "Ghost", "label": "y"}]}
    packages = {"packages": [{"name": "a", "classes": ["X", "x"]}, {"name": "b", "classes": ["X"]}], "relationships": [{"source": "com.X", "target": "A"}]}
    docs = spark.createDataFrame([(1, "sequence_diagram", json.dumps(sequence)), (2, "package_diagram", json.dumps(packages)), (3, "state_diagram", "{}")], "diagram_id int, diagram_type string, json string")
    entities, links = diagrams.dedupe_entities(diagrams.parse_entities(docs)), diagrams.parse_relationships(docs)
    for end in ("source", "target"):
        links = diagrams.resolve_references(links, entities, end)
    assert sorted((r.diagram_id, r.source, r.target) for r in links.collect()) == [(1, "UserRepository", "UserRepository"), (1, "View", "Ghost"), (2, "X", "a")]
    errors = {(r.diagram_id, r.check, r.subject) for r in diagrams.integrity_errors(docs, entities, links, diagrams.parse_notes(docs)).collect()}
    assert errors == {(1, "undeclared endpoint", "Ghost"), (2, "class in several packages", "X"), (3, "no entities", ""), (3, "no transitions", ""), (3, "no initial transition", "")}


def test_chunk_ids_are_stable(spark):
    rows = [("p", "/A.java", "A.java", ".java", 1, None, "class A {}")]
    ids = lambda: [r.id for r in chunk.chunk_files(parse.parse_files(spark.createDataFrame(rows, index.FILES))).collect()]
    assert ids() == ids() and len(set(ids())) == 1
