import random
import re
import time

import pytest

from codeatlas.functions import rules, spans
from codeatlas.operators import bodies, chunk, parse
from pyspark.sql import functions as F

FILES = "project_id string, path string, relative string, extension string, size long, source string"


def files(spark, *sources, ext=".java"):
    return spark.createDataFrame([("p", f"/a/F{k}{ext}", f"F{k}{ext}", ext, len(s), s) for k, s in enumerate(sources)], FILES)


def classes(spark, *sources):
    rows = parse.explode_classes(parse.parse_code(files(spark, *sources))).collect()
    return [(r.name, r.superclass, r.interfaces) for r in rows]


def test_class_pattern_oddities(spark):
    got = classes(spark, "enum class Foo", "class K(val x: Int) : Base()", "class A extends B implements C, D {", "interface A extends B, C {", "class G<T> : X(), Y {")
    assert got == [("class", "", []), ("K", "", []), ("A", "B", ["C", "D"]), ("A", "B", ["C"]), ("G", "X", [])]


@pytest.mark.parametrize(("gap", "found"), [(299 - 2, ["X"]), (301, [])])
def test_annotations_in_the_300_characters_before(spark, gap, found):
    code = parse.parse_code(files(spark, "@X" + " " * gap + "class A {}"))
    assert code.first().classes[0].annotations == found


def test_methods_fields_and_newlines(spark):
    code = parse.parse_code(files(spark, "package a.b;\r\nclass A {\n return x;\n when(x) {\n void run( int a ) { }\n if (y) { }\n val z: Int\n}")).first()
    assert code.package == "a.b" and [m.name for m in code.methods] == ["when", "run"] and code.methods[1].params == "int a"
    assert [(f.type, f.name) for f in code.fields] == [("return", "x"), ("Int", "z")]


def test_kinds_and_empty_files(spark):
    rows = [("p", p, p, "", 1, s) for p, s in [("a.kt", "x"), ("b.properties", "x"), ("AndroidManifest.xml", "<x>"), ("l.xml", "<manifest>"), ("m.xml", "<A/>"), ("build.gradle.kts", "y"), ("e.java", ""), ("n.java", None)]]
    got = {r.path: r.kind for r in parse.classified(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {"a.kt": "code", "AndroidManifest.xml": "manifest", "l.xml": "manifest", "m.xml": "layout", "build.gradle.kts": "gradle"}


def test_build_pattern_needs_a_bracket(spark):
    text = "implementation 'no'\nimplementation(\"yes:1\")\nid(\"plug\")\nminSdkVersion 21\ntargetSdk = 30"
    row = parse.parse_builds(files(spark, text, ext=".gradle")).first()
    assert (row.dependencies, row.plugins, row.min_sdk, row.target_sdk) == (["yes:1"], ["plug"], "", "30")


def test_method_bodies():
    source = "int a() { return b(); }\n  public void b() { if (x) { y(); } }\nvoid c() { {"
    assert bodies.bodies_of(source, {"a", "b", "c", "d"}) == {
        "a": "int a() { return b(); }", "b": "return b(); }\n  public void b() { if (x) { y(); } }", "c": "void c() { {", "d": "",
    }
    assert bodies.bodies_of("prerun() { } run() { x }", {"run"}) == {"run": "run() { }"}  # the end of a longer word comes first


def test_guarded_patterns_find_what_plain_ones_find():
    rng = random.Random(4)
    method = re.compile(r"(?:fun\s+)?(\w+)\s*\(([^)]*)\)\s*(?::\s*([\w<>\[\]?,]+))?\s*\{")
    field = re.compile(r"(?:val|var)\s+(\w+)\s*:\s*([\w<>\[\]?,]+)|([\w<>\[\]?,]+)\s+(\w+)\s*[;=]")
    parts = ["val", "var", "fun", "x", "List<A>", "é", " ", "\n", "(", ")", "{", ":", ";", "=", ",", "[]", "1"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(25)))
        assert bodies.METHOD_HEAD.findall(text) == method.findall(text)
        assert [m[0] for m in bodies.FIELD_HEAD.finditer(text)] == [m[0] for m in field.finditer(text)]


def test_long_texts_are_parsed_in_time_linear_in_their_length(spark):
    blob = "A" * 200_000
    many = "".join(f"@M{k} class C{k} extends B{{ void m{k}() {{ n{k}(); }} }}\n" for k in range(9000))
    begun = time.time()
    code = parse.parse_code(files(spark, many[:500_000], blob, f'String s = "{blob}";'))
    rows = chunk.with_bodies(code).groupBy("path").count().collect()
    n = many[:500_000].count("class ")
    assert max(r["count"] for r in rows) >= n - 1 and bodies.resolve_members(files(spark, many, blob)).count() == 9000
    assert {len(c.annotations) for r in code.collect() for c in r.classes} <= set(range(8))
    assert time.time() - begun < 60


def test_pieces_of_texts(spark):
    rng = random.Random(1)
    texts = ["", "x", "1", "a1b", "".join(rng.choice("ab12 é\U0001f600,") for _ in range(9000)), "1,2,3," * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit("[0-9]+"), F.lit(0)).alias("f"), F.split("t", "[0-9]+", -1).alias("g"))
    cut = lambda f: f(F.col("f"), F.col("g"), 7, 1)
    for r in df.select("t", spans.starts(F.col("f"), F.col("g")).alias("s"), cut(spans.texts_before).alias("b"), cut(spans.texts_after).alias("a")).collect():
        found = list(re.finditer("[0-9]+", r.t))
        assert r.s == [m.start() for m in found]
        assert (r.b, r.a) == ([r.t[max(0, m.start() - 7) : m.start()] for m in found], [r.t[m.end() : m.end() + 7] for m in found])


def test_members_belong_to_the_enclosing_class(spark):
    source = "class A { String f; void m() { int q = 1; } class B { long g; void n(int a) { } } }"
    rows = bodies.resolve_members(files(spark, source)).collect()
    assert {(r.class_name, r.kind, r.name) for r in rows} == {("A", "field", "f"), ("A", "method", "m"), ("B", "field", "g"), ("B", "method", "n")}


def test_method_chunks_need_more_than_60_characters(spark):
    body = lambda n: "void m() { " + "x" * (n - 13) + " }"
    code = parse.parse_code(files(spark, body(60), body(61)))
    assert [len(r.content) for r in chunk.method_chunks(code).collect()] == [61]


def test_rules_in_order(spark):
    df = spark.createDataFrame([("XViewModel", "BaseFragment", ["Dao"]), ("FooDao", "", []), ("Foo", "", ["Module"])], "n string, s string, a array<string>")
    kind = rules.component_type(F.col("n"), F.col("s"), F.col("a"))
    got = [tuple(r) for r in df.select(kind.alias("k"), rules.layer(kind, F.col("n"), F.col("s"), F.col("a")).alias("l")).collect()]
    assert got == [("Fragment", "UI"), ("DAO", "Data"), ("DI Module", "DI")]
