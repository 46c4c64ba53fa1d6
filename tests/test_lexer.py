import random
import time

import pytest

from codeatlas.functions import lexer
from codeatlas.operators import bodies
from tests.test_parse import files


def code(source, kotlin=False):
    covered = lexer.cover(source, lexer.spans(source, kotlin))
    assert len(covered) == len(source) and covered.count("\n") == source.count("\n")
    return covered.split()


@pytest.mark.parametrize("source, left", [
    ('a /* } " */ b "x\\"}" + \'}\' + \'\\\'\' // "\nc', "a b + + c"), ('x """\n } "q" \\""" } """ d "un}\n e', "x d e"), ("a // b", "a"), ("a /* b", "a"), ('a """ b', "a"), ("'a' 'bc 'd", "'bc 'd"), ("a /* /* } */ b", "a b"), ("", ""),
])
def test_java(source, left):
    assert code(source) == left.split()


@pytest.mark.parametrize("source, left", [
    ('a /* /* } */ x */ b "v ${f("}") + "${g({ 1 })}"} {" c', "a b f( ) + g({ 1 }) c"), ('""" "q" ${h()} { """" d', "h() d"), ('val s = "it\'s" // it\'s }', "val s ="), ('"${ a', "a"), ('"$a ${"$b"} }" z', "z"), ('"un ${ if (x) { y } } }\n w', "if (x) { y } w"),
])
def test_kotlin(source, left):
    assert code(source, True) == left.split()


def test_long_and_random_texts_take_linear_time():
    rng, parts = random.Random(5), ['"', '"""', "'", "//", "/*", "*/", "\\", "${", "{", "}", "\n", "x"]
    begun = time.time()
    for kotlin in (False, True):
        for n in (30, 300, 100_000):
            code("".join(rng.choices(parts, k=n)), kotlin)
        for unit in ('"', '"""', "/*", "'", '"${', "'\\", '"${"', "class A(", "class A<"):
            text = unit * 60_000
            code(text, kotlin)
    assert time.time() - begun < 40


def test_members_beside_braces_in_literals(spark):
    source = 'class A { String s = "}"; void f() { g("{"); } // }\n char c = \'}\'; static { int q; } }\ninterface B { }\nenum C { X }'
    rows = bodies.resolve_members(files(spark, source)).collect()
    assert {(r.class_name, r.kind, r.name) for r in rows} == {("A", "field", "s"), ("A", "method", "f"), ("A", "field", "c")}
    kotlin = "data class Z(val x: Int)\nclass B(val f: () -> Unit = { }) : C({ 1 }), D { val y: Int = 2 }\nobject O"
    assert [(r.class_name, r.name) for r in bodies.resolve_members(files(spark, kotlin, ext=".kt")).collect()] == [("B", "y")]


def test_members_of_hostile_texts_take_linear_time(spark):
    begun = time.time()
    assert bodies.resolve_members(files(spark, "class A(" * 40_000, "class A{" * 40_000, "class A " * 40_000 + "{ int x; }", '"' * 300_000)).count() == 1
    assert time.time() - begun < 30
