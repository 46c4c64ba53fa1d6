import time

from codeatlas.functions import specs
from codeatlas.operators import spans
from tests.test_parse import files


def found(spark, source, ext=".java"):
    return sorted((r.rule_id, r.line_number) for r in spans.span_scan(files(spark, source, ext=ext)).collect())


def test_rules_over_lines_and_scopes(spark):
    source = """class A {
  void onDraw(int x) { db.rawQuery(
      "a" + x); }
  void other() { db.rawQuery(q); try { f(); } catch (E e)
  {
    // "not" { empty? } no statement
  } while (a(b())) { if (x) { p = new
    Big(); } new Small(); }
    new Outside(); }
  static final Context c;
}"""
    assert found(spark, source) == [("allocation_in_loop", 7), ("allocation_in_loop", 8), ("empty_catch_block", 4), ("io_in_callback", 2), ("joined_sql", 2), ("static_view", 10)]


def test_kotlin_and_other_files(spark):
    source = 'fun onCreate() { val t = "rawQuery( ${url.openConnection()} " }\nfun later() { url.openConnection() }\nfun g() { try { } catch (e: E) { } }'
    assert found(spark, source, ".kt") == [("empty_catch_block", 3), ("io_in_callback", 1)]
    assert found(spark, source, ".xml") == [] and found(spark, "") == [] and found(spark, "catch (") == []


def test_every_rule_is_known_and_long_texts_take_linear_time(spark):
    assert len({r[0] for r in specs.SPAN_RULES}) == len(specs.SPAN_RULES) and {r[2] for r in specs.SPAN_RULES} <= set(specs.SEVERITIES)
    begun = time.time()
    many = "for (;;) { new A();\n" * 20_000
    assert len(found(spark, many)) == 20_000
    for unit in ("catch (", "for (", "while(x){", "void onCreate(", "try{}catch(E e){}"):
        found(spark, unit * 30_000)
    assert time.time() - begun < 60
