import pytest

from codeatlas.functions import text as tx
from codeatlas.operators import context
from pyspark.sql import functions as F

RANKED = "query_id long, rank int, file_path string, component_name string, component_type string, layer string, chunk_type string, content string"


def pack(documents, limit):
    blocks, total, seen = [], 0, set()
    for k, doc in documents:
        if not doc or k in seen:
            continue
        seen.add(k)
        header = f"[CLASS] {k} (Class, Layer: UI)"
        block, gap = f"### {header}\n{doc}", 7 if blocks else 0
        if total + gap + len(block) > limit:
            rest = limit - total
            if blocks and rest < 240:
                break
            cut = doc[: max(rest - len(header) - 32, 120)].rstrip()
            block = f"### {header}\n{cut + (tx.TRUNCATED if cut != doc else '')}"
            if blocks and total + gap + len(block) > limit:
                break
        blocks.append(block)
        total += gap + len(block)
    return tx.SEPARATOR.join(blocks) or tx.NO_CONTEXT


@pytest.mark.parametrize("sizes", [[100, 100], [900], [500, 260, 500, 20], [500, 257], [330, 330, 330, 5], [0], [120, 120, 120, 120, 120, 400]])
def test_pack_context_matches_the_fold(spark, sizes):
    documents = [(f"C{k % 5}", "word " * (n // 5)) for k, n in enumerate(sizes)]
    rows = [(1, k, n, n, "Class", "UI", "CLASS", d) for k, (n, d) in enumerate(documents)]
    got = context.pack_context(spark.createDataFrame(rows, RANKED), max_chars=700).collect()
    want = pack(documents, 700)
    assert [r.context for r in got] == ([want] if any(d for _, d in documents) else [])


def test_responses(spark):
    df = spark.createDataFrame([("<think>a</think> hi <|EOT|>\n\n\n\nx<think>open",)], "t string")
    assert df.select(tx.clean_response(F.col("t"))).first()[0] == "hi \n\nx"
    made = spark.createDataFrame([('a {"k": [1,],} // c\n b',), ("none",), ("{bad",)], "t string").select(tx.extract_json(F.col("t"))).collect()
    assert [r[0] for r in made] == ['{"k": [1]}', None, None]
    titles = spark.createDataFrame([("Data Access",), ("Data access",), ("data",), ("Main App 2",)], "t string").select(tx.is_title_case(F.col("t"))).collect()
    assert [r[0] for r in titles] == [True, False, False, True]


def test_diagram_questions_and_prompts(spark):
    rows = spark.createDataFrame([("class_diagram", "Foo", "deepseek-x"), ("package_diagram", "Foo", "m")], "diagram_type string, focus string, model string")
    got = {r.diagram_type: r for r in context.diagram_questions(rows).collect()}
    assert "'Foo'" in got["class_diagram"].question and got["class_diagram"].budget == 8000 and "Foo" not in got["package_diagram"].question
    assert context.section_questions(spark).count() == 7 and context.scan_questions(spark).count() == 10
