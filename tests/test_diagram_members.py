import json
import time

from codeatlas.operators import diagrams


def _docs(spark, n):
    members = [{"name": f"m{k}", "type": "int", "params": "x" * 80, "visibility": "-"} for k in range(n)]
    packages = {"packages": [{"name": "p", "classes": [f"C{k}" + "x" * 80 for k in range(n)]}]}
    rows = [(1, "class_diagram", json.dumps({"classes": [{"name": "Big", "fields": members}]})), (2, "package_diagram", json.dumps(packages))]
    return spark.createDataFrame(rows, "diagram_id int, diagram_type string, json string")


def test_members_of_a_large_class_cost_no_more_each(spark):
    """The name of a class is read once and not from its whole text for each member."""

    def seconds(n):
        docs = _docs(spark, n).cache()
        docs.count()
        began = time.time()
        members, entities, traits = diagrams.parse_members(docs), diagrams.parse_entities(docs).filter("kind = 'member'"), diagrams.parse_traits(docs).filter("kind = 'member'")
        assert members.filter("class_name = 'Big' AND visibility = '-'").count() == entities.filter("parent = 'p'").count() == traits.filter("parent = 'p'").count() == n
        return time.time() - began

    seconds(10)
    assert seconds(6000) < 20
