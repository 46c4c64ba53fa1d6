import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from codeatlas.operators import stats


def test_places_in_a_hot_group_come_from_ranges(spark):
    rng = random.Random(3)
    rows = [("p" if k % 3 else f"q{k % 7}", rng.choice(["UI", "Data", "odd", None]) if k % 5 == 0 else "UI", f"C{rng.randrange(300)}", f"/f{k}") for k in range(4000)]
    classes = spark.createDataFrame(rows, "project_id string, layer string, name string, path string").repartition(5)
    got = stats.layer_groups(classes)
    layer = F.when(F.col("layer").isin("UI", "Data"), F.col("layer")).otherwise("Other")
    want = classes.select("project_id", layer.alias("layer"), "name").withColumn("position", F.row_number().over(Window.partitionBy("project_id", "layer").orderBy("name")))
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(map(tuple, want.collect()))
    assert stats.layer_groups(classes.limit(0)).count() == 0
