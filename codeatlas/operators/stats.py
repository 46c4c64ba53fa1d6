"""Project statistics from the parsed tables and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.text import humanize
from codeatlas.sources.scratch import durable

# The layers that a layer group can have.
LAYERS = ["UI", "Business Logic", "Data", "Service", "DI", "Other"]
SCREENS = ["Activity", "Fragment"]
# The names of the architecture patterns.
PATTERNS = [
    "MVVM (Model-View-ViewModel)", "MVVM (ViewModel detected, no Repository layer)", "MVC (Activities directly accessing DAOs)",
    "Activity/Fragment based (no clear pattern)", "Unknown",
]


def project_stats(parsed: dict[str, DataFrame], chunks: DataFrame) -> DataFrame:
    """Counts of files, chunks, languages and classes for each project."""
    rows = [parsed["code"].select("project_id", F.col("language").alias("kind"), F.size("classes").alias("n_classes"))]
    rows += [parsed[k].select("project_id", F.lit(v).alias("kind"), F.lit(0).alias("n_classes")) for k, v in (("manifest", "xml"), ("layout", "xml"), ("build", "gradle"))]
    files = reduce(DataFrame.unionByName, rows).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_files"), *[F.count_if(F.col("kind") == k).alias(f"{k}_files") for k in ("java", "kotlin", "xml", "gradle")], F.sum("n_classes").alias("classes")
    )
    counted = chunks.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_chunks"))
    return files.join(counted, "project_id", "left").fillna(0, ["total_chunks"])


def components_by(classes: DataFrame, column: str) -> DataFrame:
    """Class counts for each value of ``component_type`` or ``layer``, most first."""
    return classes.groupBy("project_id", column).agg(F.count(F.lit(1)).alias("n")).orderBy("project_id", F.desc("n"), column)


def architecture_pattern(classes: DataFrame) -> DataFrame:
    """One label for each project, from the component types that it has."""
    has = {k: F.max(F.col("component_type") == k) for k in ("ViewModel", "Repository", "DAO", "Activity", "Fragment")}
    flags = classes.groupBy("project_id").agg(*[v.alias(k) for k, v in has.items()])
    label = (
        F.when(F.col("ViewModel") & F.col("Repository"), PATTERNS[0])
        .when(F.col("ViewModel"), PATTERNS[1])
        .when(F.col("Activity") & F.col("DAO"), PATTERNS[2])
        .when(F.col("Activity") | F.col("Fragment"), PATTERNS[3])
        .otherwise(PATTERNS[4])
    )
    return flags.select("project_id", label.alias("pattern"))


def class_list(classes: DataFrame) -> DataFrame:
    """Class names of each project in order, repeats kept."""
    return classes.select("project_id", "name").orderBy("project_id", "name")


def first_by_path(rows: DataFrame) -> DataFrame:
    """The row of the smallest path for each project."""
    others = [c for c in rows.columns if c not in ("project_id", "path")]
    picked = rows.groupBy("project_id").agg(F.min(F.struct("path", *others)).alias("x"))
    return picked.select("project_id", "x.*")


def short_permissions(permissions, limit: int = 10):
    return F.slice(F.transform(permissions, lambda p: F.element_at(F.split(p, r"\."), -1)), 1, limit)


def manifest_info(manifests: DataFrame) -> DataFrame:
    return first_by_path(manifests).select("project_id", "package", "min_sdk", "target_sdk", F.size("activities").alias("n_activities"), short_permissions("permissions").alias("permissions"))


def gradle_info(builds: DataFrame) -> DataFrame:
    return first_by_path(builds).select("project_id", "plugins", "dependencies", "min_sdk", "target_sdk", "compile_sdk")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with each row's place in its group: no group is sorted by one task.

    Rows are dealt to ranges of (group, order) and stored; a place is the rows of the group in earlier ranges plus the place within its own range.
    """
    placed = durable(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = placed.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range that holds some of a group
    earlier = F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*group, "_range", F.coalesce(earlier, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    return placed.withColumn("_at", within).join(counts, [*group, "_range"]).withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).drop("_range", "_at", "_before")


def layer_groups(classes: DataFrame) -> DataFrame:
    """(project_id, layer, name, position): class names of each layer in order, a row each; an unknown layer counts as Other."""
    known = F.when(F.col("layer").isin(LAYERS), F.col("layer")).otherwise("Other")
    rows = classes.select("project_id", known.alias("layer"), "name", F.xxhash64(*[c for c in ("path", "pos") if c in classes.columns], F.lit(0)).alias("_tie"))
    return numbered(rows, ["project_id", "layer"], ["name", "_tie"], "position").drop("_tie")


def screen_list(classes: DataFrame) -> DataFrame:
    """Distinct Activity and Fragment classes with a readable name."""
    rows = classes.filter(F.col("component_type").isin(SCREENS) & (F.col("name") != "")).select("project_id", "name").distinct()
    return rows.withColumn("display_name", humanize(F.col("name")))
