"""Parsed files to text chunks with seven metadata columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions.text import MAX_CHUNK, truncate
from codeatlas.operators.bodies import method_bodies

# Members shown in a class chunk, and the least length of a method chunk.
SHOWN_FIELDS, SHOWN_METHODS, MIN_METHOD = 20, 30, 60
COLUMNS = ["project_id", "id", "content", "component_name", "component_type", "layer", "package", "file_path", "chunk_type", "language"]


def _lines(*parts: Column) -> Column:
    """The parts that are not null, a line each."""
    return F.concat_ws("\n", *parts)


def _listed(title: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(title), F.array_join(items, ", ")))


def _some(title: str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(title), value))


def _chunk_id(kind: str, *ordinal: Column) -> Column:
    """A stable id from project, path, kind and place: no global numbering, so no global sort."""
    return F.sha2(F.concat_ws("|", "project_id", "path", F.lit(kind), *[c.cast("string") for c in ordinal]), 256)


def class_text(cls: Column, package: Column, fields: Column, methods: Column) -> Column:
    head = F.concat(
        F.lit("["), cls["component_type"], F.lit("] class "), cls["name"],
        F.coalesce(_some(" extends ", cls["superclass"]), F.lit("")), F.coalesce(_listed(" implements ", cls["interfaces"]), F.lit("")),
    )
    shown_fields = F.transform(F.slice(fields, 1, SHOWN_FIELDS), lambda f: F.concat(F.lit("\n  "), f["type"], F.lit(" "), f["name"]))
    shown_methods = F.transform(F.slice(methods, 1, SHOWN_METHODS), lambda m: F.concat(F.lit("\n  "), m["return_type"], F.lit(" "), m["name"], F.lit("("), m["params"], F.lit(")")))
    return _lines(
        _some("Package: ", package), head, _listed("Annotations: ", F.transform(cls["annotations"], lambda a: F.concat(F.lit("@"), a))), _some("Layer: ", cls["layer"]),
        F.when(F.size(fields) > 0, F.concat(F.lit("Fields:"), F.array_join(shown_fields, ""))),
        F.when(F.size(methods) > 0, F.concat(F.lit("Methods:"), F.array_join(shown_methods, ""))),
    )


def class_chunks(code: DataFrame) -> DataFrame:
    rows = code.select("project_id", "path", "language", "package", "fields", "methods", F.posexplode("classes").alias("pos", "cls"))
    text = class_text(F.col("cls"), F.col("package"), F.col("fields"), F.col("methods"))
    return rows.select(
        "project_id", _chunk_id("CLASS", F.col("pos")).alias("id"), truncate(text).alias("content"), F.col("cls.name").alias("component_name"),
        F.col("cls.component_type").alias("component_type"), F.col("cls.layer").alias("layer"), "package", F.col("path").alias("file_path"),
        F.lit("CLASS").alias("chunk_type"), "language",
    )


def with_bodies(code: DataFrame) -> DataFrame:
    """One row for each method with its text, in place of the source."""
    named = code.withColumn("body", method_bodies(F.col("source"), F.transform("methods", lambda m: m["name"])))
    first = F.get(F.col("classes"), 0)
    named = named.select("project_id", "path", "language", "package", first["name"].alias("first_class"), first["layer"].alias("first_layer"), F.arrays_zip("methods", "body").alias("zipped"))
    rows = named.select("project_id", "path", "language", "package", "first_class", "first_layer", F.posexplode("zipped").alias("pos", "z"))
    return rows.select("project_id", "path", "language", "package", "first_class", "first_layer", "pos", F.col("z.methods.name").alias("name"), F.col("z.body").alias("body"))


def method_chunks(code: DataFrame) -> DataFrame:
    rows = with_bodies(code).filter(F.length("body") > MIN_METHOD)
    return rows.select(
        "project_id", _chunk_id("METHOD", F.col("pos")).alias("id"), truncate(F.col("body")).alias("content"),
        F.concat(F.coalesce("first_class", F.lit("Unknown")), F.lit("."), F.col("name")).alias("component_name"), F.lit("Method").alias("component_type"),
        F.coalesce("first_layer", F.lit("Other")).alias("layer"), "package", F.col("path").alias("file_path"), F.lit("METHOD").alias("chunk_type"), "language",
    )


def _config(rows: DataFrame, text: Column, name: Column, component: str, layer: str, package: Column, chunk_type: str, language: str) -> DataFrame:
    return rows.select(
        "project_id", _chunk_id(chunk_type).alias("id"), truncate(text, MAX_CHUNK).alias("content"), name.alias("component_name"), F.lit(component).alias("component_type"),
        F.lit(layer).alias("layer"), package.alias("package"), F.col("path").alias("file_path"), F.lit(chunk_type).alias("chunk_type"), F.lit(language).alias("language"),
    )


def manifest_chunks(manifests: DataFrame) -> DataFrame:
    text = _lines(
        F.concat(F.lit("Android Manifest — Package: "), F.col("package")), _some("Min SDK: ", F.col("min_sdk")), _some("Target SDK: ", F.col("target_sdk")),
        *[_listed(f"{c.capitalize()}: ", F.col(c)) for c in ("activities", "services", "receivers", "permissions")],
    )
    return _config(manifests, text, F.lit("AndroidManifest"), "Config", "Config", F.col("package"), "CONFIG", "xml")


def base_name(path: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=[^.])\.[^.]*$", "")


def layout_chunks(layouts: DataFrame) -> DataFrame:
    name = base_name(F.col("path"))
    text = F.concat(F.lit("Layout: "), name, F.lit("\nWidgets: "), F.array_join("widgets", ", "))
    return _config(layouts.filter(F.size("widgets") > 0), text, name, "Layout", "UI", F.lit(""), "LAYOUT", "xml")


def build_chunks(builds: DataFrame) -> DataFrame:
    deps = F.transform("dependencies", lambda d: F.concat(F.lit("\n  - "), d))
    text = _lines(
        F.lit("Gradle build configuration"), _listed("Plugins: ", F.col("plugins")), F.when(F.size("dependencies") > 0, F.concat(F.lit("Dependencies:"), F.array_join(deps, ""))),
        _some("Min SDK: ", F.col("min_sdk")), _some("Compile SDK: ", F.col("compile_sdk")),
    )
    return _config(builds, text, F.lit("build.gradle"), "Config", "Config", F.lit(""), "CONFIG", "gradle")


def chunk_files(parsed: dict[str, DataFrame]) -> DataFrame:
    """All chunks of the parsed tables."""
    parts = [
        class_chunks(parsed["code"]), method_chunks(parsed["code"]), manifest_chunks(parsed["manifest"]),
        layout_chunks(parsed["layout"]), build_chunks(parsed["build"]),
    ]
    return reduce(DataFrame.unionByName, parts)
