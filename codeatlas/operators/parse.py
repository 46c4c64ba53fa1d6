"""Source files to packages, classes, members, manifests, layouts and build files.

Everything is regular expressions in one projection per step: no shuffle. Whole matches are taken from a text once and their
parts from the short matches; runs of word characters are entered only at their start, so that a long run costs one look. Patterns keep the reference semantics, oddities included: no word boundary before ``class``, comments are
not skipped, ``return x;`` is a field, ``when(x) {`` a method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.functions import rules, spans

# The patterns that define what is found, in Java syntax with Unicode classes.
PACKAGE = r"(?Umd)^package\s+([\w.]+)"
IMPORT = r"(?Umd)^import\s+([\w.*]+)"
CLASS = r"(?U)(?:class|interface|object|enum)\s+(\w+)(?:\s*<[^>]*>)?(?:\s*(?:extends|:)\s*([\w.]+))?(?:\s*(?:implements|,)\s*([^{\n]+))?"
ANNOTATION = r"(?U)@(\w+)"
METHOD = r"(?U)(?<!\w)(\w++)\s*+\(([^)]*+)\)\s*+(?::\s*([\w<>\[\]?,]+))?\s*\{"
FIELD = r"(?U)(?:val|var)\s+(\w+)\s*:\s*([\w<>\[\]?,]+)|(?<![\w<>\[\]?,])([\w<>\[\]?,]++)\s++(\w++)\s*+[;=]"
CONTROL = ["if", "for", "while", "switch", "catch", "synchronized"]
TAG = r"(?U)<(\w[\w.]*)"
MANIFEST = {
    "activities": r'<activity[^>]*android:name\s*=\s*"([^"]+)"',
    "services": r'<service[^>]*android:name\s*=\s*"([^"]+)"',
    "receivers": r'<receiver[^>]*android:name\s*=\s*"([^"]+)"',
    "providers": r'<provider[^>]*android:name\s*=\s*"([^"]+)"',
    "permissions": r'<uses-permission[^>]*android:name\s*=\s*"([^"]+)"',
}
MANIFEST_FIRST = {
    "package": r'package\s*=\s*"([^"]+)"',
    "min_sdk": r'android:minSdkVersion\s*=\s*"(\d+)"',
    "target_sdk": r'android:targetSdkVersion\s*=\s*"(\d+)"',
}
BUILD = {
    "dependencies": r"""(?:implementation|api|compileOnly|testImplementation)\s*[\("]\s*['"]([^'"]+)['"]""",
    "plugins": r"""id\s*[\("]\s*['"]([^'"]+)['"]""",
}
BUILD_FIRST = {"min_sdk": r"minSdk\s*=?\s*(\d+)", "target_sdk": r"targetSdk\s*=?\s*(\d+)", "compile_sdk": r"compileSdk\s*=?\s*(\d+)"}
NEAR, LEAST_CLASS = 300, 6


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def package_name(source: Column) -> Column:
    return F.regexp_extract(source, PACKAGE, 1)


def imports(source: Column) -> Column:
    return every(source, IMPORT)


def class_matches(files: DataFrame) -> DataFrame:
    """``files`` plus ``classes``: name, superclass, interfaces, annotations, component_type, layer."""
    made = files.withColumns({"_found": every(F.col("source"), CLASS, 0), "_gaps": F.split("source", CLASS, -1)})
    part = lambda x, k: F.regexp_extract(x, CLASS, k)

    def one(found, before):
        named = F.filter(F.transform(F.split(part(found, 3), ","), lambda i: F.regexp_replace(i, r"(?U)^\s+|\s+$", "")), lambda i: i != "")
        return F.struct(part(found, 1).alias("name"), part(found, 2).alias("superclass"), named.alias("interfaces"), every(before, ANNOTATION).alias("annotations"))

    def typed(c):
        kind = rules.component_type(c["name"], c["superclass"], c["annotations"])
        return F.struct(c["name"].alias("name"), c["superclass"].alias("superclass"), c["interfaces"].alias("interfaces"), c["annotations"].alias("annotations"), kind.alias("component_type"), rules.layer(kind, c["name"], c["superclass"], c["annotations"]).alias("layer"))

    before = spans.texts_before(F.col("_found"), F.col("_gaps"), NEAR, LEAST_CLASS)
    made = made.withColumn("classes", F.transform(F.zip_with("_found", before, one), typed))
    return made.select(*files.columns, "classes")


def methods(source: Column) -> Column:
    def one(x):
        part = lambda k: F.regexp_extract(x, METHOD, k)
        kind = F.coalesce(F.nullif(part(3), F.lit("")), F.lit("void"))
        return F.struct(part(1).alias("name"), kind.alias("return_type"), F.regexp_replace(part(2), r"(?U)^\s+|\s+$", "").alias("params"))

    return F.filter(F.transform(every(source, METHOD, 0), one), lambda m: ~m["name"].isin(CONTROL))


def fields(source: Column) -> Column:
    def one(x):
        filled = lambda a, b: F.coalesce(*[F.nullif(F.regexp_extract(x, FIELD, k), F.lit("")) for k in (a, b)])
        return F.struct(filled(2, 3).alias("type"), filled(1, 4).alias("name"))

    return F.filter(F.transform(every(source, FIELD, 0), one), lambda f: f["type"].isNotNull() & f["name"].isNotNull())


def classified(files: DataFrame) -> DataFrame:
    """Files with text and a kind; unparsed and empty ones are dropped."""
    kept = files.filter(F.col("source").isNotNull() & (F.col("source") != ""))
    return kept.withColumn("kind", rules.file_kind(F.col("path"), F.col("source"))).filter("kind IS NOT NULL")


def parse_code(files: DataFrame) -> DataFrame:
    code = classified(files).filter("kind = 'code'")
    source = F.col("source")
    made = class_matches(code).withColumns({"language": rules.language_of(F.col("path")), "package": package_name(source), "imports": imports(source), "methods": methods(source), "fields": fields(source)})
    return made.select("project_id", "path", "language", "package", "imports", "classes", "methods", "fields", "source")


def manifest_columns(source: Column) -> dict[str, Column]:
    return {k: every(source, p) for k, p in MANIFEST.items()} | {k: F.regexp_extract(source, p, 1) for k, p in MANIFEST_FIRST.items()}


def parse_manifests(files: DataFrame) -> DataFrame:
    rows = classified(files).filter("kind = 'manifest'")
    return rows.select("project_id", "path", *[c.alias(k) for k, c in manifest_columns(F.col("source")).items()])


def widgets(source: Column) -> Column:
    """Opening tags that begin with a capital or hold a dot."""
    return F.filter(every(source, TAG), lambda t: t.rlike(r"^\p{Lu}|\."))


def parse_layouts(files: DataFrame) -> DataFrame:
    return classified(files).filter("kind = 'layout'").select("project_id", "path", widgets(F.col("source")).alias("widgets"))


def build_columns(source: Column) -> dict[str, Column]:
    return {k: every(source, p) for k, p in BUILD.items()} | {k: F.regexp_extract(source, p, 1) for k, p in BUILD_FIRST.items()}


def parse_builds(files: DataFrame) -> DataFrame:
    rows = classified(files).filter("kind = 'gradle'")
    return rows.select("project_id", "path", *[c.alias(k) for k, c in build_columns(F.col("source")).items()])


def parse_files(files: DataFrame) -> dict[str, DataFrame]:
    """The four parsed tables of a file listing with texts."""
    return {"code": parse_code(files), "manifest": parse_manifests(files), "layout": parse_layouts(files), "build": parse_builds(files)}


def _exploded(code: DataFrame, column: str, prefix: list[str]) -> DataFrame:
    return code.select("project_id", "path", "language", "package", F.posexplode(column).alias("pos", "x")).select("project_id", "path", "language", "package", "pos", *[F.col(f"x.{c}").alias(c) for c in prefix])


def explode_classes(code: DataFrame) -> DataFrame:
    return _exploded(code, "classes", ["name", "superclass", "interfaces", "annotations", "component_type", "layer"])


def explode_methods(code: DataFrame) -> DataFrame:
    return _exploded(code, "methods", ["name", "return_type", "params"])


def explode_fields(code: DataFrame) -> DataFrame:
    return _exploded(code, "fields", ["type", "name"])


def explode_imports(code: DataFrame) -> DataFrame:
    return code.select("project_id", "path", F.posexplode("imports").alias("pos", "imported"))
