"""Column rules: what a file is, what a class is, and which layer it belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scanned extensions and ignored folders.
EXTENSIONS = [".java", ".kt", ".xml", ".gradle", ".kts", ".properties"]
IGNORED_DIRS = [".git", ".gradle", ".idea", "build", "bin", "node_modules", "__pycache__", ".chroma_db"]


def extension_of(path: Column) -> Column:
    """Lower-cased last suffix of the file name with its dot; '' without one (a leading dot is none)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))


def in_ignored_dir(relative: Column) -> Column:
    parts = F.split(relative, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, IGNORED_DIRS)))


def file_kind(path: Column, source: Column) -> Column:
    """code, manifest, layout or gradle; null for files that are scanned but not parsed."""
    ext = extension_of(path)
    return (
        F.when(ext.isin(".java", ".kt"), "code")
        .when((ext == ".xml") & (path.contains("AndroidManifest") | source.contains("<manifest")), "manifest")
        .when(ext == ".xml", "layout")
        .when(ext.isin(".gradle", ".kts"), "gradle")
    )


def language_of(path: Column) -> Column:
    return F.when(path.endswith(".kt"), "kotlin").otherwise("java")


def component_type(name: Column, superclass: Column, annotations: Column) -> Column:
    """The first rule that a class meets names its component type."""
    n, s = F.lower(name), F.lower(F.coalesce(superclass, F.lit("")))
    marks = F.transform(annotations, F.lower)
    marked = lambda *xs: F.arrays_overlap(marks, F.array(*map(F.lit, xs)))
    rules = [
        ("Activity", s.contains("activity") | n.endswith("activity")),
        ("Fragment", s.contains("fragment") | n.endswith("fragment")),
        ("ViewModel", s.contains("viewmodel") | n.endswith("viewmodel")),
        ("Service", s.contains("service") | n.endswith("service")),
        ("BroadcastReceiver", s.contains("broadcastreceiver") | n.endswith("receiver")),
        ("ContentProvider", s.contains("contentprovider") | n.endswith("provider")),
        ("Adapter", n.contains("adapter")),
        ("DAO", marked("dao") | n.endswith("dao")),
        ("Entity", marked("entity") | n.endswith("entity")),
        ("Repository", n.contains("repository")),
        ("DI Module", marked("module", "hiltmodule")),
        ("Interface", s.contains("interface")),
    ]
    return _first(rules, "Class")


def layer(component: Column, name: Column, superclass: Column, annotations: Column) -> Column:
    """The first rule that a class meets names its layer."""
    n, s, a = F.lower(name), F.lower(F.coalesce(superclass, F.lit(""))), F.lower(F.array_join(annotations, " "))
    has = lambda c, *xs: F.greatest(*[c.contains(x) for x in xs]) if len(xs) > 1 else c.contains(xs[0])
    rules = [
        ("UI", component.isin("Activity", "Fragment") | has(s, "activity", "fragment") | n.endswith("activity") | n.endswith("fragment")),
        ("Business Logic", s.contains("viewmodel") | has(n, "viewmodel", "repository", "usecase", "interactor")),
        ("Data", has(n, "dao", "database", "model", "dto") | has(a, "entity", "table")),
        ("Service", s.contains("service") | n.endswith("service")),
        ("DI", has(a, "module", "component", "inject")),
    ]
    return _first(rules, "Other")


def _first(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    out = F
    for value, test in rules:
        out = out.when(test, value)
    return out.otherwise(otherwise)
