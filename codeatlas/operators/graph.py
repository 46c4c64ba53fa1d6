"""The code graph: five kinds of nodes and nine kinds of edges, each a projection or an equi-join.

Names are resolved against all classes of the project, so the result does not depend on file order (a
parent declared later is found; a stub is made only for a name that is never declared). Where an upsert by key
would let the last file win, the row of the largest path and position wins. Joins are on
(project_id, name) with both sides made distinct first; AQE splits the names that everybody uses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.operators import bodies, parse
from codeatlas.sources.scratch import durable, spread

# Types that are no classes.
PRIMITIVES = ["int", "long", "float", "double", "boolean", "byte", "char", "short", "String", "void", "Object", "Int", "Long", "Float", "Double", "Boolean"]
EDGE = ["project_id", "src_label", "src_key", "rel", "dst_label", "dst_key"]
SLOTS, TASKS = 8, 4  # parts of the callers of a name; tasks of a join that gives many more rows than it reads, for each core
BLOCK = 128  # callers of a name, and definitions of it, about, that are one row until their edges are made


def qualified(package: Column, name: Column) -> Column:
    return F.when(package != "", F.concat(package, F.lit("."), name)).otherwise(name)


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    latest = F.max(F.struct(*order, *[c for c in rows.columns if c not in key and c not in order]))
    return rows.groupBy(*key).agg(latest.alias("_x")).select(*key, *[F.col(f"_x.{c}").alias(c) for c in rows.columns if c not in key])


def _edges(rows: DataFrame, src_label: str, src: str, rel: str, dst_label: str, dst: str) -> DataFrame:
    return rows.select(
        "project_id", F.lit(src_label).alias("src_label"), F.col(src).alias("src_key"), F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), F.col(dst).alias("dst_key")
    ).distinct()


def declared(code: DataFrame) -> DataFrame:
    """One row for each class declaration, with its qualified name."""
    rows = parse.explode_classes(code)
    return rows.withColumn("qualified_name", qualified(F.col("package"), F.col("name")))


def file_nodes(parsed: dict[str, DataFrame]) -> DataFrame:
    languages = {"manifest": "xml", "layout": "xml", "build": "gradle"}
    rows = [parsed["code"].select("project_id", "path", "language")]
    rows += [parsed[k].select("project_id", "path", F.lit(v).alias("language")) for k, v in languages.items()]
    return reduce(DataFrame.unionByName, rows).dropDuplicates(["project_id", "path"])


def package_nodes(code: DataFrame) -> DataFrame:
    return code.filter("package <> ''").select("project_id", F.col("package").alias("name")).distinct()


def class_nodes(code: DataFrame) -> DataFrame:
    rows = declared(code).select(
        "project_id", "qualified_name", "path", "pos", "name", "package", "component_type", "layer", "language", F.array_join("annotations", ",").alias("annotations")
    )
    return _last_wins(rows, ["project_id", "qualified_name"], ["path", "pos"]).drop("pos").withColumnRenamed("path", "file_path")


def defined_in(code: DataFrame) -> DataFrame:
    return _edges(declared(code), "Class", "qualified_name", "DEFINED_IN", "File", "path")


def belongs_to(code: DataFrame) -> DataFrame:
    return _edges(declared(code).filter("package <> ''"), "Class", "qualified_name", "BELONGS_TO", "Package", "package")


def _named_classes(code: DataFrame) -> DataFrame:
    return declared(code).select("project_id", F.col("name").alias("wanted"), F.col("qualified_name").alias("dst")).distinct()


def _resolved(wanted: DataFrame, classes: DataFrame, rel: str) -> tuple[DataFrame, DataFrame]:
    """Edges from ``src`` to every class named ``wanted``, and stubs for names that no class has."""
    wanted = wanted.distinct()
    linked = wanted.join(classes, ["project_id", "wanted"], "left").withColumn("dst", F.coalesce("dst", "wanted"))
    stubs = wanted.join(classes, ["project_id", "wanted"], "left_anti").select("project_id", F.col("wanted").alias("name")).distinct()
    return _edges(linked, "Class", "src", rel, "Class", "dst"), stubs


def inheritance(code: DataFrame, named: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """INHERITS_FROM edges and stub classes; ``named``: the classes by name, if they are at hand."""
    wanted = declared(code).filter("superclass <> ''").select("project_id", F.col("qualified_name").alias("src"), F.col("superclass").alias("wanted"))
    return _resolved(wanted, _named_classes(code) if named is None else named, "INHERITS_FROM")


def interfaces(code: DataFrame, named: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """IMPLEMENTS edges and stub interfaces."""
    wanted = declared(code).select("project_id", F.col("qualified_name").alias("src"), F.explode("interfaces").alias("wanted"))
    return _resolved(wanted, _named_classes(code) if named is None else named, "IMPLEMENTS")


def _first_class(code: DataFrame) -> Column:
    return qualified(F.col("package"), F.get(F.col("classes"), 0)["name"])


def _members(code: DataFrame, column: str, *parts: str) -> DataFrame:
    """A row for each method or field of a file, which belong to its first class: id, path, pos, name, class_name and ``parts``."""
    rows = code.filter(F.size("classes") > 0).select("project_id", "path", _first_class(code).alias("class_name"), F.posexplode(column).alias("pos", "m"))
    return rows.select("project_id", F.concat("class_name", F.lit("."), "m.name").alias("id"), "path", "pos", F.col("m.name").alias("name"), *[F.col(f"m.{c}").alias(c) for c in parts], "class_name")


def method_nodes(code: DataFrame) -> DataFrame:
    """Key class.method; overloads merge."""
    return _last_wins(_members(code, "methods", "return_type"), ["project_id", "id"], ["path", "pos"]).drop("path", "pos")


def has_method(code: DataFrame) -> DataFrame:
    return _edges(_members(code, "methods"), "Class", "class_name", "HAS_METHOD", "Method", "id")


def field_nodes(code: DataFrame) -> DataFrame:
    return _last_wins(_members(code, "fields", "type"), ["project_id", "id"], ["path", "pos"]).drop("path", "pos")


def has_field(code: DataFrame) -> DataFrame:
    return _edges(_members(code, "fields"), "Class", "class_name", "HAS_FIELD", "Field", "id")


def of_type(code: DataFrame, named: DataFrame | None = None) -> DataFrame:
    wanted = last_part(F.regexp_replace("type", r"<.*$", ""))
    rows = field_nodes(code).filter(~F.col("type").isin(PRIMITIVES)).select("project_id", F.col("id").alias("src"), wanted.alias("wanted"))
    return _edges(rows.distinct().join(_named_classes(code) if named is None else named, ["project_id", "wanted"]), "Field", "src", "OF_TYPE", "Class", "dst")


def import_edges(code: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Each class of a file to the existing classes that the file imports by name."""
    rows = code.withColumn("wanted", F.explode(F.array_distinct(F.transform("imports", last_part)))).select("project_id", "package", "wanted", F.explode("classes").alias("c"))
    rows = rows.select("project_id", qualified(F.col("package"), F.col("c.name")).alias("src"), "wanted").distinct()
    return _edges(rows.join(_named_classes(code) if named is None else named, ["project_id", "wanted"]), "Class", "src", "IMPORTS", "Class", "dst")


def method_calls(code: DataFrame) -> DataFrame:
    """Distinct (project_id, caller id, called name) from the methods' bodies; names in comments and literals are no calls, and braces there end no method."""
    called = F.inline(bodies.method_calls(F.col("source"), F.col("language")))
    rows = code.filter(F.size("classes") > 0).select("project_id", _first_class(code).alias("class_name"), called)
    return rows.select("project_id", F.concat("class_name", F.lit("."), "name").alias("src"), F.explode("calls").alias("wanted")).distinct()


def definitions(code: DataFrame, max_definitions: int | None = None) -> DataFrame:
    """Distinct (project_id, wanted, dst): the methods that a called name can mean.

    Names with more than ``max_definitions`` definitions can be left out (off by default).
    """
    methods = _members(code, "methods").select("project_id", F.col("name").alias("wanted"), F.col("id").alias("dst")).distinct()
    if max_definitions:
        few = methods.groupBy("project_id", "wanted").count().filter(F.col("count") <= max_definitions).drop("count")
        methods = methods.join(few, ["project_id", "wanted"], "left_semi")
    return methods


def _in_slots(many: DataFrame, few: DataFrame, key: list[str], by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key`` that gives many more rows than it reads, dealt over a fixed number of tasks: a key's rows in ``many`` go to ``SLOTS`` parts by
    ``by``, each with a copy of the key's rows in ``few``. Tasks are not merged for their small inputs."""
    tasks, on = TASKS * spread(many.sparkSession), [*key, "_slot"]
    many = many.withColumn("_slot", F.pmod(F.xxhash64(by), F.lit(SLOTS)).cast("int"))
    few = few.withColumn("_slot", F.explode(F.array(*[F.lit(i) for i in range(SLOTS)])))
    return many.repartition(tasks, *on), few.repartition(tasks, *on)


def _blocks(known: DataFrame) -> DataFrame:
    """(project_id, wanted, dsts): ``definitions`` in arrays of about ``BLOCK``, however many a name has."""
    key = ["project_id", "wanted"]
    parts = known.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    return known.join(parts, key).groupBy(*key, F.pmod(F.xxhash64("dst"), "parts").alias("part")).agg(F.sort_array(F.collect_list("dst")).alias("dsts")).drop("part")


def _in_blocks(rows: DataFrame, key: list[str], column: str, name: str) -> DataFrame:
    """``column`` of the rows of a key in arrays of ``BLOCK``, in its order; rows stay in the tasks where they are for a join on the key."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(column))
    return rows.withColumn("part", F.floor((place - 1) / BLOCK)).groupBy(*key, "part").agg(F.collect_list(column).alias(name)).drop("part")


def _call_blocks(called: DataFrame, known: DataFrame) -> DataFrame:
    """CALLS edges as rows for ``_expanded``: blocks of a name's callers joined to blocks of its definitions, so that the join gives a row for some ``BLOCK`` * ``BLOCK`` edges."""
    key = ["project_id", "wanted"]
    callers, methods = _in_slots(called, _blocks(known), key, "src")
    key = [*key, "_slot"]
    rows = _in_blocks(callers, key, "src", "srcs").join(methods, key)
    return rows.select("project_id", F.lit("Method").alias("src_label"), "srcs", F.lit("CALLS").alias("rel"), F.lit("Method").alias("dst_label"), "dsts", "wanted")


def _expanded(blocks: DataFrame) -> DataFrame:
    """The edges of rows with ``srcs``, ``dsts`` and ``wanted``, the name by which methods are called: each source to each target, but no method to itself.

    A definition's id ends with its name, so that only a caller of its own name can be among the targets.
    """
    own = F.col("src_key").endswith(F.concat(F.lit("."), "wanted"))
    others = F.when(own, F.array_remove("dsts", F.col("src_key"))).otherwise(F.col("dsts"))
    return blocks.withColumn("src_key", F.explode("srcs")).withColumn("dst_key", F.explode(others)).select(*EDGE)


def call_edges(called: DataFrame, known: DataFrame) -> DataFrame:
    """CALLS edges of ``method_calls`` and ``definitions``: a caller to every method of the project with the called name, except itself.

    Both sides are distinct and a method has one name, so that no edge comes twice.
    """
    return _expanded(_call_blocks(called, known))


def calls(code: DataFrame, max_definitions: int | None = None) -> DataFrame:
    """CALLS edges of parsed files."""
    return call_edges(method_calls(code), definitions(code, max_definitions))


def call_counts(called: DataFrame, known: DataFrame) -> DataFrame:
    """(project_id, count) of the CALLS edges, from callers times definitions of each name: the edges themselves are not made."""
    many = lambda df, name: df.groupBy("project_id", "wanted").agg(F.count(F.lit(1)).alias(name))
    pairs = many(called, "callers").join(many(known, "defined"), ["project_id", "wanted"]).select("project_id", (F.col("callers") * F.col("defined")).alias("n"))
    own = called.join(known.withColumnRenamed("dst", "src"), ["project_id", "wanted", "src"], "left_semi").groupBy("project_id").agg((-F.count(F.lit(1))).alias("n"))
    return pairs.unionByName(own).groupBy("project_id").agg(F.sum("n").alias("count")).filter("count > 0")


def count_calls(code: DataFrame) -> DataFrame:
    """(rel, count) of the CALLS edges."""
    total = call_counts(method_calls(code), definitions(code)).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    return total.select(F.lit("CALLS").alias("rel"), "count")


def _edge_parts(code: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """All edges but CALLS, and the stubs; the classes by name are made once."""
    named = durable(_named_classes(code), "named-classes")
    supers, ifaces = inheritance(code, named), interfaces(code, named)
    return [supers[0], ifaces[0], has_method(code), has_field(code), belongs_to(code), defined_in(code), of_type(code, named), import_edges(code, named)], [supers[1], ifaces[1]]


def _nodes(parsed: dict[str, DataFrame], stubs: list[DataFrame]) -> DataFrame:
    code = parsed["code"]
    node = lambda df, label, key, name: df.select("project_id", F.lit(label).alias("label"), F.col(key).alias("key"), F.col(name).alias("name"))
    classes = [node(class_nodes(code), "Class", "qualified_name", "name"), *[node(df, "Class", "name", "name") for df in stubs]]
    nodes = [
        reduce(DataFrame.unionByName, classes).dropDuplicates(["project_id", "key"]), node(file_nodes(parsed), "File", "path", "path"),
        node(package_nodes(code), "Package", "name", "name"), node(method_nodes(code), "Method", "id", "name"), node(field_nodes(code), "Field", "id", "name"),
    ]
    return reduce(DataFrame.unionByName, nodes)


def build_graph(parsed: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes as (project_id, label, key, name)."""
    nodes, edges, called, known = build_parts(parsed)
    return nodes, with_calls(edges, called, known)


def build_parts(parsed: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges but CALLS, called, known): the graph as it is stored. ``called`` and ``known`` are ``method_calls`` and ``definitions``, of which ``with_calls``
    gives the CALLS edges; these are as many as callers times definitions, the stored rows only as many as both."""
    edges, stubs = _edge_parts(parsed["code"])
    return _nodes(parsed, stubs), reduce(DataFrame.unionByName, edges), method_calls(parsed["code"]), definitions(parsed["code"])


def with_calls(edges: DataFrame, called: DataFrame, known: DataFrame) -> DataFrame:
    """All edges. A filter on labels or relations that leaves out CALLS leaves out their join.

    The other edges are blocks of one, so that what comes together here are blocks and not every CALLS edge: these are made last.
    """
    plain = edges.select("project_id", "src_label", F.array("src_key").alias("srcs"), "rel", "dst_label", F.array("dst_key").alias("dsts"), F.lit(None).cast("string").alias("wanted"))
    return _expanded(plain.unionByName(_call_blocks(called, known)))


def build_counters(parsed: dict[str, DataFrame]) -> DataFrame:
    """What the build attempts for each project: files, classes, methods, fields, inheritance, interfaces, imports."""
    code = parsed["code"]
    total = lambda c: F.sum(c).cast("long")
    members = lambda c: F.when(F.size("classes") > 0, F.size(c)).otherwise(0)
    supers = F.size(F.filter("classes", lambda c: c["superclass"] != ""))
    ifaces = F.aggregate("classes", F.lit(0), lambda a, c: a + F.size(c["interfaces"]))
    made = code.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("code_files"), total(F.size("classes")).alias("classes"), total(members("methods")).alias("methods"), total(members("fields")).alias("fields"),
        total(supers).alias("inherits"), total(ifaces).alias("implements"), total(F.size("classes") * F.size("imports")).alias("imports"),
    )
    files = file_nodes(parsed).groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    return files.join(made, "project_id", "left")


def class_dependencies(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """Out-edges of the classes named in ``names`` (project_id, name): rel, target label, name and key."""
    return _neighbours(nodes, edges, names, "src", "dst")


def class_dependents(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """In-edges of the classes named in ``names``."""
    return _neighbours(nodes, edges, names, "dst", "src")


def _neighbours(nodes: DataFrame, edges: DataFrame, names: DataFrame, near: str, far: str) -> DataFrame:
    mine = nodes.filter("label = 'Class'").join(names.distinct(), ["project_id", "name"]).select("project_id", "name", F.col("key").alias(f"{near}_key"))
    found = edges.filter(F.col(f"{near}_label") == "Class").join(mine, ["project_id", f"{near}_key"])
    ends = nodes.select("project_id", F.col("label").alias(f"{far}_label"), F.col("key").alias(f"{far}_key"), F.col("name").alias("other_name"))
    return found.join(ends, ["project_id", f"{far}_label", f"{far}_key"]).select(
        "project_id", "name", "rel", F.col(f"{far}_label").alias("other_label"), "other_name", F.col(f"{far}_key").alias("other_key")
    )


def call_chain(calls_: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """Directed CALLS paths of 1 to ``depth`` edges from the methods in ``starts`` (project_id, key): keys and length.

    An edge occurs at most once in a path.
    """
    edges = calls_.filter("rel = 'CALLS'").select("project_id", F.col("src_key").alias("a"), F.col("dst_key").alias("b"))
    step = edges.join(starts.select("project_id", F.col("key").alias("a")).distinct(), ["project_id", "a"])
    paths = step.select("project_id", F.array("a", "b").alias("keys"), F.col("b").alias("at"))
    levels = [paths]
    for n in range(2, depth + 1):
        grown = levels[-1].withColumnRenamed("at", "a").join(edges, ["project_id", "a"])
        again = F.exists(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: (F.element_at("keys", i) == F.col("a")) & (F.element_at("keys", i + 1) == F.col("b")))
        levels.append(grown.filter(~again).select("project_id", F.concat("keys", F.array("b")).alias("keys"), F.col("b").alias("at")))
    return reduce(DataFrame.unionByName, levels).select("project_id", "keys", (F.size("keys") - 1).alias("length"))


def call_walks(called: DataFrame, known: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """Walks along CALLS edges, by the names that they follow: (project_id, start, names, length, walks), without the edges being made.

    ``called`` (project_id, src, wanted) and ``known`` (project_id, wanted, dst) are ``method_calls`` and ``definitions``; an edge is a name that both share.
    Methods of one name are one node here: a name leads to the names that methods of it call, as often as there are such methods, and the last name
    stands for all its definitions. So a walk costs a row for each sequence of names and not for each sequence of methods. A method's own name is
    not among its calls, so no edge leads back to where it starts. ``expand_walks`` gives the methods.
    """
    links = called.join(known.select("project_id", F.col("wanted").alias("at"), F.col("dst").alias("src")), ["project_id", "src"])
    links = links.groupBy("project_id", "at", "wanted").agg(F.count(F.lit(1)).alias("n"))
    defined = known.groupBy("project_id", "wanted").agg(F.count(F.lit(1)).alias("defined"))
    begun = called.join(starts.select("project_id", F.col("key").alias("src")).distinct(), ["project_id", "src"])
    levels = [begun.select("project_id", F.col("src").alias("start"), F.array("wanted").alias("names"), F.col("wanted").alias("at"), F.lit(1).cast("long").alias("ways"))]
    for _ in range(depth - 1):
        grown = levels[-1].join(links, ["project_id", "at"])
        levels.append(grown.select("project_id", "start", F.concat("names", F.array("wanted")).alias("names"), F.col("wanted").alias("at"), (F.col("ways") * F.col("n")).alias("ways")))
    rows = reduce(DataFrame.unionByName, levels).join(defined.withColumnRenamed("wanted", "at"), ["project_id", "at"])
    return rows.select("project_id", "start", "names", F.size("names").alias("length"), (F.col("ways") * F.col("defined")).alias("walks"))


def walk_blocks(walks: DataFrame, called: DataFrame, known: DataFrame, depth: int = 3) -> DataFrame:
    """The paths of some walks, without their last methods: (project_id, keys, ends, length), a path from ``keys`` to each of ``ends``. An edge occurs at most once in a path.

    Some ``BLOCK`` beginnings that end in the same name meet some ``BLOCK`` definitions of the last one. What comes together are these pairs, and paths that follow each other
    differ in little, so that a writer's compression finds what they share.
    """
    leads = called.join(known.select("project_id", F.col("wanted").alias("name"), F.col("dst").alias("src")), ["project_id", "src"])
    leads = leads.select("project_id", "name", F.col("wanted").alias("next"), F.col("src").alias("b"))
    ends = _blocks(known).withColumnRenamed("wanted", "name")
    rows = walks.select("project_id", "names", "length", F.array("start").alias("keys"))
    found, key = [], ["project_id", "name"]
    for n in range(1, depth + 1):
        a, b, at = F.element_at("keys", -1), F.col("b"), lambda i: F.element_at("keys", i)
        named = lambda df: df.withColumns({"name": F.get("names", F.lit(n - 1)), "next": F.get("names", F.lit(n))})  # noqa: B023, E731
        asked = named(walks).select("project_id", "length", "name", "next").distinct()  # the few names that follow each other on a walk
        begun, blocks = _in_slots(named(rows).filter(F.col("length") == n), ends.join(asked.filter(F.col("length") == n).select(*key).distinct(), key, "left_semi"), key, "keys")
        found.append(_in_blocks(begun, [*key, "_slot"], "keys", "begun").join(blocks, [*key, "_slot"]).select("project_id", "begun", "dsts", F.lit(n).alias("length")))
        if n < depth:
            again = reduce(lambda x, y: x | y, [(at(i) == a) & (at(i + 1) == b) for i in range(1, n)], F.lit(False))
            more = _in_slots(named(rows).filter(F.col("length") > n), leads.join(asked, [*key, "next"], "left_semi"), [*key, "next"], "keys")
            rows = more[0].join(more[1], [*key, "next", "_slot"]).filter(~again & (a != b)).select("project_id", "names", "length", F.concat("keys", F.array("b")).alias("keys"))
    paths = reduce(DataFrame.unionByName, found).select("project_id", F.explode("begun").alias("keys"), "dsts", "length")
    last, others = F.element_at("keys", -1), F.array_remove("dsts", F.element_at("keys", -1))
    for i in range(depth - 2):  # the edge from the i-th key is behind the path if that key comes again
        others = F.array_remove(others, F.when((F.get("keys", F.lit(i)) == last) & (F.col("length") > i + 1), F.get("keys", F.lit(i + 1))).otherwise(last))
    return paths.select("project_id", "keys", others.alias("ends"), "length")


def expand_walks(walks: DataFrame, called: DataFrame, known: DataFrame, depth: int = 3) -> DataFrame:
    """The paths of some walks: (project_id, keys, length). An edge occurs at most once in a path."""
    paths = walk_blocks(walks, called, known, depth).withColumn("b", F.explode("ends"))
    return paths.select("project_id", F.concat("keys", F.array("b")).alias("keys"), "length")


def _placed(counted: DataFrame) -> DataFrame:
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("count"), "name")))  # a row for each label and type


def graph_summary(nodes: DataFrame, edges: DataFrame, called: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Counts by node label and edge type, with the place in the order of each; with ``called`` and ``known`` the CALLS edges that they give are counted too."""
    counted = edges.groupBy(F.col("rel").alias("name")).count()
    if called is not None:
        made = call_counts(called, known).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
        counted = counted.unionByName(made.select(F.lit("CALLS").alias("name"), "count")).groupBy("name").agg(F.sum("count").alias("count")).filter("count > 0")
    nodes = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).count()
    return _placed(nodes.unionByName(counted.select(F.lit("edge").alias("kind"), "name", "count")))


def summary_of(parsed: dict[str, DataFrame]) -> DataFrame:
    """The summary of the graph that ``build_graph`` would make, without its CALLS edges being made."""
    return graph_summary(*build_parts(parsed))
