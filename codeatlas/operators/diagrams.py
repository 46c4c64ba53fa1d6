"""Diagram records as tables: entities, relationships and notes, their canonical references, and integrity errors.

One JSON document is one diagram (diagram_id, diagram_type, json). Lists are read as arrays of JSON texts and
their fields by path, so that one bad element does not lose the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.text import humanize, squeeze
from codeatlas.sources.scratch import durable

# Where a diagram type keeps its entities (list, kind), its relationships (list, source, target) and nested lists.
ENTITIES = {
    "class_diagram": [("classes", "class"), ("external_classes", "external")],
    "usecase_diagram": [("actors", "actor"), ("usecases", "usecase")],
    "sequence_diagram": [("participants", "participant")],
    "state_diagram": [("states", "state")],
    "component_diagram": [("components", "component"), ("interfaces", "interface"), ("external_components", "external")],
    "package_diagram": [("packages", "package")],
    "deployment_diagram": [("nodes", "node")],
    "navigation_diagram": [("screens", "screen")],
}
CHILDREN = {"package_diagram": ("packages", "classes", "member"), "deployment_diagram": ("nodes", "children", "child")}
LINKS = {
    "sequence_diagram": ("messages", "sender", "receiver"),
    "state_diagram": ("transitions", "source", "target"),
    "navigation_diagram": ("transitions", "source", "target"),
}
LIMITS = {"class": 15, "usecase": 20, "participant": 10}
INITIAL = "idle|initial|created|new|ready"
ENTRY = "main|home|splash|launcher|login|start"
EDGE_STATE = "[*]"
# Visibilities of members, types of participants, nodes and groups.
VISIBILITIES = ["+", "-", "#", "~"]
PARTICIPANTS = ["participant", "actor", "database", "entity", "boundary", "control", "collections"]
NODES = ["node", "database", "cloud", "artifact"]
GROUPS = ["alt", "opt", "loop", "critical", "group"]
MAX_NESTING = 5
STEP_TYPES = ["action", "decision", "fork", "join", "stop"]


def _list(json: Column, path: str) -> Column:
    return F.from_json(F.get_json_object(json, f"$.{path}"), "array<string>")


def _field(element: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(element, f"$.{name}"), F.lit(default))


def _name(element: Column) -> Column:
    """The name of an object, or the element itself where it is a plain string."""
    return F.when(element.rlike(r"^\s*\{"), _field(element, "name")).otherwise(element)


def _entity_rows(rows: DataFrame, kind: str, parent: Column) -> DataFrame:
    e = F.col("e")
    return rows.select(
        "diagram_id", "diagram_type", F.lit(kind).alias("kind"), "pos", _name(e).alias("name"), _field(e, "alias").alias("alias"), _field(e, "display_name").alias("display_name"), parent.alias("parent")
    )


def parse_entities(docs: DataFrame) -> DataFrame:
    """(diagram_id, diagram_type, kind, pos, name, alias, display_name, parent)."""
    parts = []
    for kind_of, lists in ENTITIES.items():
        mine = docs.filter(F.col("diagram_type") == kind_of)
        for path, kind in lists:
            parts.append(_entity_rows(mine.select("diagram_id", "diagram_type", F.posexplode(_list(F.col("json"), path)).alias("pos", "e")), kind, F.lit("")))
    for kind_of, (path, inner, kind) in CHILDREN.items():
        parts.append(_entity_rows(_inner(_kept(docs.filter(F.col("diagram_type") == kind_of), path), inner, "diagram_type"), kind, F.col("up")))
    return reduce(DataFrame.unionByName, parts)


def parse_relationships(docs: DataFrame) -> DataFrame:
    """(diagram_id, diagram_type, pos, source, target, label, arrow_type, guard); grouped messages follow the plain ones."""
    link = F.create_map(*[x for k, v in LINKS.items() for x in (F.lit(k), F.lit(v[0]))])
    named = F.coalesce(link[F.col("diagram_type")], F.lit("relationships"))
    listed = F.from_json(F.coalesce(*[F.when(named == n, F.get_json_object("json", f"$.{n}")) for n in ("relationships", "messages", "transitions")]), "array<string>")
    groups = F.coalesce(_list(F.col("json"), "groups"), F.array().cast("array<string>"))
    grouped = F.flatten(F.transform(groups, lambda g: F.concat(*[F.coalesce(_list(g, n), F.array().cast("array<string>")) for n in ("messages", "else_messages")])))
    rows = docs.select("diagram_id", "diagram_type", F.posexplode(F.concat(F.coalesce(listed, F.array().cast("array<string>")), grouped)).alias("pos", "e"))
    e = F.col("e")
    end = lambda plain, message: F.coalesce(F.get_json_object(e, f"$.{plain}"), F.get_json_object(e, f"$.{message}"), F.lit(""))
    return rows.select("diagram_id", "diagram_type", "pos", end("source", "sender").alias("source"), end("target", "receiver").alias("target"), _field(e, "label").alias("label"), _field(e, "arrow_type", "-->").alias("arrow_type"), _field(e, "guard").alias("guard"))


def parse_notes(docs: DataFrame) -> DataFrame:
    """(diagram_id, diagram_type, pos, target, position, text)."""
    e, side = F.col("e"), F.lower(_field(F.col("e"), "position", "right"))
    rows = docs.select("diagram_id", "diagram_type", F.posexplode(_list(F.col("json"), "notes")).alias("pos", "e"))
    return rows.select("diagram_id", "diagram_type", "pos", _field(e, "target").alias("target"), F.when(side.isin("right", "left", "top", "bottom"), side).otherwise("right").alias("position"), _field(e, "text").alias("text"))


def parse_steps(docs: DataFrame) -> DataFrame:
    """Activity steps of any depth with their place in the nesting: (diagram_id, path, depth, step_type, label, condition, swimlane).

    One level is read after the other until a level is empty; each is stored, so that the plan does not grow with the depth.
    """
    level = docs.filter("diagram_type = 'activity_diagram'").select("diagram_id", F.posexplode(_list(F.col("json"), "steps")).alias("pos", "e"))
    level = durable(level.select("diagram_id", F.format_string("%04d", "pos").alias("path"), F.lit(0).alias("depth"), "e"), "steps")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        inner = lambda part: F.transform(F.coalesce(_list(F.col("e"), part), F.array().cast("array<string>")), lambda x, i: F.struct(F.format_string(f"/{part[0]}%04d", i).alias("place"), x.alias("e")))
        below = level.select("diagram_id", "path", "depth", F.inline(F.concat(inner("yes_steps"), inner("no_steps"))).alias("place", "e"))
        level = durable(below.select("diagram_id", F.concat("path", "place").alias("path"), (F.col("depth") + 1).alias("depth"), "e"), "steps")
    e = F.col("e")
    kind = F.lower(_field(e, "step_type", "action"))
    columns = [F.when(kind.isin(STEP_TYPES), kind).otherwise("action").alias("step_type"), _field(e, "label").alias("label"), _field(e, "condition").alias("condition"), _field(e, "swimlane").alias("swimlane")]
    return reduce(DataFrame.unionByName, levels or [level]).select("diagram_id", "path", "depth", *columns)


def _one_of(value: Column, known: list[str], default: str) -> Column:
    return F.when(F.lower(value).isin(known), F.lower(value)).otherwise(default)


def _flag(element: Column, name: str) -> Column:
    """Whether a JSON value counts as true: a text that is not empty, a number but zero, a list or object with something in it."""
    value, text = F.get_json_object(element, f"$.{name}"), element.rlike(rf'"{name}"\s*:\s*"')
    return F.coalesce(F.when(text, value != "").otherwise(~value.isin("false", "0", "0.0", "[]", "{}")), F.lit(False))


def _kept(rows: DataFrame, path: str) -> DataFrame:
    return rows.select("diagram_id", "diagram_type", F.posexplode(_list(F.col("json"), path)).alias("pos", "e"))


def _inner(rows: DataFrame, list_: str, *more: str) -> DataFrame:
    """A row for each element ``e`` of a list inside the element ``e`` of ``rows``, whose name is ``up``.

    The name is read before the list is opened: beside a generator Spark would read it from the whole outer text once for each inner element.
    """
    named = rows.select("diagram_id", *more, _name(F.col("e")).alias("up"), F.col("e").alias("_outer"))
    return named.select("diagram_id", *more, "up", F.posexplode(_list(F.col("_outer"), list_)).alias("pos", "e"))


def parse_members(docs: DataFrame) -> DataFrame:
    """Fields and methods of the classes of class diagrams: (diagram_id, kind of class, class_pos, class_name, member, pos, name, type, params, visibility).

    ``type`` is a field's type or what a method returns; an unknown visibility is ``+``.
    """
    mine, parts = docs.filter("diagram_type = 'class_diagram'"), []
    for path, kind in ENTITIES["class_diagram"]:
        for list_, member, type_ in (("fields", "field", "type"), ("methods", "method", "return_type")):
            outer = _kept(mine, path).withColumnRenamed("pos", "class_pos")
            rows = _inner(outer, list_, "class_pos").select("diagram_id", F.lit(kind).alias("kind"), "class_pos", F.col("up").alias("class_name"), "pos", "e")
            e, seen = F.col("e"), _field(F.col("e"), "visibility", "+")
            parts.append(rows.select(
                "diagram_id", "kind", "class_pos", "class_name", F.lit(member).alias("member"), "pos", _name(e).alias("name"), _field(e, type_).alias("type"),
                (_field(e, "params") if member == "method" else F.lit("")).alias("params"), F.when(seen.isin(VISIBILITIES), seen).otherwise("+").alias("visibility"),
            ))
    return reduce(DataFrame.unionByName, parts)


def parse_traits(docs: DataFrame) -> DataFrame:
    """What else each entity says of itself: (diagram_id, diagram_type, kind, parent, pos, name, entity_type, stereotype, package, is_abstract, is_interface,
    entry_action, exit_action, do_action). Participants, nodes and children of nodes have a type, with the type's default where it is absent or (but for
    children) unknown."""
    parts = []

    def add(rows: DataFrame, kind: str, parent: Column) -> None:
        e = F.col("e")
        types = {"participant": lambda: _one_of(_field(e, "participant_type", "participant"), PARTICIPANTS, "participant"), "node": lambda: _one_of(_field(e, "node_type", "node"), NODES, "node"), "child": lambda: F.when(e.rlike(r"^\s*\{"), _field(e, "child_type", "artifact")).otherwise("artifact")}
        texts = [_field(e, c).alias(c) for c in ("stereotype", "package")]
        flags = [_flag(e, c).alias(c) for c in ("is_abstract", "is_interface")]
        actions = [_field(e, c).alias(c) for c in ("entry_action", "exit_action", "do_action")]
        parts.append(rows.select("diagram_id", "diagram_type", F.lit(kind).alias("kind"), parent.alias("parent"), "pos", _name(e).alias("name"), types.get(kind, lambda: F.lit(""))().alias("entity_type"), *texts, *flags, *actions))

    for kind_of, lists in ENTITIES.items():
        for path, kind in lists:
            add(_kept(docs.filter(F.col("diagram_type") == kind_of), path), kind, F.lit(""))
    for kind_of, (path, inner, kind) in CHILDREN.items():
        add(_inner(_kept(docs.filter(F.col("diagram_type") == kind_of), path), inner, "diagram_type"), kind, F.col("up"))
    return reduce(DataFrame.unionByName, parts)


def parse_groups(docs: DataFrame) -> DataFrame:
    """The groups of sequence diagrams: (diagram_id, pos, group_type, label, else_label, n_messages, n_else_messages)."""
    e = F.col("e")
    size = lambda name: F.coalesce(F.size(_list(e, name)), F.lit(0)).alias(f"n_{name}")
    rows = _kept(docs.filter("diagram_type = 'sequence_diagram'"), "groups")
    return rows.select("diagram_id", "pos", _one_of(_field(e, "group_type", "alt"), GROUPS, "alt").alias("group_type"), _field(e, "label").alias("label"), _field(e, "else_label").alias("else_label"), size("messages"), size("else_messages"))


def member_errors(members: DataFrame, traits: DataFrame, groups: DataFrame) -> DataFrame:
    """(diagram_id, check, subject) of what members, traits and groups break: members without a name or given twice in a class (a method by its
    parameters too), classes that are abstract and an interface at once, groups without messages."""
    row = lambda df, check, subject: df.select("diagram_id", F.lit(check).alias("check"), subject.alias("subject"))
    twice = members.filter("trim(name) <> ''").groupBy("diagram_id", "kind", "class_pos", "class_name", "member", "name", "params").count().filter("count > 1")
    parts = [
        row(members.filter("trim(name) = ''"), "empty member name", F.concat_ws(" ", "class_name", "member")),
        row(twice, "duplicate member", F.concat_ws(".", "class_name", "name")),
        row(traits.filter("is_abstract AND is_interface"), "abstract interface", F.col("name")),
        row(groups.filter("n_messages + n_else_messages = 0"), "empty group", F.col("pos").cast("string")),
    ]
    return reduce(DataFrame.unionByName, parts)


def step_errors(docs: DataFrame, steps: DataFrame) -> DataFrame:
    """(diagram_id, check, subject) of what the steps of activity diagrams break; steps below ``MAX_NESTING`` decisions are not looked at."""
    row = lambda df, check, subject: df.select("diagram_id", F.lit(check).alias("check"), subject.alias("subject"))
    mine = docs.filter("diagram_type = 'activity_diagram'").select("diagram_id", "json")
    near = steps.filter(F.col("depth") <= MAX_NESTING)
    lanes = mine.select("diagram_id", F.explode(_list(F.col("json"), "swimlanes")).alias("swimlane"))
    named = lanes.filter("swimlane <> ''").distinct()
    yes = steps.filter(F.col("path").rlike(r"/y\d+$")).select("diagram_id", F.regexp_replace("path", r"/y\d+$", "").alias("path")).distinct()
    decisions = near.filter("step_type = 'decision'")
    used = near.filter("swimlane <> ''").join(named.select("diagram_id").distinct(), "diagram_id", "left_semi")
    with_steps = mine.join(steps.select("diagram_id").distinct(), "diagram_id", "left_semi")
    empty = lambda kind, c: near.filter((F.col("step_type") == kind) & (F.trim(c) == ""))
    parts = [
        row(mine.join(steps.select("diagram_id").distinct(), "diagram_id", "left_anti"), "no steps", F.lit("")),
        row(lanes.groupBy("diagram_id", "swimlane").count().filter("count > 1"), "duplicate swimlane", F.col("swimlane")),
        row(used.join(named, ["diagram_id", "swimlane"], "left_anti").select("diagram_id", "swimlane").distinct(), "undeclared swimlane", F.col("swimlane")),
        row(empty("action", "label"), "empty action label", F.col("path")),
        row(empty("fork", "label"), "empty fork label", F.col("path")),
        row(empty("decision", "condition"), "empty condition", F.col("path")),
        row(decisions.join(yes, ["diagram_id", "path"], "left_anti"), "no yes steps", F.col("path")),
        row(decisions.filter(F.col("depth") == MAX_NESTING), "nesting too deep", F.col("path")),
        row(with_steps.join(near.filter("step_type = 'action'").select("diagram_id").distinct(), "diagram_id", "left_anti"), "no action steps", F.lit("")),
    ]
    return reduce(DataFrame.unionByName, parts)


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """Names squeezed, empty ones dropped, the first of each lower-cased name, kind and parent kept; display names filled."""
    clean = entities.withColumn("name", squeeze("name")).filter("name <> ''").withColumn("alias", F.regexp_replace("alias", r"\W+", ""))
    shown = squeeze(F.col("display_name"))
    clean = clean.withColumn("display_name", F.when(shown != "", shown).otherwise(humanize(F.col("name"))))
    first = Window.partitionBy("diagram_id", "kind", F.lower("parent"), F.lower("name")).orderBy("pos")
    return clean.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def reference_keys(entities: DataFrame) -> DataFrame:
    """(diagram_id, key, exact, canonical, priority): everything that names an entity; exact before lower case, name before alias."""
    initials = F.regexp_replace("name", r"[^\p{Lu}]", "")
    named = [("name", 1), ("alias", 2), ("display_name", 2)]
    ways = [F.struct(F.col(c).alias("key"), F.lit(True).alias("exact"), F.lit(p).alias("priority")) for c, p in named]
    ways += [F.struct(F.lower(c).alias("key"), F.lit(False).alias("exact"), F.lit(p + 2).alias("priority")) for c, p in named]
    short = F.when((F.col("diagram_type") == "sequence_diagram") & (F.length(initials) >= 2), F.lower(initials))
    ways.append(F.struct(short.alias("key"), F.lit(False).alias("exact"), F.lit(5).alias("priority")))
    rows = entities.select("diagram_id", "pos", F.col("name").alias("canonical"), F.inline(F.array(*ways))).filter("key <> ''")
    best = F.min(F.struct("priority", "pos", "canonical"))
    return rows.groupBy("diagram_id", "key", "exact").agg(best.alias("b")).select("diagram_id", "key", "exact", F.col("b.canonical").alias("canonical"), F.col("b.priority").alias("priority"))


def resolve_references(rows: DataFrame, entities: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by the canonical name where an entity answers to it; ``[*]`` stays."""
    keys = reference_keys(entities)
    exact = keys.filter("exact").select("diagram_id", F.col("key").alias(column), F.col("canonical").alias("_a"), F.col("priority").alias("_pa"))
    lower = keys.filter("NOT exact").select("diagram_id", F.col("key").alias("_low"), F.col("canonical").alias("_b"), F.col("priority").alias("_pb"))
    suffix = keys.filter("exact AND priority = 1").select("diagram_id", F.col("key").alias("_last"), F.col("canonical").alias("_c"))
    made = rows.withColumn("_low", F.lower(column)).withColumn("_last", F.when(F.col("diagram_type") == "package_diagram", F.regexp_extract(column, r"\.([^.]+)$", 1)))
    made = made.join(exact, ["diagram_id", column], "left").join(lower, ["diagram_id", "_low"], "left").join(suffix, ["diagram_id", "_last"], "left")
    return made.withColumn(column, F.when(F.col(column) == EDGE_STATE, F.col(column)).otherwise(F.coalesce("_a", "_b", "_c", F.col(column)))).select(*rows.columns)


def endpoints(relationships: DataFrame) -> DataFrame:
    ends = F.array(F.col("source"), F.col("target"))
    return relationships.select("diagram_id", "diagram_type", F.explode(ends).alias("name")).filter(F.col("name") != "").distinct()


def promote_external(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities plus stubs for undeclared endpoints with a valid name: external ones, or children of the first node."""
    known = entities.select("diagram_id", "name").unionByName(entities.filter("kind = 'interface' AND alias <> ''").select("diagram_id", F.col("alias").alias("name"))).distinct()
    wanted = endpoints(relationships).filter(F.col("diagram_type").isin("class_diagram", "component_diagram", "deployment_diagram"))
    wanted = wanted.filter(F.col("name").rlike(r"^[A-Za-z][A-Za-z0-9_. -]*$") & (F.length("name") <= 80)).join(known, ["diagram_id", "name"], "left_anti")
    nodes = entities.filter("kind = 'node'").groupBy("diagram_id").agg(F.min_by("name", "pos").alias("node"))
    stubs = wanted.join(nodes, "diagram_id", "left").filter((F.col("diagram_type") != "deployment_diagram") | F.col("node").isNotNull())
    deployed = F.col("diagram_type") == "deployment_diagram"
    stubs = stubs.select(
        "diagram_id", "diagram_type", F.when(deployed, "child").otherwise("external").alias("kind"), F.lit(1_000_000).alias("pos"), "name", F.lit("").alias("alias"), humanize(F.col("name")).alias("display_name"), F.coalesce("node", F.lit("")).alias("parent")
    )
    return entities.select(*stubs.columns).unionByName(stubs)


def relation_kind(label: Column, arrow_type: Column) -> Column:
    text = F.lower(F.concat_ws(" ", label, arrow_type))
    return (
        F.when(text.contains("include"), "include")
        .when(text.contains("extend"), "extend")
        .when(text.contains("general") | arrow_type.contains("|>"), "generalization")
        .otherwise("association")
    )


def _preferred(entities: DataFrame, kind: str, words: str) -> DataFrame:
    order = F.struct((~F.lower("name").rlike(words)).cast("int"), "pos")
    return entities.filter(F.col("kind") == kind).groupBy("diagram_id").agg(F.min_by("name", order).alias("name"))


def initial_states(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(diagram_id, name) of the initial transition to add where a diagram has none."""
    have = relationships.filter(F.col("source") == EDGE_STATE).select("diagram_id").distinct()
    return _preferred(entities, "state", INITIAL).join(have, "diagram_id", "left_anti")


def entry_screens(docs: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(diagram_id, name): the named entry, else the first target of ``[*]``, else a screen whose name says so, else the first."""
    named = docs.filter("diagram_type = 'navigation_diagram'").select("diagram_id", F.nullif(_field(F.col("json"), "entry_screen"), F.lit("")).alias("given"))
    started = relationships.filter((F.col("source") == EDGE_STATE) & (F.col("target") != EDGE_STATE)).groupBy("diagram_id").agg(F.min_by("target", "pos").alias("started"))
    rows = named.join(started, "diagram_id", "left").join(_preferred(entities, "screen", ENTRY), "diagram_id", "left")
    return rows.select("diagram_id", F.coalesce("given", "started", "name").alias("name"))


def exit_screens(relationships: DataFrame) -> DataFrame:
    """(diagram_id, name): screens that lead to ``[*]``, the first spelling of each."""
    rows = relationships.filter((F.col("target") == EDGE_STATE) & (F.col("source") != EDGE_STATE))
    return rows.groupBy("diagram_id", F.lower("source").alias("k")).agg(F.min_by("source", "pos").alias("name")).select("diagram_id", "name")


def integrity_errors(docs: DataFrame, entities: DataFrame, relationships: DataFrame, notes: DataFrame) -> DataFrame:
    """(diagram_id, check, subject) for everything that breaks a rule."""
    row = lambda df, check, subject: df.select("diagram_id", F.lit(check).alias("check"), subject.cast("string").alias("subject"))
    known = entities.select("diagram_id", "name").distinct()
    ends = endpoints(relationships).filter(F.col("name") != EDGE_STATE)
    state = relationships.filter("diagram_type = 'state_diagram'")
    has_links = relationships.select("diagram_id").distinct()
    linked = docs.filter(F.col("diagram_type").isin("state_diagram", "sequence_diagram", "navigation_diagram"))
    counts = entities.groupBy("diagram_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    limit = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])[F.col("kind")]
    members = entities.filter("kind = 'member'").groupBy("diagram_id", F.lower("name").alias("k")).agg(F.countDistinct("parent").alias("n"), F.min("name").alias("name"))
    kinds = entities.filter("kind IN ('actor', 'usecase')").select("diagram_id", "name", "kind").distinct()
    use = relationships.filter("diagram_type = 'usecase_diagram'").withColumn("relation", relation_kind(F.col("label"), F.col("arrow_type")))
    use = use.join(kinds.toDF("diagram_id", "source", "ks"), ["diagram_id", "source"]).join(kinds.toDF("diagram_id", "target", "kt"), ["diagram_id", "target"])
    odd = F.when(F.col("ks") == F.col("kt"), F.when(F.col("ks") == "usecase", ~F.col("relation").isin("include", "extend", "generalization")).otherwise(F.col("relation") != "generalization"))
    odd = odd.otherwise(~F.col("relation").isin("association", "generalization"))
    parts = [
        row(entities.filter("trim(name) = ''"), "empty name", F.col("kind")),
        row(entities.filter("name <> ''").groupBy("diagram_id", "kind", "parent", F.lower(F.trim("name")).alias("k")).count().filter("count > 1"), "duplicate", F.col("k")),
        row(counts.filter(F.col("n") > limit), "too many", F.col("kind")),
        row(docs.select("diagram_id").join(entities.select("diagram_id").distinct(), "diagram_id", "left_anti"), "no entities", F.lit("")),
        row(relationships.filter("source = ''"), "empty source", F.col("pos")),
        row(relationships.filter("target = ''"), "empty target", F.col("pos")),
        row(ends.join(known, ["diagram_id", "name"], "left_anti"), "undeclared endpoint", F.col("name")),
        row(notes.filter("target <> ''").select("diagram_id", F.col("target").alias("name")).distinct().join(known, ["diagram_id", "name"], "left_anti"), "undeclared note target", F.col("name")),
        row(notes.filter("target = '' AND diagram_type <> 'package_diagram'"), "empty note target", F.col("pos")),
        row(linked.select("diagram_id").join(has_links, "diagram_id", "left_anti"), "no transitions", F.lit("")),
        row(state.filter("source = '[*]' AND target = '[*]'"), "edge to edge", F.col("pos")),
        row(docs.filter("diagram_type = 'state_diagram'").join(state.filter("source = '[*]'").select("diagram_id").distinct(), "diagram_id", "left_anti"), "no initial transition", F.lit("")),
        row(members.filter("n > 1"), "class in several packages", F.col("name")),
        row(use.filter(odd), "relation between wrong kinds", F.concat_ws(" ", "source", "relation", "target")),
    ]
    return reduce(DataFrame.unionByName, parts)
