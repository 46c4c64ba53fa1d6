"""Query preparation, context packing and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeatlas.functions import specs
from codeatlas.functions import text as tx
from codeatlas.operators.stats import screen_list

# Limits and texts of the context format.
MIN_REST, MARGIN, MIN_DOCUMENT, NEIGHBOURS, MENTIONS, SCREENS = 240, 32, 120, 10, 3, 40
GRAPH_HEAD = "\n\n" + "=" * 40 + "\nSTRUCTURAL CONTEXT (from Knowledge Graph):\n" + "=" * 40 + "\n"
SCREEN_HEAD = "KNOWN SCREENS DETECTED FROM STATIC PARSING:\n"
DEFAULT_TASK = "Answer the question based on the code context provided."
SYSTEM = (
    "You are {model}, an expert AI assistant specialized in Android code analysis and software architecture. You have been given RELEVANT EXCERPTS from the project's"
    " codebase via a retrieval system. Use ONLY the provided context to answer. Be specific and reference actual class/method names from the context.\n"
)


def lookup(pairs: dict, key: Column) -> Column:
    """The value of a small constant map, null for other keys."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def expand_query(queries: DataFrame, mode: str = "auto") -> DataFrame:
    """``queries`` plus ``expanded``: up to three distinct wordings, one a line."""
    if mode != "auto":
        return queries.withColumn("expanded", F.col("question"))
    kind = F.col("analysis_type")
    first, rest = ({k: " ".join(part(v)) for k, v in specs.HINTS.items()} for part in (lambda v: v[:5], lambda v: v[5:]))
    join = lambda *cs: tx.squeeze(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in cs]))
    wordings = F.array(
        tx.squeeze(F.col("question")), join(F.replace(kind, F.lit("_"), F.lit(" ")), tx.quoted_terms(F.col("question")), lookup(first, kind)), join(F.col("question"), lookup(rest, kind))
    )
    made = F.array_join(F.filter(F.array_distinct(wordings), lambda x: x != ""), "\n")
    return queries.withColumn("expanded", F.when(kind.isin(list(specs.HINTS)), made).otherwise(F.col("question")))


def dedup_results(ranked: DataFrame) -> DataFrame:
    """The best-ranked row of each file, component and chunk type in a query; empty documents are dropped first."""
    best = Window.partitionBy("query_id", "file_path", "component_name", "chunk_type").orderBy("rank")
    kept = ranked.filter(F.col("content").isNotNull() & (F.col("content") != ""))
    return kept.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def _header() -> Column:
    return tx.block_header(F.col("chunk_type"), F.col("component_name"), F.col("component_type"), F.col("layer"))


def pack_context(ranked: DataFrame, max_chars: int = tx.MAX_CONTEXT) -> DataFrame:
    """(query_id, context): blocks in rank order within ``max_chars``, the last ones cut or left out.

    A fold over the few ranked rows of each query; the first block may be over the budget.
    """
    items = F.array_sort(F.collect_list(F.struct("rank", _header().alias("header"), F.col("content").alias("document"))))
    rows = dedup_results(ranked).groupBy("query_id").agg(items.alias("items"))
    sep = len(tx.SEPARATOR)
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("total"), F.lit(0).alias("blocks"), F.lit(False).alias("stop"))

    def step(acc, x):
        gap = F.when(acc["blocks"] > 0, sep).otherwise(0)
        whole = F.concat(F.lit("### "), x["header"], F.lit("\n"), x["document"])
        fits = acc["total"] + gap + F.length(whole) <= max_chars
        rest = F.lit(max_chars) - acc["total"]
        room = F.greatest(rest - F.length(x["header"]) - MARGIN, F.lit(MIN_DOCUMENT))
        cut = tx.rstrip(F.substring(x["document"], F.lit(1), room))
        cut = F.when(cut != x["document"], F.concat(cut, F.lit(tx.TRUNCATED))).otherwise(cut)
        short = F.concat(F.lit("### "), x["header"], F.lit("\n"), cut)
        block = F.when(fits, whole).otherwise(short)
        later = acc["blocks"] > 0
        stop = acc["stop"] | (~fits & later & ((rest < MIN_REST) | (acc["total"] + gap + F.length(short) > max_chars)))
        text = F.when(stop, acc["text"]).otherwise(F.concat(acc["text"], F.when(later, F.lit(tx.SEPARATOR)).otherwise(""), block))
        total = F.when(stop, acc["total"]).otherwise(acc["total"] + gap + F.length(block))
        return F.struct(text.alias("text"), total.alias("total"), F.when(stop, acc["blocks"]).otherwise(acc["blocks"] + 1).alias("blocks"), stop.alias("stop"))

    packed = F.aggregate("items", start, step, lambda acc: acc["text"])
    return rows.select("query_id", F.when(packed == "", tx.NO_CONTEXT).otherwise(packed).alias("context"))


def join_context(ranked: DataFrame) -> DataFrame:
    """(query_id, context): all blocks in rank order."""
    block = tx.format_block(F.col("chunk_type"), F.col("component_name"), F.col("component_type"), F.col("layer"), F.col("content"))
    items = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: x["block"]), tx.SEPARATOR).alias("context"))


def graph_context(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, graph): up to ten out-edges and ten in-edges of the first three classes that a question names."""
    named = questions.select("query_id", "project_id", F.posexplode(tx.class_mentions(F.col("question"), MENTIONS)).alias("pos", "mention"))
    classes = nodes.filter("label = 'Class'").select("project_id", F.col("name").alias("mention"), F.col("key").alias("class_key"))
    mine = named.join(classes, ["project_id", "mention"])
    names = nodes.select("project_id", "label", "key", F.col("name").alias("other"))

    def side(near, far, order, title, line):
        found = mine.join(edges.filter(F.col(f"{near}_label") == "Class").withColumnRenamed(f"{near}_key", "class_key"), ["project_id", "class_key"])
        ends = names.select("project_id", F.col("label").alias(f"{far}_label"), F.col("key").alias(f"{far}_key"), "other")
        found = found.join(ends, ["project_id", f"{far}_label", f"{far}_key"]).select("query_id", "pos", "mention", "rel", "other", F.col(f"{far}_key").alias("k"))
        few = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "pos").orderBy("rel", "other", "k"))).filter(F.col("n") <= NEIGHBOURS)
        listed = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
        text = F.concat(title, F.lit("\n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n"))
        return few.groupBy("query_id", "pos", "mention").agg(text.alias("text")).withColumn("side", F.lit(order))

    out = side("src", "dst", 0, F.concat(F.lit("**"), F.col("mention"), F.lit(" depends on:**")), F.concat(F.lit("  - ("), F.col("rel"), F.lit(") → "), F.col("other")))
    into = side("dst", "src", 1, F.concat(F.lit("**Classes that depend on "), F.col("mention"), F.lit(":**")), F.concat(F.lit("  - "), F.col("other"), F.lit(" ("), F.col("rel"), F.lit(")")))
    blocks = F.array_sort(F.collect_list(F.struct("pos", "side", "text")))
    return out.unionByName(into).groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["text"]), "\n\n").alias("graph"))


def hybrid_context(vector: DataFrame, graph: DataFrame) -> DataFrame:
    """(query_id, context): the retrieved text, then the graph section where there is one."""
    rows = vector.join(graph, "query_id", "left")
    return rows.select("query_id", F.concat_ws("\n", "context", F.when(F.col("graph") != "", F.concat(F.lit(GRAPH_HEAD), F.col("graph")))).alias("context"))


def route_model(queries: DataFrame) -> DataFrame:
    return queries.withColumn("model", F.coalesce(lookup(specs.MODELS, F.col("analysis_type")), F.lit(specs.DEFAULT_MODEL)))


def build_prompts(queries: DataFrame, contexts: DataFrame, tasks: dict[str, str] | None = None) -> DataFrame:
    """(query_id, prompt); ``tasks`` maps analysis types to instructions."""
    rows = queries.join(contexts, "query_id", "left")
    model = F.coalesce("model", F.lit("AI Assistant")) if "model" in queries.columns else F.lit("AI Assistant")
    head, tail = SYSTEM.split("{model}")
    task = F.coalesce(lookup(tasks, F.col("analysis_type")), F.lit(DEFAULT_TASK)) if tasks else F.lit(DEFAULT_TASK)
    rule = "=" * 60
    prompt = F.concat(
        F.lit(head), model, F.lit(tail + "\nTASK: "), task, F.lit(f"\n\nRETRIEVED CODE CONTEXT:\n{rule}\n"), F.coalesce("context", F.lit(tx.NO_CONTEXT)),
        F.lit(f"\n{rule}\n\nQUESTION: "), F.col("question"), F.lit("\n\nANSWER:\n"),
    )
    return rows.select("query_id", prompt.alias("prompt"))


def section_questions(spark: SparkSession) -> DataFrame:
    rows = [(k, f"Generate the '{title}' documentation section for this project.", kind, specs.SECTION_TOP_K, layer) for k, title, kind, layer in specs.SECTIONS]
    return spark.createDataFrame(rows, "key string, question string, analysis_type string, top_k int, layer_filter string")


def scan_questions(spark: SparkSession) -> DataFrame:
    rows = [(key, name, specs.AUDIT_QUESTION.replace("{name}", name).replace("{about}", about), f"sec_{key}", k, layer) for key, name, about, k, layer in specs.CATEGORIES]
    return spark.createDataFrame(rows, "key string, display_name string, question string, analysis_type string, top_k int, layer_filter string")


def diagram_questions(requests: DataFrame) -> DataFrame:
    """``requests`` (diagram_type, focus, model) plus question, top_k, layer_filter and budget."""
    columns = "diagram_type string, plain string, focused string, top_k int, layer_filter string, budget int"
    table = F.broadcast(requests.sparkSession.createDataFrame(specs.DIAGRAMS, columns))  # one row for each diagram type
    rows = requests.join(table, "diagram_type")
    wanted = F.col("focused").isNotNull() & F.col("focus").isNotNull() & (F.col("focus") != "")
    small = F.lower(F.coalesce("model", F.lit(""))).contains(specs.SMALL_MODEL)
    return rows.select(
        *requests.columns, F.when(wanted, F.replace("focused", F.lit("{focus}"), F.col("focus"))).otherwise(F.col("plain")).alias("question"), "top_k", "layer_filter",
        F.when(small, F.least("budget", F.lit(specs.SMALL_MODEL_BUDGET))).otherwise(F.col("budget")).alias("budget"),
    )


def screen_hints(classes: DataFrame) -> DataFrame:
    """(project_id, hint): the first 40 screens of each project, for navigation questions."""
    first = Window.partitionBy("project_id").orderBy("name")
    few = screen_list(classes).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SCREENS)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ", ")
    return few.groupBy("project_id").agg(F.concat(F.lit(SCREEN_HEAD), names, F.lit("\n\n")).alias("hint"))
