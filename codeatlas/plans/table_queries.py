"""Queries over the driver's tables, which stand in for sources, chunks, vectors, questions, answers, findings and runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeatlas.functions import specs
from codeatlas.functions import text as tx
from codeatlas.operators import audit, clusters, context, diagrams, graph, history, incremental, vectors
from codeatlas.plans import corpus
from codeatlas.sources import store
from codeatlas.sources.scratch import durable, read_table, shared_dir

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


# Sources, stored tables, change detection


@query(r"SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, substr(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), 1, 500000) AS t FROM documents)")
def s3_read_text(spark, sf_dir):
    rows = _documents(spark, sf_dir).select("doc_id", tx.read_text(F.coalesce("text", F.lit("")).cast("binary")).alias("t"))
    return rows.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name FROM supplier")
def s5_upsert_chunks(spark, sf_dir):
    old = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return store.upsert_chunks(old, new.unionByName(new))


@query("SELECT doc_id, lang, source, n_chars, (SELECT count(*) FROM documents) AS n FROM documents")
def s6_chunk_metadata_and_count(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return store.chunk_metadata(docs.withColumnRenamed("text", "content")).crossJoin(F.broadcast(store.chunk_count(docs)))  # one row


_FILES = "SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS path, n_chars AS size FROM documents"
_PRINTS = f"SELECT project_id, md5(string_agg(concat(path, ':', CAST(size AS VARCHAR)), '' ORDER BY path)) AS fingerprint FROM ({_FILES}) GROUP BY project_id"


def _fingerprints(spark, sf_dir):
    files = _documents(spark, sf_dir).select(F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"))
    return incremental.project_fingerprint(files)


@query(_PRINTS)
def i1_project_fingerprint(spark, sf_dir):
    return _fingerprints(spark, sf_dir)


@query(f"SELECT project_id, fingerprint FROM ({_PRINTS}) WHERE project_id NOT LIKE '%1%' OR project_id LIKE 'src1%'")
def i2_changed_projects(spark, sf_dir):
    now = _fingerprints(spark, sf_dir)
    changed = F.when(F.col("project_id") == "src1", F.lit("old")).otherwise(F.col("fingerprint"))
    stored = now.filter("project_id LIKE '%1%'").select("project_id", changed.alias("fingerprint"), F.when(F.col("project_id").like("src1%"), 0).otherwise(5).alias("total_chunks"))
    return incremental.changed_projects(now, stored)


@query("SELECT doc_id, CASE WHEN length(text) > 1500 THEN concat(substr(text, 1, 1500), chr(10), '... [truncated]') ELSE text END AS content FROM documents")
def k1_truncate(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.truncate(F.col("text")).alias("content"))


# Vectors

_COS = "round(1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def _vector(spark, sf_dir, vec_id=0):
    return read_table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


@query(f"SELECT vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def v2_cosine_distance(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)])
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.cosine_distance(F.col("embedding"), q), 6).alias("distance"))


@query(f"SELECT vec_id, {_COS.format(a='e.embedding', b='q.embedding')} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE label = 3 ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, vec_id LIMIT 8")
def v3_search(spark, sf_dir):
    found = vectors.search(read_table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), equal={"label": 3}, id_column="vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'License') AND lang = 'en'")
def v4_where_document(spark, sf_dir):
    return vectors.where(_documents(spark, sf_dir), {"lang": "en"}, "License", text="text").select("doc_id")


@query(f"""SELECT query_id, id, rank, distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS rank,
 {_COS.format(a='e.embedding', b='q.embedding')} AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND (q.vec_id % 200 = 0 OR e.label = q.label)) WHERE rank <= CASE WHEN query_id % 200 = 0 THEN 12 ELSE 10 END""")
def v5_search_many(spark, sf_dir):
    index = read_table(spark, sf_dir, "embeddings")
    wide = F.col("vec_id") % 200 == 0
    queries = index.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.when(wide, 12).otherwise(10).alias("top_k"), F.when(~wide, F.col("label")).alias("label"))
    found = vectors.search_many(index, queries, filters=("label",), id_column="vec_id")
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@query(f"""SELECT query_id, id, rank, distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS rank,
 {_COS.format(a='e.embedding', b='q.embedding')} AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 AND (q.vec_id % 200 = 0 OR e.label = q.label)) WHERE rank <= CASE WHEN query_id % 200 = 0 THEN 12 ELSE 10 END""")
def v5_search_clusters(spark, sf_dir):
    """The same from an index in clusters, of which most pairs of a query and a row are never compared."""
    index = read_table(spark, sf_dir, "embeddings")
    path = f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}"
    clusters.write_clusters(index, path, id_column="vec_id")
    wide = F.col("vec_id") % 200 == 0
    queries = index.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.when(wide, 12).otherwise(10).alias("top_k"), F.when(~wide, F.col("label")).alias("label"))
    found = clusters.search_clusters(spark, path, queries, filters=("label",), id_column="vec_id")
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


_SPEC_ROWS = ", ".join(f"('{c[0]}', {c[3]}, {'NULL' if c[4] is None else repr(c[4])})" for c in specs.CATEGORIES)


_LAYERED = "(SELECT *, CASE WHEN label = 3 THEN 'Data' ELSE 'UI' END AS layer FROM embeddings)"


@query(f"""SELECT key, top_k, layer_filter, id, rank FROM (SELECT key, top_k, layer_filter, e.vec_id AS id, row_number() OVER (PARTITION BY key ORDER BY 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS rank
 FROM (VALUES {_SPEC_ROWS}) s(key, top_k, layer_filter), (SELECT embedding FROM embeddings WHERE vec_id = 0) q, {_LAYERED} e WHERE s.layer_filter IS NULL OR s.layer_filter = e.layer) WHERE rank <= top_k""")
def v6_distinct_contexts(spark, sf_dir):
    index = read_table(spark, sf_dir, "embeddings").withColumn("layer", F.when(F.col("label") == 3, "Data").otherwise("UI"))
    query = F.array(*[F.lit(float(x)) for x in _vector(spark, sf_dir)]).alias("embedding")

    def retrieve(few):
        asked = few.select(F.col("context_id").alias("query_id"), query, "top_k", F.col("layer_filter").alias("layer"))
        return vectors.search_many(index, asked, filters=("layer",), id_column="vec_id").select(F.col("query_id").alias("context_id"), "id", F.col("rank").cast("long").alias("rank"))

    return vectors.distinct_contexts(context.scan_questions(spark), retrieve).select("key", "top_k", "layer_filter", "id", "rank")


# Questions, contexts, prompts

_PHRASES = ["its dependency", "a subclass", "the interface", "the call chain", "what it imports", "what classes there are", "who uses it", "the impact of changing it", "what is connected to it", "the relationship between both", "the page", "a dependable importer"]
_PHRASE = "CASE item_id % 12 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_PHRASES)) + " END"
_Q = f"SELECT item_id AS query_id, text AS body, concat('Show ', chr(39), split_part(replace(text, chr(10), ' '), ' ', 1), chr(39), ' and ', chr(34), split_part(replace(text, chr(10), ' '), ' ', 2), chr(34), ' of the ', {_PHRASE}, ' MainActivity Repo') AS question, CASE item_id % 3 WHEN 0 THEN 'class_diagram' WHEN 1 THEN 'state_diagram' ELSE 'general' END AS analysis_type FROM {{benchmark}}"
_QS = f"({_Q.replace('{benchmark}', 'benchmark')})"


def _questions(spark, sf_dir):
    return corpus.run_sql(spark, _Q, benchmark=read_table(spark, sf_dir, "benchmark"))


@query(f"SELECT query_id, array_to_string(list_concat(regexp_extract_all(question, '''([^'']+)''', 1), regexp_extract_all(question, '\"([^\"]+)\"', 1)), ' ') AS terms FROM {_QS}")
def q1_quoted_terms(spark, sf_dir):
    return _questions(spark, sf_dir).select("query_id", tx.quoted_terms(F.col("question")).alias("terms"))


_TERMS = "array_to_string(list_concat(regexp_extract_all(question, '''([^'']+)''', 1), regexp_extract_all(question, '\"([^\"]+)\"', 1)), ' ')"
_HINT = lambda k, part: " ".join(specs.HINTS[k][part])
_EXPANDED = " ".join(
    f"WHEN '{k}' THEN concat(question, chr(10), '{k.replace('_', ' ')} ', {_TERMS}, ' {_HINT(k, slice(0, 5))}', chr(10), question, ' {_HINT(k, slice(5, None))}')" for k in ("class_diagram", "state_diagram")
)


@query(f"SELECT query_id, CASE analysis_type {_EXPANDED} ELSE question END AS expanded FROM {_QS}")
def q2_expand_query(spark, sf_dir):
    return context.expand_query(_questions(spark, sf_dir)).select("query_id", "expanded")


@query("SELECT item_id AS query_id, item_id % 12 < 10 AS structural FROM benchmark")
def q3_is_structural(spark, sf_dir):
    return _questions(spark, sf_dir).select("query_id", tx.is_structural(F.col("question")).alias("structural"))


@query(r"SELECT doc_id, array_to_string(list_slice(list_filter(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-zA-Z0-9]{2,}$')), 1, 3), ',') AS mentions FROM documents")
def q4_class_mentions(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.array_join(tx.class_mentions(F.col("text"), 3), ",").alias("mentions"))


def _ranked(spark, sf_dir):
    """Documents as search results: a query for each source, language and fifty ids, ranked by id."""
    return corpus.run_sql(spark, _RANKED.replace("FROM documents", "FROM {documents}").replace("VARCHAR", "STRING"), documents=_documents(spark, sf_dir)).select(
        "*", F.lit("Class").alias("component_type"), F.lit("Data").alias("layer"), F.lit("CLASS").alias("chunk_type")
    )


_RANKED = "SELECT concat(source, '-', lang, '-', CAST(CAST(floor(doc_id / 50) AS BIGINT) AS VARCHAR)) AS query_id, doc_id AS rank, concat('f', CAST(doc_id % 20 AS VARCHAR)) AS file_path, lang AS component_name, text AS content FROM documents"
_BLOCK = "concat('### [CLASS] ', component_name, ' (Class, Layer: Data)', chr(10), content)"


@query(f"SELECT query_id, rank, {_BLOCK} AS block FROM ({_RANKED})")
def q5_format_block(spark, sf_dir):
    block = tx.format_block(F.col("chunk_type"), F.col("component_name"), F.col("component_type"), F.col("layer"), F.col("content"))
    return _ranked(spark, sf_dir).select("query_id", "rank", block.alias("block"))


@query(f"SELECT query_id, min(rank) AS rank, file_path FROM ({_RANKED}) WHERE content <> '' GROUP BY query_id, file_path")
def q6_dedup_results(spark, sf_dir):
    return context.dedup_results(_ranked(spark, sf_dir)).select("query_id", "rank", "file_path")


_SEP = "concat(chr(10), chr(10), '---', chr(10), chr(10))"


@query(f"""WITH RECURSIVE ranked AS ({_RANKED}), best AS (SELECT query_id, arg_min(component_name, rank) AS component_name, arg_min(content, rank) AS content, min(rank) AS rank FROM ranked WHERE content <> '' GROUP BY query_id, file_path),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, concat('[CLASS] ', component_name, ' (Class, Layer: Data)') AS header FROM best),
fold(query_id, n, txt, total, blocks, stop) AS (SELECT DISTINCT query_id, 0::BIGINT, '', 0::BIGINT, 0, FALSE FROM placed
UNION ALL SELECT query_id, n, CASE WHEN stopped THEN txt ELSE concat(txt, CASE WHEN blocks > 0 THEN {_SEP} ELSE '' END, block) END, CASE WHEN stopped THEN total ELSE total + gap + length(block) END,
 CASE WHEN stopped THEN blocks ELSE blocks + 1 END, stopped FROM (SELECT *, CASE WHEN fits THEN whole ELSE short END AS block, stop OR (NOT fits AND blocks > 0 AND (rest < 240 OR total + gap + length(short) > 4000)) AS stopped FROM (
 SELECT *, concat('### ', header, chr(10), CASE WHEN cut <> content THEN concat(cut, chr(10), '... [truncated]') ELSE cut END) AS short FROM (
 SELECT f.query_id, p.n, f.txt, f.total, f.blocks, f.stop, p.header, p.content, CASE WHEN f.blocks > 0 THEN 7 ELSE 0 END AS gap, concat('### ', p.header, chr(10), p.content) AS whole, 4000 - f.total AS rest,
 f.total + CASE WHEN f.blocks > 0 THEN 7 ELSE 0 END + length(concat('### ', p.header, chr(10), p.content)) <= 4000 AS fits, rtrim(substr(p.content, 1, greatest(4000 - f.total - length(p.header) - 32, 120)), concat(' ', chr(10))) AS cut
 FROM fold f JOIN placed p ON p.query_id = f.query_id AND p.n = f.n + 1))))
SELECT query_id, arg_max(txt, n) AS context FROM fold GROUP BY query_id""")
def q7_pack_context(spark, sf_dir):
    return context.pack_context(_ranked(spark, sf_dir), max_chars=4000)


@query(f"SELECT query_id, string_agg({_BLOCK}, {_SEP} ORDER BY rank) AS context FROM ({_RANKED}) GROUP BY query_id")
def q8_join_context(spark, sf_dir):
    return context.join_context(_ranked(spark, sf_dir))


_GQ = "(SELECT k AS query_id, project_id, name FROM classes)"


@query(corpus.oracle(f"""SELECT query_id, array_to_string(list_filter([CASE WHEN outs IS NOT NULL THEN concat('**', name, ' depends on:**', chr(10), outs) END, CASE WHEN ins IS NOT NULL THEN concat('**Classes that depend on ', name, ':**', chr(10), ins) END], lambda x: x IS NOT NULL), concat(chr(10), chr(10))) AS graph FROM (
 SELECT q.query_id, q.name, concat('  - (INHERITS_FROM) → ', c.superclass) AS outs, CASE WHEN d.name IS NOT NULL THEN concat('  - ', d.name, ' (INHERITS_FROM)') END AS ins FROM {_GQ} q JOIN classes c ON c.k = q.query_id LEFT JOIN classes d ON d.superclass = q.name AND d.project_id = q.project_id)"""))
def q9_graph_context(spark, sf_dir):
    code = corpus.parsed(spark, sf_dir)["code"]
    edges, stubs = graph.inheritance(code)
    nodes = graph.class_nodes(code).select("project_id", F.col("qualified_name").alias("key"), "name").unionByName(stubs.select("project_id", F.col("name").alias("key"), "name"))
    nodes = nodes.withColumn("label", F.lit("Class"))
    asked = corpus.class_rows(spark, sf_dir).select(F.col("k").alias("query_id"), "project_id", F.concat(F.lit("who uses "), "name").alias("question"))
    return context.graph_context(asked, nodes, edges)


@query(f"SELECT query_id, CASE WHEN query_id % 2 = 0 THEN concat(body, chr(10), chr(10), chr(10), repeat('=', 40), chr(10), 'STRUCTURAL CONTEXT (from Knowledge Graph):', chr(10), repeat('=', 40), chr(10), question) ELSE body END AS context FROM {_QS}")
def q10_hybrid_context(spark, sf_dir):
    qs = _questions(spark, sf_dir)
    return context.hybrid_context(qs.select("query_id", F.col("body").alias("context")), qs.filter("query_id % 2 = 0").select("query_id", F.col("question").alias("graph")))


@query(f"SELECT query_id, CASE analysis_type WHEN 'class_diagram' THEN '{specs.MODELS['general']}' WHEN 'state_diagram' THEN '{specs.MODELS['general']}' WHEN 'general' THEN '{specs.MODELS['general']}' ELSE '{specs.DEFAULT_MODEL}' END AS model FROM {_QS}")
def q11_route_model(spark, sf_dir):
    return context.route_model(_questions(spark, sf_dir)).select("query_id", "model")


_HEAD, _TAIL = (s.replace("'", "''").replace("\n", "' || chr(10) || '") for s in context.SYSTEM.split("{model}"))


@query(f"SELECT query_id, '{_HEAD}' || 'AI Assistant' || '{_TAIL}' || chr(10) || 'TASK: ' || CASE analysis_type WHEN 'class_diagram' THEN 'Draw the classes.' ELSE 'Answer the question based on the code context provided.' END || chr(10) || chr(10) || 'RETRIEVED CODE CONTEXT:' || chr(10) || repeat('=', 60) || chr(10) || body || chr(10) || repeat('=', 60) || chr(10) || chr(10) || 'QUESTION: ' || question || chr(10) || chr(10) || 'ANSWER:' || chr(10) AS prompt FROM {_QS}")
def q12_build_prompts(spark, sf_dir):
    qs = _questions(spark, sf_dir)
    return context.build_prompts(qs, qs.select("query_id", F.col("body").alias("context")), tasks={"class_diagram": "Draw the classes."})


_DIAGRAM_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in d) + ")" for d in specs.DIAGRAMS)
_REQUEST = "SELECT p_partkey AS id, p_name AS focus, CASE p_size % 9 " + " ".join(f"WHEN {i} THEN '{d[0]}'" for i, d in enumerate(specs.DIAGRAMS)) + " END AS diagram_type, CASE WHEN p_partkey % 2 = 0 THEN 'deepseek-coder' ELSE 'other' END AS model FROM {part}"


@query(f"SELECT id, CASE WHEN focused IS NOT NULL THEN replace(focused, '{{focus}}', focus) ELSE plain END AS question, top_k, layer_filter, CASE WHEN model = 'deepseek-coder' THEN least(budget, 8000) ELSE budget END AS budget FROM ({_REQUEST.replace('{part}', 'part')}) r JOIN (VALUES {_DIAGRAM_ROWS}) d(diagram_type, plain, focused, top_k, layer_filter, budget) USING (diagram_type)")
def q13_diagram_questions(spark, sf_dir):
    requests = corpus.run_sql(spark, _REQUEST, part=read_table(spark, sf_dir, "part"))
    return context.diagram_questions(requests).select("id", "question", "top_k", "layer_filter", "budget")


def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_SECTION_ROWS = _values([(k, f"Generate the '{title}' documentation section for this project.", kind, specs.SECTION_TOP_K, layer) for k, title, kind, layer in specs.SECTIONS])


@query(f"SELECT p_partkey AS id, s.* FROM part JOIN (VALUES {_SECTION_ROWS}) s(key, question, analysis_type, top_k, layer_filter) ON key = CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{s[0]}'" for i, s in enumerate(specs.SECTIONS)) + " END")
def q13_section_questions(spark, sf_dir):
    keys = F.array(*[F.lit(s[0]) for s in specs.SECTIONS])
    asked = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(keys, (F.col("p_partkey") % 7).cast("int")).alias("key"))
    return asked.join(F.broadcast(context.section_questions(spark)), "key")  # seven rows


_SCAN_ROWS = _values([(c[0], c[1], f"Perform a thorough security and code quality audit for: {c[1]}. {c[2]}", f"sec_{c[0]}", c[3], c[4]) for c in specs.CATEGORIES])


@query(f"SELECT p_partkey AS id, key, display_name, opening, analysis_type, top_k, layer_filter, TRUE AS ends FROM part JOIN (VALUES {_SCAN_ROWS}) s(key, display_name, opening, analysis_type, top_k, layer_filter) ON key = CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{c[0]}'" for i, c in enumerate(specs.CATEGORIES)) + " END")
def q13_scan_questions(spark, sf_dir):
    keys = F.array(*[F.lit(c[0]) for c in specs.CATEGORIES])
    asked = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(keys, (F.col("p_partkey") % 10).cast("int")).alias("key"))
    rows = asked.join(F.broadcast(context.scan_questions(spark)), "key")  # ten rows
    parts = F.split("question", "\n\n")
    return rows.select("id", "key", "display_name", parts[0].alias("opening"), "analysis_type", "top_k", "layer_filter", F.col("question").endswith("Output ONLY the JSON array, no other text.").alias("ends"))


# Graph paths over foreign keys

_FK = "SELECT 'p' AS project_id, concat('s', CAST(s_suppkey AS STRING)) AS a, concat('n', CAST(s_nationkey AS STRING)) AS b FROM {supplier} UNION ALL SELECT 'p', concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM {nation} UNION ALL SELECT 'p', concat('r', CAST(n_regionkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)) FROM {nation}"


@query(f"""WITH RECURSIVE e AS ({_FK.replace('{supplier}', 'supplier').replace('{nation}', 'nation')}), paths(keys, tail, used) AS (SELECT [a, b], b, [concat(a, '>', b)] FROM e WHERE a LIKE 's%'
 UNION ALL SELECT list_append(keys, e.b), e.b, list_append(used, concat(e.a, '>', e.b)) FROM paths JOIN e ON e.a = paths.tail WHERE len(used) < 3 AND NOT list_contains(used, concat(e.a, '>', e.b))) SELECT array_to_string(keys, '>') AS path, CAST(len(used) AS INTEGER) AS length FROM paths""")
def g18_call_chain(spark, sf_dir):
    e = corpus.run_sql(spark, _FK, supplier=read_table(spark, sf_dir, "supplier"), nation=read_table(spark, sf_dir, "nation"))
    edges = e.select("project_id", F.col("a").alias("src_key"), F.lit("CALLS").alias("rel"), F.col("b").alias("dst_key"))
    starts = read_table(spark, sf_dir, "supplier").select(F.lit("p").alias("project_id"), F.concat(F.lit("s"), "s_suppkey").alias("key"))
    return graph.call_chain(edges, starts, 3).select(F.array_join("keys", ">").alias("path"), "length")


# Findings

_SEV = "CASE event_type WHEN 'error' THEN 'critical ' WHEN 'click' THEN 'LOW' WHEN 'view' THEN 'Medium' WHEN 'purchase' THEN 'HIGH' ELSE 'odd' END"
_KNOWN = "CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'click' THEN 'LOW' WHEN 'view' THEN 'MEDIUM' WHEN 'purchase' THEN 'HIGH' ELSE 'INFO' END"
_ANSWER = f"concat(CASE WHEN event_id % 3 = 0 THEN 'Here: ' ELSE '' END, CASE WHEN event_id % 5 = 0 THEN '' ELSE '[' END, '{{\"severity\": \"', {_SEV}, '\", \"title\": \" t', CAST(event_id AS STRING), ' \", \"extra\": ', props, '}}', CASE WHEN event_id % 5 = 0 THEN '' ELSE ', 7]' END)"
_EVENTS = f"SELECT event_id, user_id, event_type, ts, value, {_ANSWER} AS raw_response, {_KNOWN} AS severity FROM {{events}}"


def _events(spark, sf_dir):
    return corpus.run_sql(spark, _EVENTS, events=read_table(spark, sf_dir, "events"))


@query(f"SELECT event_id, CASE WHEN event_id % 15 = 0 THEN 'INFO' ELSE severity END AS severity, CASE WHEN event_id % 15 = 0 THEN 'Scan Results (unstructured)' ELSE concat('t', CAST(event_id AS VARCHAR)) END AS title, CASE WHEN event_id % 15 = 0 THEN 'N/A' ELSE 'Unknown' END AS location FROM ({_EVENTS.replace("{events}", "events")})")
def f1_f2_parse_and_normalize(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("f", F.explode(audit.parse_findings(F.col("raw_response"))))
    return rows.select("event_id", "f.severity", "f.title", "f.location")


def _findings(spark, sf_dir):
    rows = _events(spark, sf_dir)
    project = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 500).cast("string"))
    return rows.select(project.alias("project_id"), (F.col("event_id") % 10).cast("string").alias("category"), (F.col("event_id") % 10).cast("string").alias("display_name"), F.col("event_id").alias("pos"), "severity")


_F = f"(SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(floor(event_id / 500) AS BIGINT) AS VARCHAR)) AS project_id, CAST(event_id % 10 AS VARCHAR) AS category, event_id AS pos, severity FROM ({_EVENTS.replace("{events}", "events")}))"
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


@query(f"SELECT project_id, category, pos, severity, {_RANK} AS severity_rank FROM {_F}")
def f3_order_findings(spark, sf_dir):
    return audit.order_findings(_findings(spark, sf_dir)).select("project_id", "category", "pos", "severity", audit.severity_rank(F.col("severity")).alias("severity_rank"))


_SUMMARY = f"""SELECT project_id, total_findings, n_critical, n_high, n_medium, n_low, n_info, greatest(0, least(100, 100 - 15 * n_critical - 8 * n_high - 4 * n_medium - 2 * n_low))::INTEGER AS health_score FROM (SELECT project_id, count(*) AS total_findings,
 count(*) FILTER (severity = 'CRITICAL') AS n_critical, count(*) FILTER (severity = 'HIGH') AS n_high, count(*) FILTER (severity = 'MEDIUM') AS n_medium, count(*) FILTER (severity = 'LOW') AS n_low, count(*) FILTER (severity = 'INFO') AS n_info FROM {{f}} GROUP BY project_id)"""
_SUM = _SUMMARY.format(f=_F)
_GRADED = f"SELECT *, CASE WHEN health_score >= 90 THEN 'A' WHEN health_score >= 80 THEN 'B' WHEN health_score >= 65 THEN 'C' WHEN health_score >= 50 THEN 'D' ELSE 'F' END AS health_grade FROM ({_SUM})"
#: Every project was scanned for two categories more: one is clean, one failed.
_SCANNED = f"SELECT DISTINCT project_id, category, NULL AS error FROM {_F} UNION ALL SELECT DISTINCT project_id, 'clean', NULL FROM {_F} UNION ALL SELECT DISTINCT project_id, 'failed', 'timeout' FROM {_F}"


@query(f"""SELECT s.project_id, s.categories_scanned, s.categories_clean, n.total_findings, n_critical, n_high, n_medium, n_low, n_info, health_score, health_grade
 FROM (SELECT project_id, count(*) AS categories_scanned, count(*) FILTER (category = 'clean') AS categories_clean FROM ({_SCANNED}) GROUP BY project_id) s JOIN ({_GRADED}) n ON s.project_id = n.project_id""")
def f4_f5_scan_summary(spark, sf_dir):
    found = _findings(spark, sf_dir)
    return audit.scan_summary(_scanned(found), found)


def _scanned(found):
    results = found.select("project_id", "category", F.lit(None).cast("string").alias("error")).distinct()
    more = F.explode(F.array(F.struct(F.lit("clean").alias("category"), F.lit(None).cast("string").alias("error")), F.struct(F.lit("failed").alias("category"), F.lit("timeout").alias("error")))).alias("x")
    return results.unionByName(found.select("project_id").distinct().select("project_id", more).select("project_id", "x.*"))


_KEYS = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{c[0]}'" for i, c in enumerate(specs.CATEGORIES)) + " END"
_NAMES = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{c[1]}'" for i, c in enumerate(specs.CATEGORIES)) + " END"
_REPORTED = f"(SELECT concat(CAST(user_id AS VARCHAR), '-', CAST(CAST(floor(event_id / 500) AS BIGINT) AS VARCHAR)) AS project_id, event_id % 10 AS place, {_NAMES} AS display_name, event_id AS pos, severity FROM ({_EVENTS.replace('{events}', 'events')}))"
_BODY = "concat('[', severity, '] t', CAST(pos AS VARCHAR), chr(10), chr(10), CASE WHEN pos % 2 = 0 THEN concat('**Location:** `here`', chr(10), chr(10)) ELSE '' END, 'why', chr(10), chr(10))"


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY project_id, place ORDER BY {_RANK}, pos) AS nr FROM {_REPORTED}),
sections AS (SELECT project_id, place, concat('## ', any_value(display_name), chr(10), chr(10), CASE WHEN place = 9 THEN concat('> **Error:** timeout', chr(10)) ELSE string_agg(concat('### ', CAST(nr AS VARCHAR), '. ', {_BODY}), concat('---', chr(10), chr(10)) ORDER BY nr) END) AS t FROM f GROUP BY project_id, place),
n AS (SELECT project_id, count(*) AS total, count(DISTINCT place) AS scanned, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'LOW') AS l, count(*) FILTER (severity = 'INFO') AS i FROM f GROUP BY project_id),
g AS (SELECT *, greatest(0, 100 - 15 * c - 8 * h - 4 * m - 2 * l) AS score FROM n)
SELECT project_id, concat('# Security & Code Quality Report', chr(10), chr(10), '**Health Score:** ', CAST(score AS VARCHAR), '/100 (Grade: **', CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 65 THEN 'C' WHEN score >= 50 THEN 'D' ELSE 'F' END, '**)', chr(10), chr(10), '**Total Findings:** ', CAST(total AS VARCHAR), '  |  **Categories Scanned:** ', CAST(scanned AS VARCHAR), '  |  **Clean Categories:** 0', chr(10), chr(10),
 '## Severity Breakdown', chr(10), chr(10), '| Severity | Count |', chr(10), '|---|---|', chr(10), array_to_string(list_filter([CASE WHEN c > 0 THEN concat('| CRITICAL | ', CAST(c AS VARCHAR), ' |') END, CASE WHEN h > 0 THEN concat('| HIGH | ', CAST(h AS VARCHAR), ' |') END, CASE WHEN m > 0 THEN concat('| MEDIUM | ', CAST(m AS VARCHAR), ' |') END, CASE WHEN l > 0 THEN concat('| LOW | ', CAST(l AS VARCHAR), ' |') END, CASE WHEN i > 0 THEN concat('| INFO | ', CAST(i AS VARCHAR), ' |') END], lambda x: x IS NOT NULL), chr(10)),
 chr(10), chr(10), '---', chr(10), chr(10), (SELECT string_agg(t, chr(10) ORDER BY place) FROM sections s WHERE s.project_id = g.project_id)) AS report FROM g""")
def f6_scan_report(spark, sf_dir):
    """Findings of all events; the last category failed in every project that has findings of it."""
    keys, names = (F.array(*[F.lit(c[k]) for c in specs.CATEGORIES]) for k in (0, 1))
    rows = _findings(spark, sf_dir).withColumn("at", F.col("category").cast("int"))
    rows = rows.select(
        "project_id", F.get(keys, F.col("at")).alias("category"), F.get(names, F.col("at")).alias("display_name"), "pos", "severity", F.concat(F.lit("t"), "pos").alias("title"), F.when(F.col("pos") % 2 == 0, "here").otherwise("").alias("location"),
        F.lit("why").alias("description"), F.lit("").alias("recommendation"),
    )
    failed = F.when(F.col("category") == specs.CATEGORIES[-1][0], "timeout")
    return audit.scan_report(rows.select("project_id", "category", "display_name", failed.alias("error")).distinct(), rows)


@query(f"SELECT p.project_id, s.severity, count(f.severity) AS n FROM (SELECT DISTINCT project_id FROM {_F}) p CROSS JOIN (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) s(severity) LEFT JOIN {_F} f ON f.project_id = p.project_id AND f.severity = s.severity GROUP BY ALL")
def f4_findings_by_severity(spark, sf_dir):
    return audit.findings_by_severity(_findings(spark, sf_dir))


@query(f"SELECT project_id, category AS display_name, count(*) AS n FROM {_F} GROUP BY ALL")
def f4_findings_by_category(spark, sf_dir):
    return audit.findings_by_category(_findings(spark, sf_dir))


_MET = ", ".join("CASE WHEN regexp_matches(line, '" + r[3].replace("'", "''") + f"') THEN '{r[0]}' END" for r in specs.RULES)


@query(f"""SELECT doc_id, line_number, unnest(list_filter([{_MET}], lambda x: x IS NOT NULL)) AS rule_id
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line_number FROM documents)""")
def f7_rule_scan(spark, sf_dir):
    sources = _documents(spark, sf_dir).select(F.col("source").alias("project_id"), F.col("doc_id").alias("path"), F.col("text").alias("source"))
    return audit.rule_scan(sources).select(F.col("path").alias("doc_id"), "line_number", "rule_id")


# Answers

_TALK = "SELECT conv_id, turn, {text} AS raw FROM {conversations}"
_RAW = "concat('<think>', role, '</think>', chr(10), text, chr(10), chr(10), chr(10), chr(10), 'end<|im_end|>', CASE WHEN turn % 2 = 0 THEN '<think>never closed' ELSE '' END)"


def _talk(spark, sf_dir, text):
    return corpus.run_sql(spark, _TALK.replace("{text}", text), conversations=read_table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, concat(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), chr(10), 'end') AS answer FROM conversations")
def r1_clean_response(spark, sf_dir):
    return _talk(spark, sf_dir, _RAW).select("conv_id", "turn", tx.clean_response(F.col("raw")).alias("answer"))


_JSON = "concat('Sure: ```json', chr(10), '{\"turn\": ', CAST(turn AS STRING), ', \"list\": [1, 2', CASE WHEN turn % 2 = 1 THEN ',' ELSE '' END, ']}', chr(10), '```', CASE WHEN turn % 5 = 4 THEN ' }' ELSE '' END)"


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE concat('{\"turn\": ', CAST(turn AS VARCHAR), ', \"list\": [1, 2]}') END AS found FROM conversations")
def r2_extract_json(spark, sf_dir):
    return _talk(spark, sf_dir, _JSON).select("conv_id", "turn", tx.extract_json(F.col("raw")).alias("found"))


_DOC = "concat('Answer: ', chr(10), '# Over', CAST(turn AS STRING), chr(10), 'core features', chr(10), 'some text.', chr(10), chr(10), chr(10), '#### deep', chr(10), 'Data Access Rules', chr(10), 'last')"


@query("SELECT conv_id, turn, concat('### Over', CAST(turn AS VARCHAR), chr(10), '### core features', chr(10), 'some text.', chr(10), chr(10), '#### deep', chr(10), '### Data Access Rules', chr(10), 'last') AS found FROM conversations")
def r3_normalize_doc(spark, sf_dir):
    return _talk(spark, sf_dir, _DOC).select("conv_id", "turn", tx.normalize_doc(F.col("raw")).alias("found"))


_TITLED = "concat(CASE turn % 4 WHEN 3 THEN '### Something Else' WHEN 2 THEN 'Project Overview' ELSE '### Project Overview' END, CASE WHEN turn % 2 = 0 THEN ' of all' ELSE ' x' END, chr(10), role)"


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN concat('### Something Else x', chr(10), role) WHEN 2 THEN concat('Project Overview of all', chr(10), role) ELSE role END AS found FROM conversations")
def r4_strip_duplicate_title(spark, sf_dir):
    return _talk(spark, sf_dir, _TITLED).select("conv_id", "turn", tx.strip_duplicate_title(F.col("raw"), F.lit("📋 Project Overview")).alias("found"))


_TITLES = ", ".join(f"({i}, '{s[1]}')" for i, s in enumerate(specs.SECTIONS))


@query(f"SELECT conv_id AS project_id, concat('# Project Documentation', chr(10), string_agg(concat(chr(10), '---', chr(10), chr(10), '## ', title, chr(10), chr(10), coalesce(text, ''), chr(10)), '' ORDER BY turn)) AS report FROM conversations JOIN (VALUES {_TITLES}) s(t, title) ON turn = t GROUP BY conv_id")
def r5_assemble_report(spark, sf_dir):
    """Turns as sections; turns beyond the seven sections have no place in a report."""
    talk = read_table(spark, sf_dir, "conversations")
    keys = F.array(*[F.lit(s[0]) for s in specs.SECTIONS])
    return audit.assemble_report(talk.select(F.col("conv_id").alias("project_id"), F.get(keys, F.col("turn").cast("int")).alias("key"), F.col("text").alias("content")))


# Diagram records: a class diagram for each nation, with its suppliers as classes

_DIAGRAM_DOCS = """SELECT n_nationkey AS diagram_id, 'class_diagram' AS diagram_type, concat('{"classes": [', cls, '], "relationships": [{"source": "', low, '", "target": "', upper(high), '", "label": "includes"}, {"source": "', low, '", "target": "Outside', CAST(n_nationkey AS STRING), '", "arrow_type": "--|>"}], "notes": [{"target": "nobody", "position": "ABOVE"}]}') AS json, low, high, n
FROM {nation} JOIN (SELECT s_nationkey, {agg} AS cls, min(s_name) AS low, max(s_name) AS high, count(*) AS n FROM {supplier} GROUP BY s_nationkey) s ON s_nationkey = n_nationkey"""


def _diagrams(spark, sf_dir):
    agg = """array_join(transform(sort_array(collect_list(s_name)), x -> concat('{"name": " ', x, ' "}, {"name": "', lower(x), '"}')), ', ')"""
    docs = corpus.run_sql(spark, _DIAGRAM_DOCS.replace("{agg}", agg), nation=read_table(spark, sf_dir, "nation"), supplier=read_table(spark, sf_dir, "supplier"))
    return docs.select("diagram_id", "diagram_type", "json")


@query("SELECT s_nationkey AS diagram_id, s_name AS name, 'class' AS kind FROM supplier")
def d1_d2_parse_and_dedupe(spark, sf_dir):
    return diagrams.dedupe_entities(diagrams.parse_entities(_diagrams(spark, sf_dir))).select("diagram_id", "name", "kind")


def _resolved(spark, sf_dir):
    """The documents, their entities, and their relationships with canonical ends, stored."""
    docs = durable(_diagrams(spark, sf_dir), "diagrams")
    entities, links = durable(diagrams.dedupe_entities(diagrams.parse_entities(docs)), "entities"), diagrams.parse_relationships(docs)
    for end in ("source", "target"):
        links = diagrams.resolve_references(links, entities, end)
    return docs, entities, durable(links, "relationships")


_ENDS = "(SELECT s_nationkey AS diagram_id, min(s_name) AS low, max(s_name) AS high FROM supplier GROUP BY s_nationkey)"


@query(f"SELECT diagram_id, 0 AS pos, low AS source, high AS target, 'include' AS kind FROM {_ENDS} UNION ALL SELECT diagram_id, 1, low, concat('Outside', CAST(diagram_id AS VARCHAR)), 'generalization' FROM {_ENDS}")
def d3_d5_resolve_and_relation_kind(spark, sf_dir):
    _, _, links = _resolved(spark, sf_dir)
    return links.select("diagram_id", "pos", "source", "target", diagrams.relation_kind(F.col("label"), F.col("arrow_type")).alias("kind"))


@query(f"SELECT diagram_id, concat('Outside', CAST(diagram_id AS VARCHAR)) AS name, 'external' AS kind FROM {_ENDS}")
def d4_promote_external(spark, sf_dir):
    docs, entities, links = _resolved(spark, sf_dir)
    return diagrams.promote_external(entities, links).filter("kind <> 'class'").select("diagram_id", "name", "kind")


@query(f"""SELECT diagram_id, 'too many' AS "check", 'class' AS subject FROM (SELECT s_nationkey AS diagram_id, count(*) AS n FROM supplier GROUP BY ALL) WHERE n > 15 UNION ALL SELECT diagram_id, 'undeclared endpoint', concat('Outside', CAST(diagram_id AS VARCHAR)) FROM {_ENDS}
 UNION ALL SELECT diagram_id, 'undeclared note target', 'nobody' FROM {_ENDS}""")
def d7_integrity_errors(spark, sf_dir):
    docs, entities, links = _resolved(spark, sf_dir)
    return diagrams.integrity_errors(docs, entities, links, diagrams.parse_notes(docs))


_STATE_DOCS = """SELECT c_nationkey AS diagram_id, 'state_diagram' AS diagram_type, concat('{"states": ["', low, '", "Idle', CAST(c_nationkey AS STRING), '"], "transitions": [{"source": "', CASE WHEN c_nationkey % 2 = 0 THEN '[*]' ELSE low END, '", "target": "', low, '"}]}') AS json, low
FROM (SELECT c_nationkey, min(c_name) AS low FROM {customer} GROUP BY c_nationkey)"""


@query("SELECT DISTINCT c_nationkey AS diagram_id, concat('Idle', CAST(c_nationkey AS VARCHAR)) AS name FROM customer WHERE c_nationkey % 2 = 1")
def d6_initial_state(spark, sf_dir):
    docs = corpus.run_sql(spark, _STATE_DOCS, customer=read_table(spark, sf_dir, "customer")).select("diagram_id", "diagram_type", "json")
    entities = diagrams.dedupe_entities(diagrams.parse_entities(docs))
    return diagrams.initial_states(entities, diagrams.parse_relationships(docs))


#: A diagram of each type for each nation, made of its suppliers and customers' segments.
_ALL_TYPES = """SELECT n_nationkey AS diagram_id, 'sequence_diagram' AS diagram_type, concat('{"participants": [{"name": "', low, '", "alias": "L"}, {"name": "', high, '"}], "messages": [{"sender": "L", "receiver": "', upper(high), '"}], "groups": [{"messages": [{"sender": "', high, '", "receiver": "L", "label": "g"}], "else_messages": [{"sender": "L", "receiver": "L"}]}]}') AS json FROM {ends}
UNION ALL SELECT n_nationkey, 'package_diagram', concat('{"packages": [{"name": "p', CAST(n_nationkey AS STRING), '", "classes": ["', low, '", "', lower(low), '", "', high, '"]}]}') FROM {ends}
UNION ALL SELECT n_nationkey, 'deployment_diagram', concat('{"nodes": [{"name": "device", "children": ["', low, '", {"name": "', high, '"}]}, {"name": "server"}]}') FROM {ends}
UNION ALL SELECT n_nationkey, 'component_diagram', concat('{"components": [{"name": "', low, '"}], "interfaces": [{"name": "Api", "alias": "a-', CAST(n_nationkey AS STRING), '"}], "external_components": [{"name": "', high, '"}]}') FROM {ends}
UNION ALL SELECT n_nationkey, 'usecase_diagram', concat('{"actors": [{"name": "', low, '"}], "usecases": [{"name": "buy"}, {"name": " Buy "}, {"name": "sell  it"}]}') FROM {ends}
UNION ALL SELECT n_nationkey, 'navigation_diagram', concat('{"screens": [{"name": "', low, '"}, {"name": "MainActivity"}', CASE WHEN n_nationkey % 3 = 0 THEN '], "entry_screen": "Given"' ELSE ']' END, ', "transitions": [', CASE WHEN n_nationkey % 3 = 1 THEN concat('{"source": "[*]", "target": "', low, '"}, ') ELSE '' END, '{"source": "', low, '", "target": "[*]"}, {"source": "', upper(low), '", "target": "[*]"}, {"source": "[*]", "target": "[*]"}]}') FROM {ends}"""
_NATION_ENDS = "(SELECT n_nationkey, min(s_name) AS low, max(s_name) AS high FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING min(s_name) <> max(s_name))"
_PAIRS = _NATION_ENDS.replace("{supplier}", "supplier").replace("{nation}", "nation")


def _typed_diagrams(spark, sf_dir):
    tables = {t: read_table(spark, sf_dir, t) for t in ("supplier", "nation")}
    return corpus.run_sql(spark, _ALL_TYPES.replace("{ends}", _NATION_ENDS), **tables)


def _kinds(*rows):
    return " UNION ALL ".join(f"SELECT n_nationkey AS diagram_id, '{t}' AS diagram_type, '{kind}' AS kind, {parent} AS parent, {name} AS name FROM {_PAIRS}" for t, kind, parent, name in rows)


@query(_kinds(
    ("sequence_diagram", "participant", "''", "low"), ("sequence_diagram", "participant", "''", "high"), ("package_diagram", "package", "''", "concat('p', CAST(n_nationkey AS VARCHAR))"),
    ("package_diagram", "member", "concat('p', CAST(n_nationkey AS VARCHAR))", "low"), ("package_diagram", "member", "concat('p', CAST(n_nationkey AS VARCHAR))", "high"),
    ("deployment_diagram", "node", "''", "'device'"), ("deployment_diagram", "node", "''", "'server'"), ("deployment_diagram", "child", "'device'", "low"), ("deployment_diagram", "child", "'device'", "high"),
    ("component_diagram", "component", "''", "low"), ("component_diagram", "interface", "''", "'Api'"), ("component_diagram", "external", "''", "high"),
    ("usecase_diagram", "actor", "''", "low"), ("usecase_diagram", "usecase", "''", "'buy'"), ("usecase_diagram", "usecase", "''", "'sell it'"), ("navigation_diagram", "screen", "''", "low"), ("navigation_diagram", "screen", "''", "'MainActivity'"),
))
def d1_entities_of_all_types(spark, sf_dir):
    docs = _typed_diagrams(spark, sf_dir).withColumn("type", F.col("diagram_type")).withColumn("diagram_id", F.concat_ws("/", "diagram_id", "type"))  # a document each
    found = diagrams.dedupe_entities(diagrams.parse_entities(docs))
    return found.select(F.split("diagram_id", "/")[0].cast("int").alias("diagram_id"), "diagram_type", "kind", "parent", "name")


@query(f"SELECT n_nationkey AS diagram_id, pos, a AS source, b AS target, label FROM (SELECT n_nationkey, 0 AS pos, low AS a, high AS b, '' AS label FROM {_PAIRS} UNION ALL SELECT n_nationkey, 1, high, low, 'g' FROM {_PAIRS} UNION ALL SELECT n_nationkey, 2, low, low, '' FROM {_PAIRS})")
def d1_d3_sequence_messages(spark, sf_dir):
    docs = _typed_diagrams(spark, sf_dir).filter("diagram_type = 'sequence_diagram'")
    entities, links = durable(diagrams.dedupe_entities(diagrams.parse_entities(docs)), "entities"), diagrams.parse_relationships(docs)
    for end in ("source", "target"):
        links = diagrams.resolve_references(links, entities, end)
    return links.select("diagram_id", "pos", "source", "target", "label")


@query(f"SELECT n_nationkey AS diagram_id, CASE n_nationkey % 3 WHEN 0 THEN 'Given' WHEN 1 THEN low ELSE 'MainActivity' END AS entry, low AS exits FROM {_PAIRS}")
def d6_entry_and_exit_screens(spark, sf_dir):
    docs = _typed_diagrams(spark, sf_dir).filter("diagram_type = 'navigation_diagram'")
    entities, links = diagrams.dedupe_entities(diagrams.parse_entities(docs)), diagrams.parse_relationships(docs)
    entry = diagrams.entry_screens(docs, entities, links).select("diagram_id", F.col("name").alias("entry"))
    return entry.join(diagrams.exit_screens(links).select("diagram_id", F.col("name").alias("exits")), "diagram_id")


# Members, types, flags and actions: every nation is a class with its suppliers as fields and methods, a participant, a node and a state

_MEMBER_DOCS = """SELECT n_nationkey AS diagram_id, t AS diagram_type, CASE t
 WHEN 'class_diagram' THEN concat('{"classes": [{"name": "', n_name, '", "stereotype": "s', n_nationkey, '", "package": "p", "is_abstract": ', CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END, ', "is_interface": ',
  CASE n_nationkey % 3 WHEN 0 THEN '"no"' WHEN 1 THEN '0' ELSE '""' END, ', "fields": [', fields, ', {"visibility": "?"}], "methods": [', methods, ', "plain", {"name": "m"}, {"name": "m"}]}], "external_classes": [{"name": "Ext", "fields": [{"name": "x", "type": "int", "visibility": "~"}]}]}')
 WHEN 'sequence_diagram' THEN concat('{"participants": [{"name": "', n_name, '", "participant_type": "', CASE n_nationkey % 3 WHEN 0 THEN 'Actor' WHEN 1 THEN 'robot' ELSE 'database' END, '"}, {"name": "B"}], "groups": [{"group_type": "', CASE n_nationkey % 2 WHEN 0 THEN 'LOOP' ELSE 'maybe' END, '", "label": "g", "messages": [{}, {}]}, {"else_messages": []}]}')
 WHEN 'deployment_diagram' THEN concat('{"nodes": [{"name": "', n_name, '", "node_type": "', CASE n_nationkey % 2 WHEN 0 THEN 'Cloud' ELSE 'moon' END, '", "children": ["a", {"name": "b", "child_type": "Odd"}, {"name": "c"}]}]}')
 ELSE concat('{"states": [{"name": "', n_name, '", "entry_action": "in', n_nationkey, '", "do_action": "run"}, {"name": "B", "exit_action": "out"}]}') END AS json
FROM {nation} JOIN (SELECT s_nationkey, {fields} AS fields, {methods} AS methods FROM {supplier} GROUP BY s_nationkey) s ON s_nationkey = n_nationkey
CROSS JOIN (VALUES ('class_diagram'), ('sequence_diagram'), ('deployment_diagram'), ('state_diagram')) v(t)"""
_SEEN = "CASE s_suppkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '#' WHEN 2 THEN '~' ELSE '+' END"


def _member_docs(spark, sf_dir):
    seen = "CASE s_suppkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '#' WHEN 2 THEN '~' WHEN 3 THEN 'public' ELSE '+' END"
    one = lambda kind: f"""array_join(transform(sort_array(collect_list(struct(s_suppkey, s_name, {seen} AS seen))), x -> concat('{{"name": "{kind}', x.s_suppkey, '", "{'type' if kind == 'f' else 'return_type'}": "', x.s_name, '", "params": "int a", "visibility": "', x.seen, '"}}')), ', ')"""
    return corpus.run_sql(spark, _MEMBER_DOCS.replace("{fields}", one("f")).replace("{methods}", one("m")), nation=read_table(spark, sf_dir, "nation"), supplier=read_table(spark, sf_dir, "supplier"))


_ODD_STEPS = """SELECT n_nationkey AS diagram_id, 'activity_diagram' AS diagram_type, CASE n_nationkey % 4
 WHEN 0 THEN '{"steps": []}' WHEN 1 THEN concat('{"swimlanes": ["A", "A", ""], "steps": [{"label": "', n_name, '", "swimlane": "A"}, {"label": " ", "swimlane": "B"}, {"step_type": "fork"}, {"swimlane": "B", "label": "x"}]}')
 WHEN 2 THEN '{"steps": [{"step_type": "decision", "yes_steps": [{"step_type": "stop"}]}, {"step_type": "decision", "condition": "c", "no_steps": [{"step_type": "stop"}]}]}'
 ELSE concat('{"steps": [', repeat('{"step_type": "decision", "condition": "c", "yes_steps": [', 7), '{"step_type": "fork"}', repeat(']}', 7), ', {"label": "', n_name, '"}]}') END AS json FROM {nation}"""


@query("""SELECT n_nationkey AS diagram_id, "check", subject FROM nation, (VALUES (0, 'no steps', ''), (1, 'duplicate swimlane', 'A'), (1, 'undeclared swimlane', 'B'), (1, 'empty action label', '0001'), (1, 'empty fork label', '0002'),
 (2, 'empty condition', '0000'), (2, 'no yes steps', '0001'), (2, 'no action steps', ''), (3, 'nesting too deep', concat('0000', repeat('/y0000', 5)))) v(k, "check", subject) WHERE n_nationkey % 4 = k""")
def d7_step_errors(spark, sf_dir):
    docs = corpus.run_sql(spark, _ODD_STEPS, nation=read_table(spark, sf_dir, "nation"))
    return diagrams.step_errors(docs, diagrams.parse_steps(docs))


_WITH = "(SELECT n_nationkey AS diagram_id, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))"


@query(f"""SELECT diagram_id, 'class' AS kind, n_name AS class_name, member, CASE member WHEN 'field' THEN concat('f', CAST(s_suppkey AS VARCHAR)) ELSE concat('m', CAST(s_suppkey AS VARCHAR)) END AS name, s_name AS type, CASE member WHEN 'field' THEN '' ELSE 'int a' END AS params, {_SEEN} AS visibility
 FROM {_WITH} JOIN supplier ON s_nationkey = diagram_id, (VALUES ('field'), ('method')) v(member)
 UNION ALL SELECT diagram_id, 'class', n_name, 'field', '', '', '', '+' FROM {_WITH} UNION ALL SELECT diagram_id, 'class', n_name, 'method', unnest(['plain', 'm', 'm']), '', '', '+' FROM {_WITH}
 UNION ALL SELECT diagram_id, 'external', 'Ext', 'field', 'x', 'int', '', '~' FROM {_WITH}""")
def d1_class_members(spark, sf_dir):
    """Fields and methods with types, parameters and visibility."""
    return diagrams.parse_members(_member_docs(spark, sf_dir)).drop("class_pos", "pos")


@query(f"""SELECT diagram_id, kind, parent, name, entity_type, stereotype, is_abstract, is_interface, concat_ws('|', entry_action, exit_action, do_action) AS actions FROM (
 SELECT diagram_id, 'class' AS kind, '' AS parent, n_name AS name, '' AS entity_type, concat('s', CAST(diagram_id AS VARCHAR)) AS stereotype, diagram_id % 2 = 0 AS is_abstract, diagram_id % 3 = 0 AS is_interface, '' AS entry_action, '' AS exit_action, '' AS do_action FROM {_WITH}
 UNION ALL SELECT diagram_id, 'external', '', 'Ext', '', '', false, false, '', '', '' FROM {_WITH}
 UNION ALL SELECT diagram_id, 'participant', '', n_name, CASE diagram_id % 3 WHEN 0 THEN 'actor' WHEN 1 THEN 'participant' ELSE 'database' END, '', false, false, '', '', '' FROM {_WITH}
 UNION ALL SELECT diagram_id, 'participant', '', 'B', 'participant', '', false, false, '', '', '' FROM {_WITH}
 UNION ALL SELECT diagram_id, 'node', '', n_name, CASE diagram_id % 2 WHEN 0 THEN 'cloud' ELSE 'node' END, '', false, false, '', '', '' FROM {_WITH}
 UNION ALL SELECT diagram_id, 'child', n_name, unnest(['a', 'b', 'c']), unnest(['artifact', 'Odd', 'artifact']), '', false, false, '', '', '' FROM {_WITH}
 UNION ALL SELECT diagram_id, 'state', '', n_name, '', '', false, false, concat('in', CAST(diagram_id AS VARCHAR)), '', 'run' FROM {_WITH}
 UNION ALL SELECT diagram_id, 'state', '', 'B', '', '', false, false, '', 'out', '' FROM {_WITH})""")
def d1_entity_traits(spark, sf_dir):
    """Types of participants, nodes and children, stereotypes, flags, and the actions of states."""
    found = diagrams.parse_traits(_member_docs(spark, sf_dir))
    return found.select("diagram_id", "kind", "parent", "name", "entity_type", "stereotype", "is_abstract", "is_interface", F.concat_ws("|", "entry_action", "exit_action", "do_action").alias("actions"))


@query(f"""SELECT diagram_id, 0 AS pos, CASE diagram_id % 2 WHEN 0 THEN 'loop' ELSE 'alt' END AS group_type, 'g' AS label, 2 AS n_messages, 0 AS n_else_messages FROM {_WITH} UNION ALL SELECT diagram_id, 1, 'alt', '', 0, 0 FROM {_WITH}""")
def d1_message_groups(spark, sf_dir):
    return diagrams.parse_groups(_member_docs(spark, sf_dir)).drop("else_label")


@query(f"""SELECT diagram_id, "check", subject FROM (SELECT diagram_id, 'empty member name' AS "check", concat(n_name, ' field') AS subject FROM {_WITH} UNION ALL SELECT diagram_id, 'duplicate member', concat(n_name, '.m') FROM {_WITH}
 UNION ALL SELECT diagram_id, 'abstract interface', n_name FROM {_WITH} WHERE diagram_id % 6 = 0 UNION ALL SELECT diagram_id, 'empty group', '1' FROM {_WITH})""")
def d7_member_errors(spark, sf_dir):
    docs = _member_docs(spark, sf_dir)
    return diagrams.member_errors(diagrams.parse_members(docs), diagrams.parse_traits(docs), diagrams.parse_groups(docs))


_STEP_DOCS = """SELECT n_nationkey AS diagram_id, 'activity_diagram' AS diagram_type, concat('{"steps": [', repeat('{"step_type": "Decision", "condition": "c", "no_steps": [{"label": "no", "step_type": "odd"}], "yes_steps": [', CAST(n_nationkey AS INT)), '{"label": "leaf", "step_type": "STOP"}', repeat(']}', CAST(n_nationkey AS INT)), ']}') AS json FROM {nation}"""


@query("""SELECT n_nationkey AS diagram_id, CAST(d AS INTEGER) AS depth, 'decision' AS step_type, '' AS label, concat('0000', repeat('/y0000', CAST(d AS INT))) AS path FROM nation, range(0, 25) r(d) WHERE d < n_nationkey
 UNION ALL SELECT n_nationkey, CAST(d + 1 AS INTEGER), 'action', 'no', concat('0000', repeat('/y0000', CAST(d AS INT)), '/n0000') FROM nation, range(0, 25) r(d) WHERE d < n_nationkey
 UNION ALL SELECT n_nationkey, CAST(n_nationkey AS INTEGER), 'stop', 'leaf', concat('0000', repeat('/y0000', CAST(n_nationkey AS INT))) FROM nation""")
def d1_activity_steps(spark, sf_dir):
    """Decisions nested as deep as the nation's number."""
    docs = corpus.run_sql(spark, _STEP_DOCS, nation=read_table(spark, sf_dir, "nation"))
    return diagrams.parse_steps(docs).select("diagram_id", "depth", "step_type", "label", "path")


#: Documents with errors: of each nation one of five kinds.
_BAD_DOCS = """SELECT n_nationkey AS diagram_id, CASE n_nationkey % 5 WHEN 0 THEN 'state_diagram' WHEN 1 THEN 'usecase_diagram' WHEN 2 THEN 'package_diagram' WHEN 3 THEN 'sequence_diagram' ELSE 'class_diagram' END AS diagram_type,
 CASE n_nationkey % 5 WHEN 0 THEN concat('{"states": [{"name": "', n_name, '"}], "transitions": [{"source": "[*]", "target": "[*]"}, {"source": "', n_name, '", "target": ""}]}')
 WHEN 1 THEN concat('{"actors": [{"name": "A"}, {"name": "B"}], "usecases": [{"name": "', n_name, '"}, {"name": "U"}], "relationships": [{"source": "A", "target": "B", "label": "x"}, {"source": "U", "target": "', n_name, '", "label": "x"}, {"source": "A", "target": "U", "label": "include"}, {"source": "A", "target": "U"}]}')
 WHEN 2 THEN concat('{"packages": [{"name": "p", "classes": ["', n_name, '", "X"]}, {"name": "q", "classes": ["X"]}], "notes": [{"target": "", "text": "fine here"}]}')
 WHEN 3 THEN '{"participants": []}' ELSE concat('{"classes": [{"name": " "}, {"name": "', n_name, '"}, {"name": "', lower(n_name), '"}], "notes": [{"target": ""}], "relationships": [{"source": "", "target": "', n_name, '"}]}') END AS json FROM {nation}"""
_ERRORS = " UNION ALL ".join(
    f"""SELECT n_nationkey AS diagram_id, '{check}' AS "check", {subject} AS subject FROM nation WHERE n_nationkey % 5 = {k}"""
    for k, check, subject in [
        (0, "edge to edge", "'0'"), (0, "empty target", "'1'"), (1, "relation between wrong kinds", "'A association B'"), (1, "relation between wrong kinds", "concat('U association ', n_name)"), (1, "relation between wrong kinds", "'A include U'"),
        (2, "class in several packages", "'X'"), (3, "no entities", "''"), (3, "no transitions", "''"), (4, "empty name", "'class'"), (4, "duplicate", "lower(n_name)"), (4, "empty note target", "'0'"), (4, "empty source", "'0'"),
    ]
)


@query(_ERRORS)
def d7_errors_of_other_kinds(spark, sf_dir):
    """Errors in the documents as they come, before names are cleaned and references resolved."""
    docs = durable(corpus.run_sql(spark, _BAD_DOCS, nation=read_table(spark, sf_dir, "nation")), "diagrams")
    return diagrams.integrity_errors(docs, diagrams.parse_entities(docs), diagrams.parse_relationships(docs), diagrams.parse_notes(docs))


# History


def _runs(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("project_path"), F.col("ts").alias("last_accessed"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("total_files"), F.col("event_id").alias("parsed"), (F.col("event_id") * 2).alias("total_chunks"))


@query("SELECT user_id AS project_path, arg_max(event_id, (ts, event_id)) AS total_files, 2 * arg_max(event_id, (ts, event_id)) AS total_chunks FROM events GROUP BY user_id")
def h1_latest_runs(spark, sf_dir):
    return history.latest_runs(_runs(spark, sf_dir)).select("project_path", "total_files", "total_chunks")


@query("SELECT user_id AS project_path, strftime(max(ts), '%Y-%m-%d %H:%M') AS shown FROM events GROUP BY user_id")
def h2_recent_projects(spark, sf_dir):
    return history.recent_projects(_runs(spark, sf_dir)).select("project_path", "shown")


@query("SELECT turn, role, text AS content FROM conversations WHERE conv_id = 3")
def h3_chat_of(spark, sf_dir):
    chats = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project_path"), "turn", "role", F.col("text").alias("content"))
    return history.chat_of(chats, 3)


@query("SELECT conv_id AS project_path, turn, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE role END AS role FROM conversations WHERE conv_id % 3 <> 0 OR turn = 0")
def h3_replace_chats(spark, sf_dir):
    chats = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project_path"), "turn", "role")
    return history.replace_chats(chats, chats.filter("project_path % 3 = 0 AND turn = 0").withColumn("role", F.lit("new")))


@query("""SELECT coalesce(r.p, c.p) AS project_path, r.last, r.files AS total_files, 2 * r.files AS total_chunks, c.n AS n_turns, c.digest FROM (SELECT CAST(user_id AS VARCHAR) AS p, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, arg_max(event_id, (ts, event_id)) AS files FROM events GROUP BY user_id) r
 FULL JOIN (SELECT CAST(conv_id AS VARCHAR) AS p, count(*) AS n, md5(string_agg(concat(role, ':', text), '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id) c ON r.p = c.p""")
def s8_history_round_trip(spark, sf_dir):
    """Runs of all users and chats of all conversations, saved as JSON and loaded again."""
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    chats = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("project_path"), "turn", "role", F.col("text").alias("content"))
    store.save_history(history.latest_runs(_runs(spark, sf_dir)).withColumn("project_path", F.col("project_path").cast("string")), chats, path)
    runs, chats = store.load_history(spark, path)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "content").alias("x")))), lambda t: t["x"]), "|")
    talk = chats.groupBy("project_path").agg(F.count(F.lit(1)).alias("n_turns"), F.md5(said).alias("digest"))  # the turns of a chat
    runs = runs.select("project_path", F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss").alias("last"), "total_files", "total_chunks")
    return runs.join(talk, "project_path", "full")
