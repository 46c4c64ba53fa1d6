"""Mixing sources to target weights: budgets down a tree, then a token prefix of each leaf.

A tree of domain, language and source carries weights. A token budget enters at the root and is
divided among the children by weight; a child that holds fewer tokens (over all its allowed epochs)
than its share takes what it holds, and the rest goes to its siblings, in proportion to their
weights. What all children of a node together cannot hold never reaches that node, because a node's
capacity is the sum of its leaves': so siblings fill a shortage before their ancestors' siblings do.

Each leaf then takes its tokens from seeded epochs: as many whole epochs as fit, and of the next one
the longest prefix, in that epoch's order, that stays within what is left.

At scale: documents are counted by leaf with map-side combining; the tree is tiny. A prefix is
not found by sorting a leaf in one task: tokens are summed over slices of the hashed order (about
``SLICE`` documents each), a running sum over the slices finds the one the cut falls in, and only that
slice is sorted.

Defined results: a null or empty text holds no tokens, is in the order like any other and is taken if
it falls in the prefix; a null domain, language or source is the value ``''``; weights that are
missing are 1, a weight of 0 or less takes nothing; rows that repeat an id are ordered by id and then
together (they are taken or left together).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.sources.scratch import durable

LEVELS = ["domain", "language", "leaf_source"]
SLICE = 1000


def word_tokens(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(body == "", F.lit(0)).otherwise(F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1).cast("long")


def _divide(nodes: DataFrame, by: list[str], capacity: str, weight: str, budget: str, out: str) -> DataFrame:
    """Shares of ``budget`` among the rows with the same ``by``: least(capacity, weight * level)."""
    ratio = F.col(capacity) / F.col(weight)
    order = Window.partitionBy(*by).orderBy(F.col("_ratio"), *[c for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    made = nodes.withColumn("_ratio", F.when(F.col(weight) > 0, ratio).otherwise(0.0))
    made = made.withColumn("_cap", F.when(F.col(weight) > 0, F.col(capacity)).otherwise(0))
    made = made.withColumn("_w", F.greatest(F.col(weight), F.lit(0.0)))
    made = made.withColumn("_left_w", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    made = made.withColumn("_left_b", F.col(budget) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    made = made.withColumn("_level", F.when(F.col("_left_w") > 0, F.greatest(F.lit(0.0), F.col("_left_b") / F.col("_left_w"))))
    level = F.max("_level").over(whole)  # levels rise while children are filled up, and fall after that
    share = F.least(F.col("_cap").cast("double"), F.col("_w") * F.coalesce(level, F.lit(1e300)))
    return made.withColumn(out, share).drop("_ratio", "_cap", "_w", "_left_w", "_left_b", "_level")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: Column, max_epochs: int = 1) -> DataFrame:
    """``leaves`` (domain, language, leaf_source, leaf_tokens) with each leaf's ``leaf_budget`` (long)."""

    def weight(level):
        given = weights.get(level) or {}
        pairs = [x for k, v in sorted(given.items()) for x in (F.lit(k), F.lit(float(v)))]
        return F.coalesce(F.create_map(*pairs)[F.col(level)], F.lit(1.0)) if pairs else F.lit(1.0)

    tree = leaves.withColumn("_c2", F.col("leaf_tokens") * max_epochs)
    tree = tree.withColumn("_c1", F.sum("_c2").over(Window.partitionBy("domain", "language")))
    nodes1 = tree.groupBy("domain").agg(F.sum("_c2").alias("_cap0"))
    nodes1 = nodes1.withColumn("_whole", F.sum("_cap0").over(Window.partitionBy()))
    nodes1 = nodes1.withColumns({"_budget": F.least(F.col("_whole").cast("double"), budget(F.col("_whole") / max_epochs)), "_weight": weight("domain")})
    nodes1 = _divide(nodes1, [], "_cap0", "_weight", "_budget", "_b0").select("domain", "_b0")
    nodes2 = tree.groupBy("domain", "language").agg(F.sum("_c2").alias("_cap1")).join(nodes1, "domain").withColumn("_weight", weight("language"))
    nodes2 = _divide(nodes2, ["domain"], "_cap1", "_weight", "_b0", "_b1").select("domain", "language", "_b1")
    nodes3 = tree.join(nodes2, ["domain", "language"]).withColumn("_weight", weight("leaf_source"))
    nodes3 = _divide(nodes3, ["domain", "language"], "_c2", "_weight", "_b1", "_b2")
    return nodes3.select(*leaves.columns, F.floor(F.col("_b2") + 1e-6).cast("long").alias("leaf_budget"))


def select(docs: DataFrame, domain: Column, weights: dict, budget, max_epochs: int = 1, seed: int = 0) -> DataFrame:
    """One row for each document: id, leaf, ``n_tokens``, and ``copies``, how often the mix takes it.

    ``budget`` maps the column of all tokens in the input to the token budget.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    counted = durable(
        docs.select(
            "doc_id", text(domain).alias("domain"), text(F.col("lang")).alias("language"), text(F.col("source")).alias("leaf_source"), word_tokens(F.col("text")).alias("n_tokens")
        ),
        "mix-counts",
    )
    leaves = counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("leaf_docs"))
    leaves = leaf_budgets(leaves, weights, budget, max_epochs)
    epochs = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("leaf_budget") / F.col("leaf_tokens"))).otherwise(0).cast("long")
    leaves = durable(leaves.withColumn("epochs", epochs).withColumn("rest", F.col("leaf_budget") - F.col("epochs") * F.col("leaf_tokens")), "mix-leaves")
    on = [F.col(f"d.{c}") == F.col(f"l.{c}") for c in LEVELS]
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("l.epochs"), F.coalesce(F.col("d.doc_id").cast("string"), F.lit(""))))
    rows = counted.alias("d").join(leaves.alias("l"), on).select(
        "d.*", "l.epochs", "l.rest", "l.leaf_tokens", "l.leaf_docs", key.alias("order_key")
    )
    place = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("slice", F.floor(place * F.ceil(F.col("leaf_docs") / SLICE)).cast("long"))
    slices = rows.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    before = Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("slice_tokens").over(before), F.lit(0)))
    rows = rows.join(slices, [*LEVELS, "slice"])
    whole = F.col("before") + F.col("slice_tokens") <= F.col("rest")
    cut = ~whole & (F.col("before") <= F.col("rest"))
    sure = rows.filter(~cut).withColumn("taken", whole)
    edge = rows.filter(cut).withColumn("taken", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "slice").orderBy("order_key")) <= F.col("rest"))
    copies = F.col("epochs") + F.when(F.col("taken") & (F.col("epochs") < max_epochs), 1).otherwise(0)
    return sure.unionByName(edge).select("doc_id", *LEVELS, "n_tokens", copies.cast("long").alias("copies"))


# The mix of the registered query and of the pipeline.
WEIGHTS = {
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0},
    "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
}
BUDGET_SHARE = 0.5


def source_domain(source: Column) -> Column:
    """Domain of a source of the test tables: its number modulo 4."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "^src([0-9]{1,9})$", 1).try_cast("int")
    return F.coalesce(F.concat(F.lit("d"), (number % 4).cast("string")), F.lit("other"))


def report(docs: DataFrame) -> DataFrame:
    """The mix of ``WEIGHTS`` over half the tokens of the table, each document at most twice."""
    return select(docs, source_domain(F.col("source")), WEIGHTS, lambda total: F.floor(total * BUDGET_SHARE).cast("double"), max_epochs=2, seed=7)


def keep_selected(docs: DataFrame) -> DataFrame:
    """The documents that a mix of one epoch takes, with their own columns.

    The budget is nine tenths of the tokens and the weights are even, so that only the surplus
    of the largest leaves goes.
    """
    chosen = select(docs, source_domain(F.col("source")), {}, lambda total: F.floor(total * 0.9).cast("double"), seed=7)
    ids = chosen.filter("copies > 0").select(F.col("doc_id").alias("_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")


def _oracle(epochs: int = 2, seed: int = 7) -> str:
    """The report in SQL."""

    def divide(nodes: str, by: str, out: str) -> str:
        part = f"PARTITION BY {by} " if by else ""
        before = f"({part}ORDER BY cap / w, {LEVELS[len(by.split(',')) if by else 0]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        return f"""SELECT *, least(CAST(cap AS DOUBLE), w * max(level) OVER ({part})) AS {out} FROM (SELECT *, greatest(0.0, (budget - coalesce(sum(cap) OVER {before}, 0)) / (sum(w) OVER ({part}) - coalesce(sum(w) OVER {before}, 0))) AS level FROM ({nodes}))"""

    weight = lambda level: "CASE " + level + "".join(f" WHEN '{k}' THEN {v!r}" for k, v in WEIGHTS.get(level, {}).items()) + " ELSE 1.0 END" if WEIGHTS.get(level) else "1.0"
    cast = lambda level: f"CAST({weight(level)} AS DOUBLE) AS w"
    top = divide(f"SELECT domain, CAST({epochs} * sum(leaf_tokens) AS BIGINT) AS cap, {cast('domain')}, floor((SELECT sum(leaf_tokens) FROM leaves) * {BUDGET_SHARE}) AS budget FROM leaves GROUP BY domain", "", "b0")
    second = divide(f"SELECT domain, language, CAST({epochs} * sum(leaf_tokens) AS BIGINT) AS cap, {cast('language')}, any_value(b0) AS budget FROM leaves JOIN top USING (domain) GROUP BY domain, language", "domain", "b1")
    third = divide(f"SELECT domain, language, leaf_source, leaf_tokens, CAST({epochs} * leaf_tokens AS BIGINT) AS cap, {cast('leaf_source')}, b1 AS budget FROM leaves JOIN second USING (domain, language)", "domain, language", "b2")
    return f"""WITH counted AS (SELECT doc_id, coalesce('d' || CAST(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '^src([0-9]{{1,9}})$', 1), '') AS INT) % 4 AS VARCHAR), 'other') AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS leaf_source,
 CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, language, leaf_source, CAST(sum(n_tokens) AS BIGINT) AS leaf_tokens FROM counted GROUP BY ALL), top AS ({top}), second AS ({second}), third AS ({third}),
budgets AS (SELECT *, CASE WHEN leaf_tokens > 0 THEN CAST(floor(b2 + 1e-6) AS BIGINT) // leaf_tokens ELSE 0 END AS epochs FROM third), ready AS (SELECT *, CAST(floor(b2 + 1e-6) AS BIGINT) - epochs * leaf_tokens AS rest FROM budgets)
SELECT doc_id, domain, language, leaf_source, n_tokens, epochs + CASE WHEN epochs < {epochs} AND sum(n_tokens) OVER (PARTITION BY domain, language, leaf_source ORDER BY md5(concat('{seed}:', CAST(epochs AS VARCHAR), ':', coalesce(CAST(doc_id AS VARCHAR), '')))) <= rest THEN 1 ELSE 0 END AS copies
FROM counted JOIN ready USING (domain, language, leaf_source)"""


SQL = _oracle()
