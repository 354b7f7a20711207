"""Mixing sources to target weights, by hierarchical budgeting.

A tree of domain, language and source gets a token budget. At every node the
budget is shared among the children by weight; a child can take no more than
its subtree can give (its tokens times `epochs`), and what it leaves is shared
again among its siblings, so a shortage reaches an ancestor's other children
only when a whole subtree is used up. All sums are integers; shares are rounded
down. Each leaf then takes whole epochs, and of one more epoch the prefix of
documents, in a seeded order, whose tokens fit into what is left.

The order of an epoch is that of md5(seed:epoch:doc_id). The prefix is found in
two steps, so that no leaf is sorted in one task: tokens are summed by the
first four hex digits of the hash, sums of these cells are accumulated, and
only the cell in which the budget ends is sorted.

Null, empty and odd input: null lang, source or domain is ''. Documents without
tokens are never selected. Repeated rows share a place in the order and are
taken one by one. A leaf with weight 0 gets nothing. An empty table gives an
empty mix. Only the id, text, and tree columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Weights of the production mix; other names weigh 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 3, "fr": 3, "es": 2}
SOURCE_WEIGHTS = {"src0": 2}
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """A production domain: one of four groups of sources, by a hash."""
    d = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)
    return F.when(d < "4", "d0").when(d < "8", "d1").when(d < "c", "d2").otherwise("d3")


def _weight(level: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Share `budget` of each parent among its rows of nodes (w, cap): adds
    `alloc`. Children are saturated in order of cap / w."""
    part = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = part.orderBy(F.col("cap") / F.nullif("w", F.lit(0)), child).rowsBetween(Window.unboundedPreceding, -1)
    x = nodes.withColumn("w_left", F.sum("w").over(part) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    x = x.withColumn("b_left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    # decimals: cap and weight may both be large
    full = (F.col("w") > 0) & (F.col("cap").cast("decimal(30,0)") * F.col("w_left").cast("decimal(8,0)") <= F.col("w").cast("decimal(8,0)") * F.col("b_left").cast("decimal(30,0)"))
    x = x.withColumn("full", full)
    rest_b = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(part), F.lit(0))
    rest_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(part)
    x = x.withColumn("rest_b", rest_b).withColumn("rest_w", rest_w)
    return x.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(F.expr("(w * rest_b) div nullif(rest_w, 0)"), F.lit(0)))).drop("w_left", "b_left", "full", "rest_b", "rest_w")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: Column, epochs: int) -> DataFrame:
    """domain, lang, source, tokens, alloc for leaves (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * epochs)
    total = leaves.agg(budget.cast("long").alias("budget"))
    above, have = total, []
    for i, level in enumerate(LEVELS):
        keys = list(LEVELS[: i + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(above, have) if have else nodes.crossJoin(above)  # one row
        nodes = nodes.withColumn("w", _weight(level, weights.get(level, {})))
        above = share_out(nodes, have, level).select(*keys, F.col("alloc").alias("budget"))
        have = keys
    return leaves.join(above.withColumnRenamed("budget", "alloc"), have).select(*have, "tokens", "alloc")


def _hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], share: float = 0.5, epochs: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", max_leaves: int = 100_000) -> DataFrame:
    """doc_id, epoch, domain, lang, source, n_tokens: one row for each time a
    document is taken. The budget is `share` of all tokens, rounded down."""
    empty = F.lit("")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(domain_of(F.col("source")), empty).alias("domain"), F.coalesce(F.col("lang"), empty).alias("lang"), F.coalesce(F.col("source"), empty).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = materialize(rows).where(F.col("n_tokens") > 0)  # numbers and names only
    keys = list(LEVELS)
    leaves = rows.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"))
    plan = materialize(budgets(leaves, weights, F.expr(f"cast(floor(sum(tokens) * {share}d) as long)"), epochs))
    plan = plan.withColumn("whole", F.expr("alloc div tokens").cast("int")).withColumn("rest", F.col("alloc") % F.col("tokens"))
    few = plan.count() <= max_leaves  # the tree, not the documents, bounds it
    own = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    near = rows.join(own(plan.select(*keys, "whole", "rest")), keys)
    near = near.withColumn("h", _hash(seed, F.col("whole"), F.col("doc_id"))).withColumn("cell", F.substring("h", 1, 4))
    cells = near.where(F.col("rest") > 0).groupBy(*keys, "rest", "cell").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("cell"))
    edge = cells.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
    edge = edge.groupBy(*keys).agg(F.min("cell").alias("last_cell"), F.min(F.col("upto") - F.col("n")).alias("before"))
    near = near.join(own(edge), keys, "left")  # one row a leaf at most
    whole = near.where(F.col("whole") > 0).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"), *keys, "n_tokens")
    inner = near.where((F.col("rest") > 0) & (F.col("cell") < F.coalesce("last_cell", F.lit("g"))))
    order = Window.partitionBy(*keys).orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = near.where((F.col("rest") > 0) & (F.col("cell") == F.col("last_cell"))).withColumn("sum", F.col("before") + F.sum("n_tokens").over(order)).where(F.col("sum") <= F.col("rest"))
    some = inner.select("doc_id", F.col("whole").alias("epoch"), *keys, "n_tokens").unionByName(last.select("doc_id", F.col("whole").alias("epoch"), *keys, "n_tokens"))
    return whole.unionByName(some)


WEIGHTS = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": SOURCE_WEIGHTS}


def op4_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), WEIGHTS)


def _sql_weight(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items()) + " ELSE 1 END"


def _sql_level(i: int) -> str:
    keys, have = ", ".join(LEVELS[: i + 1]), ", ".join(LEVELS[:i])
    part = f"PARTITION BY {have}" if have else ""
    before = f"OVER ({part} ORDER BY cap / w, {LEVELS[i]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    above = f"JOIN alloc{i - 1} USING ({have})" if have else "CROSS JOIN (SELECT floor(sum(tokens) * 0.5)::BIGINT AS budget FROM leaves)"
    return f"""
nodes{i} AS (SELECT {keys}, budget, cap, {_sql_weight(LEVELS[i])} AS w
  FROM (SELECT {keys}, sum(tokens * 2)::BIGINT AS cap FROM leaves GROUP BY {keys}) {above}),
full{i} AS (SELECT *, cap * (sum(w) OVER ({part}) - coalesce(sum(w) {before}, 0)) <= w * (budget - coalesce(sum(cap) {before}, 0)) AS is_full FROM nodes{i}),
alloc{i} AS (SELECT {keys}, (CASE WHEN is_full THEN cap ELSE
  (w * (budget - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0))) // (sum(w) FILTER (NOT is_full) OVER ({part})) END)::BIGINT AS budget FROM full{i})"""


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, substr(md5(coalesce(source, '')), 1, 1) AS d,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents WHERE text IS NOT NULL),
tree AS (SELECT doc_id, CASE WHEN d < '4' THEN 'd0' WHEN d < '8' THEN 'd1' WHEN d < 'c' THEN 'd2' ELSE 'd3' END AS domain, lang, source, n_tokens FROM docs WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM tree GROUP BY ALL),
{_sql_level(0)},
{_sql_level(1)},
{_sql_level(2)},
plan AS (SELECT domain, lang, source, budget // tokens AS whole, budget % tokens AS rest FROM alloc2 JOIN leaves USING (domain, lang, source)),
near AS (SELECT tree.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '42', whole::VARCHAR, doc_id::VARCHAR)), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM tree JOIN plan USING (domain, lang, source))
SELECT doc_id, unnest(range(0, whole))::INTEGER AS epoch, domain, lang, source, n_tokens FROM near
UNION ALL
SELECT doc_id, whole::INTEGER AS epoch, domain, lang, source, n_tokens FROM near WHERE upto <= rest
"""
