"""Mixing sources to target weights by hierarchical budgets, in DataFrame expressions alone.

A tree has domains, their languages, and their sources as leaves. Its root gets the token budget; each node hands its own to its children by weight.
A child that can use no more than its capacity (its leaves' tokens in max_epochs epochs) gets just that, and what it leaves goes to its siblings by
weight; only what no sibling can use was never handed down, so it stays with the ancestors' other children. Budgets are whole tokens, rounded down.

A leaf's budget is filled from seeded epochs: each epoch puts the leaf's documents in the order of a hash of seed, epoch and doc_id. Whole epochs
take every document; the last takes the longest prefix that fits. The prefix ends at a hash that is found by radix: sums of tokens in 256 buckets a
leaf, then in the 256 parts of the bucket where the budget ends, and so on. So a leaf with a third of all documents costs one pass and sums that are
combined before they are shuffled; no window runs over a leaf's documents, only over what one of its 16.7 million buckets holds.

Nulls in lang and source are the empty name; null text has no tokens and comes along with its neighbours in the order. Rows with one doc_id share
their hash and are taken or left together. Names without a weight have weight 1. Other columns pass through mix() unharmed, clashing names too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, table

NAME = "op3_hierarchical_budgets"
DOMAIN = "CASE WHEN right(source, 1) IN ('0', '2', '4', '6', '8') THEN 'web' WHEN right(source, 1) IN ('1', '3', '5') THEN 'books' ELSE 'code' END"
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 2}, "source": {}}
#: Budget in per cent of all tokens, epochs of a leaf at most, seed of their orders.
PERCENT, EPOCHS, SEED = 100, 4, 17
LEAF = ["domain", "lang", "source"]
#: Bits of a document's place in its leaf's order; levels of the radix and bits of each.
BITS, LEVELS, STEP = 60, 3, 8


def weight(level: str, weights: dict) -> str:
    own = weights.get(level, {})
    return "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in own.items()) + " ELSE 1 END" if own else "1"


def place(seed: int) -> str:
    return f"cast(conv(substring(md5(concat('{seed}:', epochs, ':', coalesce(cast(doc_id as string), ''))), 1, {BITS // 4}), 16, 10) as bigint)"


def share_out(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes has a weight w, a capacity cap and the parent's budget total; adds budget. Capacities in order of cap / w fill up first."""
    by = f"PARTITION BY {', '.join(parent)}" if parent else "PARTITION BY 1"
    order = f"({by} ORDER BY cap / w, name ROWS BETWEEN"
    df = nodes.selectExpr("*", f"total - coalesce(sum(cap) OVER {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_tokens", f"sum(w) OVER {order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight")
    df = df.selectExpr("*", f"min(CASE WHEN cap * left_weight > w * left_tokens THEN cap / w END) OVER ({by}) AS short")
    df = df.selectExpr("*", "short IS NULL OR cap / w < short AS full")
    df = df.selectExpr("*", f"total - sum(CASE WHEN full THEN cap ELSE 0 END) OVER ({by}) AS open_tokens", f"sum(CASE WHEN full THEN 0 ELSE w END) OVER ({by}) AS open_weight")
    return df.withColumn("budget", F.expr("CASE WHEN full THEN cap ELSE least(cap, w * open_tokens div open_weight) END")).drop("left_tokens", "left_weight", "short", "full", "open_tokens", "open_weight")


def budgets(leaves: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, weights: dict = WEIGHTS) -> DataFrame:
    """domain, lang, source, tokens (available), budget from leaves (domain, lang, source, tokens)."""
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {percent} div 100 as total"))
    above, keys = total, []
    for level in LEAF:
        key = [*keys, level]
        nodes = leaves.groupBy(*key).agg(F.expr(f"sum(tokens) * {epochs} as cap")).withColumn("w", F.expr(f"cast({weight(level, weights)} as bigint)")).withColumn("name", F.col(level))
        nodes = nodes.join(above, keys) if keys else nodes.crossJoin(F.broadcast(above))  # one row
        above, keys = share_out(nodes, keys).select(*key, F.col("budget").alias("total")), key
    return leaves.join(above, LEAF).withColumnRenamed("total", "budget")


def with_leaf(docs: DataFrame, domain: str = DOMAIN) -> DataFrame:
    """doc_id, the leaf and n_tokens."""
    df = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "coalesce(cast(lang as string), '') lang", "coalesce(cast(source as string), '') source")
    return df.selectExpr("doc_id", f"{domain} as domain", "lang", "source", r"cast(coalesce(regexp_count(text, '[^ \\t-\\r]+'), 0) as bigint) as n_tokens")


def plan(light: DataFrame, tables: Tables, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: dict = WEIGHTS) -> DataFrame:
    """For each leaf: tokens, budget, epochs (whole ones), last (the place up to which the next epoch is taken, -1: none)."""
    leaves = light.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    state = tables.cut(budgets(leaves, percent, epochs, weights).selectExpr("*", "if(tokens > 0, budget div tokens, 0) as epochs", "if(tokens > 0, budget % tokens, 0) as need"))
    placed = tables.cut(light.join(state.where("need > 0").select(*LEAF, "epochs"), LEAF).select(*LEAF, "n_tokens", F.expr(f"{place(seed)} as place")))
    # path: the leading bits of the bucket where the budget ends
    now = state.where("need > 0").selectExpr(*LEAF, "need", "0L as path")
    for level in range(1, LEVELS + 1):
        shift = BITS - STEP * level
        inside = placed.join(now, LEAF).where(f"shiftright(place, {shift + STEP}) = path")
        sums = inside.groupBy(*LEAF, "need", F.expr(f"shiftright(place, {shift}) as path")).agg(F.sum("n_tokens").alias("t"))
        upto = sums.selectExpr("*", f"sum(t) over (partition by {', '.join(LEAF)} order by path) as upto")
        best = upto.where("upto > need").groupBy(*LEAF).agg(F.expr("min(struct(path, need - (upto - t) as need)) as x"))
        now = tables.cut(best.selectExpr(*LEAF, "x.need", "x.path"))
    inside = placed.join(now, LEAF).where(f"shiftright(place, {shift}) = path")
    sums = inside.groupBy(*LEAF, "need", "place").agg(F.sum("n_tokens").alias("t"))
    upto = sums.selectExpr("*", f"sum(t) over (partition by {', '.join(LEAF)} order by place) as upto")
    # the place before the first one that does not fit
    last = tables.cut(upto.where("upto > need").groupBy(*LEAF).agg(F.expr("min(place) - 1 as last")))
    tables.free(light, state, last)
    return state.join(last, LEAF, "left").selectExpr(*LEAF, "tokens", "budget", "epochs", "if(need > 0, last, -1L) as last")


def copies() -> str:
    return f"cast(epochs + if({place(SEED)} <= last, 1, 0) as bigint)"


def select(docs: DataFrame) -> DataFrame:
    """doc_id, the leaf, n_tokens, copies (how often the mixture takes it), leaf_tokens, leaf_budget; documents that are taken at least once."""
    tables = Tables(docs.sparkSession)
    light = tables.cut(with_leaf(docs))
    chosen = light.join(plan(light, tables), LEAF).withColumn("copies", F.expr(copies()))
    return chosen.where("copies > 0").selectExpr("doc_id", *LEAF, "n_tokens", "copies", "tokens as leaf_tokens", "budget as leaf_budget")


def mix(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """The mixture: rows of docs, each as often as its leaf's epochs take it. The small tables that the result reads stay in `tables`, for the caller to free."""
    tables = tables or Tables(docs.sparkSession)
    leaves = plan(tables.cut(with_leaf(docs)), tables)
    at = {c: f"own.`{c}`" for c in docs.columns}
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"))
    df = df.selectExpr("own", "cast(own.doc_id as bigint) as doc_id", "coalesce(cast(own.lang as string), '') as lang", "coalesce(cast(own.source as string), '') as source")
    df = df.withColumn("domain", F.expr(DOMAIN)).join(leaves.select(*LEAF, "epochs", "last"), LEAF).withColumn("copies", F.expr(copies())).where("copies > 0")
    return df.selectExpr("own", "explode(sequence(1L, copies)) as epoch").selectExpr(*at.values())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same in windows over whole leaves."""
    parts, above, keys = [], "", []
    for level in LEAF:
        key = ", ".join([*keys, level])
        by = f"PARTITION BY {', '.join(keys)}" if keys else "PARTITION BY 1"
        up = f"JOIN {above} USING ({', '.join(keys)})" if keys else ", root"
        parts.append(f"""{level}_a AS (SELECT *, {weight(level, WEIGHTS)}::BIGINT AS w FROM (SELECT {key}, (sum(tokens) * {EPOCHS})::BIGINT AS cap FROM leaves GROUP BY {key}) {up}),
{level}_b AS (SELECT *, total - coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lt,
    sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lw FROM {level}_a),
{level}_c AS (SELECT *, min(CASE WHEN cap * lw > w * lt THEN cap / w END) OVER ({by}) AS short FROM {level}_b),
{level}_d AS (SELECT *, short IS NULL OR cap / w < short AS isfull FROM {level}_c),
{level}_e AS (SELECT *, total - sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ({by}) AS ot, sum(CASE WHEN isfull THEN 0 ELSE w END) OVER ({by}) AS ow FROM {level}_d),
{level}_f AS (SELECT {key}, (CASE WHEN isfull THEN cap ELSE least(cap, w * ot // ow) END)::BIGINT AS total FROM {level}_e)""")
        above, keys = f"{level}_f", [*keys, level]
    leaf = ", ".join(LEAF)
    return rf"""
WITH docs AS (SELECT doc_id, {DOMAIN} AS domain, lang, source, n_tokens FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents)),
leaves AS (SELECT {leaf}, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY {leaf}),
root AS (SELECT (coalesce(sum(tokens), 0) * {PERCENT} // 100)::BIGINT AS total FROM leaves),
{", ".join(parts)},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN total // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN total % tokens ELSE 0 END AS need FROM leaves JOIN source_f USING ({leaf})),
placed AS (SELECT *, ('0x' || substr(md5('{SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS place FROM docs JOIN plan USING ({leaf})),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {leaf} ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed)
SELECT doc_id, {leaf}, n_tokens, (epochs + CASE WHEN need > 0 AND upto <= need THEN 1 ELSE 0 END)::BIGINT AS copies, tokens AS leaf_tokens, total AS leaf_budget
FROM summed WHERE epochs + CASE WHEN need > 0 AND upto <= need THEN 1 ELSE 0 END > 0"""
