"""Connected components by alternating large and small stars, all in joins and grouped minima; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables

#: Each round at least halves the longest path to a least node, so this many settle any graph that fits on disk; one that they don't is an error.
ROUNDS = 60


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v. large: each node's larger neighbours, small: its smaller ones, go to the least of all."""
    if large:
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        return both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").distinct()
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u")
    return moved.where("v <> m").selectExpr("v as u", "m as v").unionByName(low.selectExpr("u", "m as v")).distinct()


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """node, component (least node of its component) for every node of links (a, b). Equal links count once, a link of a node with itself not at all; without links there are no rows."""
    edges = tables.cut(links.where("a <> b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    seen = None
    for _ in range(ROUNDS):
        edges = tables.cut(star(star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {ROUNDS} rounds")
    return edges.selectExpr("u as node", "v as component").unionByName(edges.selectExpr("v as node", "v as component")).distinct()
