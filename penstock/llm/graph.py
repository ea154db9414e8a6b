"""Connected components of an edge table, by alternating large and small stars, without a vertex's neighbours ever meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: u > v, distinct. Every vertex takes the least of its neighbours (small: of the smaller ones) and passes it on. The minimum is combined before the shuffle, and the join back may be split where a vertex is hot."""
    if small:
        both = edges
    else:
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if small:
        out = linked.where("v <> m").selectExpr("v as u", "m as v").unionByName(least.selectExpr("u", "m as v"))
    else:
        out = linked.where("v > u").selectExpr("v as u", "m as v")
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b (bigint). (node, root) for every node with an edge to another, root being the least node of its component."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        e = written(_star(_star(e, small=False), small=True), "stars")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.selectExpr("u as node", "v as root").unionByName(e.selectExpr("v as node", "v as root").distinct())
