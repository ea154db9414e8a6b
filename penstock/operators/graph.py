"""Roots of a parent forest and connected components, as DataFrame iterations that survive lost executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir, or a temporary one only where none is set and everything runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="penstock-")
    return f"{root.rstrip('/')}/penstock/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's checkpoint folder; a temporary one only where none is set and everything runs in one process (tests)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="penstock-ck-"))
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver collects its garbage, which a driver with much memory may never do by itself. Called between steps that write much."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forest_roots(parents: DataFrame, rounds: int = 40) -> DataFrame:
    """parents: node, parent (a root is its own parent). (node, root), by pointer jumping: as many rounds as the logarithm of the depth."""
    p = cut_lineage(parents.select("node", F.col("parent").alias("root")))
    for _ in range(rounds):
        up = p.select(F.col("node").alias("root"), F.col("root").alias("above"))
        q = cut_lineage(p.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")))
        p = q.drop("moved")
        if not q.where("moved").head(1):
            return p
    raise RuntimeError("the parents hold a cycle")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: a > b, distinct. Every node passes the least of its neighbours (small: of the lesser ones) to the others. Minima are combined before the shuffle, and the join back may be split where a node is hot."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = both.join(least, "a")
    if small:
        out = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: node. edges: a, b. (node, root) with the least node of each component, by large and small stars in turns: rounds grow with the logarithm of the longest path squared at most, whatever the nodes' order, and stop when nothing changes."""
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        e = cut_lineage(_star(_star(e, small=False), small=True))
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return nodes.select("node").distinct().join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
