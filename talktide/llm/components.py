"""Connected components of an edge table, by alternating large-star and small-star steps.

Every round is one stored table in the shared folder, so lineage stays short and lost executors cost one round.
Nothing of the graph goes to the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktide.llm.common import scratch_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): each node's neighbours are linked to the least of them and itself; `large`: only greater neighbours, else it and its smaller ones."""
    if large:
        sides = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = sides.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge to another: the least node it reaches. edges: two columns of one orderable type."""
    edges = scratch_table(edges.toDF("a", "b").where("a <> b").distinct())
    before = None
    while True:
        edges = scratch_table(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(now)


def merged(known: DataFrame, edges: DataFrame) -> DataFrame:
    """components() of the edges that gave `known`, a stored table of such rows, and of `edges` besides: only the known components
    that these touch are joined, each as one node."""
    sides = edges.toDF("a", "b")
    for x in "ab":
        sides = sides.join(known.select(F.col("node").alias(x), F.col("component").alias(f"{x}_own")), x, "left")
    found = components(sides.select(F.coalesce("a_own", "a").alias("a"), F.coalesce("b_own", "b").alias("b")))
    found = scratch_table(found.select(F.col("node").alias("own"), F.col("component").alias("least")))
    old = known.join(found, F.col("component") == F.col("own"), "left").select("node", F.coalesce("least", "component").alias("component"))
    new = found.join(known, F.col("own") == F.col("node"), "left_anti").select(F.col("own").alias("node"), F.col("least").alias("component"))
    return old.union(new)
