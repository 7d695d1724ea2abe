"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join of the
edges with those minima, which adaptive execution can split when one node has
very many edges. No edge list ever leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.checkpoints import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node around it."""
    near = _both(edges)
    least = near.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = near.join(least, near.a == least.u).where("b > a")
    return moved.select(F.col("b").alias("a"), F.least("m", F.col("u")).alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them. edges: a > b."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, edges.a == least.u).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
    return moved.select("e.*").where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, component), the component being its least node. Nodes without links don't appear.

    Links with a null end and loops are ignored.
    """
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(now)
    while True:
        now = cut(_small(_large(now).distinct()).distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
