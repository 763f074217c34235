"""Connected components of an edge table, by contraction.

Each round every node points to the smallest of itself and its neighbours in a random order
of that round, and the edges are rewritten to the nodes pointed to. The graph shrinks by a
constant factor, so the rounds grow with the logarithm of the nodes. Grouping combines
before the shuffle; each round is written, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); loops and repeats are allowed."""
    spark = edges.sparkSession
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .filter("a != b").distinct(), "edges")
    levels = []
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(levels))).alias("h"), F.col(c).alias("v"))  # noqa: E731,B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m")).select(
            "node", F.least(rank("node"), F.col("m"))["v"].alias("up")), "up")
        levels.append(up)
        edges = materialize(
            edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .filter("a != b").distinct(), "edges")
    if not levels:
        return spark.createDataFrame([], "node long, root long")
    roots = levels[-1].select("node", F.col("up").alias("root"))
    for level in reversed(levels[:-1]):
        top = roots.select(F.col("node").alias("up"), "root")
        roots = level.join(top, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return roots
