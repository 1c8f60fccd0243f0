"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasift.llm.common import stage, unstage

def _star(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star, over edges (a, b) with a > b: nodes move to ever smaller roots."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node but the roots; ``edges`` has columns u, v of one orderable type.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one
    round. Only counts and a checksum reach the driver.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct(), label)
    mark = _mark(now)
    # The steps settle within some multiple of log2 of the nodes; beyond that something is wrong.
    for _ in range(16 + 4 * math.ceil(math.log2(mark[0] + 2))):
        if not mark[0]:
            break
        after = stage(_star(now), label)
        fresh = _mark(after)
        unstage(now)
        now = after
        if fresh == mark:
            break
        mark = fresh
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
