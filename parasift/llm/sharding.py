"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks by a hash of their identity and, if equal, their number. How many rows of each block go to each shard is drawn
exactly: the matrix has the law it would have if all rows were shuffled and cut into shards. Each block
permutes its rows and deals them out by its row of the matrix; after the exchange each shard permutes
what it got. DataFrame operations only; the driver draws the matrix, whose size follows the number of
blocks, from the block counts.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parasift.llm.common import small_table, stage, stage_path

LEAST_BLOCKS = 64
BLOCK_ROWS = 500_000
#: Equal rows that one task numbers at a time.
RUN = 100_000
#: Rows of the matrix that go into one literal, and its entries that are broadcast at most.
MATRIX_ROWS = 5_000
MOST_BROADCAST = 2_000_000


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """Good ones among ``draws`` from an urn; inverts the law outward from its mode, at any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    peak = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    left = rng.random() - peak
    down, up, p_down, p_up = mode, mode, peak, peak
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if max(p_up * (up < high), p_down * (down > low)) < 1e-300:
            break  # what is left is rounding
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Row sums ``blocks``, column sums ``shards``; each row a draw from what the shards still lack."""
    rng, lack, matrix = random.Random(seed), list(shards), []
    for size in blocks:
        row, rest, others = [], size, sum(lack)
        for want in lack:
            others -= want
            row.append(hypergeometric(want, others, rest, rng))
            rest -= row[-1]
        lack = [a - b for a, b in zip(lack, row)]
        matrix.append(row)
    return matrix


def _matrix_table(spark: SparkSession, matrix: list[list[int]]) -> DataFrame:
    """(__block, __upto) of the running sums of each block's row, written in bounded parts."""
    path = stage_path(spark, "shard-matrix")
    for low in range(0, len(matrix), MATRIX_ROWS):
        upto = [{"__block": low + i, "__upto": list(accumulate(row))} for i, row in enumerate(matrix[low : low + MATRIX_ROWS])]
        small_table(spark, upto, "__block:int,__upto:array<bigint>").write.mode("append").parquet(path)
    return spark.read.schema("__block int, __upto array<bigint>").parquet(path)


def assign_shards(df: DataFrame, shards: int, identity: list[Column], seed: int = 42) -> DataFrame:
    """Columns of ``df`` plus ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Shard sizes differ by one at most. ``identity`` decides a row's random draws, so equal calls give
    equal results whatever the partitioning. Rows equal in all of ``df`` are interchangeable: they are
    counted, and their number in the count goes into their draws, so however many there are they spread
    over blocks and shards like any others; each gets a slot. Nulls are values like any other. An empty
    table gives no rows; fewer rows than shards leave shards empty. Keep ``df`` narrow: its rows are
    shuffled three times. Columns of ``df`` must not begin with ``__``; columns ``shard`` and ``slot`` are
    replaced. Rows with one identity but other columns that differ share draws, and so a block.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    # Equal rows as one row and a count; numbered again in runs, so that no task makes more than one run at a time.
    counted = df.groupBy(*columns).agg(F.count("*").alias("__n"))
    runs = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(RUN).cast("long"))).alias("__run"))
    several = runs.where(F.col("__n") > RUN).repartition("__run", *columns)
    numbered = runs.where(F.col("__n") <= RUN).unionByName(several).select("*", F.explode(F.sequence("__run", F.least(F.col("__run") + RUN, "__n") - 1)).alias("__i"))
    draw = lambda n: F.xxhash64(F.lit(seed), F.lit(n), *identity, "__i")
    rows = stage(numbered.select(*columns, "__i", draw(1).alias("__r1"), draw(2).alias("__r2"), draw(3).alias("__r3")), "shard-rows")
    count = rows.count()
    n_blocks = max(LEAST_BLOCKS, math.ceil(count / BLOCK_ROWS))
    rows = rows.withColumn("__block", F.pmod("__r1", F.lit(n_blocks)).cast("int"))
    sizes = dict(rows.groupBy("__block").count().collect())
    goal = [count // shards + (i < count % shards) for i in range(shards)]
    random.Random(seed).shuffle(goal)
    plan = _matrix_table(spark, communication_matrix([sizes.get(i, 0) for i in range(n_blocks)], goal, seed))
    order = [F.col(c) for c in [*columns, "__i"]]
    place = F.row_number().over(Window.partitionBy("__block").orderBy("__r2", *order))
    # One row a block: broadcast only up to a bound, else joined by block, as the rows already lie by block.
    known = F.broadcast(plan) if n_blocks * shards <= MOST_BROADCAST else plan.hint("merge")
    dealt = rows.withColumn("__place", place).join(known, "__block")
    dealt = dealt.withColumn("shard", F.size(F.filter("__upto", lambda c: c < F.col("__place"))))
    parts = max(8, math.ceil(count / shards / BLOCK_ROWS))
    dealt = stage(dealt.select(*columns, "__i", "shard", "__r3", F.pmod(F.shiftrightunsigned("__r3", 20), F.lit(parts)).cast("int").alias("__part")), "shard-dealt")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # shards x parts rows.
    starts = dealt.groupBy("shard", "__part").agg(F.count("*").alias("n")).select("shard", "__part", F.coalesce(before, F.lit(0)).alias("__start"))
    starts = F.broadcast(starts) if parts * shards <= MOST_BROADCAST else starts.hint("merge")
    inside = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__r3", *order))
    return dealt.withColumn("__inside", inside).join(starts, ["shard", "__part"]).select(*columns, "shard", (F.col("__start") + F.col("__inside") - 1).alias("slot"))
