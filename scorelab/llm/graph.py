"""Connected components and pair blocks shared by the similarity operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelab.llm.store import written


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node of ``edges``.

    Alternates two star steps until nothing changes: each node hands its larger
    neighbours (then its smaller ones) to the smallest node it knows. Every step is a
    pre-aggregated minimum per node and a join on the node, whose large partitions the
    engine can split, so a hub needs no task of its own; a chain of n nodes takes a
    number of rounds that grows with log n. The table of each round is written to the
    checkpoint folder; nothing but counters reaches the driver."""
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are tables of their own, so that the join on a hub can be split
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        down = written(down, "edges")
        low = written(down.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    # at the fixed point each node points at its root
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v"))).distinct()


def pair_blocks(members: DataFrame, bucket: str, n: Column, member: str, block: int) -> DataFrame:
    """Deal the members of each bucket of ``n`` rows to pairs of blocks.

    A bucket is cut by a hash of the member into ceil(n / block) blocks; a member joins
    every pair of blocks that holds its own. Adds ``i`` and ``j`` (the pair) and ``own``.
    Any two members meet in exactly one pair if their blocks differ; members of one
    block meet in the pair (own, own). A pair of blocks is a bounded group, so a bucket of
    any size is spread over many tasks."""
    return (members.withColumn("_nb", F.greatest(F.lit(1), F.ceil(n / F.lit(block))).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64(F.lit("block"), F.col(bucket), F.col(member)), F.col("_nb")).cast("int"))
            .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
            .withColumn("i", F.least("own", "_o")).withColumn("j", F.greatest("own", "_o"))
            .drop("_o", "_nb"))
