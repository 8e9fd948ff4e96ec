"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into a fixed number of blocks by a hash of the document. A source's
target says how many whole passes over it the mix takes and how many words of one more
pass; that pass takes blocks in a permuted order until the words are reached, and the
documents of the last block in a permuted order. So each source has an exact quota of
blocks. The quotas are split among the output shards by a binary tree: a node gives its
left half a multivariate-hypergeometric draw from what it holds. Shard by shard, each
source's quota takes the next blocks of the permuted order, so shards are disjoint and
every shard has the mix's proportions up to chance. Rows are then shuffled inside shards.

Only DataFrame functions touch rows. The driver holds one row for each source (its size,
target and quotas), which a weight for each source presupposes. Every choice is a hash
of the seed and the row, so reruns and retried tasks agree.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelab.llm.ordered import numbered
from scorelab.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources (about 12 kB of plan each), the plan is broadcast.
BROADCAST_SOURCES = 1000


def size_of(text: str) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def share_out(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; the excess goes to
    the others by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        per = left / w if (w := sum(weights[i] for i in open_)) else 0.0
        over = [i for i in open_ if per * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.remove(i)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Blocks of each source (inner lists) for each shard: a binary tree of multivariate-hypergeometric draws."""
    rnd, out = random.Random(seed), [None] * shards

    def part(held: list[int], lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = held
            return
        mid, n = (lo + hi) // 2, sum(held)
        draws = (n * (mid - lo) + (hi - lo) // 2) // (hi - lo)
        left = [0] * len(held)
        ends, total = [], 0
        for q in held:
            ends.append(total := total + q)
        s = 0
        for x in sorted(rnd.sample(range(n), draws)):
            while x >= ends[s]:
                s += 1
            left[s] += 1
        part(left, lo, mid)
        part([a - b for a, b in zip(held, left)], mid, hi)

    part(list(quotas), 0, shards)
    return out


def _rows(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table from the driver as a literal, without an RDD."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _key(seed: int, *cols) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def allocate(df: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, id_col: str = "doc_id",
             source_col: str = "source", text_col: str = "text", blocks: int = 1024, shards: int = 64, seed: int = 17) -> DataFrame:
    """Every row of ``df`` with its part in the mix.

    Sources in order of code point (null last) get ``weights`` in turn and share ``share``
    times all words; no target is above ``most`` times its source's words. Adds
    ``mix_size`` (words of the row), ``mix_source_size``, ``mix_target`` (of its source) and
    ``mix_copies``, an array of (pass, shard), one entry for each time the row is taken; a
    row is taken whole or not at all, at most ``most`` times; of repeated rows at the edge of a
    target, as many as fit are taken. Null texts have no words.
    Rows with a null source form a source; repeated rows and null ids are rows like others
    (a row's hash covers id and text). An empty table gives an empty result. Other columns
    stay as they are; those named like an added column are replaced."""
    out = _allocate(df, weights, share, most, id_col, source_col, text_col, blocks, shards, seed)
    kept = [c for c in df.columns if c not in ADDED]
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], *ADDED)


ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]


def _allocate(df: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: int = 2, id_col: str = "doc_id", source_col: str = "source",
              text_col: str = "text", blocks: int = 1024, shards: int = 64, seed: int = 17) -> DataFrame:
    """Each row as a struct ``_row``, so that no name of its columns can clash, its hash ``_h`` and the columns ``ADDED``."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{source_col}`").alias("_from"),
                     _key(seed, F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("_h"), size_of(f"`{text_col}`").alias("mix_size"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_h"), F.lit(blocks)).cast("int"))
    narrow = written(rows.select(F.col("_from").alias("source"), "_h", "_block", F.col("mix_size").alias("size")), "mix-sizes")
    plan = _plan(narrow, list(weights), share, most, blocks, shards, seed)
    if plan is None:
        return rows.select("_row", "_h", "mix_size", F.lit(0).cast("bigint").alias("mix_source_size"), F.lit(0.0).alias("mix_target"),
                           F.array().cast("array<struct<pass:int,shard:int>>").alias("mix_copies"))
    plan, n_sources, has_ties = plan
    if n_sources <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = rows.join(plan, F.col("_from").eqNullSafe(plan["_source"]), "left")
    shard = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda p: F.when(
        p <= F.col("_full"), F.struct(p.cast("int").alias("pass"), F.element_at("_shard", p.cast("int") * blocks + F.col("_block") + 1).alias("shard"))))
    # in the last pass, the block at the edge gives only documents up to the edge, and of the repeated
    # rows at the edge as many as there is room for
    at_edge = F.coalesce(F.col("_block") == F.col("_edge_block"), F.lit(False))
    tied = at_edge & F.coalesce(F.col("_h") == F.col("_tie_h"), F.lit(False))

    def taken(rows: DataFrame, beyond: Column) -> DataFrame:
        copies = F.filter(shard, lambda c: (c["shard"] >= 0) & ~((c["pass"] == F.col("_full")) & beyond))
        return rows.select("_row", "_h", "mix_size", F.col("_source_size").alias("mix_source_size"), F.col("_target").alias("mix_target"),
                           copies.alias("mix_copies"))

    beyond = at_edge & ~F.coalesce(F.col("_h") <= F.col("_edge_h"), F.lit(False))
    if not has_ties:
        return taken(joined, beyond)
    # rows that are equal are told apart by a number, given over all of them in ranges
    alike = numbered(joined.where(tied), "mix-ties", F.col("_from"))
    first = alike.groupBy(F.col("_from").alias("_tie_from")).agg(F.min("at").alias("_first"))
    alike = alike.join(F.broadcast(first) if n_sources <= BROADCAST_SOURCES else first, F.col("_from").eqNullSafe(F.col("_tie_from")))
    return taken(joined.where(~tied), beyond).union(taken(alike, F.col("at") - F.col("_first") >= F.col("_tie_take")))


def _plan(narrow: DataFrame, weights, share, most, blocks, shards, seed):
    """For each source: its size, target, whole passes, shard of each block in each pass
    (-1: not taken) and the edge of the last pass. None without rows."""
    spark = narrow.sparkSession
    per_block = written(narrow.groupBy("source", "_block").agg(F.sum("size").alias("words")), "mix-blocks")
    found = per_block.groupBy("source").agg(F.sum("words").alias("size")).orderBy(F.col("source").asc_nulls_last()).collect()
    if not found:
        return None
    sizes = [r["size"] for r in found]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    table = []
    for i, (r, t) in enumerate(zip(found, targets)):
        full = min(most, int(t / r["size"] + 1e-12)) if r["size"] else 0
        table.append({"k": i, "_source": r["source"], "_source_size": r["size"], "_target": t, "_full": full,
                      "_left": max(0.0, t - full * r["size"])})
    schema = "k int, _source string, _source_size bigint, _target double, _full int, _left double"
    sources = _rows(spark, table, schema)

    from pyspark.sql import Window as W

    grid = (F.broadcast(sources) if len(table) <= BROADCAST_SOURCES else sources).select(
        "k", "_source", "_full", "_left", F.explode(F.sequence(F.lit(0), F.col("_full"))).alias("pass"))
    taken = per_block.join(grid, per_block["source"].eqNullSafe(grid["_source"])).select("k", "pass", "_block", "words", "_full", "_left")
    order = W.partitionBy("k", "pass").orderBy(_key(seed, F.lit("block"), F.col("k"), F.col("pass"), F.col("_block")), "_block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = taken.withColumn("before", before).where(
        (F.col("pass") < F.col("_full")) | (F.col("before") < F.col("_left"))).withColumn("at", F.row_number().over(order) - 1)
    taken = written(taken, "mix-taken")
    counts = {(r["k"], r["pass"]): r["n"] for r in taken.groupBy("k", "pass").agg(F.count("*").alias("n")).collect()}
    quotas = [sum(counts.get((i, p), 0) for p in range(most + 1)) for i in range(len(table))]
    tree = split_quotas(quotas, shards, seed)
    bounds = []
    for i in range(len(table)):
        ends, first = [], 0
        for s in range(shards):
            ends.append((ends[-1] if ends else 0) + tree[s][i])
        for p in range(most + 1):
            bounds.append({"k": i, "pass": p, "first": first, "ends": ends})
            first += counts.get((i, p), 0)
    ends = _rows(spark, bounds, "k int, pass int, first int, ends array<int>")
    dealt = taken.join(F.broadcast(ends) if len(table) <= BROADCAST_SOURCES else ends, ["k", "pass"]).withColumn("_n", F.col("first") + F.col("at"))
    # a shard draws as many of the next blocks as its quota says; what no quota covers is in no shard
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("_n")))).where(F.col("shard") < shards)
    # the block in which the last pass ends, and the last of its documents to take
    edge = dealt.where((F.col("pass") == F.col("_full")) & (F.col("before") + F.col("words") > F.col("_left"))).select(
        "k", F.col("_block").alias("_edge_block"), (F.col("_left") - F.col("before")).alias("_room"))
    per_source = sources.join(edge, "k", "left")
    docs = narrow.join(F.broadcast(per_source) if len(table) <= BROADCAST_SOURCES else per_source,
                       narrow["source"].eqNullSafe(per_source["_source"]) & (narrow["_block"] == per_source["_edge_block"]))
    # repeated rows share a hash: a group of them is taken as far as it fits
    docs = docs.groupBy("k", "_h", "size", "_room").agg(F.count("*").alias("n"))
    docs = docs.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(
        W.partitionBy("k").orderBy("_h", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    fits = F.floor((F.col("_room") - F.col("before")) / F.col("size") + F.lit(0.5))
    fits = F.when(F.col("size") == 0, F.when(F.col("before") <= F.col("_room"), F.col("n")).otherwise(0)).otherwise(F.least(F.greatest(fits, F.lit(0)), F.col("n")))
    docs = docs.withColumn("fits", fits.cast("bigint"))
    partly = (F.col("fits") > 0) & (F.col("fits") < F.col("n"))
    last = docs.groupBy("k").agg(F.max(F.when(F.col("fits") == F.col("n"), F.col("_h"))).alias("_edge_h"),
                                 F.max(F.when(partly, F.col("_h"))).alias("_tie_h"), F.max(F.when(partly, F.col("fits"))).alias("_tie_take"))
    # dense arrays: element pass * blocks + block + 1
    cells = sources.select("k", "_full", F.explode(F.sequence(F.lit(0), F.col("_full"))).alias("pass")).select(
        "k", "pass", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    arrays = cells.join(dealt.select("k", "pass", "_block", "shard"), ["k", "pass", "_block"], "left").groupBy("k").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pass", "_block", F.coalesce("shard", F.lit(-1)).alias("shard")))),
                    lambda x: x["shard"]).alias("_shard"))
    plan = written(per_source.join(last, "k", "left").join(arrays, "k").drop("k", "_left", "_room"), "mix-plan")
    return plan, len(table), not plan.where("_tie_h is not null").isEmpty()


def mix(df: DataFrame, slices: int = 16, with_place: bool = True, **options) -> DataFrame:
    """The mix itself: a row for each taken copy, with the columns of ``df`` and, unless
    ``with_place`` is false, ``mix_pass``, ``mix_shard`` and ``mix_key`` (which replace columns of
    those names). Rows are dealt by shard and ``slices`` parts of it and sorted by
    ``mix_key``, a hash, so each part of a shard is in random order. Options and cases as
    in ``allocate``."""
    place = ["mix_pass", "mix_shard", "mix_key"]
    out = _allocate(df, **options).select("_row", "_h", F.explode("mix_copies").alias("_c"))
    out = out.select("_row", F.col("_c.pass").alias("mix_pass"), F.col("_c.shard").alias("mix_shard"),
                     _key(options.get("seed", 17) + 1, F.col("_h"), F.col("_c.pass")).alias("mix_key"))
    out = out.repartition("mix_shard", F.pmod("mix_key", F.lit(slices))).sortWithinPartitions("mix_shard", "mix_key")
    kept = [c for c in df.columns if not with_place or c not in place]
    return out.select(*[F.col("_row")[c].alias(c) for c in kept], *(place if with_place else []))
