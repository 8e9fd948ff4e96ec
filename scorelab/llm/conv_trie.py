"""Prefix trie of conversations rebuilt from the head of another one and their own suffix.

No rebuilt text is ever made. Equal turns share a reference: the place of the first turn with that role
and text, found by grouping whole texts. A turn at place i weighs t * B^i (mod p), where t is a hash
of its reference; the fingerprint of a run of turns is the sum of its weights. Runs compose as
a monoid: (s, n) followed by (s', n') is (s + B^n s', n + n'). With running sums for each
conversation, the fingerprint of a rebuilt prefix is the base's running sum up to the head's
end plus a difference of the conversation's own running sums, shifted by a power of B: a few
numbers of stored rows, for two independent B.

A node is a depth and a fingerprint. Its members' last turns must share one reference. If that
holds at every node, then members of a node also share the fingerprint one turn earlier
(subtracting the same weight), and so, node by node up to the root, all their turns. If it
fails anywhere, everything is done again with other B; so the result is exact.

What a node needs of its subtree are sums over its members. The smallest member of a node names
it, and it also names all its nodes further down: a conversation owns the depths below ``nd``, the
deepest node that a smaller conversation names. Hence a node's children are members that own
the next depth, its leaves are members that own a node in which all members end, and every node
of the subtree is counted once, at its owner."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelab.llm.ordered import in_order, numbered
from scorelab.llm.shingles import mix
from scorelab.llm.store import written

PRIME = 2**31 - 1
#: Places of a conversation in one window of running sums; a longer one has several.
RUN = 4096
#: Ids that are joined into one row before a node's list is hashed.
CHUNK = 2000


def stored_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``pos`` (from 1), ``ref`` and ``len`` (code points of the text) of every turn of an id.

    Turns are ordered by ``turn_col`` (null first), ties by the SHA-256 of role and text. Places come from a
    sort over ranges, so a conversation of any length is spread over tasks."""
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("bigint").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                                text(role_col).alias("role"), text(text_col).alias("text")).where("conv is not null")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit("\n"), F.col("role"), F.col("text")).cast("binary"), 256))
    turns = numbered(rows.withColumn("digest", digest), "trie-turns", F.col("conv"), F.col("turn"), F.col("digest"))
    first = written(turns.groupBy("digest", "role", "text").agg(F.min("at").alias("ref")), "trie-texts")
    same = ["digest"] if first.groupBy("digest").count().where("count > 1").isEmpty() else ["digest", "role", "text"]
    start = written(turns.groupBy("conv").agg(F.min("at").alias("start")), "trie-starts")
    turns = turns.join(first.select(*same, "ref"), same).join(start, "conv")
    return written(turns.select("conv", (F.col("at") - F.col("start") + 1).alias("pos"), "ref", F.length("text").cast("bigint").alias("len")), "trie-refs")


def weights(ref: np.ndarray, pos: np.ndarray, base: int, seed: int, prime: int) -> np.ndarray:
    """t * base^pos modulo ``prime``, where t (not 0) is a hash of the reference."""
    t = 1 + mix(ref.astype(np.uint64) + np.uint64(seed)) % np.uint64(prime - 1)
    power, left, square = np.ones(len(pos), np.uint64), pos.astype(np.uint64), base
    while left.any():
        power = np.where(left & np.uint64(1), power * np.uint64(square) % np.uint64(prime), power)
        left, square = left >> np.uint64(1), square * square % prime
    return (t * power % np.uint64(prime)).astype(np.int64)


def running(turns: DataFrame, bases: tuple[int, int], seed: int, prime: int) -> DataFrame:
    """``turns`` with running sums up to each turn: ``s1``, ``s2`` (modulo ``prime``) of the weights, ``x`` of the lengths."""
    def run(batches):
        for b in batches:
            ref, pos = (b.column(c).to_numpy() for c in ("ref", "pos"))
            w = [pa.array(weights(ref, pos, base, seed, prime)) for base in bases]
            yield pa.RecordBatch.from_arrays([*b.columns, *w], names=["conv", "pos", "ref", "len", "w1", "w2"])

    rows = turns.mapInArrow(run, "conv bigint, pos bigint, ref bigint, len bigint, w1 bigint, w2 bigint")
    rows = written(rows.withColumn("run", F.floor((F.col("pos") - 1) / F.lit(RUN)).cast("bigint")), "trie-weights")
    sums = ["w1", "w2", "len"]
    totals = rows.groupBy("conv", "run").agg(*[F.sum(c).alias(c) for c in sums])
    order = W.partitionBy("conv").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("conv", "run", *[F.sum(F.col(c).cast("decimal(38,0)")).over(order).alias(f"{c}_before") for c in sums]).where("run > 0")
    inside = W.partitionBy("conv", "run").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("conv", "run", "pos", "ref", "len", *[F.sum(c).over(inside).alias(f"{c}_inside") for c in sums]).join(before, ["conv", "run"], "left")
    total = lambda c: F.col(f"{c}_inside").cast("decimal(38,0)") + F.coalesce(F.col(f"{c}_before"), F.lit(0))
    return rows.select("conv", "pos", "ref", "len", *[(total(c) % F.lit(prime)).cast("bigint").alias(s) for c, s in (("w1", "s1"), ("w2", "s2"))],
                       total("len").cast("bigint").alias("x"))


def prefixes(turns: DataFrame, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column], most_head: int,
             bases: tuple[int, int], seed: int, prime: int) -> DataFrame:
    """A row for every prefix of every rebuilt conversation: ``conv``, ``d``, ``s1``, ``s2`` (its fingerprint), ``ref`` and ``len``
    (of its last turn; root: -1 and 0), ``x`` (code points so far) and ``size`` (turns of the whole rebuilt conversation)."""
    sums = written(running(turns, bases, seed, prime), "trie-sums")
    at_head = F.col("pos") == F.least(head_of(F.col("conv")), F.lit(most_head))
    convs = sums.groupBy("conv").agg(F.count("*").alias("own"), *[F.coalesce(F.max(F.when(at_head, F.col(c))), F.lit(0)).alias(f"h_{c}") for c in ("s1", "s2", "x")])
    heads = sums.where(F.col("pos") <= most_head).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("pos", "s1", "s2", "ref", "len", "x"))).alias("head"))
    convs = convs.withColumns({"h": F.least(head_of(F.col("conv")), F.lit(most_head)).cast("int"), "base": base_of(F.col("conv"))})
    convs = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")))
    convs = convs.withColumn("m", F.size("head")).withColumn("size", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    last = F.element_at("head", -1)
    convs = written(convs.withColumns({f"b_{c}": F.when(F.col("m") > 0, last[c]).otherwise(F.lit(0)) for c in ("s1", "s2", "x")}), "trie-convs")
    root = F.struct(F.lit(0).cast("bigint").alias("pos"), *[F.lit(0).cast("bigint").alias(c) for c in ("s1", "s2")], F.lit(-1).cast("bigint").alias("ref"),
                    *[F.lit(0).cast("bigint").alias(c) for c in ("len", "x")])
    top = convs.select("conv", "size", F.explode(F.concat(F.array(root), "head")).alias("p")).select(
        "conv", F.col("p.pos").alias("d"), "p.s1", "p.s2", "p.ref", "p.len", "p.x", "size")
    shift = F.col("h") - F.col("m")
    own = sums.join(convs.drop("head", "base", "own"), "conv").where(F.col("pos") > F.col("h"))
    moved = {}
    for s, base in zip(("s1", "s2"), bases):
        back = F.array(*[F.lit(pow(base, -n, prime)).cast("bigint") for n in range(most_head + 1)])[shift]
        moved[s] = F.pmod(F.col(f"b_{s}") + F.pmod(F.col(s) - F.col(f"h_{s}"), F.lit(prime)) * back, F.lit(prime)).alias(s)
    own = own.select("conv", (F.col("pos") - shift).alias("d"), moved["s1"], moved["s2"], "ref", "len",
                     (F.col("b_x") + F.col("x") - F.col("h_x")).alias("x"), "size")
    return top.unionByName(own)


def listed_digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ``ends_sha256`` of the ascending ids, comma-joined, of each key. Ranges of the sorted ids are joined to
    rows of ``CHUNK`` ids; only these meet in one task, which hashes them as they pass."""
    def stream(batches, names: list[str]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in names))

    def join(batches):
        held, out = [], []

        def close():
            if held:
                out.append((*held[0][:-1], held[0][-1], ",".join(str(h[-1]) for h in held)))
                held.clear()

        def flush():
            done = pa.RecordBatch.from_pylist([dict(zip([*key, "first", "ids"], o)) for o in out],
                                              pa.schema([(k, pa.int64()) for k in [*key, "first"]] + [("ids", pa.string())]))
            out.clear()
            return done

        for row in stream(batches, [*key, "conv"]):
            if held and (held[0][:-1] != row[:-1] or len(held) >= CHUNK):
                close()
            held.append(row)
            if len(out) >= 500:
                yield flush()
        close()
        yield flush()

    def digest(batches):
        at, sha, out = None, None, []
        schema = pa.schema([(k, pa.int64()) for k in key] + [("ends_sha256", pa.string())])
        for row in stream(batches, [*key, "ids"]):
            if row[:-1] != at:
                if sha:
                    out.append((*at, sha.hexdigest()))
                at, sha = row[:-1], hashlib.sha256(row[-1].encode())
            else:
                sha.update(b"," + row[-1].encode())
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema)
                out = []
        if sha:
            out.append((*at, sha.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema)

    columns = ", ".join(f"{k} bigint" for k in key)
    rows = in_order(ends.select(*key, "conv"), *[F.col(k) for k in key], F.col("conv")).select(*key, "conv")
    chunks = rows.mapInArrow(join, f"{columns}, first bigint, ids string")
    return chunks.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, f"{columns}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column], most_head: int,
                conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                seed: int = 7, prime: int = PRIME) -> DataFrame:
    """One row for each distinct prefix (node) of the rebuilt conversations.

    Conversation c becomes the first h = ``head_of(c)`` (at most ``most_head``) turns of ``base_of(c)`` (all if it has
    fewer, none if it does not exist) and its own turns after its first h. Two turns are equal if role and text
    are. Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (root: null), ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` (over the subtree, each node's (members - 1) times the code points of its last
    text) and ``ends_sha256`` (of the ids of the members that end there, ascending, joined by commas).

    Null roles and texts are empty; null turns come first, ties by the SHA-256 of role and text; repeated
    rows are turns like others. Rows without a conversation id belong to no conversation and take no part. A
    rebuilt conversation without turns is a member of the root. An empty table gives no rows; extra columns
    are ignored. ``prime`` is the fingerprints' modulus: with a small one, more attempts are needed."""
    turns = stored_turns(conversations, conv_col, turn_col, role_col, text_col)
    key = ["d", "s1", "s2"]
    draw = np.random.Generator(np.random.PCG64(seed))
    for _ in range(64):
        bases = tuple(int(b) for b in draw.integers(2, prime - 1, 2))
        rows = written(prefixes(turns, base_of, head_of, most_head, bases, int(draw.integers(1 << 62)), prime), "trie-prefixes")
        nodes = written(rows.groupBy(*key).agg(F.min("conv").alias("rep"), F.count_if(F.col("d") < F.col("size")).alias("onward"),
                                               (F.min("ref") == F.max("ref")).alias("same")), "trie-nodes")
        if nodes.where("not same").isEmpty():
            break
    else:
        raise RuntimeError("fingerprints of prefixes keep colliding; choose a larger prime")
    rows = written(rows.join(nodes.select(*key, "rep", (F.col("onward") == 0).alias("leaf")), key), "trie-members")
    mine = F.col("conv") == F.col("rep")
    theirs = F.max(F.when(~mine, F.struct("d", "x", "rep")))
    convs = written(rows.groupBy("conv").agg(theirs.alias("t"), F.max(mine & (F.col("d") == F.col("size")) & F.col("leaf")).alias("owns_leaf")).select(
        "conv", "owns_leaf", F.coalesce("t.d", F.lit(-1)).alias("nd"), F.coalesce("t.x", F.lit(0)).alias("nx"), F.col("t.rep").alias("above")), "trie-owners")
    all_ = rows.join(convs, "conv")
    out = all_.groupBy(*key).agg(
        F.min("conv").alias("conv_id"), F.max(F.when(mine & (F.col("d") > 0), F.when(F.col("d") - 1 > F.col("nd"), F.col("conv")).otherwise(F.col("above")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"), F.count_if((F.col("nd") <= F.col("d")) & (F.col("d") < F.col("size"))).alias("n_children"),
        F.count_if("owns_leaf").alias("n_leaves"), F.sum(F.when(F.col("d") <= F.col("nd"), F.col("nx") - F.col("x") + F.col("len")).otherwise(F.lit(0))).alias("saved_tokens"))
    ends = written(listed_digests(rows.where(F.col("d") == F.col("size")), key), "trie-ends")
    empty = hashlib.sha256(b"").hexdigest()
    return written(out, "trie-sums-of-nodes").join(ends, key, "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
