"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosine checks.

1. Equal vectors form one class of copies, keyed by a digest of the bytes.
2. A normalised vector x has, in each of several tables, the key of
   (floor((a_1 x + b_1) / r), ..., floor((a_k x + b_k) / r)) with Gaussian a and uniform b.
   Pairs with cosine c are |x - y| = sqrt(2 - 2c) apart; ``plan_tables`` takes the
   number of tables that finds such pairs with the wanted recall for a key of k parts, and
   ``plan_key`` the k: the more vectors there are and the closer those that do not link, the longer the key.
3. Buckets with the same members keep one copy of themselves, and are dealt to pairs of
   bounded blocks. A task computes the exact cosines of its block pair in double
   precision and counts each pair in the first bucket that holds both. Link counts and
   a spanning forest leave the task, never all pairs.
4. Components of the forest give the component ids.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.llm.graph import components, pair_blocks
from scorelab.llm.ngram_join import grouped
from scorelab.llm.shingles import mix
from scorelab.llm.store import written

BLOCK = 256


def hit_chance(distance: float, r: float) -> float:
    """Chance that one quantised Gaussian projection of width ``r`` puts two points ``distance`` apart together."""
    if distance <= 0:
        return 1.0
    t = r / distance
    cdf = 0.5 * (1 + math.erf(-t / math.sqrt(2)))
    return 1 - 2 * cdf - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan_tables(cosine: float, recall: float, r: float, k: int) -> int:
    """Tables of ``k`` projections that find a pair at ``cosine`` with ``recall``."""
    p = hit_chance(math.sqrt(2 - 2 * cosine), r) ** k
    return 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))


def plan_key(n: int, apart: np.ndarray, cosine: float, recall: float, r: float, pair_cost: float = 16.0) -> tuple[int, int]:
    """(k, tables) of least work for ``n`` vectors, ``apart`` being distances of pairs that do not link.

    A vector's work is a row in each table and ``pair_cost`` times as much for each stranger that it
    meets there; of these there are n times the mean chance of the given distances. Longer keys
    need more tables for the same recall, so the sum has a smallest value."""
    at, share = np.unique(np.round(apart, 2), return_counts=True)
    chance = np.array([hit_chance(d, r) for d in at.tolist()])
    share = share / max(share.sum(), 1)

    def work(k: int) -> float:
        return plan_tables(cosine, recall, r, k) * (1 + pair_cost * n * float(share @ chance**k))
    k = min(range(8, 65), key=work)
    return k, plan_tables(cosine, recall, r, k)


def normalised(values: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows are usable (same length, finite, not zero)."""
    dims = [len(v) if v is not None else 0 for v in values]
    d = dim or max(dims, default=0)
    x = np.zeros((len(values), d))
    good = np.zeros(len(values), bool)
    for i, v in enumerate(values):
        if v is not None and len(v) == d and None not in v:
            x[i] = v
            good[i] = True
    good &= np.isfinite(x).all(1)
    x[~good] = 0
    top = np.abs(x).max(1, initial=0)
    good &= top > 0
    x = x / np.where(top > 0, top, 1)[:, None]
    return x / np.where(good, np.sqrt((x * x).sum(1)), 1)[:, None], good


def vector_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                      recall: float = 0.999, r: float = 2.0, k: int | None = None, seed: int = 5, sample: int = 1000) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Rows link if the cosine of their vectors, in double precision, is at least ``cosine``.
    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different lengths do not link. Copies count as links of each
    other. ``recall`` is the chance of finding a pair exactly at the threshold (pairs
    above it are found more surely, equal vectors always); every link is verified. The key's
    length ``k``, if not given, is planned from the number of different vectors and the distances
    within ``sample`` of them; it changes the work, not which links count.
    Null ids stay null and never name a component unless it has no other. An empty
    table gives an empty result; extra columns are ignored."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def by_length(values: list, step: int = 1000):
        at: dict[int, list[int]] = {}
        for i, v in enumerate(values):
            if v:
                at.setdefault(len(v), []).append(i)
        for d, found in at.items():
            for s in range(0, len(found), step):
                yield d, found[s:s + step]

    def name(batches):
        for batch in batches:
            values = batch.column("v").to_pylist()
            digests: list = [None] * len(values)
            for d, part in by_length(values):
                for i, good in zip(part, normalised([values[i] for i in part], d)[1].tolist()):
                    if good:
                        digests[i] = hashlib.blake2b((np.array(values[i], "<f8") + 0.0).tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), batch.column("v")], names=["id", "c", "v"])

    sig = written(rows.mapInArrow(name, "id bigint, c binary, v array<double>"), "vectors")
    classes = written(sig.where("c is not null").groupBy("c").agg(
        F.count("*").alias("copies"), F.min("id").alias("rep"), F.first("v").alias("v")), "vector-classes")
    if k is None:
        # the digests are hashes, so the smallest ones are a random sample of the different vectors
        some = [r_["v"] for r_ in classes.orderBy("c").limit(sample).select("v").collect()]
        cosines = [np.zeros(0)]
        for d in sorted({len(v) for v in some}):
            x, _ = normalised([v for v in some if len(v) == d], d)
            cosines.append((x @ x.T)[np.triu_indices(len(x), 1)])
        c = np.concatenate(cosines)
        k, tables = plan_key(classes.count(), np.sqrt(np.maximum(2 - 2 * c[c < cosine], 0)), cosine, recall, r)
    else:
        tables = plan_tables(cosine, recall, r, k)

    def sign(batches):
        lines: dict[int, tuple] = {}
        for batch in batches:
            values = batch.column("v").to_pylist()
            keys: list = [None] * len(values)
            for d, part in by_length(values):
                if d not in lines:
                    rng = np.random.Generator(np.random.PCG64([seed, d]))
                    lines[d] = rng.standard_normal((d, tables * k)), rng.uniform(0, r, tables * k)
                a, b = lines[d]
                cell = np.floor((normalised([values[i] for i in part], d)[0] @ a + b) / r).astype(np.int32).reshape(len(part), tables, k)
                key = np.zeros((len(part), tables), np.uint64)
                for t in range(k):
                    key = mix(key + cell[:, :, t].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
                for n, i in enumerate(part):
                    keys[i] = key[n].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(keys, pa.list_(pa.int64()))], names=["c", "keys"])

    keyed = written(classes.select("c", "v").mapInArrow(sign, "c binary, keys array<bigint>"), "vector-keys")
    inside = keyed.select("c", F.posexplode("keys").alias("t", "h")).select(F.xxhash64("t", "h").alias("bucket"), "c")
    # most buckets hold one vector: those with more are found from the numbers alone, before any row is joined
    shared = written(inside.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared-buckets")
    inside = written(inside.join(shared, "bucket").select("bucket", "c"), "shared-members")
    sizes = inside.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("c").alias("low"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("s1"),
        F.sum(F.xxhash64(F.lit(1), "c").cast("decimal(38,0)")).alias("s2"))
    kept = sizes.groupBy("n", "low", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = written(inside.join(kept, "bucket"), "vector-members")
    mine = members.groupBy("c").agg(F.collect_list("bucket").alias("kept"))
    vectors = classes.select("c", "copies", "v").join(mine, "c")
    dealt = pair_blocks(members, "bucket", F.col("n"), "c", BLOCK).drop("n").join(vectors, "c")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "c")

    def verify(batches):
        for (bucket, i, j), group in grouped(batches, ["bucket", "i", "j"]):
            links, forest = verify_block([r["v"] for r in group], np.array([r["own"] for r in group]), [np.array(r["kept"]) for r in group],
                                         bucket, np.array([r["copies"] for r in group]), i, j, cosine)
            rows_ = [(r["c"], n, None) for r, n in zip(group, links.tolist()) if n] + [(group[a]["c"], 0, group[b]["c"]) for a, b in forest]
            if rows_:
                c, n, to = zip(*rows_)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()), pa.array(n, pa.int64()), pa.array(to, pa.binary())], names=["c", "links", "to"])

    found = written(dealt.mapInArrow(verify, "c binary, links bigint, to binary"), "vector-links")
    roots = components(found.where("to is not null"), "c", "to")
    rep = classes.select("c", "copies", "rep")
    rooted = rep.join(roots, rep.c == roots.node, "left").select("c", "copies", "rep", F.coalesce("root", "c").alias("root"))
    # tables of their own, so that the joins can split the rows of a large component
    rooted = written(rooted, "rooted")
    lowest = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "lowest")
    n_links = found.where("to is null").groupBy("c").agg(F.sum("links").alias("links"))
    per_class = written(rooted.join(lowest, "root").join(n_links, "c", "left").select(
        "c", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "per-class")
    out = sig.select("id", "c").join(per_class, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def verify_block(values: list, own: np.ndarray, kept: list[np.ndarray], bucket: int, weight: np.ndarray,
                 i: int, j: int, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Exact cosines of the pairs that meet here first: links of each member, forest of links."""
    m = len(values)
    links, forest = np.zeros(m, np.int64), []
    dims = np.array([len(v) for v in values])
    allowed = np.triu(np.ones((m, m), bool), 1) & (dims[:, None] == dims[None, :])
    if i != j:
        allowed &= own[:, None] != own[None, :]
    earlier = [k[k < bucket] for k in kept]
    ids, of, times = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    if (times > 1).any():
        inside = np.zeros((m, len(ids)), np.float32)
        inside[np.repeat(np.arange(m), [len(k) for k in earlier]), of] = 1
        inside = inside[:, times > 1]
        allowed &= inside @ inside.T == 0
    root = list(range(m))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        x, _ = normalised([values[a] for a in at], d)
        near = (x @ x.T >= cosine) & allowed[np.ix_(at, at)]
        p, q = np.nonzero(near)
        p, q = at[p], at[q]
        np.add.at(links, p, weight[q])
        np.add.at(links, q, weight[p])
        for a, b in zip(p.tolist(), q.tolist()):
            u, v = find(a), find(b)
            if u != v:
                root[max(u, v)] = min(u, v)
                forest.append((a, b))
    return links, forest
