"""N-gram Jaccard join by MinHash banding.

1. Each text becomes the set of its five-word shingles (``shingles``). Texts with equal
   sets form one class of copies, keyed by a 128-bit digest of the set, so copies are
   counted and never expanded into pairs.
2. Band and row counts are chosen for a target recall at the threshold. Classes are
   shuffled on band hashes; buckets with the same members keep one copy of themselves.
3. Buckets are dealt to pairs of bounded blocks (``graph.pair_blocks``). A task holds two
   blocks of whole sets and verifies each pair exactly, in the first bucket the two
   share, so no pair counts twice. Only link counts per member and a spanning forest of
   the block's links leave the task.
4. Components of the forest edges give each document its class id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.llm.arrow import map_slices
from scorelab.llm.graph import components, pair_blocks
from scorelab.llm.shingles import band_hashes, bands_for, shingle_sets
from scorelab.llm.store import written

BLOCK = 128
SLICE = 1 << 20


def _texts(column) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def signatures(rows: DataFrame, width: int, bands: int, n_rows: int) -> DataFrame:
    """``id``, ``key`` (xxhash64 of the text), ``c`` (digest of the shingle set, null without words), ``bands``."""
    def run(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(_texts(part.column("text")), width)
        full = [i for i, s in enumerate(sets) if len(s)]
        found = band_hashes([sets[i] for i in full], bands, n_rows) if full else []
        keys: list = [None] * len(sets)
        for i, b in zip(full, found):
            keys[i] = b
        return {"id": part.column("id"), "key": part.column("key"), "bands": keys,
                "c": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]}

    return map_slices(rows, run, "id bigint, key bigint, c binary, bands array<bigint>", "text", limit=SLICE)


def verify_block(sets: list[np.ndarray], own: np.ndarray, kept: list[np.ndarray], bucket: int, weight: np.ndarray,
                 i: int, j: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Exact Jaccard of the pairs that meet here first: links of each member, forest of links."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    allowed = np.triu(np.ones((m, m), bool), 1)
    if i != j:
        allowed &= own[:, None] != own[None, :]
    allowed &= np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes) - 1e-9
    # the pair belongs to the smallest bucket that both are in
    earlier = [k[k < bucket] for k in kept]
    values, of, times = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    if (times > 1).any():
        inside = np.zeros((m, len(values)), np.float32)
        inside[np.repeat(np.arange(m), [len(k) for k in earlier]), of] = 1
        inside = inside[:, times > 1]
        allowed &= inside @ inside.T == 0
    links = np.zeros(m, np.int64)
    x, y = np.nonzero(allowed)
    if not len(x):
        return links, []
    if len(x) <= 2 * m:
        inter = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y)])
    else:
        values, of = np.unique(np.concatenate(sets), return_inverse=True)
        rows = np.repeat(np.arange(m), sizes)
        shared = np.bincount(of)[of] > 1
        order = np.argsort(of[shared], kind="stable")
        of, rows = of[shared][order], rows[shared][order]
        total = np.zeros((m, m), np.float32)
        of = np.cumsum(np.concatenate([[0], np.diff(of) != 0])) if len(of) else of
        step = 8192
        for k in range(0, int(of[-1]) + 1 if len(of) else 0, step):
            a, b = np.searchsorted(of, [k, k + step])
            part = np.zeros((m, step), np.float32)
            part[rows[a:b], of[a:b] - k] = 1
            total += part @ part.T
        inter = total[x, y]
    good = inter >= threshold * (sizes[x] + sizes[y] - inter) - 1e-6
    x, y = x[good], y[good]
    np.add.at(links, x, weight[y])
    np.add.at(links, y, weight[x])
    root = list(range(m))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    forest = []
    for a, b in zip(x.tolist(), y.tolist()):
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            forest.append((a, b))
    return links, forest


def grouped(batches, keys: list[str]):
    """Rows of a sorted partition, one group of equal ``keys`` at a time, as lists of dicts."""
    held, at = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != at and held:
                yield at, held
                held = []
            at = key
            held.append(row)
    if held:
        yield at, held


def ngram_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Near-duplicate classes of texts: ``id_col``, ``class_id`` and ``n_links`` for every row.

    Two rows are linked if the Jaccard similarity of their shingle sets is at least
    ``threshold``; ``n_links`` counts the other rows linked directly, copies included;
    ``class_id`` is the smallest id reachable by links. Texts without a word (null and
    empty ones too) link with nothing and are their own class. Shorter texts than
    ``width`` words have one shingle of all their words. Repeated rows are copies of each
    other. Null ids stay null and never name a class unless it holds no other id. Extra
    columns are ignored. ``recall`` bounds the chance of finding a pair exactly at the
    threshold; pairs above it are found more surely, and every reported link is verified."""
    sig, per_class = _classes(df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")), **options)
    return sig.select("id", "c").join(per_class, "c", "left").select(
        F.col("id").alias(id_col), F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one row of each near-duplicate class: the one with the smallest id, ties by a
    hash of the text; of repeated rows any one, as they are equal in id and text. Rows
    without a word all stay. Columns and cases as in ``ngram_classes``."""
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                      F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(2**63 - 1)).alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_key"))
    sig, per_class = _classes(df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")), **options)
    each = written(sig.groupBy(F.coalesce("id", F.lit(2**63 - 1)).alias("_id"), F.col("key").alias("_key")).agg(
        F.first("c").alias("c"), F.count("*").alias("times")), "rows")
    kept = each.join(per_class.select("c", "keeper"), "c", "left").where(
        "c is null or (keeper.id = _id and keeper.key = _key)").select("_id", "_key", F.when(F.col("c").isNotNull(), F.col("times")).otherwise(1).alias("_times"))
    kept = written(kept, "kept")
    rows = [F.col("_row")[c].alias(c) for c in df.columns]
    once = keyed.join(kept.where("_times = 1").select("_id", "_key"), ["_id", "_key"]).select(*rows)
    more = keyed.join(kept.where("_times > 1").select("_id", "_key"), ["_id", "_key"]).dropDuplicates(["_id", "_key"]).select(*rows)
    return once.unionByName(more)


def _classes(rows: DataFrame, width: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """The signatures of the rows (``id``, ``text``), and for each class of copies ``c``: ``class_id``,
    ``n_links`` and ``keeper``, the (id, key) of the first row of the whole class."""
    bands, n_rows = bands_for(threshold, recall)
    rows = rows.withColumn("key", F.xxhash64("text"))
    sig = written(signatures(rows, width, bands, n_rows), "signatures")

    classes = sig.where("c is not null").groupBy("c").agg(
        F.count("*").alias("copies"), F.min("id").alias("rep"), F.min(F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "key")).alias("at"),
        F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    inside = classes.select("c", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("bucket"), "c")
    sizes = inside.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("c").alias("low"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("s1"),
        F.sum(F.xxhash64(F.lit(1), "c").cast("decimal(38,0)")).alias("s2")).where("n > 1")
    kept = sizes.groupBy("n", "low", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    members = written(inside.join(kept, "bucket"), "members")
    mine = members.groupBy("c").agg(F.sort_array(F.collect_list("bucket")).alias("kept"))

    reps = mine.join(classes.select("c", "copies", "at"), "c")
    texts = (rows.select(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "key", "text")
             .join(reps.select("c", F.col("at.id").alias("id"), F.col("at.key").alias("key"), "copies", "kept"), ["id", "key"])
             .dropDuplicates(["c"]))
    dealt = pair_blocks(members, "bucket", F.col("n"), "c", BLOCK).drop("n").join(texts.drop("id", "key"), "c")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "c")

    def verify(batches):
        links: dict[bytes, int] = {}
        edges: list[tuple[bytes, bytes]] = []

        def out():
            a = [(c, n, None) for c, n in links.items()] + [(u, 0, v) for u, v in edges]
            cols = list(zip(*a)) if a else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()),
                                               pa.array(cols[2], pa.binary())], names=["c", "links", "to"])

        for (bucket, i, j), group in grouped(batches, ["bucket", "i", "j"]):
            sets: list = []
            for k in range(0, len(group), 64):
                sets += shingle_sets([r["text"].encode() for r in group[k:k + 64]], width)
            n, forest = verify_block(sets, np.array([r["own"] for r in group]), [np.array(r["kept"]) for r in group],
                                     bucket, np.array([r["copies"] for r in group]), i, j, threshold)
            for r, x in zip(group, n.tolist()):
                if x:
                    links[r["c"]] = links.get(r["c"], 0) + x
            edges += [(group[a]["c"], group[b]["c"]) for a, b in forest]
            if len(links) + len(edges) > 20_000:
                yield out()
                links, edges = {}, []
        yield out()

    found = written(dealt.mapInArrow(verify, "c binary, links bigint, to binary"), "links")
    roots = components(found.where("to is not null"), "c", "to")
    rep = classes.select("c", "copies", "rep", "at")
    rooted = rep.join(roots, rep.c == roots.node, "left").select("c", "copies", "rep", "at", F.coalesce("root", "c").alias("root"))
    # tables of their own, so that the joins can split the rows of a large class
    rooted = written(rooted, "rooted")
    lowest = written(rooted.groupBy("root").agg(F.min("rep").alias("class_id"), F.min("at").alias("keeper")), "lowest")
    n_links = found.where("to is null").groupBy("c").agg(F.sum("links").alias("links"))
    per_class = written(rooted.join(lowest, "root").join(n_links, "c", "left").select(
        "c", "class_id", "keeper", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "per-class")
    return sig, per_class
