"""Hard-negative mining by rotated one-bit codes.

1. Every vector is scaled to integers v; a score is an integer inner product. Tasks pack
   the rows they read into blocks of bounded size and index them: the direction v/|v| is
   turned by a fixed random rotation to o, its code is the signs b of o, and its alignment
   a = <o, b> (b of length 1) is stored. What the code leaves, o - a b, is coded the same way,
   ``levels`` times, and the length of the last residual r is stored.
2. An anchor's turned direction q is cut into bit planes. <b, q> then is a weighted sum of
   popcounts of b AND plane, <o, q> is estimated by the sum of a <b, q> over the levels, and by
   Cauchy-Schwarz the estimate is off by at most |r| |q| plus |o - r| times the length of what
   the planes leave of q. That interval is certain, not a chance.
3. Anchors are dealt to slabs of blocks. A task streams its blocks past its anchors: a pair is
   scored exactly, in integers, only if its interval meets a wanted range of scores and the best
   ``k`` found so far for that range. The best of each task are merged.
4. This runs twice: for the positives (same label), whose scores set the ranges of the
   second run for the negatives (other labels).

The intervals drop no pair that could be in the result, so the result is exact. Anchors are a
stated query set against all rows; only the best few of each anchor leave a task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelab.llm.store import written

BLOCK_ROWS = 8192          # rows of a block at most
BLOCK_BYTES = 8 << 20      # bytes of a block's integers at most (one row may be longer)
SLAB_BYTES = 16 << 20      # bytes of the integers of a slab of blocks, about
ANCHORS = 1 << 14          # anchors that meet a slab at once, about
PLANES = 7                 # bits of an anchor's component
TILES = [256, 512, 1024, 2048]
LEAST, MOST = -(1 << 62), 1 << 62
_BLOCK = ("dim int, n int, ids binary, known binary, labels binary, width int, ints binary, codes binary, align binary, rest binary, norm binary")


def scaled(values: list, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of one length. Fails if an inner product might not fit a long."""
    x = np.floor(np.array(values, np.float64).reshape(len(values), len(values[0])) * scale)
    if x.size and float(np.abs(x).max()) ** 2 * x.shape[1] >= 2.0 ** 62:
        raise OverflowError("scaled vectors are too long for scores of 64 bits")
    return x.astype(np.int64)


def rotation(dim: int, seed: int) -> np.ndarray:
    """A fixed random rotation of ``dim`` dimensions, padded with zeros to a multiple of 64."""
    size = max(64, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def directions(ints: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated unit vectors (zero vectors stay zero) and lengths."""
    norm = np.sqrt((ints.astype(np.float64) ** 2).sum(1))
    return (ints / np.where(norm > 0, norm, 1)[:, None]) @ turn, norm


def encode(ints: np.ndarray, turn: np.ndarray, levels: int) -> tuple:
    """Codes (rows, levels, words), alignments (rows, levels), residual lengths and lengths."""
    left, norm = directions(ints, turn)
    n, size = left.shape
    codes = np.zeros((n, levels, size // 64), np.uint64)
    align = np.zeros((n, levels), np.float64)
    for level in range(levels):
        up = left >= 0
        codes[:, level] = np.packbits(up, axis=1, bitorder="little").view(np.uint64)
        align[:, level] = np.abs(left).sum(1) / math.sqrt(size)
        left = left - np.where(up, 1.0, -1.0) * (align[:, level] / math.sqrt(size))[:, None]
    return codes, align, np.sqrt((left ** 2).sum(1)), norm


class Anchors:
    """Bit planes of anchors' rotated directions."""

    def __init__(self, ints: np.ndarray, turn: np.ndarray):
        self.ints = ints
        q, self.norm = directions(ints, turn)
        self.low = q.min(1, initial=0.0)
        self.step = np.maximum((q.max(1, initial=0.0) - self.low) / (2 ** PLANES - 1), 1e-12)
        parts = np.rint((q - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        near = self.low[:, None] + self.step[:, None] * parts
        self.total = near.sum(1)
        self.error = np.sqrt(((q - near) ** 2).sum(1))
        self.length = np.sqrt((q ** 2).sum(1))
        self.planes = [np.packbits((parts >> j) & 1, axis=1, bitorder="little").astype(np.uint8).view(np.uint64) for j in range(PLANES)]

    def interval(self, a: slice, codes: np.ndarray, align: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of the anchors ``a`` (rows) with coded vectors (columns)."""
        words = codes.shape[2]
        root = np.float32(1 / math.sqrt(words * 64))
        estimate = np.zeros((a.stop - a.start, len(codes)), np.float32)
        for level in range(codes.shape[1]):
            bits = np.zeros(estimate.shape, np.int32 if words > 4 else np.int16)
            for j, plane in enumerate(self.planes):
                for w in range(words):
                    bits += np.bitwise_count(codes[None, :, level, w] & plane[a, None, w]).astype(bits.dtype) << j
            ones = np.bitwise_count(codes[:, level]).sum(1, dtype=np.int64)
            # <b, q> = (2 * sum of q over the set bits - sum of q) / sqrt(size)
            inner = (2 * self.step[a, None]).astype(np.float32) * bits
            inner += (2 * self.low[a, None] * ones[None, :] - self.total[a, None]).astype(np.float32)
            estimate += inner * (align[:, level].astype(np.float32) * root)[None, :]
        coded = 1 + rest   # at least the length of the coded part
        # the last term covers rounding in 32 bits: sums of some hundred terms of at most 8
        wide = (self.length[a, None] * rest[None, :] + self.error[a, None] * coded[None, :] + 1e-3).astype(np.float32)
        size = (self.norm[a, None] * norm[None, :]).astype(np.float32)
        return (estimate - wide) * size - 1, (estimate + wide) * size + 1


def best(anchors: Anchors, labels: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, blocks, k: int, same: bool) -> tuple:
    """The first ``k`` rows of ``blocks`` for each anchor and each of its ranges of scores.

    ``low`` and ``high`` (anchors x ranges) bound the scores; ``same`` takes rows of the anchor's
    label with another id, otherwise rows of other labels. Returns arrays (anchor,
    range, row id, id is known, score); higher scores come first, then smaller ids, unknown last."""
    n, ranges = low.shape
    floor = low.copy()   # a score below it cannot be among the first k any more
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool, np.int64)]
    tiles = 0

    def merge(fresh: list[tuple]) -> list[np.ndarray]:
        a, s, i, known, score = (np.concatenate([h, *(f[c] for f in fresh)]) for c, h in enumerate(held))
        order = np.lexsort((i, ~known, -score, s, a))
        a, s, i, known, score = (x[order] for x in (a, s, i, known, score))
        group = a * ranges + s
        first = np.searchsorted(group, group)
        keep = np.arange(len(group)) - first < k
        full = np.arange(len(group)) - first == k - 1
        floor[a[full], s[full]] = np.maximum(floor[a[full], s[full]], score[full])
        return [x[keep] for x in (a, s, i, known, score)]

    for block in blocks:
        row_ids, known, row_labels, ints, codes, align, rest, norm = block
        start = 0
        while start < len(row_ids):
            size = TILES[min(tiles, len(TILES) - 1)]
            tiles += 1
            r = slice(start, min(start + size, len(row_ids)))
            start = r.stop
            fresh = []
            step = max(1, (1 << 19) // (r.stop - r.start))
            for a0 in range(0, n, step):
                a = slice(a0, min(a0 + step, n))
                lo, hi = anchors.interval(a, codes[r], align[r], rest[r], norm[r])
                allowed = labels[a, None] == row_labels[None, r]
                if same:
                    allowed &= (ids[a, None] != row_ids[None, r]) | ~known[None, r]
                else:
                    allowed = ~allowed
                allowed &= (hi >= floor[a].min(1)[:, None]) & (lo <= high[a].max(1)[:, None])
                x, y = np.nonzero(allowed)
                meets = np.zeros(len(x), bool)
                for s in range(ranges):
                    meets |= (hi[x, y] >= floor[a][x, s]) & (lo[x, y] <= high[a][x, s])
                x, y = x[meets] + a0, y[meets] + r.start
                score = np.empty(len(x), np.int64)
                for c in range(0, len(x), 1 << 15):
                    part = slice(c, c + (1 << 15))
                    score[part] = np.einsum("ij,ij->i", anchors.ints[x[part]], ints[y[part]])
                for s in range(ranges):
                    hit = (score >= floor[x, s]) & (score <= high[x, s])
                    if hit.any():
                        fresh.append((x[hit], np.full(int(hit.sum()), s), row_ids[y[hit]], known[y[hit]], score[hit]))
            if fresh:
                held = merge(fresh)
    return tuple(held)


def usable(vector: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x) < F.lit(math.inf)) & ~F.isnan(x), F.lit(False)))
    return F.col(vector).isNotNull() & finite


def index(df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float = 256.0, levels: int = 4, seed: int = 11) -> DataFrame:
    """Every row with a label and a vector of finite components, packed into coded blocks of bounded size."""
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"),
                     F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(F.col("label").isNotNull() & usable("v"))

    def run(batches):
        turns: dict[int, np.ndarray] = {}
        held: dict[int, list] = {}

        def pack(dim: int):
            ids, labels, values = zip(*held.pop(dim))
            turn = turns.setdefault(dim, rotation(dim, seed))
            ints = scaled(values, scale)
            codes, align, rest, norm = encode(ints, turn, levels)
            most = int(np.abs(ints).max(initial=0))
            width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
            known = np.array([i is not None for i in ids])
            cells = [dim, len(ids), np.array([i or 0 for i in ids], "<i8").tobytes(), known.tobytes(), np.array(labels, "<i8").tobytes(),
                     width, ints.astype(f"<i{width}").tobytes(), codes.tobytes(), align.astype("<f4").tobytes(), rest.astype("<f8").tobytes(), norm.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, kinds)], names=names)

        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 3 + [pa.int32()] + [pa.binary()] * 5
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        for batch in batches:
            lists = batch.column("v")
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, label, a, b in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                rows_ = held.setdefault(b - a, [])
                rows_.append((i, label, flat[a:b]))
                if len(rows_) >= min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, b - a)) + 1):
                    yield pack(b - a)
        for dim in list(held):
            yield pack(dim)

    return rows.mapInArrow(run, _BLOCK)


def unpack(row: dict, levels: int) -> tuple:
    """The arrays of a block, as ``best`` takes them."""
    n, dim = row["n"], row["dim"]
    words = max(1, -(-dim // 64))
    return (np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], bool), np.frombuffer(row["labels"], "<i8"),
            np.frombuffer(row["ints"], f"<i{row['width']}").reshape(n, dim).astype(np.int64), np.frombuffer(row["codes"], np.uint64).reshape(n, levels, words),
            np.frombuffer(row["align"], "<f4").reshape(n, levels), np.frombuffer(row["rest"], "<f8"), np.frombuffer(row["norm"]))


def search(blocks: DataFrame, anchors: DataFrame, k: int, same: bool, levels: int, seed: int) -> DataFrame:
    """(``anchor``, ``slot``, ``row``, ``score``, ``rank``): the first ``k`` rows for every range of every anchor.

    ``anchors`` has ``anchor``, ``label``, ``ints`` and ``ranges``, an array of (slot, low, high). Each slab of
    blocks meets each group of anchors in one task; both are bounded."""
    n_blocks, n_bytes = blocks.agg(F.count("*"), F.sum(F.octet_length("ints"))).first()
    n_anchors = anchors.count()
    spark = blocks.sparkSession
    slabs = max(1, min(n_blocks, max(-(-(n_bytes or 0) // SLAB_BYTES), 2 * spark.sparkContext.defaultParallelism)))
    groups = max(1, -(-n_anchors // ANCHORS))
    left = blocks.withColumns({"slab": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slabs)).cast("int"),
                               "part": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    right = anchors.withColumns({"part": F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int"),
                                 "slab": F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))})

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = right.sort_by("anchor").to_pylist()
        out = []
        for dim in sorted({len(w["ints"]) for w in wanted}):
            mine = [w for w in wanted if len(w["ints"]) == dim]
            rows_ = (unpack(r, levels) for batch in left.to_batches(max_chunksize=1) for r in batch.to_pylist() if r["dim"] == dim)
            ranges = max(len(w["ranges"]) for w in mine)
            low, high = np.full((len(mine), ranges), MOST), np.full((len(mine), ranges), LEAST)
            for i, w in enumerate(mine):
                for s, x in enumerate(w["ranges"]):
                    low[i, s], high[i, s] = x["low"], x["high"]
            turn = rotation(dim, seed)
            names = np.array([w["anchor"] for w in mine])
            a, s, row, known, score = best(Anchors(np.array([w["ints"] for w in mine], np.int64).reshape(len(mine), dim), turn),
                                           np.array([w["label"] for w in mine]), names, low, high, rows_, k, same)
            slot = np.array([[x["slot"] for x in w["ranges"]] + [0] * (ranges - len(w["ranges"])) for w in mine], np.int32)
            out.append(pa.table({"anchor": pa.array(names[a], pa.int64()), "slot": pa.array(slot[a, s], pa.int32()),
                                 "row": pa.array(row, pa.int64(), mask=~known), "score": pa.array(score, pa.int64())}))
        empty = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()), ("score", pa.int64())])
        return pa.concat_tables(out) if out else empty.empty_table()

    # few bytes but much work: a number of partitions, so that none are put together
    tasks = min(slabs * groups, 10000)
    left, right = (x.repartition(tasks, "slab", "part").groupBy("slab", "part") for x in (left, right))
    found = left.cogroup(right).applyInArrow(run, "anchor bigint, slot int, row bigint, score bigint")
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("row"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: float = 256.0,
                   levels: int = 4, seed: int = 11) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A score is the inner product of floor(``scale`` * x) with the anchor's; higher scores come
    first, ties by smaller id. For each anchor (a row for which ``is_anchor`` holds, an expression of
    the id column) and each of its first ``positives`` other rows of the same label, the first
    ``negatives`` rows of other labels with least * positive <= 100 * negative <= most * positive.

    Rows with a null label or vector, or a null or non-finite component, take no part. Vectors of
    another length than the anchor's have no inner product with it and do not meet it; empty and
    zero vectors score 0. Rows with a null id are rows like others (after all ids in ties) but never
    anchors. Repeated rows count as often as they occur, so a repeated positive is listed
    again with its negatives; rows with an anchor's id are not "other" rows, and of several the one
    with the smallest label, then vector, is the anchor. An empty table gives no rows; extra columns
    are ignored. Vectors so long that a score might not fit a long fail."""
    blocks = written(index(df, id_col, label_col, vector_col, scale, levels, seed), "code-blocks")
    given = df.where(is_anchor).select(F.col(f"`{id_col}`").cast("bigint").alias("anchor"), F.col(f"`{label_col}`").cast("bigint").alias("label"),
                                       F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    ints = F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("bigint"))
    anchors = given.where(F.col("anchor").isNotNull() & F.col("label").isNotNull() & usable("v")).select(
        "anchor", "label", ints.alias("ints"))
    anchors = written(anchors.groupBy("anchor").agg(F.min(F.struct("label", "ints")).alias("a")).select("anchor", "a.label", "a.ints"), "anchors")
    any_score = F.array(F.struct(F.lit(0).alias("slot"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    near = written(search(blocks, anchors.withColumn("ranges", any_score), positives, True, levels, seed).select(
        "anchor", F.col("rank").alias("slot"), F.col("row").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    share = lambda percent: F.col("positive_score").cast("decimal(20,0)") * F.lit(percent) / F.lit(100)
    bounds = F.struct("slot", F.ceil(share(least)).cast("bigint").alias("low"), F.floor(share(most)).cast("bigint").alias("high"))
    ranges = near.groupBy("anchor").agg(F.sort_array(F.collect_list(bounds)).alias("ranges"))
    far = search(blocks, written(anchors.join(ranges, "anchor"), "anchor-ranges"), negatives, False, levels, seed)
    return far.join(near, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
