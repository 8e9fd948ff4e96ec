"""Suffix-array dedup: remove every byte covered by a string of ``width`` bytes that also
starts elsewhere in the corpus.

1. Texts are grouped by digest; of equal texts one stands for all (they go entirely if
   they hold a window of ``width`` bytes).
2. Each window has an anchor: the smallest hash among its ``GRAM``-byte strings. Equal
   windows have equal anchors, so a window can only repeat if its anchor does. Anchors
   are counted (pre-aggregated) over the corpus.
3. Runs of windows with the same repeated anchor become slices, dealt by anchor. Equal
   slices are aggregated first: all windows of a slice found twice repeat.
4. A task sorts the suffixes of the different slices of its anchors in two stages
   (``suffixes``) and compares neighbours. An anchor with more than ``HOT`` different
   slices is not given to one task: see ``_hot_runs``.
5. The repeated windows of each text, as runs, are joined back to the texts and cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorelab.llm.arrow import map_slices
from scorelab.llm.shingles import _BYTE, _powers, mix
from scorelab.llm.store import written
from scorelab.llm.suffixes import repeated_windows

GRAM = 48          # bytes of an anchor string (less where the width is small)
RUN = 2048         # most windows in a slice
HOT = 1000         # most different slices of an anchor sorted in one task: at most 2.3 MB
LEVELS = (32, 8, 1)   # windows in a block, for anchors with more
CHUNK = 1 << 19    # bytes of slices sorted together
SLICE = 1 << 20
_OTHER = mix(_BYTE + np.uint64(1))


def _gram(width: int) -> int:
    return min(GRAM, max(1, width // 4))


def _rolling(buf: np.ndarray, k: int, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hash of the ``k`` bytes from each position that has them."""
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * power[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[:len(buf) - k + 1])


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``n`` neighbours, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def anchors(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts one after the other: anchor of the window at each position, whether a
    window of one text starts there, positions of anchor strings, hashes of all strings."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    k = _gram(width)
    if len(buf) < width:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(0, bool), np.zeros(0, np.int64), none
    h = _rolling(buf, k)
    n = width - k + 1
    low = _sliding(h, n, np.minimum)
    ends = np.cumsum([len(t) for t in texts])
    own = np.ones(len(low), bool)
    for a, b in zip((ends - width + 1).tolist(), ends.tolist()):   # the windows that would cross an end
        own[max(a, 0):b] = False
    for a, t in zip((ends - [len(t) for t in texts]).tolist(), texts):
        if len(t) < width:
            own[a:a + len(t)] = False
    shown = np.concatenate([np.zeros(n - 1, np.uint64), np.where(own, low, 0), np.zeros(n - 1, np.uint64)])
    high = _sliding(shown, n, np.maximum)
    at = np.flatnonzero((high[:len(h)] == h) & (high[:len(h)] != 0))
    return low, own, at, h


def _bytes(column) -> list[bytes]:
    return [b"" if t is None else t for t in column.to_pylist()]


def _anchor_lists(part: pa.RecordBatch, width: int) -> dict:
    texts = _bytes(part.column("body"))
    _, _, at, h = anchors(texts, width)
    doc = np.searchsorted(np.cumsum([len(t) for t in texts]), at, "right")
    value = h[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(doc)))
    doc, value = doc[first], value[first]
    cut = np.searchsorted(doc, np.arange(1, len(texts)))
    # an anchor string that is twice in its text is listed twice
    twice = np.split(np.repeat(value, np.minimum(times, 2)), np.cumsum(np.minimum(times, 2))[cut - 1] * (cut > 0)) if len(value) else [value] * len(texts)
    return {"id": part.column("id"), "key": part.column("key"), "n": [len(t) for t in texts], "anchors": twice}


def _slices(part: pa.RecordBatch, width: int) -> dict:
    texts = _bytes(part.column("body"))
    low, own, _, _ = anchors(texts, width)
    wanted = np.unique(np.concatenate([np.asarray(x, np.int64) for x in part.column("repeated").to_pylist()]))
    value = low.view(np.int64)
    edge = np.ones(len(value), bool)
    edge[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, len(value)))
    take = own[first] & np.isin(value[first], wanted)
    starts_of = np.cumsum([0] + [len(t) for t in texts])
    buf = b"".join(texts)
    keys = part.column("key").to_pylist()
    rows: dict[str, list] = {c: [] for c in ("anchor", "digest", "body", "starts", "key", "at")}
    for a, n in zip(first[take].tolist(), size[take].tolist()):
        doc = int(np.searchsorted(starts_of, a, "right")) - 1
        for b in range(a, a + n, RUN):
            m = min(RUN, a + n - b)
            s = buf[b:b + m + width - 1]
            for c, x in zip(rows, (int(value[a]), hashlib.blake2b(s, digest_size=16).digest(), s, m, keys[doc], b - int(starts_of[doc]))):
                rows[c].append(x)
    return rows


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _sort_tasks(batches, width: int):
    """Sorted slices of whole anchors, in chunks, to runs of repeated windows for each slice."""
    def solve(rows):
        hits = repeated_windows([r["body"] for r in rows], [r["starts"] for r in rows], width)
        found = [(r["digest"], _runs(np.ones(r["starts"], bool) if r["times"] > 1 else h)) for r, h in zip(rows, hits)]
        found = [x for x in found if x[1]]
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in found], pa.binary()),
            pa.array([[{"a": a, "b": b} for a, b in runs] for _, runs in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
            names=["digest", "runs"])

    held, size, last = [], 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if size > CHUNK and row["anchor"] != last:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            last = row["anchor"]
            size += len(row["body"])
    if held:
        yield solve(held)


def _region_hashes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the bytes [a, b) and the number ``more``."""
    power, inverse = _powers(len(buf) + 1)
    out = []
    for table in (_BYTE, _OTHER):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf] * power[:-1], out=total[1:])
        out.append(mix(mix((total[b] - total[a]) * inverse[a]) + table[7] * (more.astype(np.uint64) + np.uint64(1))).view(np.int64))
    return out[0], out[1]


def _blocks(part: pa.RecordBatch, size: int, width: int) -> dict:
    """Blocks of at most ``size`` windows, aligned to the anchor: hashes of the bytes that all
    windows of the full block hold (``cx``, ``cy``) and of all bytes of the block (``wx``, ``wy``)."""
    out: dict[str, list] = {c: [] for c in ("digest", "a", "b", "cx", "cy", "wx", "wy")}
    for digest, anchor, body, ranges in zip(*(part.column(c).to_pylist() for c in ("digest", "anchor", "body", "ranges"))):
        buf = np.frombuffer(body, np.uint8)
        at = np.flatnonzero(_rolling(buf, _gram(width)).view(np.int64) == anchor)
        i = np.concatenate([np.arange(r["a"], r["b"]) for r in ranges])
        p = at[np.searchsorted(at, i)]
        block = (p - i) // size
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(i) != 1) | (np.diff(p) != 0) | (np.diff(block) != 0)
        first = np.flatnonzero(new)
        a, b = i[first], i[np.append(first[1:], len(i)) - 1] + 1
        p, block = p[first], block[first]
        core = p - block * size
        cx, cy = _region_hashes(buf, core, core - size + 1 + width, block)
        wx, wy = _region_hashes(buf, a, b - 1 + width, (p - a) * (2 * size) + (b - a))
        for c, x in (("a", a), ("b", b), ("cx", cx), ("cy", cy), ("wx", wx), ("wy", wy)):
            out[c] += x.tolist()
        out["digest"] += [digest] * len(a)
    return out


def _hot_runs(slices: DataFrame, width: int) -> DataFrame:
    """``digest`` and ``runs`` for the slices of anchors that have very many of them.

    Equal windows lie alike to their anchor, so windows are grouped in blocks aligned to
    it. A window can only repeat if the bytes common to its whole block repeat; other
    blocks go. Blocks that repeat as a whole are done, and one of each stands for them
    below; the rest is cut into smaller blocks, down to single windows. All counts are
    pre-aggregated; a very common block is never in one task."""
    todo = slices.select("digest", F.array(F.struct(F.lit(0).alias("a"), F.col("starts").alias("b"))).alias("ranges"))
    runs = []
    for size in LEVELS:
        size = min(size, width)
        cut = map_slices(todo.join(slices.select("digest", "anchor", "body"), "digest").select("digest", "anchor", "body", "ranges"),
                         lambda part, size=size: _blocks(part, size, width),
                         "digest binary, a int, b int, cx bigint, cy bigint, wx bigint, wy bigint", "body", limit=1 << 18)
        cut = written(cut, "blocks")
        often = written(cut.groupBy("cx", "cy").agg(F.count("*").alias("n")).where("n > 1").select("cx", "cy"), "block-cores")
        left = written(cut.join(often, ["cx", "cy"]).select("digest", "a", "b", "wx", "wy"), "blocks-left")
        whole = written(left.groupBy("wx", "wy").agg(F.count("*").alias("n"), F.min(F.struct("digest", "a")).alias("one")).where("n > 1").select("wx", "wy", "one"), "blocks-whole")
        left = left.join(whole, ["wx", "wy"], "left")
        runs.append(left.where("one is not null").select("digest", F.struct("a", "b").alias("run")))
        on = left.where(F.col("one").isNull() | (F.struct("digest", "a") == F.col("one")))
        todo = written(on.groupBy("digest").agg(F.collect_list(F.struct("a", "b")).alias("ranges")).select(
            "digest", F.array_sort("ranges").alias("ranges")), "blocks-on")
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.groupBy("digest").agg(F.collect_list("run").alias("runs"))


def repeated_runs(rows: DataFrame, width: int) -> DataFrame:
    """``key`` and ``runs`` (array of [a, b): windows starting there repeat) of the texts in
    ``rows`` (``id``, ``key``, ``body``); ``runs`` is null where all of a repeated text repeats."""
    listed = written(map_slices(rows, lambda p: _anchor_lists(p, width), "id bigint, key binary, n bigint, anchors array<bigint>", "body", limit=SLICE), "anchors")
    long_ = listed.where(F.col("n") >= width)
    texts = written(long_.groupBy("key").agg(F.count("*").alias("times"), F.min(F.coalesce("id", F.lit(2**63 - 1))).alias("id"),
                                             F.first("anchors").alias("anchors")), "texts")
    each = texts.select(F.xxhash64("key").alias("ref"), F.explode("anchors").alias("anchor"))
    common = each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    # a reference shared by two texts only makes candidates of more anchors
    mine = each.join(common, "anchor").groupBy("ref").agg(F.collect_set("anchor").alias("repeated"))
    chosen = texts.select("id", "key", F.xxhash64("key").alias("ref")).join(mine, "ref").drop("ref")
    bodies = rows.withColumn("id", F.coalesce("id", F.lit(2**63 - 1))).join(chosen, ["id", "key"]).drop("id")
    schema = "anchor bigint, digest binary, body binary, starts int, key binary, at int"
    cut = written(map_slices(bodies, lambda p: _slices(p, width), schema, "body", limit=SLICE), "slices")
    distinct = written(cut.groupBy("digest").agg(F.count("*").alias("times"), F.first("anchor").alias("anchor"),
                                                 F.first("starts").alias("starts"), F.first("body").alias("body")), "distinct")
    counts = distinct.groupBy("anchor").agg(F.count("*").alias("n"))
    hot = written(counts.where(F.col("n") > HOT).select("anchor"), "hot-anchors")
    cold = distinct.join(hot, "anchor", "left_anti").select("anchor", "digest", "times", "starts", "body")
    found = cold.repartition("anchor").sortWithinPartitions("anchor", "digest").mapInArrow(
        lambda b: _sort_tasks(b, width), "digest binary, runs array<struct<a:int,b:int>>")

    hot_found = _hot_runs(distinct.join(hot, "anchor", "left_semi").select("digest", "anchor", "body", "starts"), width)
    whole = distinct.where("times > 1").join(hot, "anchor", "left_semi").select(
        "digest", F.array(F.struct(F.lit(0).alias("a"), F.col("starts").alias("b"))).alias("runs"))
    runs = written(found.unionByName(hot_found).unionByName(whole), "runs")
    per_text = cut.select("digest", "key", "at").join(runs, "digest").select(
        "key", F.transform("runs", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b"))).alias("r"))
    per_text = per_text.groupBy("key").agg(F.flatten(F.collect_list("r")).alias("runs"))
    twice = texts.where("times > 1").select("key")
    return per_text.join(twice, "key", "left_anti").unionByName(
        twice.withColumn("runs", F.lit(None).cast("array<struct<a:int,b:int>>"))).withColumn("found", F.lit(True))


def _removed(df: DataFrame, id_col: str, text_col: str, width: int, keep: list[str], want: str) -> tuple[DataFrame, dict[str, str]]:
    """Rows with ``keep`` as ``_k0``, ``_k1`` ... and what the removal gives; ``want``: "kept" (bytes) or "text"."""
    body = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), body.alias("body"))
    runs = repeated_runs(rows.withColumn("key", F.unhex(F.md5("body"))), width)
    names = {f"_k{i}": c for i, c in enumerate(dict.fromkeys(keep))}
    src = df.select(*[F.col(f"`{c}`").alias(a) for a, c in names.items()], body.alias("_body"), F.col(f"`{text_col}`").isNull().alias("_null"))
    src = src.withColumn("key", F.unhex(F.md5("_body"))).join(runs, "key", "left").drop("key")
    fields = [f for f in src.schema if f.name in names]

    def cut(part: pa.RecordBatch) -> dict:
        out = {f.name: part.column(f.name) for f in fields} | {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text")}
        for body, null, found, runs in zip(*(part.column(c).to_pylist() for c in ("_body", "_null", "found", "runs"))):
            spans: list[list[int]] = []
            if found and runs is None:
                spans = [[0, len(body)]]
            for a, b in sorted((r["a"], r["b"] + width - 1) for r in runs or []):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(body[at:a])
                at = b
            kept.append(body[at:])
            left = b"".join(kept)
            for c, x in (("n_bytes", len(body)), ("n_removed", len(body) - len(left)), ("n_spans", len(spans)),
                         ("kept_sha256", hashlib.sha256(left).hexdigest()), ("kept", left if want == "kept" else None),
                         ("text", left.decode("utf-8", "ignore") if want == "text" and not null else None)):
                out[c].append(x)
        return out

    schema = StructType([*fields, *StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, text string")])
    return map_slices(src, cut, schema, "_body"), names


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200,
                   keep: tuple[str, ...] = ("doc_id",), with_text: bool = True) -> DataFrame:
    """Every row of ``df`` without the bytes that a repeated string of ``width`` bytes covers.

    Texts are UTF-8 bytes (null: empty); strings do not cross rows; overlaps count; all
    strings are judged on the input. Returns ``keep``, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` and, if ``with_text``, ``kept``
    (binary). Repeated rows repeat each other; texts shorter than ``width`` lose nothing;
    null ids are rows like others; an empty table gives an empty result. Columns of ``df``
    outside ``keep`` are left out."""
    done, names = _removed(df, id_col, text_col, width, list(keep), "kept" if with_text else "")
    return done.select(*[F.col(a).alias(c) for a, c in names.items()], "n_bytes", "n_removed", "n_spans", "kept_sha256",
                       *(["kept"] if with_text else []))


def cut_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", width: int = 200) -> DataFrame:
    """``df`` with its columns, texts without their repeated passages and ``chars_col``, where there
    is one, the characters of each text that changed. Bytes of a character that is cut in
    two go with the passage; null texts stay null; no row goes."""
    names_in = df.columns
    done, names = _removed(df, id_col, text_col, width, [c for c in names_in if c != text_col], "text")
    alias = {c: a for a, c in names.items()}
    out = []
    for c in names_in:
        col = F.col("text") if c == text_col else F.col(alias[c])
        if c == chars_col:
            col = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(col).cast(df.schema[c].dataType)
        out.append(col.alias(c))
    return done.select(*out)
