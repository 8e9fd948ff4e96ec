"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are cut into pieces by the tokenizer's pattern. Distinct pieces not seen before
are encoded together: pieces of similar length form one padded matrix of token ids, and
in each round every row merges its leftmost pair of minimum rank (pairs are found in an
open-addressing hash table), is compacted, and leaves the matrix once nothing merges.
In wide rows a round merges all occurrences of the row's minimum rank at once where that
equals doing them one by one (see ``_safe``), so long runs do not need a round per merge.

Nulls and empty texts have no tokens. Ids are those of ``tiktoken`` without special
tokens. Extra columns are kept out of the result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelab.llm.arrow import map_slices

NONE = np.int32(2**31 - 1)   # rank of a pair that is not in the vocabulary
WIDE = 64                    # from this width on, one round merges all pairs of the minimum rank
CACHE = 200_000              # distinct pieces remembered by a worker


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 token and rank in each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Vocabulary:
    """Rank tables as arrays: hashed pairs, bytes of each id, and which ranks merge in bulk."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        unsafe = set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
                    unsafe.update(x for x in (a, b) if rank < x)
        size = max(ranks.values(), default=0) + 1
        #: A rank is safe if no pair that holds its token ranks before it.
        self.safe = np.ones(size, bool)
        self.safe[list(unsafe)] = False
        self._build(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        pieces = [b""] * size
        for token, rank in ranks.items():
            pieces[rank] = token
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _build(self, left, right, merged):
        bits = max(4, int(len(left) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        key = (left << 32) | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == -1
            _, first = np.unique(np.where(free, s, -1 - np.arange(len(s))), return_index=True)
            first = first[free[first]]
            self.keys[s[first]], self.values[s[first]] = key[todo[first]], merged[todo[first]]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo = todo[rest]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where the pair is unknown or a side is padding (-1)."""
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        shape, key = key.shape, key.ravel()
        out = np.full(len(key), NONE, np.int32)
        todo = np.flatnonzero((a >= 0).ravel() & (b >= 0).ravel())
        slot = self._slot(key[todo])
        while len(todo):
            at = self.keys[slot]
            hit = at == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (at != -1)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif p:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        for bits, rows in buckets.items():
            width = 1 << bits
            step = max(1, (1 << 18) // width)
            for k in range(0, len(rows), step):
                part = rows[k:k + step]
                for i, ids in zip(part, self._encode_matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _encode_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        m = np.full((len(pieces), width), -1, np.int32)
        for r, p in enumerate(pieces):
            m[r, :len(p)] = self.byte_ids[np.frombuffer(p, np.uint8)]
        out: list[bytes] = [b""] * len(pieces)
        row_of = np.arange(len(pieces))
        rank = self.rank(m[:, :-1], m[:, 1:])
        while True:
            best = rank.argmin(1)
            low = rank[np.arange(len(m)), best]
            ended = low == NONE
            for r in np.flatnonzero(ended):
                out[row_of[r]] = m[r][m[r] >= 0].astype("<u4").tobytes()
            if ended.all():
                return out
            m, rank, row_of, best, low = (x[~ended] for x in (m, rank, row_of, best, low))
            take = np.zeros(rank.shape, bool)
            take[np.arange(len(m)), best] = True
            if width >= WIDE:
                bulk = self.safe[low]
                take[bulk] = _apart(rank[bulk] == low[bulk, None])
            m, rank = self._merge(m, rank, take, low)

    def _merge(self, m, rank, take, low):
        """Merge the marked pairs, compact the rows, and rank the pairs that are new."""
        r, c = np.nonzero(take)
        m[r, c] = low[r]
        gone = np.zeros(m.shape, bool)
        gone[r, c + 1] = True
        fresh = np.zeros(m.shape, bool)
        fresh[r, c] = True
        keep = ~gone & (m >= 0)
        place = np.cumsum(keep, 1) - 1
        width = max(2, int(place[:, -1].max()) + 1)
        rows, cols = np.nonzero(keep)
        to = place[rows, cols]
        new = np.full((len(m), width), -1, np.int32)
        new[rows, to] = m[rows, cols]
        marks = np.zeros((len(m), width), bool)
        marks[rows, to] = fresh[rows, cols]
        # rank of the pair that starts at each kept token, as it was
        old = np.concatenate([rank, np.full((len(m), 1), NONE, np.int32)], 1)
        ranks = np.full((len(m), width), NONE, np.int32)
        ranks[rows, to] = old[rows, cols]
        changed = marks.copy()
        changed[:, :-1] |= marks[:, 1:]
        x, y = np.nonzero(changed[:, :-1])
        ranks[x, y] = self.rank(new[x, y], new[x, y + 1])
        return new, ranks[:, :-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, one after the other."""
        if not len(ids):
            return b""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - n), n)
        return self.bytes[at].tobytes()


def _apart(hit: np.ndarray) -> np.ndarray:
    """Of runs of adjacent marks in a row, every other one from the left (pairs must not overlap)."""
    at = np.arange(hit.shape[1])[None, :]
    since = np.maximum.accumulate(np.where(hit, -1, at), axis=1)
    return hit & ((at - since) % 2 == 1)


class Encoder:
    """Encodes texts piece by piece, remembering a bounded number of distinct pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary, self.split, self.seen = vocabulary, regex.compile(pattern).findall, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.split(t) if t else [] for t in texts]
        seen = self.seen
        new = list(set().union(*cut).difference(seen)) if cut else []
        ids = dict(zip(new, self.vocabulary.encode_pieces([p.encode() for p in new])))
        if len(seen) + len(new) > CACHE:
            ids = {p: seen[p] if p in seen else ids[p] for p in set().union(*cut)}
            seen.clear()
        seen.update(ids)
        return [b"".join(map(seen.__getitem__, c)) for c in cut]


_LOADED: dict[tuple, Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _LOADED[key] = Encoder(Vocabulary(ranks), pattern)
    return _LOADED[key]


def encode(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Encode ``text_col`` and decode the ids again.

    ``vocabulary`` is the path of a rank file on the driver; its bytes (fixed size, under
    2 MB) are sent to the executors. Returns ``keep`` plus ``n_tokens``, ``ids`` (array of
    int, if ``with_ids``), ``ids_sha256``, ``decoded`` (binary, if ``with_ids``) and
    ``decoded_sha256``. Ties, repeated rows and null keys are kept as they are; an empty
    table gives an empty result.
    """
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    src = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(keep)], F.col(f"`{text_col}`").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema if f.name != "_text"}

    def run(part: pa.RecordBatch, encoder: Encoder) -> dict:
        ids = encoder.encode(part.column("_text").to_pylist())
        arrays = [np.frombuffer(x, "<u4") for x in ids]
        decoded = [encoder.vocabulary.decode(x) for x in arrays]
        out = {c: part.column(c) for c in kinds}
        out["n_tokens"] = [len(x) for x in arrays]
        out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
        out["decoded_sha256"] = [hashlib.sha256(x).hexdigest() for x in decoded]
        if with_ids:
            out["ids"] = [x.astype(np.int32) for x in arrays]
            out["decoded"] = decoded
        return out

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded binary"
    return map_slices(src, run, schema, "_text", setup=lambda: _encoder(sent.value, pattern))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", key: str = "doc_id") -> DataFrame:
    """Bytes of each row's ids: ``key`` and ``decoded`` (binary); null ids decode to nothing."""
    ranks = read_ranks(vocabulary)
    table = df.sparkSession.sparkContext.broadcast(ranks)
    src = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{ids_col}`").alias("_ids"))
    kind = src.schema[key].dataType.simpleString()

    def run(batches):
        tokens = {v: k for k, v in table.value.items()}
        for b in batches:
            rows = [b"".join(tokens[i] for i in x or []) for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(rows, pa.binary())], names=[key, "decoded"])

    return src.mapInArrow(run, f"`{key}` {kind}, decoded binary")
