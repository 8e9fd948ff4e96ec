"""Token ids as Parquet files: list columns with chosen encodings, row groups and page indexes.

``write_tokens`` puts documents in the order of their ids, encodes their texts and writes one
row for each: its id, the ids before it in its part (``at``), its number of ids, its ids as a
list column, and metadata columns of the caller's choice. Ids are dictionary encoded (or
delta encoded), the number columns delta encoded; row groups, pages and the rows of a page
have set bounds, and Parquet's page indexes hold each page's smallest and largest document
id. So a reader of numbers or metadata touches no token pages, and a reader of some
documents only the pages that may hold them. A manifest beside the files says how many
ids come before each part: a place in the whole stream is that number plus ``at``.

The texts are encoded by the ``tokenizers`` library. Its time goes into words it has seen
before, so a text is cut where byte-level pre-tokenizers always cut (``cuts``), and each
distinct piece is encoded once and remembered, up to a bound. ``PieceEncoder`` checks that the tokenizer is of that kind and that
tokens end where pieces end."""

from __future__ import annotations

import hashlib
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.arrow import slices
from scorelab.llm.ordered import in_order, running_start
from scorelab.session import broadcast_if_small

#: Bytes that begin a character which is not white space by any definition (``UNSURE``: if the next byte is none of these).
VISIBLE = np.isin(np.arange(256), [*range(0x21, 0x7F), *range(0xC3, 0xEF), *range(0xF0, 0xF5)])
UNSURE = {0xE1: (0x9A, 0xA0), 0xE2: (0x80, 0x81), 0xE3: (0x80, 0x80)}
ALNUM = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
PUNCTUATION = np.isin(np.arange(256), list(b".,;:!?"))
#: One pre-token: Latin letters, with or without a space before them.
WORD = r"\A ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+\z"
#: Bytes of texts that are encoded at once.
SLICE = 4 << 20
#: A worker remembers the pieces of its current generation and of the one before, each of
#: about so many (150 bytes each); pieces that are met again move to the current one. Pieces
#: met once so far, most of all in a slice, have two generations of half as many.
CACHE = 200_000
#: Bytes of pieces that are encoded as one text.
JOINED = 1 << 16


def _byte_chars() -> np.ndarray:
    """The character that stands for each byte in byte-level vocabularies, as code points."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.empty(256, "<u4")
    out[shown] = shown
    out[np.setdiff1d(np.arange(256), shown)] = 256 + np.arange(256 - len(shown))
    return out


BYTE_CHARS = _byte_chars()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text of a string array begins and the last one ends, and the bytes of all of them."""
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, np.int32), np.empty(0, np.uint8)
    ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]


def cuts(ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Places inside texts (bytes ``ends[i]`` to ``ends[i + 1]`` of ``data``) where byte-level pre-tokenizers always cut.

    These are: before a space and before and after a line feed that a visible character follows,
    and between a Latin letter or ASCII digit and a punctuation mark."""
    begins = np.zeros(len(data) + 1, bool)
    begins[ends] = True
    here = np.zeros(len(data) + 1, bool)
    gap = np.flatnonzero((data[:-1] == 0x20) | (data[:-1] == 0x0A))
    after = data[gap + 1]
    ok = VISIBLE[after] & ~begins[gap + 1]
    second = data.take(gap + 2, mode="clip") if len(gap) else after
    for first, none in UNSURE.items():
        ok &= (after != first) | ((second != none[0]) & (second != none[1]))
    gap = gap[ok]
    here[gap] = True
    here[gap[data[gap] == 0x0A] + 1] = True
    mark = np.flatnonzero(PUNCTUATION[data[1:]]) + 1
    last, lead = data[mark - 1], data.take(mark - 2, mode="clip") if len(mark) else data[mark - 1]
    latin = ((lead == 0xC3) & (last != 0x97) & (last != 0xB7)) | ((lead > 0xC3) & (lead < 0xC9)) | ((lead == 0xC9) & (last <= 0x8F))
    here[mark[(ALNUM[last] | (last >= 0x80) & latin) & ~begins[mark]]] = True
    return np.flatnonzero(here & ~begins)


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, by a byte-level tokenizer without a normalizer."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        found = json.loads(definition)
        step = found.get("pre_tokenizer") or {}
        if found.get("normalizer") or step.get("type") != "ByteLevel" or step.get("add_prefix_space") or not step.get("use_regex", True):
            raise ValueError("the tokenizer does not cut texts at spaces as byte-level tokenizers do")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True   # their strings in a text are ordinary text
        # the same model for words that are cut already and given as one character for each byte
        self.words = Tokenizer.from_str(definition)
        self.words.encode_special_tokens = True
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)   # one character stands for each byte
        self.seen: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.once: dict[str, bytes] = {}
        self.once_before: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as it is."""
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: pa.Array) -> list[bytes]:
        """Ids of pieces that begin with a space and a visible character, with a visible character or that are a line feed.

        Many are encoded as one text, words of Latin letters (one pre-token each) apart from the
        others. A token never spans two pieces, so the ids are cut where the bytes of a piece
        end; if some cut falls into a token the batch is encoded piece by piece."""
        is_word = pc.match_substring_regex(pieces, WORD)
        words, others = pieces.filter(is_word), pieces.filter(pc.invert(is_word)).to_pylist()
        found = iter(self._words(words)), iter(self._joined(others))
        return [next(found[0] if w else found[1]) for w in is_word.to_pylist()]

    def _words(self, words: pa.Array) -> list[bytes]:
        """Ids of words, many at once: as one character for each byte, with spaces between them that vanish."""
        out: list[bytes] = []
        ends, data = _bytes_of(words)
        n = 0
        while n < len(words):
            stop = min(max(int(np.searchsorted(ends, ends[n] + JOINED)), n + 1), len(words))
            wanted = ends[n:stop + 1] - ends[n]
            text = np.insert(BYTE_CHARS[data[ends[n]:ends[stop]]], wanted[1:-1], ord(" ")).tobytes().decode("utf-32-le")
            got = self._cut(text, self.words, wanted)
            out += got if got is not None else [x.tobytes() for x in self.whole(words.slice(n, stop - n).to_pylist())]
            n = stop
        return out

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, many at once: a line feed before a visible character, or `` a`` before a line feed, begins a pre-token there."""
        out: list[bytes] = []
        n = 0
        while n < len(pieces):
            start, total, text, wanted = n, 0, [], []
            while n < len(pieces) and total < JOINED:
                p = pieces[n]
                if p[0] != " ":
                    lead = " a" if p[0] == "\n" else "\n"
                    text.append(lead)
                    total += len(lead)
                begin = total
                text.append(p)
                total += len(p) if p.isascii() else len(p.encode())
                wanted += [begin, total]
                n += 1
            got = self._cut("".join(text), self.tokenizer, np.array(wanted))
            out += got[::2] if got is not None else [x.tobytes() for x in self.whole(pieces[start:n])]
        return out

    def _cut(self, text: str, tokenizer, wanted: np.ndarray) -> list[bytes] | None:
        """Ids of ``text`` between each place (in bytes) and the next; None if a place is inside a token."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
        cut = np.searchsorted(ends, wanted)
        if ends[-1] != wanted[-1] or (ends[cut] != wanted).any():
            return None
        raw, cut = ids.tobytes(), (4 * cut).tolist()
        return [raw[a:b] for a, b in zip(cut[:-1], cut[1:])]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each. A null text is empty.

        Distinct pieces are found by Arrow's kernels; a piece is looked up once for each slice, and
        ids are gathered by number."""
        if not len(texts):
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "").cast(pa.string())
        of_text, data = _bytes_of(texts)
        cut = cuts(of_text, data)
        heads = np.searchsorted(cut, of_text[:-1]) + np.arange(len(texts))
        is_head = np.zeros(len(cut) + len(texts), bool)
        is_head[heads] = True
        starts = np.empty(len(is_head) + 1, np.int32)
        starts[:-1][is_head], starts[:-1][~is_head], starts[-1] = of_text[:-1], cut, of_text[-1]
        pieces = pa.StringArray.from_buffers(len(is_head), pa.py_buffer(starts), pa.py_buffer(data))
        coded = pc.dictionary_encode(pieces.filter(pa.array(~is_head)))
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        pool = list(map(self.seen.get, words))
        unseen = [i for i, f in enumerate(pool) if f is None]
        lost = [words[i] for i in unseen]
        before, once, once_before = self.before.get, self.once.get, self.once_before.get
        ids = [before(w) or once(w) or once_before(w) for w in lost]
        new = [i for i, f in zip(unseen, ids) if f is None]
        fresh = iter(self.pieces(coded.dictionary.take(pa.array(new, pa.int32()))))
        often = (np.bincount(coded.indices.to_numpy(), minlength=len(words)) > 1).tolist()
        for i, w, f in zip(unseen, lost, ids):
            pool[i] = f or next(fresh)
            (self.seen if f or often[i] else self.once)[w] = pool[i]
        if len(self.seen) > CACHE:
            self.before, self.seen = self.seen, {}
        if len(self.once) > CACHE // 2:
            self.once_before, self.once = self.once, {}
        pool += [h.tobytes() for h in self.whole(pieces.filter(pa.array(is_head)).to_pylist())]
        # numbers of 32 bits: a slice has far fewer pieces and ids
        size = np.fromiter(map(len, pool), np.int32, len(pool)) // 4
        place = np.cumsum(size, dtype=np.int32) - size
        which = np.empty(len(pieces), np.int32)
        which[~is_head] = coded.indices.to_numpy()
        which[is_head] = len(words) + np.arange(len(texts))
        n = size[which]
        ends_of = np.cumsum(n, dtype=np.int32)
        at = np.repeat(place[which] - (ends_of - n), n) + np.arange(ends_of[-1] if len(n) else 0, dtype=np.int32)
        return np.frombuffer(b"".join(pool), "<u4")[at], np.add.reduceat(n, heads).astype(np.int64)


_LOADED: dict[bytes, PieceEncoder] = {}


def _encoder(definition: str) -> PieceEncoder:
    """The encoder of a worker, which keeps its pieces from task to task."""
    key = hashlib.sha256(definition.encode()).digest()
    if key not in _LOADED:
        _LOADED[key] = PieceEncoder(definition)
    return _LOADED[key]


def file_options(ids: str = "dictionary", row_group: int = 64 << 20, page: int = 256 << 10, page_rows: int = 1000,
                 compression: str = "zstd") -> dict[str, str]:
    """Options of Spark's Parquet writer. ``ids``: ``dictionary`` (pages of ids fall back to delta where a
    row group has more distinct ids than a dictionary page holds) or ``delta``; ``row_group`` and
    ``page`` in bytes; ``page_rows``: rows of a page at most, the grain of the page index."""
    if ids not in ("dictionary", "delta"):
        raise ValueError("ids are 'dictionary' or 'delta' encoded")
    return {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group), "parquet.page.size": str(page),
            "parquet.page.row.count.limit": str(page_rows), "parquet.columnindex.truncate.length": "64", "compression": compression,
            "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#at": "false", "parquet.enable.dictionary#n_tokens": "false",
            "parquet.enable.dictionary#ids.list.element": "true" if ids == "dictionary" else "false"}


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text",
                 meta: tuple[str, ...] = (), **options) -> None:
    """Write the ids of every text of ``df`` to ``path``/tokens and the manifest to ``path``/manifest.

    ``tokenizer`` is the path of a tokenizers file on the driver (a fixed size, sent to the
    executors). Whole texts are encoded without special tokens (null: empty) and ``end_id`` is
    appended to each. Documents come in ascending order of ``id_col``, null first, ties by a hash
    of the text; repeated rows are all written, next to each other. ``meta`` names columns to
    keep, as fields of ``meta``, so no name clashes; other columns are not written. An empty
    table gives files without rows. ``options`` are those of ``file_options``."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = F.struct(*[F.col(f"`{c}`").alias(c) for c in meta]) if meta else F.struct(F.lit(0).alias("none"))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), kept.alias("meta"))
    rows = in_order(rows, F.col("doc_id"), F.xxhash64("text")).select("doc_id", "text", "meta")
    kind, meta_kind = rows.schema["doc_id"].dataType.simpleString(), rows.schema["meta"].dataType.simpleString()

    def run(batches):
        encoder, at = _encoder(sent.value), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, n = encoder.encode(part.column("text"))
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                ends = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(at + ends[:-1]), pa.array(n), lists, part.column("meta")],
                                                 names=["doc_id", "at", "n_tokens", "ids", "meta"])
                at += int(ends[-1])

    out = rows.mapInArrow(run, f"doc_id {kind}, at bigint, n_tokens bigint, ids array<int>, meta {meta_kind}")
    if not meta:
        out = out.drop("meta")
    out.write.options(**file_options(**options)).parquet(f"{path}/tokens")
    parts = _parts(df.sparkSession, path).groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    starts = running_start(parts, "part", "n_tokens")
    parts.join(starts, "part").write.parquet(f"{path}/manifest")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """The rows with the number of their part: the task that wrote them, in the order of the ranges."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("bigint")
    return spark.read.parquet(f"{path}/tokens").withColumn("part", part)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids`` and, if written, ``meta``. Only selected columns are read, and filters on ``doc_id`` reach the
    row-group statistics and page indexes."""
    starts = spark.read.parquet(f"{path}/manifest").select("part", F.col("start").alias("_start"))
    rows = _parts(spark, path).join(broadcast_if_small(starts), "part").withColumn("start", F.col("_start") + F.col("at"))
    return rows.select("doc_id", "start", "n_tokens", "ids", *[c for c in rows.columns if c == "meta"])


def read_window(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """Ids ``lo`` to ``hi`` (exclusive) of the whole stream: ``doc_id``, ``start`` (of the slice) and ``ids``, a row
    for each document that the window touches. Files that it does not touch are not read."""
    manifest = spark.read.parquet(f"{path}/manifest")
    touched = manifest.where((F.col("start") < hi) & (F.col("start") + F.col("n_tokens") > lo)).agg(F.min("part"), F.max("part")).first()
    first, last = (-1, -1) if touched[0] is None else touched
    starts = manifest.select("part", F.col("start").alias("_start"))
    rows = _parts(spark, path).where(F.col("part").between(first, last)).join(broadcast_if_small(starts), "part")
    begin = F.col("_start") + F.col("at")
    skip = F.greatest(F.lit(lo) - begin, F.lit(0))
    size = F.least(F.lit(hi) - begin, F.col("n_tokens")) - skip
    return rows.where(size > 0).select("doc_id", (begin + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), size.cast("int")).alias("ids"))


def checksums(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` (counted from the ids) and ``ids_crc32`` of documents read back."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in batches:
            lists = part.column("ids")
            ends = lists.offsets.to_numpy()
            raw = lists.values.to_numpy().astype("<u4", copy=False)
            crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc)],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
