"""Token files: ids against whole texts, file layout, selective reads, edge cases."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorelab.llm import token_files
from scorelab.llm.queries import QUERIES
from scorelab.session import scratch_path
from tests.conftest import SF001, SF01

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return token_files.PieceEncoder(open(VOCABULARY, encoding="utf-8").read())


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def brute(rows, whole):
    """(doc_id, start, n_tokens, crc32) of (doc_id, text) rows that are already in order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = whole(text) + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def place(spark, name="tokens"):
    return scratch_path(spark, name).removeprefix("file:")


def read(spark, path):
    out = token_files.checksums(token_files.read_tokens(spark, path)).collect()
    return sorted([(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out], key=lambda r: r[1])


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_query_equals_whole_texts(spark, whole, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    out = QUERIES["op12_token_files"](spark, sf)
    got = sorted(map(tuple, out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    assert got == brute(docs, whole)


def encoded(encoder, texts):
    """Ids of each text, from a sliced array (its offsets do not begin at 0)."""
    ids, n = encoder.encode(pa.array(["other text", *texts], pa.string()).slice(1))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] if len(texts) else []


PIECES = st.lists(st.sampled_from([" ", "  ", "\n", "\t ", " ", "　", "\x1c", "\x85", "a", "b1", "_x", "'s", "'ll", "é", "é", "́",
                                   "中文", "١٢", "½", "🙂", "<|endoftext|>", "\x00", "\x01", "\ue000", "...", "-", "Ab", "x" * 50]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES | st.text(max_size=40), max_size=6))
def test_pieces_equal_whole_texts(encoder, texts):
    assert encoded(encoder, texts) == [x.tolist() for x in encoder.whole(texts)]


GAPS = st.lists(st.sampled_from([" ", "\n", "\n\n", "\r\n", "\u00a0", "\u1680", "\u180e", "\u2003", "\u2028", "\u3000", "\u200b", "\ufeff", "Of", "it's", "'re", ".", "!?", "#$",
                                 "9", "\u00d7", "\u00f7", "\u00e9", "\u01c3", "\u024f", "\u0250", "\u1ea1", "\u10d0", "\u3042", "\u2014", "\ud55c", "\u0416", "\U00020000", "\u0301"]), max_size=20).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(GAPS, max_size=6))
def test_cuts_equal_whole_texts(encoder, texts):
    assert encoded(encoder, texts) == [x.tolist() for x in encoder.whole(texts)]


def test_words_at_line_starts_are_words():
    """Ends of lines do not multiply the words that begin lines: each is encoded once, without the regular expression."""
    encoder = token_files.PieceEncoder(open(VOCABULARY, encoding="utf-8").read())
    texts = [f"head{end}\n{word} on" for end in (".", "!", "?", ":", ",", ";") for word in ("Of", "The", "And", "Ein", "\u00c9t\u00e9")]
    assert encoded(encoder, texts) == [x.tolist() for x in encoder.whole(texts)]
    assert set(encoder.seen) == {".", "!", "?", ":", ",", ";", "\n", "Of", "The", "And", "Ein", "\u00c9t\u00e9", " on"}


def test_pieces_met_once_do_not_drive_out_others(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 8)
    encoder = token_files.PieceEncoder(open(VOCABULARY, encoding="utf-8").read())
    for texts in (["a common common"], *([f"a rare{i} scarce{i} few{i} odd{i} next{i}"] for i in "bcdefgh"), ["a fewh common"]):
        assert encoded(encoder, texts) == [x.tolist() for x in encoder.whole(texts)]
        assert len(encoder.once) <= 4 and len(encoder.once_before) <= 9
    assert " common" in encoder.seen and " fewh" in encoder.seen and " rareb" not in encoder.once_before


def test_cache_bound_and_small_joins(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 3)
    monkeypatch.setattr(token_files, "JOINED", 8)
    encoder = token_files.PieceEncoder(open(VOCABULARY, encoding="utf-8").read())
    for texts in (["one two three four five"], ["two six", None, "six one two"], [""], []):
        assert encoded(encoder, texts) == [x.tolist() for x in encoder.whole([t or "" for t in texts])]
        assert len(encoder.seen) <= 3 and len(encoder.before) <= 8      # a generation ends after the slice that fills it


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_files.PieceEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_nulls_ties_repeats_clashing_names(spark, whole):
    rows = [(5, "b c", "x", 1), (None, "no id", "y", 2), (5, "b c", "z", 3), (5, None, None, 4), (-2, "", "w", 5), (7, "word " * 30000, "v", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, at int").repartition(3)
    path = place(spark)
    token_files.write_tokens(df, path, VOCABULARY, meta=("ids", "at", "text"))
    back = token_files.read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, -2, 5, 5, 5, 7]
    assert sorted((r["meta"]["ids"], r["meta"]["at"]) for r in back if r["meta"]["ids"]) == [("v", 6), ("w", 5), ("x", 1), ("y", 2), ("z", 3)]
    assert read(spark, path) == brute([(r["doc_id"], r["meta"]["text"]) for r in back], whole)
    assert back[2]["meta"]["text"] == back[3]["meta"]["text"] or back[3]["meta"]["text"] == back[4]["meta"]["text"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    path = place(spark)
    token_files.write_tokens(df, path, VOCABULARY)
    assert read(spark, path) == []
    assert token_files.read_window(spark, path, 0, 10).collect() == []


def test_one_hot_id_spreads_over_parts(spark, whole):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") < 2000, 9).otherwise(F.col("id")).cast("bigint").alias("doc_id"), F.lit("one two").alias("text"))
        path = place(spark)
        token_files.write_tokens(df, path, VOCABULARY)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n_docs"] for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1500
    assert read(spark, path) == brute([(9, "one two")] * 2000 + [(i, "one two") for i in range(2000, 3000)], whole)


@pytest.mark.parametrize("ids", ["dictionary", "delta"])
def test_layout_of_files(spark, ids):
    path = place(spark)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").union(spark.read.parquet(f"{SF01}/documents.parquet"))
    token_files.write_tokens(docs.coalesce(1), path, VOCABULARY, ids=ids, row_group=1 << 20, page=64 << 10, page_rows=100)
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/tokens/part-*.parquet")]
    assert sum(m.num_row_groups for m in files) > 1
    for m in files:
        for g in range(m.num_row_groups):
            columns = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c) for c in range(m.num_columns)}
            assert all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and not columns["doc_id"].has_dictionary_page
            tokens = columns["ids.list.element"]
            assert tokens.has_dictionary_page == (ids == "dictionary")
            assert ids == "dictionary" or "DELTA_BINARY_PACKED" in tokens.encodings


def test_metadata_reads_touch_no_tokens(spark):
    path = place(spark)
    token_files.write_tokens(spark.read.parquet(f"{SF001}/documents.parquet"), path, VOCABULARY, meta=("lang",))
    rows = token_files.read_tokens(spark, path).where("doc_id = 17").select("doc_id", "start", "meta.lang")
    plan = rows._jdf.queryExecution().explainString(rows._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line and "doc_id" in line)
    assert "ids" not in schema and "lang" in schema
    assert "EqualTo(doc_id,17)" in plan


def test_window_of_the_stream(spark, whole):
    path = place(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(spark.read.parquet(f"{SF001}/documents.parquet"), path, VOCABULARY)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect())
    stream = [i for _, text in docs for i in whole(text) + [0]]
    for lo, hi in [(0, 10), (1000, 9000), (len(stream) - 5, len(stream) + 100), (3, 3), (len(stream), len(stream) + 9)]:
        got = token_files.read_window(spark, path, lo, hi).orderBy("start").collect()
        assert [i for r in got for i in r["ids"]] == stream[lo:hi]
        assert [r["start"] for r in got][:1] == [lo][:len(got)]
