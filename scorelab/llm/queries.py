"""One registered query for each operator of this package, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm import bpe, chat, conv_trie, embed_dedup, hard_negatives, line_crf, mixing, ngram_join, oracles, quality_rules, suffix_dedup, token_files, toxicity, warc
from scorelab.session import scratch_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def digest_chat(conversations: DataFrame) -> DataFrame:
    """Conversations formatted, and digests of what reading the output back gives."""
    made = chat.format_trees(chat.from_turns(conversations))
    back = made.select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(F.when(F.col("tree") != "null", F.col("tree")).cast("bigint").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
                       F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
                       F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op4_chat", oracles.CHAT)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return digest_chat(given.unionByName(extra))


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


@query("op1_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.allocate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                      F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_copies")).cast("bigint").alias("taken"),
                      F.array_sort(F.transform("mix_copies", lambda c: c["shard"])).alias("shards"))


@query("op2_ngram_join", oracles.NGRAM_JOIN)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents"))


@query("op9_embed_dedup", oracles.EMBED_DEDUP)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.vector_components(table(spark, sf_dir, "embeddings"))


@query("op7_warc", oracles.WARC)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records, broken = warc.read_archives(spark, path)
    for r in broken.limit(1).collect():
        raise ValueError(f"{r['path']} at {r['at']}: {r['reason']}")
    digest = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not have its digest")))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


@query("op10_line_crf")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.score(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read_tokens(spark, path))


@query("op11_hard_negatives", oracles.HARD_NEGATIVES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(rows, vec_id % 100 == 0)


@query("op13_conv_trie", oracles.CONV_TRIE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_trie.prefix_trie(table(spark, sf_dir, "conversations"), lambda c: c - c % 100,
                                 lambda c: F.crc32(c.cast("string").cast("binary")) % 6, most_head=5)
