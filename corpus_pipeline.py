"""The corpus pipeline: documents -> training tokens, in five stages.

``run`` applies ``STAGES`` to ``documents``; each stage's result is written as Parquet in
the shared checkpoint folder and read again as the next one's input. All but the last
return the columns of ``documents`` (doc_id, text, lang, source, n_chars; others that
the table has stay as they are). Part of the ``scorelab.llm`` subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scorelab.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from scorelab.llm.store import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    It is fitted on ``labels`` of ``docs`` outside the held-out fold. Rows stay or go by
    their own text, so ties, repeated rows and null ids need nothing; null texts stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Texts without a word have no copies and stay. Of rows that share the smallest id and
    the class (repeated rows), the one with the smallest text stays. A group in which no
    row has an id keeps its smallest text."""
    return ngram_join.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages (200 bytes or more); ``n_chars`` follows. No
    document goes: one that was nothing but repeats stays with an empty text."""
    return suffix_dedup.cut_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources (weights 3, 1, 2 in turn, 150% of all words): a row for each copy taken."""
    return mixing.mix(docs, with_place=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every text: doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages are not expressible in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
