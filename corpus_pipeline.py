"""A corpus from raw documents: language, copies, near copies, mix, tokens.

Results for odd input, of all stages: an empty table stays empty, with its columns; columns other than doc_id, text, lang and
source pass as they are, whatever their names, but that the last stage replaces token_ids, n_tokens and decodes (names
that begin with __tw_ are the stages' own). A null or empty text has no language and is rejected first. Rows that repeat a doc_id
are documents of their own for the language and the mix; of those with equal texts too one stays; those with different texts
count as linked for near copies. Of ties the smallest doc_id stays. A very long text is one text like all others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, exact_dedup, language_id, ngram_join, source_mix
from tidewatch.llm.shared import written

#: A text that is this far from every learned language is rejected, as one without letters is.
LEAST_SCORE = 0.1
VOCABULARY = "byte_bpe_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, by profiles of all labelled documents."""
    found = language_id.predict(docs, language_id.profiles(docs), lang_col="__tw_lang", score_col="__tw_score")
    return found.where((F.col("__tw_lang") != language_id.UNKNOWN) & (F.col("__tw_score") >= LEAST_SCORE)).drop("__tw_lang", "__tw_score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id."""
    return ngram_join.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mix.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token_ids, n_tokens, and whether the ids decode to the text."""
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    both = byte_bpe.encode_and_decode(docs, path, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.withColumn("n_tokens", F.size("token_ids").cast("long")).withColumn("decodes", same).drop("decoded")


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("source_mix", mix), ("byte_bpe", tokens)]
#: Language profiles, the cube method and the tokenizer can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
