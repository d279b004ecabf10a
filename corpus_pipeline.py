"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. ``run`` applies them to the table ``documents``.
``ORACLE_SQL`` is None: perplexity bands, fingerprints and byte-pair encoding are not SQL; the
pipeline is tested against a brute-force version of its stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, quality_rules, simhash, suffix_dedup
from tessera.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have too few words and go; a null
    language is one of its own; repeated rows are judged alike and stay; an empty table stays empty."""
    return quality_rules.judge(docs).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Rows are told apart
    by id and text: of equal rows one stays, rows that share an id and have other texts are judged each
    for itself; a null id comes after all others; null and empty texts are one group."""
    return simhash.keep_one(docs, words=3, distance=3).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that start elsewhere too; a
    character that is cut in two goes whole. n_chars is the length of what is left. Null and short texts
    stay as they are; a text that repeats elsewhere as a whole is left empty."""
    cut = suffix_dedup.remove_repeats(docs, as_text=True)
    less = F.col("n_removed") > 0
    return cut.withColumns({"text": F.when(less, F.col("kept")).otherwise(F.col("text")),
                            "n_chars": F.when(less, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, one or more equal rows. Null sources are
    one source, null texts have no words."""
    return mixing.repeated(mixing.mix(docs), COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens: doc_id, source, n_tokens, ids_sha256, decoded_sha256. Null and empty texts
    have none; repeated rows give equal results."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.digests(docs.select("doc_id", "source", "text"), path)
    return coded.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("mixing sources", mixture), ("BPE tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
