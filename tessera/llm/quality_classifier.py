"""Quality classifier: an interpolated modified Kneser-Ney n-gram model trained on trusted
text gives each document's perplexity; quantiles of each language set the threshold.

The n-grams are four true characters (:mod:`tessera.llm.ngrams`). Counts, contexts and
continuation counts are DataFrames sharded by n-gram. The probability of every distinct n-gram of
the corpus comes from windows and joins of those shards, order by order; unseen n-grams fall back
through the context weights. The documents' n-grams meet the probabilities by hash and are summed
for each document, so no text is shuffled for it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import ngrams
from tessera.llm.common import join_by_key, sieve, with_arrays, with_fields, written
from tessera.llm.symbols import BITS, ORDER, SIZE, text_blocks

STEP = 0.001


def log_probabilities(trusted: DataFrame, keys: DataFrame) -> DataFrame:
    """key, p: natural logarithm of the interpolated probability of each of ``keys`` (distinct
    coarse keys of :mod:`tessera.llm.symbols`) under the counts ``trusted`` (key, n), by the joins
    that the n-grams of true characters go through."""
    return ngrams.kneser_ney(trusted.select(F.col("key").alias("gram"), "n"), keys.select(F.col("key").alias("gram")), ORDER,
                             lambda c, m: F.shiftright(c, BITS), lambda c, m: c.bitwiseAND(F.lit(SIZE ** (m - 1) - 1)), 1.0 / SIZE) \
        .withColumnRenamed("gram", "key")


def trusted_ids(labels: DataFrame, key: str, flag: str) -> DataFrame:
    """Ids of all trusted documents."""
    return labels.filter(F.col(flag) == 1).select(key).filter(F.col(key).isNotNull()).distinct()


def perplexities(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", flag: str = "quality") -> DataFrame:
    """``docs`` without its text, with trusted (boolean) and log_perplexity (per character; null for
    an empty text). The ids grow with the labels. Of the texts only those of trusted documents are
    shuffled, by the same plan at every size: a sieve in front, then an exact join by shuffle."""
    ids = written(trusted_ids(labels, key, flag), "classifier-trusted")
    likely = sieve(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias(text)), ids, [key])
    learned = written(ngrams.count_grams(likely.join(ids.hint("merge"), key, "left_semi"), text), "classifier-counts")
    seen = written(ngrams.count_grams(docs, text), "classifier-grams")
    few, rest = ngrams.placed(ngrams.model(learned, seen))
    shared = docs.sparkSession.sparkContext.broadcast(few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, text):
            yield with_arrays(batch, ngrams.logs_of(texts, shared.value))

    docs = docs.drop("trusted", "log_perplexity").withColumn("__row", F.monotonically_increasing_id())
    scored = docs.mapInArrow(run, with_fields(docs.schema, ngrams.LOGS)).drop(text)
    scored = ngrams.with_perplexity(written(scored, "classifier-logs"), rest)
    return scored.join(ids.withColumn("trusted", F.lit(True)).hint("merge"), key, "left") \
        .select(*[scored[f"`{c}`"] for c in scored.columns if c != "log_perplexity"], F.coalesce("trusted", F.lit(False)).alias("trusted"), "log_perplexity")


def quantiles(scored: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """One row for each value of ``key``: the quantiles of log_perplexity named in ``shares``,
    from a histogram of steps of 0.001 (the first step that reaches the share)."""
    bins = scored.groupBy(key, F.round(F.col("log_perplexity") / STEP).cast("long").alias("bin")).agg(F.count("*").alias("rows"))
    upto = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = bins.select(key, "bin", F.sum("rows").over(upto).alias("upto"), F.sum("rows").over(Window.partitionBy(key)).alias("all"))
    return run.groupBy(key).agg(*[(F.min(F.when(F.col("upto") >= s * F.col("all"), F.col("bin"))) * STEP).alias(n)
                                  for n, s in shares.items()])


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
             flag: str = "quality", reach: float = 5.0) -> DataFrame:
    """``docs`` without its text, with log_perplexity, lower and upper limit and kept.

    The limits of a language are its trusted documents' median plus or minus ``reach`` times
    the distance to their quantiles 0.9 and 0.1; a language without trusted documents takes
    those of all trusted documents. Null and empty texts are not kept; the null language is a
    language of its own; repeated rows are judged alike; an empty table stays empty; without
    trusted documents nothing is known and all documents with text are kept; columns named like
    a result are replaced."""
    results = ["trusted", "log_perplexity", "lower", "upper", "kept"]
    name = F.col(f"`{lang}`")
    docs = docs.drop(*results).withColumn("__lang", F.concat_ws("", F.when(name.isNull(), "n").otherwise("l"), name))
    scored = written(perplexities(docs, labels, text, key, flag), "classifier-scores")
    known = scored.filter(F.col("trusted") & F.col("log_perplexity").isNotNull()).select("__lang", "log_perplexity")
    shares = {"low": 0.1, "middle": 0.5, "high": 0.9}
    own = quantiles(known, "__lang", shares)
    whole = quantiles(known.withColumn("__lang", F.lit("all")), "__lang", shares).first()
    rows = scored.groupBy("__lang").agg(F.count("*").alias("__rows"))
    limits = written(rows.join(own, "__lang", "left"), "classifier-limits")
    if whole:
        limits = limits.withColumns({c: F.coalesce(c, F.lit(whole[c])) for c in shares})
    judged = join_by_key(scored, limits, "__lang", "__rows")
    lower = F.col("middle") - reach * (F.col("middle") - F.col("low"))
    upper = F.col("middle") + reach * (F.col("high") - F.col("middle"))
    inside = F.coalesce(F.col("log_perplexity").between(lower, upper), F.lit(whole is None))
    return judged.withColumns({"lower": lower, "upper": upper, "kept": F.col("log_perplexity").isNotNull() & inside}) \
        .drop("__lang", "low", "middle", "high")
