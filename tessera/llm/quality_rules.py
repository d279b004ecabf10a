"""Quality rules: n-gram perplexity under a modified Kneser-Ney model of the corpus, with
upper and lower bands for each language, after counts of words, symbols and repeats.

The n-grams (four true characters, see :mod:`tessera.llm.ngrams`) are counted by Spark over all
documents; their hashes and logarithms lie in sorted arrays, as far as they are bounded, and the
others are joined by hash and summed for each document. Bands are the median plus and minus a
multiple of the median deviation of a language's documents, from a histogram that Spark adds up
over all of them. :class:`Model` and :func:`fit` are the same arithmetic in arrays for the coarse
symbols of :mod:`tessera.llm.symbols`; no query scores by them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import ngrams
from tessera.llm.common import join_by_key, with_arrays, with_fields, written
from tessera.llm.symbols import BITS, ORDER, SIZE, count_keys, kept_table, text_blocks

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: Steps of the histogram of log perplexities.
STEP = 0.001

MEASURES = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] \
    + [T.StructField("base_failed", T.BooleanType())]


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more (index 0 is no count)."""
    n = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    out = np.array([0.0, 0.5, 0.5, 0.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] and n[k]:
                out[k] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k - 0.01)
    return out


class Model:
    """Sorted arrays for each order, lowest first: n-gram keys, their discounted
    probabilities, context keys, the contexts' weights of the lower order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        keys, counts = keys[order].astype(np.int64), counts[order].astype(np.float64)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(ORDER, 0, -1):
            d = discounts(counts)[np.minimum(counts, 3).astype(int)]
            context, first = np.unique(keys >> BITS, return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else counts[:0]
            rest = np.add.reduceat(d, first) if len(first) else d[:0]
            group = np.searchsorted(context, keys >> BITS)
            self.orders.insert(0, (keys.astype(np.int32), ((counts - d) / totals[group]).astype(np.float32),
                                   context.astype(np.int32), (rest / totals).astype(np.float32)))
            keys, kinds = np.unique(keys & (SIZE ** (n - 1) - 1), return_counts=True)  # distinct left neighbours
            counts = kinds.astype(np.float64)
        self.name = uuid.uuid4().hex

    def table(self) -> np.ndarray:
        """Natural logarithm of the probability of each key's last symbol after the others."""
        return kept_table(self.name, self.logarithms)

    def logarithms(self) -> np.ndarray:
        p = np.full(1, 1.0 / SIZE, np.float32)
        for n, (keys, alpha, context, weight) in enumerate(self.orders, 1):
            # a context's lower order is that of its last n-2 symbols; unseen contexts keep weight 1
            wide = np.tile(p.reshape(-1, SIZE) if n > 1 else np.full((1, SIZE), p[0], np.float32), (SIZE if n > 1 else 1, 1))
            for at in range(0, len(context), 1 << 14):
                wide[context[at:at + (1 << 14)]] *= weight[at:at + (1 << 14), None]
            p = wide.reshape(-1)
            p[keys] += alpha
        return np.log(p, out=p)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of all texts. An empty corpus gives the uniform model."""
    counted = count_keys(docs, text).toArrow()  # at most 2^24 rows, by the key space
    return Model(counted["key"].to_numpy().astype(np.int64), counted["n"].to_numpy())


def repeats(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    size = len(known)
    pairs = ids[:-1] * size + ids[1:]
    if size > 1_000_000:  # keeps the product below 2^63
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k:n - 2 + k] |= again
    return int(inside.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = repeats(words)
    return (n, len(text) - (len(raw) - len(raw.translate(None, BLANKS))), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), again, n < 50 or 100 * again > 50 * n)


def measure(docs: DataFrame, shared, text: str = "text") -> DataFrame:
    """Append the counts of :func:`base_counts`, a row number and the sums of logarithms
    (``ngrams.LOGS``) under the broadcast n-grams ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, text):
            columns = list(zip(*map(base_counts, texts)))
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.bool_())]
            yield with_arrays(batch, dict(zip([f.name for f in MEASURES], arrays)) | ngrams.logs_of(texts, shared.value))

    docs = docs.withColumn("__row", F.monotonically_increasing_id())
    return docs.mapInArrow(run, with_fields(docs.schema, MEASURES + ngrams.LOGS))


def bands(measured: DataFrame, key: str, width: float, least: float) -> DataFrame:
    """One row for each language: key, __rows, lower, upper.

    The band is the median log perplexity of the language's documents that pass the counts,
    plus and minus ``width`` times their median absolute deviation, ``least`` at least; a
    language without such a document has no band (null)."""
    fit_for = (~F.col("base_failed")) & F.col("log_perplexity").isNotNull()
    bins = measured.groupBy(key, F.when(fit_for, F.round(F.col("log_perplexity") / STEP).cast("long")).alias("bin")) \
        .agg(F.count("*").alias("rows"))
    rows = bins.groupBy(key).agg(F.sum("rows").alias("__rows"))

    def median(of: DataFrame, value: str, out: str) -> DataFrame:
        grouped = of.groupBy(key, value).agg(F.sum("rows").alias("rows"))
        upto = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        total = F.sum("rows").over(Window.partitionBy(key))
        return grouped.select(key, value, (2 * F.sum("rows").over(upto) >= total).alias("half")) \
            .filter("half").groupBy(key).agg(F.min(value).alias(out))

    used = bins.filter(F.col("bin").isNotNull())
    middle = median(used, "bin", "middle")
    spread = median(used.join(middle, key).withColumn("off", F.abs(F.col("bin") - F.col("middle"))), "off", "spread")
    half = F.greatest(F.lit(float(least)), F.lit(float(width)) * F.col("spread") * STEP)
    return rows.join(middle, key, "left").join(spread, key, "left").select(
        key, "__rows", (F.col("middle") * STEP - half).alias("lower"), (F.col("middle") * STEP + half).alias("upper"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", width: float = 9.0, least: float = 0.1,
          keep_text: bool = True) -> DataFrame:
    """Append the counts, log_perplexity and kept: false where the counts fail (fewer than 50
    words, or more than half of the words in repeated windows of three) or the perplexity lies
    outside the band of the document's language.

    Null and empty texts fail; the null language is a language of its own; ties and repeated
    rows are judged alike; an empty table stays empty; columns named like a result are
    replaced. Without ``keep_text`` the texts are left out of the result and not written."""
    names = [f.name for f in MEASURES] + ["log_perplexity", "kept"]
    name = F.col(f"`{lang}`")
    docs = docs.drop(*names).withColumn("__lang", F.concat_ws("", F.when(name.isNull(), "n").otherwise("l"), name))
    counted = written(ngrams.count_grams(docs, text), "quality-grams")
    few, rest = ngrams.placed(ngrams.model(counted, counted))
    measured = measure(docs, docs.sparkSession.sparkContext.broadcast(few), text)
    measured = ngrams.with_perplexity(written(measured if keep_text else measured.drop(text), "quality-measures"), rest)
    limits = written(bands(measured, "__lang", width, least), "quality-bands")
    judged = join_by_key(measured, limits, "__lang", "__rows")  # no text is shuffled but of rare languages
    verdict = ~F.col("base_failed") & F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return judged.withColumn("kept", F.coalesce(verdict, F.lit(False))).drop("__lang", "lower", "upper")
