"""N-grams of true characters and their probabilities under an interpolated modified Kneser-Ney
model.

An n-gram is ``ORDER`` code points as they are; its key is a 64-bit hash of them. Counts, contexts
and continuation counts are DataFrames over all documents, and the probability of every distinct
n-gram of the corpus comes from windows and joins of them, order by order. The documents' n-grams
then meet the probabilities by hash: the ``PLACED`` most frequent n-grams at most are broadcast as
sorted arrays of hashes and met where the texts lie; a document's others go out as rows (document,
hash, times), are joined with the rest of the model and summed for each document. So no text is
shuffled and nothing broadcast grows with the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import written
from tessera.llm.symbols import text_blocks

ORDER = 4
#: U+0000 stands before every text; in a text it counts as such an edge too.
EDGE = "\0" * (ORDER - 1)
MULTIPLIERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, ORDER + 1)]
#: Most n-grams of a model that are broadcast (12 bytes each), and that a task counts before it hands them on.
PLACED, HELD = 1 << 22, 1 << 20

LOGS = [T.StructField("__logs", T.DoubleType()), T.StructField("__chars", T.LongType()),
        T.StructField("__rare", T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("times", T.LongType())])))]


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash of the n-gram that ends in each character of the texts, one for each character
    (each text begins after an edge), the n-grams' places in the code points, the code points, and
    the bounds of the texts in the hashes."""
    code = np.frombuffer((EDGE + EDGE.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(code) - ORDER + 1
    keys = np.zeros(n, np.uint64)
    for k, odd in enumerate(MULTIPLIERS):
        keys += code[k:k + n] * np.uint64(odd)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    inside = np.ones(n, bool)
    for k in range(1, ORDER):
        inside[starts[1:] - k] = False
    at = np.flatnonzero(inside)
    return keys[at].view(np.int64), at, code, np.concatenate([[0], np.cumsum(sizes)])


def added(keys: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their times (1 each if None) and a place of each."""
    which, distinct = pd.factorize(keys)
    place = np.empty(len(distinct), np.int64)
    place[which] = np.arange(len(keys))
    return distinct, np.bincount(which, times, len(distinct)).astype(np.int64), place


def count_grams(df: DataFrame, text: str = "text") -> DataFrame:
    """key long, gram string, n long: how often each n-gram occurs in all texts. Each task adds up
    its own counts before the shuffle."""
    def rows(keys: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            run = grams[part].tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array([run[k:k + ORDER] for k in range(0, len(run), ORDER)], pa.string()),
                                              pa.array(n[part])], names=["key", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64), np.zeros((0, ORDER), "<u4"), np.zeros(0, np.int64)
        held, grams, n = nothing
        for _, texts in text_blocks(batches, text):
            keys, at, code, _ = keys_of(texts)
            keys, times, place = added(keys, None)
            found = code[at[place][:, None] + np.arange(ORDER)]
            held, n, place = added(np.r_[held, keys], np.r_[n, times])
            grams = np.concatenate([grams, found])[place]
            if len(held) > HELD:
                yield from rows(held, grams, n)
                held, grams, n = nothing
        yield from rows(held, grams, n)

    return df.select(F.col(f"`{text}`").alias(text)).mapInArrow(run, "key long, gram string, n long") \
        .groupBy("key", "gram").agg(F.sum("n").alias("n"))


def discount(counts: DataFrame) -> Column:
    """Modified Kneser-Ney discount of column n, from the counts of counts of the table."""
    n = counts.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    d = [0.5, 0.5, 0.5]
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] and n[k]:
                d[k - 1] = min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k - 0.01)
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def kneser_ney(learned: DataFrame, seen: DataFrame, order: int, head: Callable[[Column, int], Column],
               tail: Callable[[Column, int], Column], base: float | None = None) -> DataFrame:
    """gram, p: natural logarithm of the interpolated probability of each n-gram of ``seen`` (gram)
    under the counts ``learned`` (gram, n). ``head`` and ``tail`` give the first and the last m - 1
    symbols of a column of m symbols. Symbols that were never learned share ``base`` each (by default
    one part in the number of symbols)."""
    table = seen.select("gram", F.lit(0).cast("long").alias("n")).unionByName(learned.select("gram", "n")) \
        .groupBy("gram").agg(F.sum("n").alias("n"))
    tables = []
    for m in range(order, 0, -1):
        table = written(table, "ngram-counts")
        tables.insert(0, (m, table.withColumn("d", F.when(F.col("n") > 0, discount(table)).otherwise(0.0))))
        table = table.groupBy(tail(F.col("gram"), m).alias("gram")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n"))
    low, p = F.lit(base or 1.0 / max(tables[0][1].count(), 1)), None
    for m, counts in tables:
        same = Window.partitionBy(head(F.col("gram"), m))  # at most as many rows as there are symbols
        of = counts.select("gram", "n", "d", F.sum("n").over(same).alias("total"), F.sum("d").over(same).alias("rest"))
        if p is not None:
            of, low = of.withColumn("tail", tail(F.col("gram"), m)).join(p.toDF("tail", "low"), "tail"), F.col("low")
        own = (F.col("n") - F.col("d")) / F.col("total") + F.col("rest") / F.col("total") * low
        p = of.select("gram", F.when(F.col("total") > 0, own).otherwise(low).alias("p"))
    return p.select("gram", F.log("p").alias("p"))


def model(learned: DataFrame, seen: DataFrame) -> DataFrame:
    """key, n, p of every n-gram of ``seen`` (key, gram, n): its hash, its count there and the
    logarithm of its probability under the counts ``learned``."""
    p = kneser_ney(learned, seen, ORDER, lambda c, m: F.substring(c, 1, m - 1), lambda c, m: F.substring(c, 2, m - 1))
    return written(seen.join(p, "gram").select("key", "n", F.col("p").cast("float").alias("p")), "ngram-model")


def placed(model: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None]:
    """The model's most frequent n-grams as sorted hashes with their logarithms, and the rest of
    the model (None: all have their place). N-grams of about the same count go together."""
    step = F.floor(F.log2("n") * 8)
    least, taken, rest = 1 << 20, 0, None
    for at, rows in sorted(model.groupBy(step.alias("step")).agg(F.count("*")).collect(), reverse=True):
        if taken + rows > PLACED:
            rest = model.filter(step < least).select("key", "p")
            break
        least, taken = at, taken + rows
    few = model.filter(step >= least).select("key", "p").toArrow()
    keys, logs = few["key"].to_numpy(), few["p"].to_numpy()
    order = np.argsort(keys)
    return (keys[order], logs[order]), rest


def logs_of(texts: list[str], few: tuple[np.ndarray, np.ndarray]) -> dict[str, pa.Array]:
    """The columns ``LOGS`` of texts: the sum of the logarithms of their n-grams that are among
    ``few``, their characters, and the others of their n-grams with their times."""
    keys, _, _, bounds = keys_of(texts)
    which, distinct = pd.factorize(keys)
    at = np.searchsorted(few[0], distinct)
    at[at == len(few[0])] = 0
    known = few[0][at] == distinct if len(few[0]) else np.zeros(len(distinct), bool)
    logs = np.zeros(len(distinct))
    logs[known] = few[1][at[known]]
    sums = np.concatenate([[0.0], np.cumsum(logs[which])])
    chars = np.diff(bounds)
    rare = np.flatnonzero(~known[which])
    text = np.searchsorted(bounds, rare, "right") - 1
    order = np.lexsort((keys[rare], text))
    text, key = text[order], keys[rare][order]
    new = np.flatnonzero(np.r_[np.ones(min(len(key), 1), bool), (text[1:] != text[:-1]) | (key[1:] != key[:-1])])
    pairs = pa.StructArray.from_arrays([pa.array(key[new]), pa.array(np.diff(np.r_[new, len(key)]))], names=["key", "times"])
    lists = np.searchsorted(text[new], np.arange(len(texts) + 1)).astype(np.int32)
    return dict(zip([f.name for f in LOGS], [pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(chars),
                                             pa.ListArray.from_arrays(pa.array(lists), pairs)]))


def with_perplexity(scored: DataFrame, rest: DataFrame | None) -> DataFrame:
    """log_perplexity (for each character; null for an empty text) in place of the columns ``LOGS``
    and ``__row`` of ``scored``, a written table whose rows have numbers of their own in ``__row``."""
    logs = F.col("__logs")
    if rest is not None:
        rows = scored.select("__row", F.explode("__rare").alias("of")).select("__row", "of.*")
        sums = written(rows.join(rest, "key").groupBy("__row").agg(F.sum(F.col("times") * F.col("p")).alias("__more")), "ngram-rest")
        scored, logs = scored.join(sums, "__row", "left"), logs + F.coalesce("__more", F.lit(0.0))
    return scored.withColumn("log_perplexity", F.when(F.col("__chars") > 0, -logs / F.col("__chars"))) \
        .drop("__row", "__more", *[f.name for f in LOGS])
