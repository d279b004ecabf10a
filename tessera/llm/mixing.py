"""Mix sources to target weights: token totals of each source, targets by weight under a
cap of repetition, then each document floor(rate) times plus one copy with probability
equal to the fraction, drawn from a hash of its id and the seed.

Everything is a partial aggregation on the source and a join back; the targets are found by
rounds of small aggregations over one row for each source, so their number is not bounded by
the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, join_by_key, written
from tessera.llm.sharding import row_numbers

#: Weights in the order of the sources' names, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: str):
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(key, seed: int):
    """A number in [0, 1) from the MD5 of the key's text and the seed."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def source_targets(sizes: DataFrame, source: str, share: float, most: float) -> DataFrame:
    """One row for each source: __key, __rows, source_size, __weight, target.

    Sources are weighed in the order of their names by code point, null last. They share
    ``share`` times all sizes by weight; a target above ``most`` times its source's size stops
    there and the excess is shared anew among the others, until none is above."""
    name = F.col(f"`{source}`")
    totals = sizes.groupBy(name.alias("__source")).agg(
        F.count("*").alias("__rows"), F.sum("__size").cast("long").alias("source_size"))
    totals = totals.withColumn("__last", F.col("__source").isNull())
    numbered, _ = row_numbers(totals, ["__last", "__source"], "__number")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                          (F.pmod("__number", F.lit(len(WEIGHTS))) + 1).cast("int"))
    table = written(numbered.withColumn("__weight", weight), "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = None, -1
    while True:  # each round caps at least one more source, or ends
        free = F.lit(True) if level is None else F.col("__weight") * F.lit(level) < cap
        left, weights, now = table.agg(
            F.lit(total) - F.sum(F.when(~free, cap).otherwise(0.0)), F.sum(F.when(free, F.col("__weight")).otherwise(0.0)),
            F.sum(F.when(free, 0).otherwise(1))).first()
        if not weights or now == capped:
            break
        level, capped = left / weights, now
    target = cap if level is None else F.least(cap, F.col("__weight") * F.lit(level))
    return table.select(F.concat_ws("", F.when(F.col("__last"), "n").otherwise("s"), F.col("__source")).alias("__key"),
                        "__rows", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", size: str | None = None,
        share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """Append size (words, or the column ``size`` where they are counted already), source_size,
    target and copies (how often the mix takes the document: floor(rate), or one more with the
    fraction's probability; rate = target / source_size).

    Null and empty texts have size 0; the null source is a source of its own, ranked last; rows
    that repeat an id draw the same number; a source without words gets rate 0; an empty table
    stays empty; columns of the results' names are replaced. Reruns agree."""
    if most < share:
        raise ValueError("the cap must be at least the share, or the targets cannot add up")
    name = F.col(f"`{source}`")
    sized = docs.withColumns({"__size": F.col(f"`{size}`").cast("long") if size else word_count(text),
                              "__key": F.concat_ws("", F.when(name.isNull(), "n").otherwise("s"), name)})
    rates = source_targets(sized.select(f"`{source}`", "__size"), source, share, most)
    joined = join_by_key(sized.drop("size", "source_size", "target", "copies"), rates, "__key", "__rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (unit_draw(F.col(f"`{key}`"), seed) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("copies", (F.floor(rate) + extra).cast("int")) \
        .withColumnRenamed("__size", "size").drop("__key")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as often as ``copies`` says, columns ``columns``."""
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*columns)
