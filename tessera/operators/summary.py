"""Numeric summaries over many columns at once (one aggregation pass each), with
optional group keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.operators.quantiles import _as_exprs, _bucketed_counts, _quantiles_from_counts, quantiles, value_counts
from tessera.session import pinned

DECILES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
# Shape thresholds (fixed values) and result codes.
SKEW_CUT = 0.5
SKEW_RIGHT = "right"
SKEW_LEFT = "left"
SKEW_NONE = "none"
KURT_HEAVY = "heavy"
KURT_LIGHT = "light"
KURT_NORMAL = "normal"


def _wide_to_long(df: DataFrame, columns: Sequence[str], by: Sequence[str],
                  measures: dict[str, callable]) -> DataFrame:
    """One aggregation computing ``measures[name](col)`` for every column, returned
    in long form ``(by..., variable, measure columns...)``."""
    aggs = []
    for i, c in enumerate(columns):
        x = col(c).cast("double")
        for m, fn in measures.items():
            aggs.append(fn(x).alias(f"{m}__{i}"))
    one = df.groupBy(*map(col, by)).agg(*aggs)
    items = [F.struct(F.lit(c).alias("variable"), *[F.col(f"{m}__{i}").alias(m) for m in measures])
             for i, c in enumerate(columns)]
    return one.select(*map(col, by), F.inline(F.array(*items)))


def central_tendency(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., variable, mean, median, mode)`` over non-null values; the mode is
    the smallest of the most frequent values.

    Median and mode both come from one table of distinct-value counts, made once."""
    by = list(by)
    means = _wide_to_long(df, columns, by, {"mean": F.avg})
    exprs = _as_exprs(df, columns)
    vc = pinned(_bucketed_counts(df, exprs, by, value_counts(df, exprs)), "value-counts")
    keys = by + ["variable"]
    med = _quantiles_from_counts(vc, by, [0.5]).select(*map(col, keys), F.col("value").alias("median"))
    w = Window.partitionBy(*map(col, keys)).orderBy(F.desc("cnt"), F.asc("value"))
    mo = vc.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*map(col, keys), F.col("value").alias("mode"))
    return means.join(med, keys, "left").join(mo, keys, "left").select(*map(col, keys), "mean", "median", "mode")


def dispersion(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., variable, range, variance, std, cv_percent)`` with ddof 1; the
    coefficient of variation is NULL when the mean is 0."""
    out = _wide_to_long(df, columns, by, {
        "_max": F.max, "_min": F.min, "variance": F.var_samp, "std": F.stddev_samp, "_mean": F.avg})
    cv = F.when(F.col("_mean") != 0, F.col("std") / F.col("_mean") * 100)
    return out.select(*map(col, by), "variable", (F.col("_max") - F.col("_min")).alias("range"), "variance", "std",
                      cv.alias("cv_percent"))


def position(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), decimals: int = 2) -> DataFrame:
    """``(by..., variable, q1, q2, q3, deciles)`` - deciles 10..90 % as an array
    rounded to ``decimals``."""
    by = list(by)
    probs = [0.25, 0.5, 0.75] + DECILES
    q = quantiles(df, columns, probs, by=by)
    g = q.groupBy(*map(col, by), "variable").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("q2"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
        F.array_sort(F.collect_list(F.when(F.col("prob").isin(DECILES),
                                           F.struct("prob", F.round("value", decimals).alias("v"))))).alias("_d"))
    return g.select(*map(col, by), "variable", "q1", "q2", "q3", F.transform("_d", lambda s: s["v"]).alias("deciles"))


def shape(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., variable, skewness, kurtosis)``: biased skewness m3/m2^1.5 and
    biased excess kurtosis m4/m2^2 - 3 (NULL for zero variance)."""
    return _wide_to_long(df, columns, by, {"skewness": F.skewness, "kurtosis": F.kurtosis})


def interpret_shape(skewness: Column, kurtosis: Column) -> tuple[Column, Column]:
    skew = (F.when(skewness > SKEW_CUT, F.lit(SKEW_RIGHT)).when(skewness < -SKEW_CUT, F.lit(SKEW_LEFT))
             .otherwise(F.lit(SKEW_NONE)))
    kurt = (F.when(kurtosis > 0, F.lit(KURT_HEAVY)).when(kurtosis < 0, F.lit(KURT_LIGHT))
             .otherwise(F.lit(KURT_NORMAL)))
    return skew, kurt


def shape_interpretation(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    s = shape(df, columns, by)
    sk, ku = interpret_shape(F.col("skewness"), F.col("kurtosis"))
    return s.select(*map(col, by), "variable", sk.alias("skew_label"), ku.alias("tail_label"))


def grouped_summary(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Mean and sample std of each predictor per group: ``(target, variable, mean, std)``."""
    return _wide_to_long(df, columns, [target], {"mean": F.avg, "std": F.stddev_samp})
