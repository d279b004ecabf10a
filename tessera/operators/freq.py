"""Frequency tables and the data behind charts (histogram, polygon, ogive, box,
bar, scatter). Counting is a distributed group-by; the result tables are tiny
(at most ``top_n + 1`` categories or ``bins`` intervals)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import all_not_null, col, numeric_columns
from tessera.session import pinned
from tessera.operators.quantiles import quantile_map

OTHER_LABEL = "Other"          # fixed: label of the long-tail row
STURGES = 3.322                # fixed: bins = int(1 + 3.322 * log10(n))
EDGE_ADJUST = 0.001            # fixed: first edge lowered by 0.1 % of the range


def category_frequencies(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """Non-null counts, most frequent first (ties by value); categories past
    ``top_n`` are summed into one ``Other`` row placed last.
    -> ``(position, category, frequency, relative_frequency, cumulative_frequency)``

    Counting is a distributed group-by; the top ``top_n`` is a distributed top-k;
    the grand total is one scalar aggregate. The result has at most top_n + 1 rows."""
    vc = (df.where(col(column).isNotNull())
            .groupBy(col(column).cast("string").alias("category"))
            .agg(F.count(F.lit(1)).alias("frequency")))
    vc = pinned(vc, "category-counts")  # counted once for the totals and the top
    st = vc.agg(F.sum("frequency").alias("total"), F.count(F.lit(1)).alias("levels")).first()
    total, levels = int(st["total"] or 0), int(st["levels"] or 0)
    top = vc.orderBy(F.desc("frequency"), F.asc("category")).limit(top_n)  # TakeOrderedAndProject
    w = Window.orderBy(F.desc("frequency"), F.asc("category"))  # over <= top_n rows
    table = top.withColumn("position", F.row_number().over(w))
    if levels > top_n:
        other = table.agg((F.lit(total) - F.sum("frequency")).alias("frequency")).select(
            F.lit(OTHER_LABEL).alias("category"), "frequency", F.lit(top_n + 1).alias("position"))
        table = table.unionByName(other)
    wc = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)  # <= top_n + 1 rows
    return table.select("position", "category", "frequency",
                        (F.col("frequency") / F.lit(total)).alias("relative_frequency"),
                        F.sum("frequency").over(wc).alias("cumulative_frequency"))


def bar_data(freq_table: DataFrame) -> DataFrame:
    return freq_table.select("position", "category", "frequency")


def _round_frac(x: float, precision: int) -> float:
    """Round for display: ``precision`` decimals, or ``precision`` significant
    digits of the fraction when the value is below 1 in magnitude."""
    if not math.isfinite(x) or x == 0 or x == int(x):
        return x
    whole = math.trunc(x)
    digits = precision if whole != 0 else -int(math.floor(math.log10(abs(x - whole)))) - 1 + precision
    return round(x, digits)


def bin_edges(mn: float, mx: float, bins: int) -> list[float]:
    """Equal-width, right-closed edges over [mn, mx] with the first edge lowered by
    0.1 % of the range; a constant column is widened by 0.1 % of |value|."""
    if mn == mx:
        pad = EDGE_ADJUST * abs(mn) if mn != 0 else EDGE_ADJUST
        mn, mx = mn - pad, mx + pad
        step = (mx - mn) / bins
        return [mn + i * step for i in range(bins)] + [mx]
    step = (mx - mn) / bins
    edges = [mn + i * step for i in range(bins)] + [mx]
    edges[0] = mn - (mx - mn) * EDGE_ADJUST
    return edges


def sturges_bins(n: int) -> int:
    return int(1 + STURGES * math.log10(n)) if n > 0 else 1


def frequency_table(df: DataFrame, column: str, bins: int | None = None,
                    label_precision: int | None = None) -> DataFrame:
    """Equal-width frequency distribution (empty bins kept).
    -> ``(bin, interval, lower, upper, class_mark, frequency, relative_frequency,
    cumulative_frequency, cumulative_relative_frequency)``"""
    x = col(column).cast("double")
    st = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("n")).first()
    if not st["n"]:
        raise ValueError(f"column {column!r} has no values")
    b = int(bins) if bins is not None else sturges_bins(st["n"])
    edges = bin_edges(float(st["mn"]), float(st["mx"]), b)
    shown = [_round_frac(e, label_precision) for e in edges] if label_precision is not None else edges
    lab = [_round_frac(e, 3) for e in edges]
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i + 1, f"({lab[i]}, {lab[i + 1]}]", edges[i], edges[i + 1], (shown[i] + shown[i + 1]) / 2.0)
         for i in range(b)], "bin int, interval string, lower double, upper double, class_mark double")
    lit_edges = F.array(*[F.lit(e) for e in edges])
    bin_of = F.least(F.lit(b), F.greatest(F.lit(1), F.size(F.filter(lit_edges, lambda e: e < x))))
    counts = df.where(x.isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    t = meta.join(F.broadcast(counts), "bin", "left").fillna(0, ["frequency"])  # b rows each side
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)        # over b rows
    n = st["n"]
    return (t.withColumn("relative_frequency", F.col("frequency") / F.lit(n))
             .withColumn("cumulative_frequency", F.sum("frequency").over(w))
             .withColumn("cumulative_relative_frequency", F.col("cumulative_frequency") / F.lit(n))
             .select("bin", "interval", "lower", "upper", "class_mark", "frequency", "relative_frequency",
                     "cumulative_frequency", "cumulative_relative_frequency"))


def histogram(table: DataFrame) -> DataFrame:
    return table.select("bin", "interval", "lower", "upper", "frequency")


def polygon(table: DataFrame) -> DataFrame:
    return table.select("bin", "class_mark", "frequency")


def ogive(table: DataFrame) -> DataFrame:
    return table.select("bin", "class_mark", "cumulative_relative_frequency")


def boxes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, fences, whiskers (most extreme values inside the fences) and the
    outlier count of every (group, column) -> ``(variable, by..., n, q1, median, q3, lower_fence,
    upper_fence, whisker_low, whisker_high, n_outliers)``. One table of distinct-value counts, made
    in one pass over the rows, gives all of it."""
    from tessera.operators.quantiles import _as_exprs, _bucketed_counts, _quantiles_from_counts, value_counts
    by = list(by)
    keys = [*by, "variable"]
    exprs = _as_exprs(df, columns)
    counted = pinned(_bucketed_counts(df, exprs, by, value_counts(df, exprs)), "value-counts")
    quartile = {name: F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    q = _quantiles_from_counts(counted, by, [0.25, 0.5, 0.75]).groupBy(*map(col, keys)).agg(*quartile.values())
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumns({"lower_fence": F.col("q1") - 1.5 * iqr, "upper_fence": F.col("q3") + 1.5 * iqr})
    for i, k in enumerate(keys):  # a NULL group is a group like any other
        q = q.withColumnRenamed(k, f"_k{i}")
    same = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    facts = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    agg = counted.join(q, same).groupBy(*map(col, keys), *facts).agg(
        F.sum("cnt").alias("n"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"), F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("cnt"))), F.lit(0)).alias("n_outliers"))
    return agg.select("variable", *map(col, by), "n", *facts, "whisker_low", "whisker_high", "n_outliers")


def box_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """:func:`boxes` of one column -> ``(by..., n, q1, ...)``; a column without values is an error
    when there are no groups."""
    out = boxes(df, [column], by).drop("variable")
    if not by and out.isEmpty():
        raise ValueError(f"column {column!r} has no values")
    return out


def box_points(df: DataFrame, column: str, key: str) -> DataFrame:
    """All outlier points of the box (no display cap): ``(key, value)``."""
    q = quantile_map(df, [column], [0.25, 0.75])[column]
    lo, hi = q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])
    x = col(column).cast("double")
    return df.where((x < lo) | (x > hi)).select(col(key), x.alias("value"))


def hash_sample(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Deterministic sample of ``n`` rows: the first ``n`` by a seeded row hash
    (a distributed top-k, each partition keeps at most ``n``)."""
    from tessera.operators.sampling import first_k
    return first_k(df, n, seed, key)


def scatter_sample(df: DataFrame, x: str, y: str, n: int = 3000, seed: int = 42,
                   key: Sequence[str] | None = None) -> DataFrame:
    names = list(dict.fromkeys([*(key or []), x, y]))
    pts = df.select(*map(col, names)).where(all_not_null([x, y]))
    return hash_sample(pts, n, seed, key)


def scatter_matrix_sample(df: DataFrame, n: int = 2000, seed: int = 42,
                          key: Sequence[str] | None = None) -> DataFrame | None:
    cols = [c for c in numeric_columns(df) if not key or c not in key]
    if len(cols) < 2:
        return None
    pts = df.select(*map(col, [*(key or []), *cols])).where(all_not_null(cols))
    return hash_sample(pts, n, seed, key)
