"""Normality tests: Kolmogorov-Smirnov against N(mean, sample sd) on every value
(all series in one distributed plan), Shapiro-Wilk on a seeded sample of at most 5000 values
per series (Royston's approximation, computed per series with ``applyInPandas`` on
the bounded sample), and the combined verdict."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col
from tessera.functions.distributions import normal_cdf_sql, normal_ppf, normal_sf

SHAPIRO_MAX = 5000      # fixed: Shapiro-Wilk sample size cap
ALPHA = 0.05            # fixed: significance level of the verdict
PARAMETRIC = "parametric"
NON_PARAMETRIC = "non-parametric"

# Royston (1995) polynomial coefficients, lowest order first.
_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]   # a_n in 1/sqrt(n)
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]   # a_(n-1) in 1/sqrt(n)
_MU_SMALL = [0.5440, -0.39978, 0.025054, -6.714e-4]                 # mean, 4 <= n <= 11, in n
_SD_SMALL = [1.3822, -0.77857, 0.062767, -0.0020322]                # log sd, 4 <= n <= 11, in n
_GAMMA_SMALL = [-2.273, 0.459]                                      # gamma, 4 <= n <= 11, in n
_MU_LARGE = [-1.5861, -0.31082, -0.083751, 0.0038915]              # mean, n > 11, in log n
_SD_LARGE = [-0.4803, -0.082676, 0.0030302]                        # log sd, n > 11, in log n


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_w(x: np.ndarray) -> tuple[float, float]:
    """W statistic and p-value for one sample (3 <= n <= 5000)."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3:
        return float("nan"), float("nan")
    rng = x[-1] - x[0]
    if rng == 0:
        return float("nan"), float("nan")
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        mm = float(m @ m)
        u = 1.0 / math.sqrt(n)
        an = -m[0] / math.sqrt(mm) + _poly(_C1, u)
        a = m / math.sqrt(mm)
        if n > 5:
            an1 = -m[1] / math.sqrt(mm) + _poly(_C2, u)
            phi = (mm - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a = m / math.sqrt(phi)
            a[0], a[1], a[-2], a[-1] = -an, -an1, an1, an
        else:
            phi = (mm - 2 * m[0] ** 2) / (1 - 2 * an ** 2)
            a = m / math.sqrt(phi)
            a[0], a[-1] = -an, an
    xc = x - x.mean()
    w = float((a @ x) ** 2 / (xc @ xc))
    w = min(w, 1.0)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(p, 0.0)
    lw = math.log(1.0 - w) if w < 1 else -math.inf
    if n <= 11:
        gamma = _poly(_GAMMA_SMALL, n)
        if lw >= gamma:
            return w, 0.0
        y = -math.log(gamma - lw)
        mu, sd = _poly(_MU_SMALL, n), math.exp(_poly(_SD_SMALL, n))
    else:
        ln = math.log(n)
        y, mu, sd = lw, _poly(_MU_LARGE, ln), math.exp(_poly(_SD_LARGE, ln))
    return w, normal_sf((y - mu) / sd)


def shapiro_wilk(df: DataFrame, column: str, by: Sequence[str] = (), seed: int = 42,
                 max_n: int = SHAPIRO_MAX, key: Sequence[str] | None = None) -> DataFrame:
    """``(by..., n_tested, shapiro_w, shapiro_p)`` per series. The sample is the first
    ``max_n`` values by a seeded row hash (``sampling.first_k``: thinned by a hash
    threshold before the per-series window, so no series is sorted whole); the test
    itself runs per series on that bounded sample."""
    from tessera.operators.sampling import first_k
    by = list(by)
    x = col(column).cast("double")
    base = df.where(x.isNotNull()).select(*map(col, dict.fromkeys(by + list(key or []))), x.alias("_x"))
    sample = first_k(base, max_n, seed, key, by).select(*by, "_x")
    schema = ", ".join([f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by] +
                       ["n_tested long", "shapiro_w double", "shapiro_p double"])

    def _test(pdf: pd.DataFrame) -> pd.DataFrame:
        wv, pv = shapiro_w(pdf["_x"].to_numpy())
        out = {b: [pdf[b].iloc[0]] for b in by}
        out.update({"n_tested": [len(pdf)], "shapiro_w": [wv], "shapiro_p": [pv]})
        return pd.DataFrame(out)

    if by:
        return sample.groupBy(*by).applyInPandas(_test, schema)
    return sample.groupBy(F.lit(0).alias("_g")).applyInPandas(_test, schema)


EXACT_MAX = 10_000  # fixed: longest series whose KS p-value is the exact one


def ks_exact(d: float, n: int) -> float:
    """P(D_n >= d) of the two-sided statistic by Durbin's matrix in the scaled powers of
    Marsaglia, Tsang and Wang."""
    s = d * d * n
    if s > 18.0:  # below 1e-15
        return 0.0
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    i, j = np.indices((m, m))
    power = np.where(i - j + 1 >= 0, 1.0, 0.0)
    hs = h ** np.arange(1, m + 1)
    power[:, 0] -= hs
    power[-1, :] -= hs[::-1]
    power[-1, 0] += max(2 * h - 1, 0.0) ** m
    factor = np.array([math.lgamma(v + 1) for v in range(m + 1)])
    below = np.maximum(i - j + 1, 0)
    power = np.where(i - j + 1 > 0, power * np.exp(-factor[below]), power)
    result, scale, base, e = np.eye(m), 0, 0, n
    while e:
        if e & 1:
            result, scale = result @ power, scale + base
            if result[k - 1, k - 1] > 1e140:
                result, scale = result * 1e-140, scale + 140
        e >>= 1
        if e:
            power, base = power @ power, 2 * base
            if power[k - 1, k - 1] > 1e140:
                power, base = power * 1e-140, base + 140
    q = result[k - 1, k - 1]
    log = math.log(q) + scale * math.log(10.0) + math.lgamma(n + 1) - n * math.log(n) if q > 0 else -math.inf
    return min(1.0, max(0.0, 1.0 - math.exp(log)))


def ks_pvalue(d: float, n: int) -> float:
    """Two-sided KS p-value: exact up to ``EXACT_MAX`` values, beyond that the asymptotic Kolmogorov
    distribution with Stephens' scaling of the statistic."""
    if d is None or n is None or n < 1 or math.isnan(d):
        return float("nan")
    if n <= EXACT_MAX:
        return ks_exact(d, n)
    sq = math.sqrt(n)
    lam = (sq + 0.12 + 0.11 / sq) * d
    if lam < 1e-3:
        return 1.0
    total = 0.0
    for k in range(1, 101):
        term = 2.0 * (-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam)
        total += term
        if abs(term) < 1e-16:
            break
    return min(1.0, max(0.0, total))


@F.pandas_udf(T.DoubleType())
def _ks_p(d: pd.Series, n: pd.Series) -> pd.Series:
    """One value for each series, not for each row."""
    return pd.Series([ks_pvalue(a, int(b)) for a, b in zip(d, n)], dtype=float)


def ks_normal(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, mean, std, ks_statistic, ks_p)``: one-sample two-sided KS test of
    every value against N(mean, sample sd), all series in one distributed plan.

    Distinct values are counted per series, the empirical CDF just below / at each
    value comes from a grouped "values below" count (``grouped_below``: windows per
    series, bucketed when a series is large), and D is the largest gap to the
    normal CDF. No series is collected or scanned separately."""
    from tessera.operators.quantiles import grouped_below
    by = list(by)
    keys = by if by else ["_series"]
    x = col(column).cast("double")
    base = df.where(x.isNotNull()).select(*map(col, by), x.alias("value"))
    if not by:
        base = base.withColumn("_series", F.lit(0))
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
                                    F.stddev_samp("value").alias("std"))
    cells = base.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = grouped_below(cells, keys).join(stats, keys)
    ranked = ranked.withColumn("_z", F.try_divide(F.col("value") - F.col("mean"), F.col("std")))  # std 0 / NULL -> NULL
    cdf = F.expr(normal_cdf_sql("_z"))
    gaps = ranked.select(*keys, "n", "mean", "std",
                         F.greatest((F.col("below") + F.col("cnt")) / F.col("n") - cdf,
                                    cdf - F.col("below") / F.col("n")).alias("_gap"))
    d = gaps.groupBy(*keys, "n", "mean", "std").agg(F.max("_gap").alias("ks_statistic"))
    valid = F.col("std").isNotNull() & (F.col("std") > 0)
    d = d.select(*keys, "n", "mean", "std",
                 F.when(valid, F.col("ks_statistic")).alias("ks_statistic"))
    d = d.withColumn("ks_p", F.when(valid, _ks_p(F.col("ks_statistic"), F.col("n"))))
    return d.select(*by, "n", "mean", "std", "ks_statistic", "ks_p")


def normality(df: DataFrame, column: str, by: Sequence[str] = (), alpha: float = ALPHA, **kw) -> DataFrame:
    """Both tests and the verdict: normal only when both p-values exceed ``alpha``."""
    by = list(by)
    ks = ks_normal(df, column, by)
    sw = shapiro_wilk(df, column, by, **kw)
    if by:
        out = ks.join(sw, by, "inner")
    else:  # one row each
        tested = sw.first()
        types = {"n_tested": "long", "shapiro_w": "double", "shapiro_p": "double"}
        out = ks.withColumns({n: F.lit(tested[n] if tested else None).cast(t) for n, t in types.items()})
    normal_sw = F.coalesce(F.col("shapiro_p") > alpha, F.lit(False))
    normal_ks = F.coalesce(F.col("ks_p") > alpha, F.lit(False))
    return out.select(*by, "n", "shapiro_w", "shapiro_p", "ks_statistic", "ks_p",
                      normal_sw.alias("normal_shapiro"), normal_ks.alias("normal_ks"),
                      F.when(normal_sw & normal_ks, F.lit(PARAMETRIC)).otherwise(F.lit(NON_PARAMETRIC))
                      .alias("recommended_tests"))
