"""Exploratory factor analysis.

Spark does the data passes: (A) count/mean/min/max per column, (B) covariance of
the mean-filled frame, (C) bootstrap replicate moments grouped by replicate id.
Everything after that is p x p algebra on the driver. Factor scores are lazy
column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, numeric_columns
from tessera.functions.distributions import chi2_sf, normal_sf
from tessera.operators.moments import moments
from tessera.operators.sampling import row_hash, with_ordinals

COLLINEAR = 0.95        # fixed: |r| above this drops the later column
EDGE_THRESHOLD = 0.4    # fixed: path-diagram edges at |loading| >= 0.4
BOOTSTRAP = 50          # fixed: bootstrap replicates
ROWS_AT_ONCE = 2_000    # rows whose weights and products are in memory at once
# Poisson(1) cumulative probabilities for k = 0..11 (Poisson bootstrap weights).
_POISSON_CDF = [sum(math.exp(-1.0) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


@dataclass
class PreparedInput:
    columns: list[str]
    means: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.coalesce(col(c).cast("double"), F.lit(self.means[c])).alias(c)
                           for c in self.columns])


def prepare_factor_input(df: DataFrame, columns: Sequence[str] | None = None) -> PreparedInput:
    """Numeric columns, all-null ones dropped, NULL -> column mean, constant columns
    dropped; at least two must remain (one aggregation job)."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.min(col(c)).cast("double").alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.max(col(c)).cast("double").alias(f"b{i}") for i, c in enumerate(cols)]).first()
    keep, means = [], {}
    for i, c in enumerate(cols):
        if row[f"m{i}"] is None or row[f"a{i}"] == row[f"b{i}"]:
            continue
        keep.append(c)
        means[c] = float(row[f"m{i}"])
    if len(keep) < 2:
        raise ValueError("factor analysis: fewer than two numeric columns vary")
    return PreparedInput(keep, means)


def drop_collinear(columns: Sequence[str], corr: np.ndarray, threshold: float = COLLINEAR) -> list[int]:
    """Indices kept: column i is dropped when |r(i, j)| > threshold for some j < i
    (whether or not j itself was dropped)."""
    a = np.abs(corr)
    return [i for i in range(len(columns)) if not any(a[i, j] > threshold for j in range(i))]


def kmo(r: np.ndarray) -> float:
    inv = np.linalg.pinv(r)
    d = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    partial = -inv / d
    off = ~np.eye(len(r), dtype=bool)
    r2, a2 = float(np.sum(r[off] ** 2)), float(np.sum(partial[off] ** 2))
    return r2 / (r2 + a2)


def bartlett(r: np.ndarray, n: int) -> tuple[float, float, float]:
    """Statistic, degrees of freedom, p. A singular matrix has an infinite statistic, p 0."""
    p = len(r)
    sign, logdet = np.linalg.slogdet(r)  # no underflow with many columns
    stat = -(n - 1 - (2 * p + 5) / 6.0) * (float(logdet) if sign > 0 else -math.inf)
    dof = p * (p - 1) / 2.0
    return stat, dof, chi2_sf(stat, dof) if math.isfinite(stat) else 0.0


def minres(r: np.ndarray, k: int, tol: float = 1e-12, max_iter: int = 1000) -> np.ndarray:
    """Unweighted least-squares (minres) loadings by iterated principal-axis
    factoring from squared multiple correlations; Heywood cases are clamped."""
    p = len(r)
    h = 1.0 - 1.0 / np.diag(np.linalg.pinv(r))
    h = np.clip(h, 0.005, 1.0)
    loadings = np.zeros((p, k))
    for _ in range(max_iter):
        rh = r.copy()
        np.fill_diagonal(rh, h)
        vals, vecs = np.linalg.eigh(rh)
        idx = np.argsort(-vals)[:k]
        vals, vecs = np.clip(vals[idx], 0.0, None), vecs[:, idx]
        loadings = vecs * np.sqrt(vals)
        new_h = np.clip(np.sum(loadings ** 2, axis=1), 0.0, 0.995)
        if np.max(np.abs(new_h - h)) < tol:
            h = new_h
            break
        h = new_h
    return loadings


def varimax(loadings: np.ndarray, normalize: bool = True, max_iter: int = 1000, tol: float = 1e-5) -> np.ndarray:
    p, k = loadings.shape
    if k < 2:
        return loadings.copy()
    x = loadings.copy()
    if normalize:
        norms = np.sqrt(np.sum(x ** 2, axis=1, keepdims=True))
        norms[norms == 0] = 1.0
        x = x / norms
    rot = np.eye(k)
    d = 0.0
    for _ in range(max_iter):
        lam = x @ rot
        u, s, vh = np.linalg.svd(x.T @ (lam ** 3 - lam @ np.diag(np.sum(lam ** 2, axis=0)) / p))
        rot = u @ vh
        d_old, d = d, float(np.sum(s))
        if d_old != 0 and d / d_old < 1 + tol:
            break
    out = x @ rot
    if normalize:
        out = out * norms
    return out


def _orient(loadings: np.ndarray) -> np.ndarray:
    """Deterministic signs: every factor's loadings sum to a positive number."""
    s = np.sign(loadings.sum(axis=0))
    s[s == 0] = 1.0
    return loadings * s


def fit_loadings(r: np.ndarray, k: int, rotation: str | None = "varimax") -> np.ndarray:
    lo = minres(r, k)
    if rotation == "varimax":
        lo = varimax(lo)
    return _orient(lo)


@dataclass
class FactorResult:
    columns: list[str]
    dropped_collinear: list[str]
    n: int
    corr: np.ndarray
    kmo: float
    bartlett_chi2: float
    bartlett_df: float
    bartlett_p: float
    eigenvalues: np.ndarray
    n_factors: int
    loadings: np.ndarray
    means: dict[str, float]            # of the filled frame (for z)
    stds: dict[str, float]             # population std of the filled frame
    fill: dict[str, float]
    bootstrap: dict = field(default_factory=dict)

    def score_weights(self) -> np.ndarray:
        return np.linalg.solve(self.corr, self.loadings)

    def scores(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Regression-method factor scores z @ R^-1 L as lazy columns factor_1..k."""
        w = self.score_weights()
        exprs = []
        for f in range(self.n_factors):
            s = F.lit(0.0)
            for j, c in enumerate(self.columns):
                z = (F.coalesce(col(c).cast("double"), F.lit(self.fill[c])) - F.lit(self.means[c])) / F.lit(self.stds[c])
                s = s + F.lit(float(w[j, f])) * z
            exprs.append(s.alias(f"factor_{f + 1}"))
        return df.select(*keep, *exprs)

    def loadings_long(self, spark) -> DataFrame:
        rows = [(c, f"factor_{f + 1}", float(self.loadings[j, f]))
                for j, c in enumerate(self.columns) for f in range(self.n_factors)]
        return spark.createDataFrame(rows, "variable string, factor string, loading double")

    def eigen_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(self.eigenvalues)],
                                     "factor int, eigenvalue double")


def sort_loadings(long: DataFrame) -> DataFrame:
    """Variables ordered by dominant factor, then by the strength of that loading:
    ``(order, variable, dominant_factor, max_abs_loading)``."""
    from pyspark.sql import Window
    w = Window.partitionBy("variable").orderBy(F.desc(F.abs("loading")), "factor")
    dom = (long.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
               .select("variable", F.col("factor").alias("dominant_factor"),
                       F.abs("loading").alias("max_abs_loading")))
    wo = Window.orderBy(F.expr("cast(substring(dominant_factor, 8) as int)"), F.desc("max_abs_loading"), "variable")
    return dom.withColumn("order", F.row_number().over(wo))  # one row per variable (p rows)


def loading_edges(long: DataFrame, threshold: float = EDGE_THRESHOLD) -> DataFrame:
    """Path-diagram edges with |loading| >= threshold: ``(variable, factor, loading, sign)``."""
    return (long.where(F.abs("loading") >= threshold)
                .withColumn("sign", F.when(F.col("loading") > 0, F.lit("positive")).otherwise(F.lit("negative"))))


def factor_analysis(df: DataFrame, columns: Sequence[str] | None = None, n_factors: int | None = None,
                    rotation: str | None = "varimax", bootstrap: int = 0, seed: int = 42,
                    key: Sequence[str] | None = None, align: bool = True) -> FactorResult:
    prep = prepare_factor_input(df, columns)
    filled = prep.transform(df)
    m = moments(filled, prep.columns)
    r_all = m.corr()
    kept_idx = drop_collinear(prep.columns, r_all)
    cols = [prep.columns[i] for i in kept_idx]
    dropped = [c for c in prep.columns if c not in cols]
    r = r_all[np.ix_(kept_idx, kept_idx)]
    n = m.n
    k_stat = kmo(r)
    chi2, dof, pval = bartlett(r, n)
    eig = np.sort(np.linalg.eigvalsh(r))[::-1]
    if n_factors is not None and not 1 <= n_factors <= len(cols):
        raise ValueError(f"{n_factors} factors asked of {len(cols)} columns")
    k = n_factors if n_factors is not None else max(int(np.sum(eig > 1)), 1)
    lo = fit_loadings(r, k, rotation)
    means = {c: float(m.mean[prep.columns.index(c)]) for c in cols}
    sd = {c: float(math.sqrt(m.cov[prep.columns.index(c), prep.columns.index(c)] * (n - 1) / n)) for c in cols}
    res = FactorResult(cols, dropped, n, r, k_stat, chi2, dof, pval, eig, k, lo, means, sd,
                       {c: prep.means[c] for c in cols})
    if bootstrap:
        res.bootstrap = bootstrap_loadings(df, res, bootstrap, seed, key, rotation, align)
    return res


def poisson_weights(hashed: np.ndarray, replicates: int) -> np.ndarray:
    """(replicates, rows) Poisson(1) weights: the row's 32-bit hash and the replicate's number are
    mixed to a uniform number, which the cumulative probabilities turn into a count."""
    mask = np.uint64(0xFFFFFFFF)
    x = (hashed.astype(np.uint64)[None, :] + np.arange(replicates, dtype=np.uint64)[:, None] * np.uint64(2654435769)) & mask
    x ^= x >> np.uint64(16)
    x = (x * np.uint64(2246822507)) & mask
    x ^= x >> np.uint64(13)
    x = (x * np.uint64(3266489909)) & mask
    x ^= x >> np.uint64(16)
    return np.searchsorted(_POISSON_CDF, (x + 0.5) / 2.0 ** 32, side="left").astype(float)


def bootstrap_moments(df: DataFrame, columns: Sequence[str], fill: dict, replicates: int, seed: int,
                      key: Sequence[str] | None = None) -> dict[int, np.ndarray]:
    """Poisson bootstrap in one job: every row gets a Poisson(1) weight per replicate
    from a seeded hash of its key; a task multiplies the weights of a batch (replicates x rows)
    by the rows' cross-products (rows x p(p+3)/2), shifted by the means in ``fill``, and adds up,
    so rows are never multiplied. Without ``key`` equal rows are numbered first, so
    each has a weight of its own. Returns {replicate: correlation matrix}."""
    if not key:
        df = with_ordinals(df)
    ids = list(key) if key else list(df.columns)
    p = len(columns)
    hashed = F.conv(F.substring(row_hash(seed, ids), 1, 8), 16, 10).cast("long").alias("h")
    xs = [F.coalesce(col(c).cast("double") - F.lit(fill[c]), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)]
    first, second = np.triu_indices(p)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((replicates, 1 + p + len(first)))
        for batch in batches:
            for part in (batch.slice(at, ROWS_AT_ONCE) for at in range(0, batch.num_rows, ROWS_AT_ONCE)):
                x = np.array([part.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(p)]).T.reshape(-1, p)
                products = np.concatenate([np.ones((len(x), 1)), x, x[:, first] * x[:, second]], axis=1)
                total += poisson_weights(part.column("h").to_numpy(zero_copy_only=False), replicates) @ products
        for b in range(replicates):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1], b), pa.int32()), pa.array(np.arange(total.shape[1]), pa.int32()),
                                              pa.array(total[b])], names=["b", "k", "v"])

    added = df.select(hashed, *xs).mapInArrow(sums, "b int, k int, v double").groupBy("b", "k").agg(F.sum("v").alias("v"))
    totals = np.zeros((replicates, 1 + p + len(first)))
    for r in added.collect():  # replicates x p(p+3)/2 numbers
        totals[r["b"], r["k"]] = r["v"]
    out = {}
    for b, row in enumerate(totals):
        if not row[0]:
            continue
        mean = row[1:1 + p] / row[0]
        cov = np.zeros((p, p))
        cov[first, second] = cov[second, first] = row[1 + p:] / row[0]
        cov -= np.outer(mean, mean)
        sd = np.sqrt(np.diag(cov))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[b] = cov / np.outer(sd, sd)
    return out


def bootstrap_correlations(df: DataFrame, columns: Sequence[str] | None = None, replicates: int = BOOTSTRAP, seed: int = 42,
                           key: Sequence[str] | None = None) -> DataFrame:
    """``(replicate, x, y, r)`` for the pairs of prepared columns."""
    prep = prepare_factor_input(df, columns)
    mats = bootstrap_moments(df, prep.columns, prep.means, replicates, seed, key)
    rows = [(b, x, y, float(m[i, j])) for b, m in sorted(mats.items()) for i, x in enumerate(prep.columns) for j, y in enumerate(prep.columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "replicate int, x string, y string, r double")


def _align(target: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Reorder and flip factors of ``lo`` to best match ``target`` (greedy by |r|)."""
    k = target.shape[1]
    c = np.corrcoef(target.T, lo.T)[:k, k:] if k > 1 else np.array([[np.sign(np.sum(target * lo)) or 1.0]])
    out = np.zeros_like(lo)
    used = set()
    for f in range(k):
        cand = [(abs(c[f, g]), g) for g in range(k) if g not in used]
        _, g = max(cand)
        used.add(g)
        out[:, f] = lo[:, g] * (1.0 if c[f, g] >= 0 else -1.0)
    return out


def bootstrap_loadings(df: DataFrame, res: FactorResult, replicates: int = BOOTSTRAP, seed: int = 42,
                       key: Sequence[str] | None = None, rotation: str | None = "varimax",
                       align: bool = True) -> dict:
    """Standard errors (population std over replicates), z and two-sided normal p."""
    mats = bootstrap_moments(df, res.columns, res.fill, replicates, seed, key)
    reps = []
    for b in sorted(mats):
        lo = fit_loadings(mats[b], res.n_factors, rotation)
        reps.append(_align(res.loadings, lo) if align else lo)
    arr = np.array(reps)
    se = arr.std(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = res.loadings / se
    p = np.vectorize(lambda v: 2 * normal_sf(abs(v)) if np.isfinite(v) else float("nan"))(z)
    return {"loadings": res.loadings, "se": se, "z": z, "p": p, "replicates": len(reps)}


def bootstrap_table(res: FactorResult, spark) -> DataFrame:
    b = res.bootstrap
    rows = [(c, f"factor_{f + 1}", float(b["loadings"][j, f]), float(b["se"][j, f]), float(b["z"][j, f]),
             float(b["p"][j, f])) for j, c in enumerate(res.columns) for f in range(res.n_factors)]
    return spark.createDataFrame(rows, "variable string, factor string, loading double, se double, z double, p double")


def scree(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Eigenvalues of the correlation matrix of the prepared, non-collinear input
    (descending): ``(factor, eigenvalue)``. Two aggregation jobs; no loadings fit."""
    prep = prepare_factor_input(df, columns)
    m = moments(prep.transform(df), prep.columns)
    r_all = m.corr()
    keep = drop_collinear(prep.columns, r_all)
    eig = np.sort(np.linalg.eigvalsh(r_all[np.ix_(keep, keep)]))[::-1]
    return df.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(eig)],
                                           "factor int, eigenvalue double")
