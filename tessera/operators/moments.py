"""Grouped first and second moments.

Factor analysis, LDA, Box's M and Pearson correlation all need only ``n``, the mean
vector and the covariance matrix of each group. Spark computes count, sums and
cross-product sums of mean-shifted values (shifting keeps the sums accurate), for few columns in a
two-level aggregation, for many as matrices of Arrow batches; the p x p algebra afterwards runs on the
driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import all_not_null, col


@dataclass
class Moments:
    columns: list[str]
    n: int
    mean: np.ndarray          # (p,)
    cov: np.ndarray           # (p, p) sample covariance (ddof 1); NaN when n < 2

    @property
    def scatter(self) -> np.ndarray:
        """Centered cross-product matrix sum (x - mean)(x - mean)^T."""
        return self.cov * (self.n - 1) if self.n > 1 else np.zeros_like(self.cov)

    def corr(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.cov))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = self.cov / np.outer(sd, sd)
        r[~np.isfinite(r)] = np.nan
        return r


SALTS = 64  # first-level groups of the two-level aggregation


def _sums(df: DataFrame, columns: Sequence[str], by: Sequence[str], shift: Sequence[float]):
    """Count, sums and cross-product sums of (x - shift), aggregated in two levels:
    first per (by..., partition salt) so partial buffers spread over ``SALTS``
    reducers, then per group over at most ``SALTS`` rows. A plain global aggregate
    would send every partition's p(p+1)/2-wide buffer to a single task."""
    p = len(columns)
    dx = [col(c).cast("double") - F.lit(float(s)) for c, s in zip(columns, shift)]
    base = df.select(*by, *[d.alias(f"_d{i}") for i, d in enumerate(dx)],
                     F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"))
    names = ["_n"] + [f"_s{i}" for i in range(p)] + [f"_q{i}_{j}" for i in range(p) for j in range(i, p)]
    exprs = [F.count(F.lit(1))] + [F.sum(f"_d{i}") for i in range(p)] + [
        F.sum(F.col(f"_d{i}") * F.col(f"_d{j}")) for i in range(p) for j in range(i, p)]
    level1 = base.groupBy(*by, "_salt").agg(*[e.alias(n) for e, n in zip(exprs, names)],
                                            *[F.min(f"_d{i}").alias(f"_lo{i}") for i in range(p)],
                                            *[F.max(f"_d{i}").alias(f"_hi{i}") for i in range(p)])
    return level1.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names],
                                   *[F.min(f"_lo{i}").alias(f"_lo{i}") for i in range(p)],
                                   *[F.max(f"_hi{i}").alias(f"_hi{i}") for i in range(p)])


#: Columns from which on the cross-products are added up as matrices; fewer are aggregate expressions.
WIDE = 24
#: Rows multiplied at once, and numbers that a task holds before it hands them on.
ROWS_AT_ONCE, HELD = 4_000, 4_000_000


def _sums_wide(df: DataFrame, columns: Sequence[str], by: Sequence[str], shift: Sequence[float]) -> list[dict]:
    """The same sums for many columns, where p(p+1)/2 aggregate expressions would be one huge stage:
    a task multiplies the matrix of a batch by itself and adds up for each group; (group, cell) rows
    are summed by Spark."""
    p = len(columns)
    first, second = np.triu_indices(p)
    cells = 1 + p + len(first)
    names = [f"_d{i}" for i in range(p)]
    dx = [(col(c).cast("double") - F.lit(float(s))).alias(n) for c, s, n in zip(columns, shift, names, strict=True)]
    key = by[0] if by else None
    kind = df.schema[key].dataType if key else T.IntegerType()
    base = df.select(col(key).alias("_g") if key else F.lit(0).alias("_g"), *dx)
    schema = T.StructType([T.StructField("_g", kind), T.StructField("cell", T.IntegerType()), T.StructField("added", T.DoubleType()),
                           T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for value, (added, low, high) in held.items():
                edges = [np.full(cells, np.nan), np.full(cells, np.nan)]
                edges[0][1:1 + p], edges[1][1:1 + p] = low, high
                yield pa.RecordBatch.from_arrays([pa.array([value] * cells, arrow), pa.array(np.arange(cells), pa.int32()), pa.array(added),
                                                  pa.array(edges[0]), pa.array(edges[1])], names=schema.names)
            held.clear()

        for batch in batches:
            arrow = batch.schema.field("_g").type
            groups = batch.column("_g").to_pylist()
            x = np.array([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).T.reshape(-1, p)
            codes: dict = {}
            code = np.array([codes.setdefault(g, len(codes)) for g in groups])
            for value, c in codes.items():
                own = x[code == c]
                added, low, high = held.setdefault(value, (np.zeros(cells), np.full(p, np.inf), np.full(p, -np.inf)))
                for at in range(0, len(own), ROWS_AT_ONCE):
                    part = own[at:at + ROWS_AT_ONCE]
                    added[0] += len(part)
                    added[1:1 + p] += part.sum(0)
                    added[1 + p:] += (part.T @ part)[first, second]
                    np.minimum(low, part.min(0), out=low)
                    np.maximum(high, part.max(0), out=high)
                if len(held) * cells > HELD:
                    yield from rows()
        if held:
            yield from rows()

    totals = base.mapInArrow(sums, schema).groupBy("_g", "cell").agg(F.sum("added").alias("added"), F.min("low").alias("low"), F.max("high").alias("high"))
    found: dict = {}
    for r in totals.collect():  # groups x p(p+3)/2 numbers
        row = found.setdefault(r["_g"], {key: r["_g"]} if key else {})
        k = r["cell"]
        if k == 0:
            row["_n"] = int(r["added"])
        elif k <= p:
            row |= {f"_s{k - 1}": r["added"], f"_lo{k - 1}": r["low"], f"_hi{k - 1}": r["high"]}
        else:
            row[f"_q{first[k - 1 - p]}_{second[k - 1 - p]}"] = r["added"]
    return list(found.values())


def _collected(df: DataFrame, columns: Sequence[str], by: Sequence[str], shift: Sequence[float]) -> list:
    """One row of sums for each group, by expressions or by matrices as the table is wide."""
    return _sums_wide(df, columns, by, shift) if len(columns) >= WIDE else _sums(df, columns, by, shift).collect()


def _to_moments(row, columns: Sequence[str], shift: Sequence[float]) -> Moments:
    p = len(columns)
    n = int(row["_n"])
    s = np.array([row[f"_s{i}"] for i in range(p)], dtype=float)
    q = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            q[i, j] = q[j, i] = row[f"_q{i}_{j}"]
    mean = np.asarray(shift, dtype=float) + s / n
    cov = (q - np.outer(s, s) / n) / (n - 1) if n > 1 else np.full((p, p), np.nan)
    for i in range(p):  # a constant column has exactly zero (co)variance
        if n > 1 and row[f"_lo{i}"] == row[f"_hi{i}"]:
            cov[i, :] = 0.0
            cov[:, i] = 0.0
    return Moments(list(columns), n, mean, cov)


def _shift(clean: DataFrame, columns: Sequence[str]) -> list[float]:
    row = clean.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(len(columns))]


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments over rows complete in ``columns`` (two jobs: a mean shift for accuracy,
    then the shifted sums)."""
    clean = df.where(all_not_null(list(columns)))
    shift = _shift(clean, columns)
    row = next(iter(_collected(clean, columns, [], shift)), None)
    if row is None or not row["_n"]:
        return Moments(list(columns), 0, np.full(len(columns), np.nan), np.full((len(columns),) * 2, np.nan))
    return _to_moments(row, columns, shift)


MAX_LEVELS = 1_000  # levels of a grouping column whose statistics may come to the driver


def require_few_levels(df: DataFrame, by: str, most: int = MAX_LEVELS) -> None:
    """Raise ``ValueError`` if column ``by`` has more than ``most`` levels (an id passed as the
    target, for instance), before anything of them is collected."""
    if df.select(col(by)).distinct().limit(most + 1).count() > most:
        raise ValueError(f"{by!r} has more than {most} levels")


def grouped_moments(df: DataFrame, columns: Sequence[str], by: str) -> dict:
    """``{group: Moments}`` over rows complete in ``columns`` and ``by`` (the result
    has one row per group, ``MAX_LEVELS`` at most)."""
    require_few_levels(df, by)
    clean = df.where(all_not_null([*columns, by]))
    shift = _shift(clean, columns)
    rows = _collected(clean, columns, [by], shift)
    return {r[by]: _to_moments(r, columns, shift) for r in rows}


def pooled(groups: dict) -> Moments:
    """Total-sample moments recombined from group moments (exact)."""
    items = list(groups.values())
    cols = items[0].columns
    n = sum(m.n for m in items)
    mean = sum(m.n * m.mean for m in items) / n
    scatter = sum(m.scatter + m.n * np.outer(m.mean - mean, m.mean - mean) for m in items)
    cov = scatter / (n - 1) if n > 1 else np.full_like(scatter, np.nan)
    return Moments(cols, n, mean, cov)
