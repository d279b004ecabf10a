"""IQR outliers and straight-line (zero within-row variance) respondents.

Fitting is one aggregation (exact quartiles, or per-column min/max); flags are
never materialised: they are column predicates evaluated inline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, numeric_columns
from tessera.operators.quantiles import quantile_map

IQR_FACTOR = 1.5        # fixed: fences at Q1 - 1.5 IQR and Q3 + 1.5 IQR
MIN_SCALE_ITEMS = 3     # fixed: a scale group needs at least 3 columns


@dataclass(frozen=True)
class IqrBounds:
    bounds: Mapping[str, tuple[float, float, float, float]]  # col -> (q1, q3, low, high)

    @property
    def columns(self) -> list[str]:
        return list(self.bounds)

    def flag(self, column: str, value: Column | None = None) -> Column:
        """True when the value lies strictly outside the fences; NULL -> False."""
        x = col(column) if value is None else value
        if column not in self.bounds:
            return F.lit(False)
        _, _, lo, hi = self.bounds[column]
        return F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))

    def any_flag(self, columns: Sequence[str] | None = None) -> Column:
        cond = F.lit(False)
        for c in columns or self.columns:
            cond = cond | self.flag(c)
        return cond

    def to_df(self, spark) -> DataFrame:
        rows = [(c, *v) for c, v in self.bounds.items()]
        return spark.createDataFrame(rows, "variable string, q1 double, q3 double, lower double, upper double")


def fit_iqr_bounds(df: DataFrame, columns: Sequence[str] | None = None, **kw) -> IqrBounds:
    """Exact quartiles (linear interpolation) for every numeric column in one job."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return IqrBounds({})
    if "counts" in kw and kw["counts"] is not None:
        kw["counts"] = {c: kw["counts"][c] for c in cols}
    q = quantile_map(df, cols, [0.25, 0.75], **kw)
    out = {}
    for c in cols:
        q1, q3 = q[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr)
    return IqrBounds(out)


def iqr_bounds_df(df: DataFrame, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    return fit_iqr_bounds(df, columns, **kw).to_df(df.sparkSession)


def outlier_cells(df: DataFrame, bounds: IqrBounds, id_col: str) -> DataFrame:
    """Long format of flagged cells -> ``(id, variable, value)``."""
    if not bounds.columns:
        return df.sparkSession.createDataFrame([], f"{id_col} long, variable string, value double")
    items = [F.struct(F.lit(c).alias("variable"), col(c).cast("double").alias("value"),
                      bounds.flag(c).alias("_f")) for c in bounds.columns]
    long = df.select(F.col(id_col), F.explode(F.array(*items)).alias("_kv")).select(id_col, "_kv.*")
    return long.where("_f").drop("_f")


def outlier_counts(df: DataFrame, bounds: IqrBounds) -> DataFrame:
    """``(variable, n_outliers)`` for columns with at least one flag (one aggregation)."""
    if not bounds.columns:
        return df.sparkSession.createDataFrame([], "variable string, n_outliers long")
    one = df.agg(*[F.count_if(bounds.flag(c)).alias(f"o{i}") for i, c in enumerate(bounds.columns)])
    items = [F.struct(F.lit(c).alias("variable"), F.col(f"o{i}").alias("n_outliers"))
             for i, c in enumerate(bounds.columns)]
    return one.select(F.inline(F.array(*items))).where(F.col("n_outliers") > 0)


def rows_with_outliers(df: DataFrame, bounds: IqrBounds) -> DataFrame:
    return df.where(bounds.any_flag())


def neutralize_outliers(df: DataFrame, bounds: IqrBounds, rows: DataFrame | None = None,
                        id_col: str | None = None) -> DataFrame:
    """Set flagged cells to NULL (every flagged row, or only ``rows`` ids)."""
    selected = F.lit(True)
    if rows is not None:
        df = df.join(rows.select(F.col(id_col), F.lit(True).alias("_sel")), id_col, "left")
        selected = F.coalesce(F.col("_sel"), F.lit(False))
    out = df.withColumns({c: F.when(selected & bounds.flag(c), F.lit(None)).otherwise(col(c))
                          for c in bounds.columns})
    return out.drop("_sel") if rows is not None else out


def drop_outlier_rows(df: DataFrame, bounds: IqrBounds) -> DataFrame:
    return df.where(~bounds.any_flag())


def apply_outliers(df: DataFrame, bounds: IqrBounds, default_action: str = "null",
                   actions: DataFrame | None = None, id_col: str | None = None) -> DataFrame:
    """Per-row action on rows with at least one flag: ``null`` (neutralise flagged
    cells), ``drop`` (remove the row) or ``ignore``. ``actions`` is an optional
    ``(id, action)`` table overriding the default for some rows; it is joined on the
    row id (broadcast when small, a shuffle join otherwise - Spark decides by size)."""
    for a in [default_action]:
        if a not in ("null", "drop", "ignore"):
            raise ValueError(f"unknown outlier action {a!r}")
    if actions is not None:
        df = df.join(actions.select(F.col(id_col), F.col("action").alias("_act")), id_col, "left")
        act = F.coalesce(F.col("_act"), F.lit(default_action))
    else:
        act = F.lit(default_action)
    flagged = bounds.any_flag()
    df = df.where(~(flagged & (act == "drop")))
    df = df.withColumns({c: F.when((act == "null") & bounds.flag(c), F.lit(None)).otherwise(col(c))
                         for c in bounds.columns})
    return df.drop("_act") if actions is not None else df


# ----------------------------------------------------------------- straight-lining

@dataclass(frozen=True)
class ScaleGroups:
    groups: Mapping[str, tuple[str, ...]] = field(default_factory=dict)  # label -> columns

    def flag(self, threshold: float = 0.0) -> Column:
        cond = F.lit(False)
        for cols in self.groups.values():
            cond = cond | row_variance_at_most(cols, threshold)
        return cond


def fit_scale_groups(df: DataFrame, columns: Sequence[str] | None = None,
                     exclude: Sequence[str] = ()) -> ScaleGroups:
    """Group numeric columns by their (min, max) truncated to integers; keep groups of
    at least 3 columns (survey item blocks). One aggregation job."""
    return fit_groups_and_counts(df, columns, exclude)[0]


def fit_groups_and_counts(df: DataFrame, columns: Sequence[str] | None = None,
                          exclude: Sequence[str] = ()) -> tuple[ScaleGroups, dict[str, int]]:
    """Scale groups plus the non-null count of every numeric column (the sizing input
    of exact quantiles), from one aggregation job."""
    every = numeric_columns(df)
    cols = list(columns) if columns is not None else numeric_columns(df, exclude=exclude)
    cols = [c for c in cols if c not in set(exclude)]
    aggs = [F.count(col(c)).alias(f"n{i}") for i, c in enumerate(every)]
    aggs += [F.min(col(c)).cast("double").alias(f"a{i}") for i, c in enumerate(cols)]
    aggs += [F.max(col(c)).cast("double").alias(f"b{i}") for i, c in enumerate(cols)]
    if not aggs:
        return ScaleGroups({}), {}
    row = df.agg(*aggs).first()
    counts = {c: int(row[f"n{i}"]) for i, c in enumerate(every)}
    groups: dict[str, list[str]] = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"a{i}"], row[f"b{i}"]
        if lo is None:
            continue
        label = f"range_{int(lo)}_{int(hi)}"
        groups.setdefault(label, []).append(c)
    return ScaleGroups({k: tuple(v) for k, v in groups.items() if len(v) >= MIN_SCALE_ITEMS}), counts


def row_variance_at_most(columns: Sequence[str], threshold: float = 0.0) -> Column:
    """Row-wise sample variance (ddof 1, NULLs skipped) <= threshold; fewer than two
    values -> not flagged. Threshold 0 is an exact min == max test."""
    a = F.array_compact(F.array(*[col(c).cast("double") for c in columns]))
    enough = F.size(a) >= 2
    if threshold == 0.0:
        return enough & (F.array_min(a) == F.array_max(a))
    n = F.size(a).cast("double")
    mean = F.try_divide(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x), n)
    ss = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return enough & F.coalesce(F.try_divide(ss, n - 1) <= F.lit(threshold), F.lit(False))


def straightliners(df: DataFrame, groups: ScaleGroups, threshold: float = 0.0) -> DataFrame:
    return df.where(groups.flag(threshold))


def drop_straightliners(df: DataFrame, groups: ScaleGroups, threshold: float = 0.0,
                        keep: DataFrame | None = None, id_col: str | None = None) -> DataFrame:
    """Remove flagged rows, except ids listed in ``keep`` (left-anti join logic)."""
    flagged = groups.flag(threshold)
    if keep is None:
        return df.where(~flagged)
    marked = df.join(keep.select(F.col(id_col), F.lit(True).alias("_keep")), id_col, "left")
    return marked.where(~flagged | F.col("_keep").isNotNull()).drop("_keep")
