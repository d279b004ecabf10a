"""Repair operators: drop / coerce columns and null imputation.

Imputation reproduces an ordered, row-dropping procedure in a single fit job: the
statistic of column *c* is computed over the rows that survive every "drop rows"
column listed before *c*, expressed as a conditional aggregate, never as a loop of
jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import all_not_null, col, is_numeric_type, to_number
from tessera.operators.quantiles import modes, quantile_map

ACTIONS = ("mean", "median", "drop", "leave", "default")


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.drop(*present) if present else df


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: to_number(col(c)) for c in present}) if present else df


@dataclass(frozen=True)
class ImputePlan:
    order: tuple[str, ...]                      # columns that had nulls, in column order
    drops: tuple[str, ...] = ()                 # "drop rows" columns
    fills: Mapping[str, object] = field(default_factory=dict)
    round_to_int: tuple[str, ...] = ()          # filled columns rounded half-even -> bigint

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.where(all_not_null(self.drops)) if self.drops else df
        types = {f.name: f.dataType for f in df.schema.fields}
        exprs = {}
        for c, v in self.fills.items():
            # modes are learnt as text: cast the fill back to the column's type
            fill = F.lit(v) if isinstance(v, (int, float)) else F.lit(v).cast(types[c])
            if c in self.round_to_int:  # only the fill is rounded: cells that exist keep their value
                exprs[c] = F.coalesce(col(c).cast("bigint"), F.bround(fill.cast("double")).cast("bigint"))
            else:
                exprs[c] = F.coalesce(col(c), fill)
        return out.withColumns(exprs) if exprs else out


def fit_impute(df: DataFrame, strategy: str = "mean", per_column: Mapping[str, str] | None = None,
               columns: Sequence[str] | None = None) -> ImputePlan:
    """Learn fill values. ``strategy`` is the default (mean / median); ``per_column``
    maps a column to mean / median / drop / leave / default. Text columns are filled
    with their mode (smallest value on ties) whatever the numeric strategy.

    Columns are visited in order and a "drop rows" column removes rows from the
    statistics of every later column. A drop column without NULLs removes nothing,
    so each column's statistic can be conditioned on *all* earlier drop-configured
    columns up front: NULL counts, means and the all-whole check come from one
    aggregation; medians and modes (only if requested) from one more job each."""
    if strategy not in ("mean", "median"):
        raise ValueError("strategy must be 'mean' or 'median'")
    per_column = dict(per_column or {})
    cols = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    actions = {}
    for c in cols:
        a = per_column.get(c, "default")
        if a not in ACTIONS:
            raise ValueError(f"unknown imputation action {a!r} for {c}")
        actions[c] = strategy if a == "default" else a
    alive, earlier_drops = {}, []
    for c in cols:
        alive[c] = all_not_null(earlier_drops) if earlier_drops else F.lit(True)
        if actions[c] == "drop":
            earlier_drops.append(c)
    fillable = [c for c in cols if actions[c] in ("mean", "median")]
    numeric = [c for c in fillable if is_numeric_type(kinds[c])]
    aggs = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(numeric):
        x = F.when(alive[c], col(c).cast("double"))
        aggs.append(F.avg(x).alias(f"m{i}"))
        aggs.append(F.coalesce(F.bool_and(F.when(x.isNotNull(), x % 1 == 0)), F.lit(True)).alias(f"w{i}"))
    row = df.agg(*aggs).first()
    order = [c for i, c in enumerate(cols) if row[f"n{i}"] > 0]
    drops = [c for c in order if actions[c] == "drop"]
    stats, rounding = {}, []
    median_cols = [c for c in numeric if c in order and actions[c] == "median"]
    for i, c in enumerate(numeric):
        if c not in order:
            continue
        if actions[c] == "mean":
            stats[c] = row[f"m{i}"]
        if row[f"w{i}"]:
            rounding.append(c)
    if median_cols:
        med = quantile_map(df, {c: F.when(alive[c], col(c)) for c in median_cols}, [0.5])
        for c in median_cols:
            stats[c] = med[c][0]
    text = [c for c in fillable if c in order and c not in numeric]
    if text:
        sel = df.select(*[F.when(alive[c], col(c)).alias(c) for c in text])
        found = {r["variable"]: r["value"] for r in modes(sel, text).collect()}
        for c in text:
            stats[c] = found.get(c)
    fills = {}
    for c in order:
        if c not in stats:
            continue
        if stats[c] is None:
            raise ValueError(f"column {c!r} has no values to impute from")
        fills[c] = stats[c]
    return ImputePlan(tuple(order), tuple(drops), fills, tuple(c for c in rounding if c in fills))


def impute(df: DataFrame, strategy: str = "mean", per_column: Mapping[str, str] | None = None) -> DataFrame:
    return fit_impute(df, strategy, per_column).transform(df)
