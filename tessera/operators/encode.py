"""Encoding: one-hot dummies for low-cardinality columns and z-scores."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, is_numeric_type, numeric_columns



@dataclass(frozen=True)
class OneHotModel:
    levels: Mapping[str, tuple]  # column -> sorted category values

    def transform(self, df: DataFrame) -> DataFrame:
        """Drop each encoded column and append ``col_value`` tinyint dummies (sorted
        categories, NULL -> all zeros) after the remaining columns."""
        cols = [c for c in self.levels if c in df.columns]
        keep = [col(c) for c in df.columns if c not in cols]
        dummies = []
        for c in cols:
            for v in self.levels[c]:
                dummies.append(F.coalesce((col(c) == F.lit(v)).cast("tinyint"), F.lit(0).cast("tinyint"))
                               .alias(f"{c}_{v}"))
        return df.select(*keep, *dummies)


def fit_one_hot(df: DataFrame, columns: Sequence[str], max_levels: int | None = None) -> OneHotModel:
    """Learn the sorted distinct values of each column by one distributed ``distinct``;
    every level becomes a column. ``max_levels`` (none by default) makes a column with more
    distinct values an error, counted exactly before any level is collected."""
    cols = [c for c in columns if c in df.columns]
    if not cols:
        return OneHotModel({})
    # distinct levels by a distributed group-by (a global collect_set would merge one
    # set per partition in a single task); levels travel as text with the typed value beside them (one row per level)
    items = [F.struct(F.lit(c).alias("variable"), col(c).cast("string").alias("level"),
                      F.to_json(F.struct(col(c).alias("v"))).alias("typed"))
             for c in cols]
    distinct = (df.select(F.explode(F.array(*items)).alias("_kv")).select("_kv.*")
                  .where(F.col("level").isNotNull()).distinct())
    if max_levels is not None:
        big = [r[0] for r in distinct.groupBy("variable").count().where(F.col("count") > max_levels).collect()]
        if big:
            raise ValueError(f"more than {max_levels} levels: {sorted(big)}")
    found = distinct.collect()
    levels: dict[str, list] = {c: [] for c in cols}
    for r in found:
        levels[r["variable"]].append(json.loads(r["typed"])["v"])
    return OneHotModel({c: tuple(sorted(levels[c])) for c in cols})


def one_hot(df: DataFrame, columns: Sequence[str] | None = None,
            profile: Mapping[str, Mapping] | None = None, keep_numeric: bool = False) -> DataFrame:
    """Encode ``columns``, or every column profiled ``categorical_low``. Columns no
    longer present are skipped; columns numeric by now are skipped unless
    ``keep_numeric`` (they may have been coerced after profiling)."""
    if columns is None:
        if profile is None:
            from tessera.operators.profile import profile_dict
            profile = profile_dict(df)
        columns = [c for c, m in profile.items() if m["kind"] == "categorical_low"]
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [c for c in columns if c in types and (keep_numeric or not is_numeric_type(types[c]))]
    return fit_one_hot(df, cols).transform(df)


@dataclass(frozen=True)
class ZScoreModel:
    stats: Mapping[str, tuple[float, float]]  # column -> (mean, population std or 1)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (col(c).cast("double") - F.lit(m)) / F.lit(s)
                               for c, (m, s) in self.stats.items()})

    def inverse(self, column: str, value: float) -> float:
        m, s = self.stats[column]
        return value * s + m


def fit_zscore(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = (),
               profile: Mapping[str, Mapping] | None = None, skip_binary: bool = True) -> ZScoreModel:
    """Mean and population std of numeric columns (one aggregation). Skipped:
    excluded columns, columns profiled categorical, and 0/1 columns (including
    all-null and constant 0 or 1). A zero std is replaced by 1."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    skip = set(exclude)
    if profile:
        skip |= {c for c, m in profile.items() if str(m.get("kind", "")).startswith("categorical")}
    cols = [c for c in cols if c not in skip]
    if not cols:
        return ZScoreModel({})
    aggs = []
    for i, c in enumerate(cols):
        x = col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"),
                 F.coalesce(F.bool_and(F.when(x.isNotNull(), x.isin(0.0, 1.0))), F.lit(True)).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    stats = {}
    for i, c in enumerate(cols):
        if skip_binary and row[f"b{i}"]:
            continue
        m, s = row[f"m{i}"], row[f"s{i}"]
        if m is None:
            continue
        stats[c] = (m, s if s not in (None, 0.0) else 1.0)
    return ZScoreModel(stats)


def zscore(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = (),
           profile: Mapping[str, Mapping] | None = None) -> DataFrame:
    return fit_zscore(df, columns, exclude, profile).transform(df)
