"""End-to-end cleaning: configure -> fit (a handful of aggregation jobs) -> lazy
transform. Stages: structural (drop empty/sparse, coerce mixed text) -> refit IQR
bounds and scale groups on the repaired frame -> outliers -> straight-liners ->
imputation. ``report`` gives the before/after counts; ``cell_flags`` the per-cell
display state. Rows are only filtered, never re-joined, so per-row facts needed
later (original values, flags) travel as hidden columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import col, is_numeric_type, numeric_columns
from tessera.operators import outliers as O
from tessera.operators import profile as P
from tessera.operators.repair import ImputePlan, coerce_numeric, drop_columns, fit_impute

_HIDDEN = "__"


@dataclass(frozen=True)
class CleaningConfig:
    structural: bool = True
    drop_sparse: bool = True
    coerce_mixed: bool = True
    extra_drop: tuple[str, ...] = ()
    keep_sparse: tuple[str, ...] = ()     # sparse columns that stay
    keep_mixed: tuple[str, ...] = ()      # mixed-type columns that stay text
    outliers: bool = True
    outlier_action: str = "null"          # null | drop | ignore
    straightline: bool = True
    straightline_action: str = "drop"     # drop | ignore
    straightline_threshold: float = 0.0
    impute: bool = True
    strategy: str = "mean"                # mean | median
    per_column: Mapping[str, str] = field(default_factory=dict)
    id_columns: tuple[str, ...] = ()      # never part of scale groups
    row_id: str | None = None             # unique column that the two tables below refer to
    row_actions: DataFrame | None = None  # (row_id, action): null | drop | ignore, instead of outlier_action
    keep_rows: DataFrame | None = None    # (row_id): straight-liners that stay


@dataclass
class CleaningPlan:
    config: CleaningConfig
    columns: list[str]
    drop_cols: list[str]
    coerce_cols: list[str]
    bounds: O.IqrBounds
    groups: O.ScaleGroups
    impute_plan: ImputePlan | None

    # -- stages -------------------------------------------------------------
    def structural(self, df: DataFrame) -> DataFrame:
        return coerce_numeric(drop_columns(df, self.drop_cols), self.coerce_cols)

    def _marked(self, df: DataFrame) -> DataFrame:
        """Structural frame + hidden original values and flags (before any change)."""
        st = self.structural(df.select(*[col(c) for c in df.columns],
                                       *[col(c).alias(f"{_HIDDEN}o_{c}") for c in self.bounds.columns]))
        extra = {f"{_HIDDEN}f_{c}": self.bounds.flag(c) for c in self.bounds.columns}
        extra[f"{_HIDDEN}sl"] = self.groups.flag(self.config.straightline_threshold)
        extra[f"{_HIDDEN}any"] = self.bounds.any_flag()
        return st.withColumns(extra)

    def _apply(self, df: DataFrame) -> DataFrame:
        cfg = self.config
        out = self._marked(df)
        if cfg.outliers and (cfg.outlier_action != "ignore" or cfg.row_actions is not None):
            act = F.lit(cfg.outlier_action)
            if cfg.row_actions is not None:
                chosen = cfg.row_actions.select(col(cfg.row_id), F.col("action").alias(f"{_HIDDEN}act"))
                out = out.join(chosen, cfg.row_id, "left")
                act = F.coalesce(col(f"{_HIDDEN}act"), act)
            out = out.where(~(col(f"{_HIDDEN}any") & (act == "drop")))
            out = out.withColumns({c: F.when(col(f"{_HIDDEN}f_{c}") & (act == "null"), F.lit(None)).otherwise(col(c))
                                   for c in self.bounds.columns})
        if cfg.straightline and cfg.straightline_action == "drop":
            gone = col(f"{_HIDDEN}sl")
            if cfg.keep_rows is not None:
                kept = cfg.keep_rows.select(col(cfg.row_id)).distinct().withColumn(f"{_HIDDEN}keep", F.lit(True))
                out = out.join(kept, cfg.row_id, "left")
                gone = gone & col(f"{_HIDDEN}keep").isNull()
            out = out.where(~gone)
        if cfg.impute and self.impute_plan is not None:
            out = self.impute_plan.transform(out)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._apply(df)
        shown = [c for c in df.columns if c in out.columns]  # a join on the row id moves it in front
        return out.select(*map(col, shown))

    # -- reporting ------------------------------------------------------------
    def report(self, df: DataFrame) -> DataFrame:
        """One row: rows / null cells / outlier cells / straight-liners before and
        after, plus deltas. "Before" uses bounds and groups fitted on the raw frame;
        an outlier remains when its row survived with the original value."""
        raw_groups, counts = O.fit_groups_and_counts(df, exclude=self.config.id_columns)
        raw_bounds = O.fit_iqr_bounds(df, counts=counts)
        nulls = F.lit(0).cast("long")
        for c in df.columns:
            nulls = nulls + col(c).isNull().cast("long")
        outs = F.lit(0).cast("long")
        for c in raw_bounds.columns:
            outs = outs + raw_bounds.flag(c).cast("long")
        before = df.agg(F.count(F.lit(1)).alias("rows_before"), F.sum(nulls).cast("long").alias("nulls_before"),
                        F.sum(outs).cast("long").alias("outliers_before"),
                        F.count_if(raw_groups.flag(self.config.straightline_threshold)).alias("straightliners_before"))
        final = self._apply(df)
        visible = [c for c in final.columns if not c.startswith(_HIDDEN)]
        types = {f.name: f.dataType for f in df.schema.fields}
        null_after = F.lit(0).cast("long")
        for c in visible:
            null_after = null_after + col(c).isNull().cast("long")
        remain = F.lit(0).cast("long")
        for c in self.bounds.columns:
            if c not in visible or c in self.coerce_cols or not is_numeric_type(types[c]):
                continue
            same = F.coalesce(col(c).cast("double") == col(f"{_HIDDEN}o_{c}").cast("double"), F.lit(False))
            remain = remain + (col(f"{_HIDDEN}f_{c}") & same).cast("long")
        first = before.first()
        after = final.agg(F.count(F.lit(1)).alias("rows_after"), F.sum(null_after).cast("long").alias("nulls_after"),
                          F.coalesce(F.sum(remain), F.lit(0)).cast("long").alias("outliers_after"),
                          F.count_if(col(f"{_HIDDEN}sl")).alias("straightliners_after"))
        both = after.withColumns({n: F.lit(first[n]).cast("long") for n in before.columns})
        return both.select(
            "rows_before", "rows_after", (F.col("rows_after") - F.col("rows_before")).alias("rows_delta"),
            "nulls_before", "nulls_after", (F.col("nulls_after") - F.col("nulls_before")).alias("nulls_delta"),
            "outliers_before", "outliers_after",
            (F.col("outliers_after") - F.col("outliers_before")).alias("outliers_delta"),
            "straightliners_before", "straightliners_after",
            (F.col("straightliners_after") - F.col("straightliners_before")).alias("straightliners_delta"))

    def cell_flags(self, df: DataFrame, id_col: str, include_id: bool = True) -> DataFrame:
        """``(id, variable, state)`` for cells shown as null / outlier / straightline
        in the cleaned frame (later rule wins: straightline < outlier < null); the id
        column's own cells too unless ``include_id`` is off."""
        final = self._apply(df)
        visible = [c for c in df.columns if c in final.columns and (include_id or c != id_col)]
        items = []
        for c in visible:
            state = F.when(col(c).isNull(), F.lit("null"))
            if c in self.bounds.columns and c not in self.coerce_cols:
                same = F.coalesce(col(c).cast("double") == col(f"{_HIDDEN}o_{c}").cast("double"),
                                  F.lit(False))
                state = state.when(col(f"{_HIDDEN}f_{c}") & same, F.lit("outlier"))
            state = state.when(col(f"{_HIDDEN}sl"), F.lit("straightline"))
            items.append(F.struct(F.lit(c).alias("variable"), state.alias("state")))
        long = final.select(F.col(id_col), F.explode(F.array(*items)).alias("_kv")).select(id_col, "_kv.*")
        return long.where(F.col("state").isNotNull())


def fit_cleaning(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> CleaningPlan:
    cfg = config
    if cfg.row_id is None and (cfg.row_actions is not None or cfg.keep_rows is not None):
        raise ValueError("row actions and rows to keep need row_id")
    drop_cols: list[str] = list(cfg.extra_drop)
    coerce_cols: list[str] = []
    if cfg.structural:  # job 1: empty / sparse / mixed-type columns
        issues, mixed = P.structure_report(df)
        drop_cols += [c for c, i in issues.items() if i == "empty" or (i == "sparse" and cfg.drop_sparse and c not in cfg.keep_sparse)]
        if cfg.coerce_mixed:
            coerce_cols = [c for c in mixed if c not in drop_cols and c not in cfg.keep_mixed]
    plan = CleaningPlan(cfg, list(df.columns), drop_cols, coerce_cols, O.IqrBounds({}), O.ScaleGroups({}), None)
    st = plan.structural(df)
    # job 2: scale groups + value counts; job 3: exact quartiles of every numeric column
    plan.groups, counts = O.fit_groups_and_counts(st, exclude=cfg.id_columns)
    plan.bounds = O.fit_iqr_bounds(st, numeric_columns(st), counts=counts)
    if cfg.impute:
        staged = CleaningPlan(cfg, plan.columns, drop_cols, coerce_cols, plan.bounds, plan.groups, None)
        pre = staged.transform(df)
        plan.impute_plan = fit_impute(pre, cfg.strategy, cfg.per_column)
    return plan


def clean(df: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    return fit_cleaning(df, config).transform(df)


def diagnose(df: DataFrame, id_columns: Sequence[str] = ()) -> dict:
    """First diagnosis of a raw frame (small driver-side summary)."""
    bounds = O.fit_iqr_bounds(df)
    groups = O.fit_scale_groups(df, exclude=id_columns)
    return {
        "structural": [r.asDict() for r in P.structural_columns(df).collect()],
        "mixed": [r.asDict() for r in P.mixed_type_columns(df).collect()],
        "outliers": {r["variable"]: r["n_outliers"] for r in O.outlier_counts(df, bounds).collect()},
        "scale_groups": dict(groups.groups),
        "n_straightliners": df.where(groups.flag()).count(),
    }
