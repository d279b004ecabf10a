"""Column profiling and structural diagnosis (one wide aggregation per call)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import col, is_numeric_type, is_text_type, to_number

# Class labels and thresholds of the profiling rule.
KIND_CONTINUOUS = "continuous"
KIND_DISCRETE = "discrete"
KIND_ID = "id"
KIND_CAT_LOW = "categorical_low"
KIND_CAT_HIGH = "categorical_high"
ID_RATIO = 0.95            # numeric / text id: unique ratio above this ...
ID_MIN_UNIQUE = 20         # ... and more than this many distinct values
LOW_MAX_UNIQUE = 20        # numeric discrete / text low-cardinality: at most this many
OTHER_LOW_MAX_UNIQUE = 10  # other types: low-cardinality at most this many
OTHER_ID_RATIO = 0.80      # other types: id above this ratio
SPARSE_SHARE = 0.60        # sparse column: null share >= this (and < 1)
MIXED_SUCCESS = 0.50       # mixed-type column: parse success share above this


def _family(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType) or is_numeric_type(dt):
        return "numeric"
    if is_text_type(dt):
        return "text"
    return "other"


def _as_text(x: Column, dt: T.DataType) -> Column:
    """A text that is equal for equal values of a column and different for different ones."""
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return (x + F.lit(0.0)).cast("string")  # both zeros are one value
    if isinstance(dt, T.BinaryType):
        return F.hex(x)
    if isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(x.isNotNull(), F.to_json(F.struct(x.alias("v"))))
    return x.cast("string")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(variable, n_unique)`` by long rows of two columns: (column number, value) pairs are made
    distinct before and after one shuffle, however many columns there are, where an aggregate of
    many ``count(distinct)`` would multiply rows as wide as the table. Columns without values
    are absent."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    items = [F.struct(F.lit(i).alias("v"), _as_text(col(c), kinds[c]).alias("value")) for i, c in enumerate(columns)]
    long = df.select(F.explode(F.array(*items)).alias("_kv")).select("_kv.*").where(F.col("value").isNotNull())
    per = long.groupBy("v", "value").agg(F.lit(1).alias("one")).groupBy("v").agg(F.count(F.lit(1)).alias("n_unique"))
    return per.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("v") + 1).alias("variable"), "n_unique")


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column: ``variable, dtype, kind, n_unique, unique_ratio, n_rows,
    n_non_null, all_integral``. One aggregation and, for exact distinct counts, one table of
    long rows (:func:`distinct_counts`); ``exact=False`` takes sketches instead. Classification is
    a lazy ``case when`` over the result rows."""
    cols = list(columns or df.columns)
    fields = {f.name: f for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = col(c)
        if not exact:
            aggs.append(F.approx_count_distinct(x).alias(f"u{i}"))
        aggs.append(F.count(x).alias(f"c{i}"))
        fam = _family(fields[c].dataType)
        if fam == "numeric":
            v = x.cast("double")
            aggs.append(F.coalesce(F.bool_and(F.isnull(v) | (v % 1 == 0)), F.lit(True)).alias(f"w{i}"))
        else:
            aggs.append(F.lit(None).cast("boolean").alias(f"w{i}"))
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("variable"),
                      F.lit(fields[c].dataType.simpleString()).alias("dtype"),
                      F.lit(_family(fields[c].dataType)).alias("family"),
                      (F.lit(0) if exact else F.col(f"u{i}")).cast("long").alias("n_unique"),
                      F.col(f"c{i}").alias("n_non_null"),
                      F.col(f"w{i}").alias("all_integral"))
             for i, c in enumerate(cols)]
    out = one.select(F.col("_n").alias("n_rows"), F.inline(F.array(*items)))
    if exact:
        out = out.drop("n_unique").join(distinct_counts(df, cols), "variable", "left").fillna(0, ["n_unique"])
    ratio = F.when(F.col("n_rows") > 0, F.col("n_unique") / F.col("n_rows")).otherwise(F.lit(0.0))
    out = out.withColumn("unique_ratio", ratio)
    out = out.withColumn("kind", classify(F.col("family"), F.col("n_unique"), F.col("unique_ratio"),
                                          F.col("all_integral")))
    return out.select("variable", "dtype", "kind", "n_unique", "unique_ratio", "n_rows", "n_non_null",
                      "all_integral")


def classify(family: Column, n: Column, ratio: Column, integral: Column) -> Column:
    is_id = (ratio > ID_RATIO) & (n > ID_MIN_UNIQUE)
    numeric = (F.when(~integral, F.lit(KIND_CONTINUOUS))
                .when(is_id, F.lit(KIND_ID))
                .when(n <= LOW_MAX_UNIQUE, F.lit(KIND_DISCRETE))
                .otherwise(F.lit(KIND_CONTINUOUS)))
    text = (F.when(is_id, F.lit(KIND_ID)).when(n <= LOW_MAX_UNIQUE, F.lit(KIND_CAT_LOW))
             .otherwise(F.lit(KIND_CAT_HIGH)))
    other = (F.when(n <= OTHER_LOW_MAX_UNIQUE, F.lit(KIND_CAT_LOW))
              .when(ratio > OTHER_ID_RATIO, F.lit(KIND_ID)).otherwise(F.lit(KIND_CAT_HIGH)))
    return F.when(family == "numeric", numeric).when(family == "text", text).otherwise(other)


def profile_dict(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> dict:
    """Collected profile ``{variable: {...}}`` for planning (one small row per column)."""
    return {r["variable"]: r.asDict() for r in profile(df, columns, exact).collect()}


def _first_values(df: DataFrame, order_col: str, cols: Sequence[str], k: int, sep: str) -> DataFrame:
    items = [F.struct(F.lit(c).alias("variable"), col(c).cast("string").alias("value"))
             for c in cols]
    long = (df.select(F.col(order_col).alias("_ord"), F.explode(F.array(*items)).alias("_kv"))
              .select("_ord", "_kv.*").where(F.col("value").isNotNull()))
    first = long.groupBy("variable", "value").agg(F.min("_ord").alias("_first"))
    w = Window.partitionBy("variable").orderBy("_first")
    top = first.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return top.groupBy("variable").agg(
        F.count(F.lit(1)).alias("_found"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", "value"))),
                                 lambda s: s["value"]), sep).alias("sample_values"))


def sample_values(df: DataFrame, order_col: str, columns: Sequence[str] | None = None,
                  k: int = 10, sep: str = ", ") -> DataFrame:
    """First ``k`` distinct non-null values of each column in order of appearance
    -> ``(variable, sample_values)``: distinct (column, value) pairs with their first
    position, and a per-column row_number filter planned as a partial WindowGroupLimit
    before the shuffle. By default all columns but ``order_col``; name it in ``columns``
    to have it too."""
    cols = list(columns) if columns is not None else [c for c in df.columns if c != order_col]
    return _first_values(df, order_col, cols, k, sep).drop("_found")


def null_summary(df: DataFrame, columns: Sequence[str] | None = None,
                 only_with_nulls: bool = True) -> DataFrame:
    """``(variable, dtype, null_count, null_share, n_rows)`` from one aggregation."""
    cols = list(columns or df.columns)
    dtypes = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(col(c).isNull()).alias(f"z{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("variable"), F.lit(dtypes[c]).alias("dtype"),
                      F.col(f"z{i}").alias("null_count")) for i, c in enumerate(cols)]
    out = one.select(F.col("_n").alias("n_rows"), F.inline(F.array(*items)))
    out = out.withColumn("null_share", F.when(F.col("n_rows") > 0, F.col("null_count") / F.col("n_rows"))
                         .otherwise(F.lit(0.0)))
    if only_with_nulls:
        out = out.where(F.col("null_count") > 0)
    return out.select("variable", "dtype", "null_count", "null_share", "n_rows")


def null_totals(df: DataFrame) -> DataFrame:
    """One row: ``n_rows, n_null_cells``."""
    total = F.lit(0).cast("long")
    for c in df.columns:
        total = total + col(c).isNull().cast("long")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(total).cast("long").alias("n_null_cells"))


def rows_with_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cond = F.lit(False)
    for c in columns or df.columns:
        cond = cond | col(c).isNull()
    return df.where(cond)


def structural_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(variable, null_share, issue)`` with issue ``empty`` (all null) or ``sparse``
    (null share >= 0.60 and < 1)."""
    s = null_summary(df, columns, only_with_nulls=True)
    issue = (F.when(F.col("null_share") == 1.0, F.lit("empty"))
              .when(F.col("null_share") >= SPARSE_SHARE, F.lit("sparse")))
    return s.select("variable", "null_share", issue.alias("issue")).where(F.col("issue").isNotNull())


def empty_columns(df: DataFrame) -> list[str]:
    return [r["variable"] for r in structural_columns(df).where("issue = 'empty'").collect()]


def sparse_columns(df: DataFrame) -> list[str]:
    return [r["variable"] for r in structural_columns(df).where("issue = 'sparse'").collect()]


def mixed_type_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-numeric columns where most non-null cells parse as numbers but some do
    not -> ``(variable, n_non_null, n_numeric, success_rate)``."""
    cols = [f.name for f in df.schema.fields
            if (columns is None or f.name in columns) and _family(f.dataType) != "numeric"]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "variable string, n_non_null long, n_numeric long, success_rate double")
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(col(c)).alias(f"c{i}"), F.count(to_number(col(c))).alias(f"p{i}")]
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("variable"), F.col(f"c{i}").alias("n_non_null"),
                      F.col(f"p{i}").alias("n_numeric")) for i, c in enumerate(cols)]
    out = one.select(F.inline(F.array(*items)))
    out = out.withColumn("success_rate", F.try_divide(F.col("n_numeric"), F.col("n_non_null")))
    return out.where((F.col("n_numeric") > 0) & (F.col("success_rate") > MIXED_SUCCESS) &
                     (F.col("n_numeric") < F.col("n_non_null")))


def mixed_type_rows(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """Cells that fail the numeric parse -> ``(id, variable, value)``."""
    items = [F.struct(F.lit(c).alias("variable"), col(c).cast("string").alias("value"),
                      to_number(col(c)).alias("_num")) for c in columns]
    long = df.select(F.col(id_col), F.explode(F.array(*items)).alias("_kv")).select(id_col, "_kv.*")
    return long.where(F.col("value").isNotNull() & F.col("_num").isNull()).drop("_num")


def integral_columns(df: DataFrame) -> list[str]:
    prof = profile(df, exact=False)
    return [r["variable"] for r in prof.where("all_integral and n_non_null > 0").collect()]


# Value-type names reported per Spark type family (the Python type a
# cell would have).
_TYPE_NAMES = {"integral": "int", "fractional": "float", "text": "str", "boolean": "bool",
               "timestamp": "Timestamp", "date": "date"}


def _type_name(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _TYPE_NAMES["integral"]
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return _TYPE_NAMES["fractional"]
    if isinstance(dt, T.BooleanType):
        return _TYPE_NAMES["boolean"]
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return _TYPE_NAMES["timestamp"]
    if isinstance(dt, T.DateType):
        return _TYPE_NAMES["date"]
    return _TYPE_NAMES["text"] if is_text_type(dt) else dt.simpleString()


def sample_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count of non-null cells per value type: ``(variable, value_type, n)``. Spark
    columns hold one type, so each column has one row (none when all NULL)."""
    cols = list(columns or df.columns)
    fields = {f.name: f for f in df.schema.fields}
    one = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    items = [F.struct(F.lit(c).alias("variable"), F.lit(_type_name(fields[c].dataType)).alias("value_type"),
                      F.col(f"c{i}").alias("n")) for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*items))).where(F.col("n") > 0)


def structure_report(df: DataFrame) -> tuple[dict[str, str], list[str]]:
    """One aggregation giving both structural findings: ``({column: 'empty' |
    'sparse'}, [mixed-type text columns])``."""
    fields = df.schema.fields
    text = [f.name for f in fields if _family(f.dataType) != "numeric"]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"z{i}") for i, f in enumerate(fields)]
    for i, c in enumerate(text):
        aggs += [F.count(col(c)).alias(f"c{i}"), F.count(to_number(col(c))).alias(f"p{i}")]
    row = df.agg(*aggs).first()
    n = row["_n"]
    issues = {}
    for i, f in enumerate(fields):
        share = row[f"z{i}"] / n if n else 0.0
        if share == 1.0:
            issues[f.name] = "empty"
        elif share >= SPARSE_SHARE:
            issues[f.name] = "sparse"
    mixed = []
    for i, c in enumerate(text):
        nn, parsed = row[f"c{i}"], row[f"p{i}"]
        if parsed > 0 and parsed / nn > MIXED_SUCCESS and parsed < nn:
            mixed.append(c)
    return issues, mixed
