"""Column-level helpers: type predicates, numeric parsing, NaN handling, long format."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# Text accepted as a number by the guarded parser (trimmed), and the
# spellings of infinity it also accepts. Anything else parses to NULL.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_WORDS = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]

# The default missing-value tokens of a CSV reader (pandas defaults).
CSV_NULL_TOKENS = ["", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A",
                   "#NA", "-nan", "-NaN", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A"]


def col(name: str) -> Column:
    """Column by exact name (quoted, so dots, spaces and backticks are literal)."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dt: T.DataType, include_bool: bool = False) -> bool:
    if include_bool and isinstance(dt, T.BooleanType):
        return True
    return isinstance(dt, _NUMERIC)


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL)


def is_text_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def numeric_columns(df: DataFrame, include_bool: bool = False,
                    exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if f.name not in skip and is_numeric_type(f.dataType, include_bool)]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and is_text_type(f.dataType)]


def to_number(c: Column | str) -> Column:
    """Guarded text -> double parse. Plain decimal / scientific numbers and infinity
    are accepted after trimming; everything else (including 'nan') is NULL.
    ``try_cast`` alone would also accept trailing type suffixes such as '12d'."""
    col = F.col(c) if isinstance(c, str) else c
    s = F.trim(col.cast("string"))
    ok = s.rlike(NUMBER_PATTERN) | F.lower(s).isin(INFINITY_WORDS)
    return F.when(ok, s.try_cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Map NaN to NULL on every float column (missing values are one thing)."""
    fixes = {f.name: F.when(F.isnan(col(f.name)), F.lit(None).cast(f.dataType)).otherwise(col(f.name))
             for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(fixes) if fixes else df


def long_format(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
                value_type: str = "double", drop_nulls: bool = True) -> DataFrame:
    """Wide -> (keep..., variable, value) without a shuffle (explode of structs)."""
    items = [F.struct(F.lit(c).alias("variable"), col(c).cast(value_type).alias("value"))
             for c in columns]
    out = df.select(*keep, F.explode(F.array(*items)).alias("_kv")).select(*keep, "_kv.variable",
                                                                          "_kv.value")
    return out.where(F.col("value").isNotNull()) if drop_nulls else out


def any_null(columns: Sequence[str]) -> Column:
    cond = F.lit(False)
    for c in columns:
        cond = cond | col(c).isNull()
    return cond


def all_not_null(columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & col(c).isNotNull()
    return cond


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
