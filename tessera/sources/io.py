"""Sources and sinks: CSV with the usual missing-value tokens, Parquet, row ids,
paging. Every loader maps NaN to NULL so missing values are one thing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import CSV_NULL_TOKENS, col, nan_to_null, to_number
from tessera.session import ensure_checkpoint_dir
from tessera.sources.csv_split import records

ROW_ID = "_row_id"
OVERFLOW = "__beyond_header"
WHOLE_PATTERN = r"^[+-]?[0-9]+$"
# Text read as booleans by the CSV type inference.
BOOL_TOKENS = ["True", "False", "TRUE", "FALSE", "true", "false"]


def read_csv(spark: SparkSession, path: str, infer_types: bool = True,
             null_tokens: Sequence[str] = CSV_NULL_TOKENS, multi_line: bool = True) -> DataFrame:
    """Header CSV read as text, missing tokens -> NULL, then types inferred per column
    from the cleaned text (a column is numeric when every non-null cell parses).

    Quotes follow RFC 4180: a doubled quote is a quote, quoted cells may hold separators
    and line ends. Large files are split among tasks all the same (``csv_split``; a record that
    crosses splits comes behind the others). ``multi_line=False`` saves the pass that this takes
    where no cell holds a line end. A row
    with fewer cells than the header is filled with NULL, one with more is an error.

    Type inference is one aggregation over the text; the typed frame is a lazy
    projection of the text frame."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", multi_line)
    header = reader.csv(path)
    too_long = F.raise_error(F.lit("CSV row with more cells than the header"))
    if multi_line:
        wider = ", ".join(f"c{i} string" for i in range(len(header.columns) + 1))
        cells = records(spark, path).where(~F.col("first")).select(F.from_csv("record", wider, {"escape": '"'}).alias("c")).select("c.*")
        raw = cells.toDF(*header.columns, OVERFLOW)
    else:
        wider = T.StructType([*header.schema.fields, T.StructField(OVERFLOW, T.StringType())])
        raw = reader.schema(wider).option("enforceSchema", True).csv(path)
    raw = raw.where(F.when(F.col(OVERFLOW).isNotNull(), too_long.cast("boolean")).otherwise(F.lit(True))).drop(OVERFLOW)
    tokens = list(null_tokens)
    cleaned = raw.select(*[F.when(col(c).isin(tokens), F.lit(None))
                           .otherwise(col(c)).alias(c) for c in raw.columns])
    if not infer_types or not cleaned.columns:
        return cleaned
    checks = []
    for c in cleaned.columns:
        s = F.trim(col(c))
        whole = s.rlike(WHOLE_PATTERN) & s.try_cast("bigint").isNotNull()
        checks.append(F.bool_and(col(c).isNull() | whole).alias(f"i_{c}"))
        checks.append(F.bool_and(col(c).isNull() | to_number(s).isNotNull()).alias(f"d_{c}"))
        checks.append(F.bool_and(col(c).isNull() | s.isin(BOOL_TOKENS)).alias(f"b_{c}"))
        checks.append(F.count(col(c)).alias(f"n_{c}"))
    res = cleaned.agg(*checks).first().asDict()
    out = []
    for c in cleaned.columns:
        s = F.trim(col(c))
        if res[f"n_{c}"] == 0:
            out.append(F.lit(None).cast("double").alias(c))  # all-missing column reads as float
        elif res[f"b_{c}"]:
            out.append(F.when(col(c).isNotNull(), F.lower(s) == "true").alias(c))
        elif res[f"i_{c}"]:
            out.append(s.try_cast("bigint").alias(c))  # every row parses; filters may meet the header first
        elif res[f"d_{c}"]:
            out.append(s.try_cast("double").alias(c))
        else:
            out.append(col(c).alias(c))
    return nan_to_null(cleaned.select(*out))


def load_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               where: str | None = None) -> DataFrame:
    """Parquet with NaN mapped to NULL. ``columns`` / ``where`` are applied to the raw
    scan, beneath the NaN projection, so they reach Parquet as ReadSchema and
    PushedFilters (a filter written on a float column *after* the projection is
    evaluated after the scan; filters on other types push down either way)."""
    raw = spark.read.parquet(path)
    if where is not None:
        raw = raw.where(where)
    if columns is not None:
        raw = raw.select(*columns)
    return nan_to_null(raw)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    out = df.drop(ROW_ID) if ROW_ID in df.columns else df
    writer = out.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """Attach a dense 0-based ``_row_id`` in partition order.

    With a unique ``key`` column it is a cast copy of it. Otherwise every partition's
    row count (one small aggregation: one row per input partition) gives its offset,
    and the id is offset + position inside the partition - JVM-only, no row passes
    through Python. The id is stable as long as the input is deterministic (a file
    scan); checkpoint or write a non-deterministic input first."""
    if key is not None:
        return df.withColumn(ROW_ID, col(key).cast("long"))
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", "_base", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    out = tagged.join(offsets, "_pid")  # one row for each input partition: Spark broadcasts it when small
    return out.withColumn(ROW_ID, F.col("_start") + F.col("_mid") - F.col("_base")).drop(
        "_pid", "_mid", "_base", "_start")


def page(df: DataFrame, number: int, size: int = 200, order_by: str = ROW_ID,
         dense_ids: bool = False) -> DataFrame:
    """Rows ``[(number-1)*size, number*size)`` in row order. With dense 0-based ids
    this is a pushed-down range filter; otherwise a sort + offset/limit."""
    if number < 1 or size < 1:
        raise ValueError("page number and size must be >= 1")
    start = (number - 1) * size
    if dense_ids:
        return df.where(F.col(order_by).between(start, start + size - 1)).orderBy(order_by)
    return df.orderBy(order_by).offset(start).limit(size)


def page_count(n_rows: int, size: int = 200) -> int:
    return max(1, (n_rows - 1) // size + 1)



PART = "_part"
INDEX = "_pages"
SCHEMA = "_schema"


def write_paged(df: DataFrame, path: str, order_by: Sequence[str] = (), rows_per_part: int = 100_000) -> None:
    """Write a table for paging: rows get dense ids in the order of ``order_by`` (else of the table's
    files) and lie in folders of ``rows_per_part`` rows; beside them the index (part, first id, rows)."""
    if order_by:  # the bounds of a range sort come from sampling: its order is pinned before it is numbered
        ensure_checkpoint_dir(df.sparkSession)
        df = df.orderBy(*map(col, order_by)).checkpoint(eager=True)
    numbered = with_row_id(df).withColumn(PART, F.expr(f"{ROW_ID} div {rows_per_part}"))
    numbered.repartition(PART).sortWithinPartitions(PART, ROW_ID).write.mode("overwrite").partitionBy(PART).parquet(f"{path}/rows")
    numbered.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/{SCHEMA}")  # an empty table has no folders
    written = paged_rows(df.sparkSession, path)
    index = written.groupBy(PART).agg(F.min(ROW_ID).alias("first_id"), F.count(F.lit(1)).alias("rows"))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/{INDEX}")  # one row for each part


def paged_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/{SCHEMA}").schema).parquet(f"{path}/rows")


def read_page(spark: SparkSession, path: str, number: int, size: int = 200) -> DataFrame:
    """Page ``number`` (from 1) of a table of :func:`write_paged`. The index names the folders that
    hold the page's ids; only these are read, however deep the page lies."""
    if number < 1 or size < 1:
        raise ValueError("page number and size must be >= 1")
    first = (number - 1) * size
    last = first + size - 1
    held = spark.read.parquet(f"{path}/{INDEX}").where((F.col("first_id") <= last) & (F.col("first_id") + F.col("rows") > first))
    parts = [r[0] for r in held.select(PART).collect()]  # the parts of one page
    rows = paged_rows(spark, path)
    return rows.where(F.col(PART).isin(parts) & F.col(ROW_ID).between(first, last)).drop(PART).orderBy(ROW_ID)


def paged_count(spark: SparkSession, path: str) -> int:
    """Rows of a table of :func:`write_paged`, from its index."""
    return spark.read.parquet(f"{path}/{INDEX}").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
