"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads the driver's Parquet tables under ``sf_dir`` (or fixtures that
are plain SQL projections of them, run unchanged by both engines) and runs one
tessera operator over the whole table. Floating results are rounded on both sides
so the order-insensitive value hash compares like with like."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.io import load_table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


#: Columns that tell the rows of ``lineitem`` apart, and the SQL of the sample that takes the first rows
#: by the hash of ``sampling.row_hash``.
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def sample_order(keys: list[str], seed: int = 42) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (both engines sum in different orders)."""
    fixes = {f.name: F.round(F.col(f.name), digits) for f in df.schema.fields
             if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(fixes) if fixes else df


# ---------------------------------------------------------------- fixtures
# Each is one SQL projection that both Spark and DuckDB run unchanged.

SURVEY_SQL = """
select o_orderkey as user_id, 1+o_orderkey%5 as q1, 1+o_custkey%5 as q2,
       1+cast(floor(o_totalprice) as bigint)%5 as q3,
       case when o_orderkey%11=0 then null else 1+cast(floor(o_orderkey/7) as bigint)%5 end as q4,
       o_totalprice as spend, o_orderpriority as segment
from orders
"""

HOLES_SQL = """
select o_orderkey, case when o_orderkey%13=0 then null else o_totalprice end as price,
       case when o_orderkey%17=0 then null else 1+o_orderkey%50 end as qty,
       case when o_orderkey%19=0 then null else o_orderstatus end as status,
       cast(null as double) as empty_col,
       case when o_orderkey%4=0 then o_totalprice end as sparse_col, o_orderkey%2 as flag01
from orders
"""

MIXED_SQL = """
select c_custkey, case when c_custkey%10=0 then 'n/d' when c_custkey%10=1 then '12d'
       when c_custkey%10=2 then null else cast(c_acctbal as string) end as bal_text, c_mktsegment
from customer
"""


# Three far groups of lines (two of them nearer to each other), and a point for each line number.
ISLANDS_SQL = """
select l_orderkey, l_linenumber, l_linenumber % 3 as island, 1000.0 * (l_linenumber % 3) + cast(l_quantity as double) as x,
       700.0 * (l_linenumber % 3) * (l_linenumber % 3) - cast(l_discount as double) as y
from lineitem
"""

# Three columns with one common factor, a copy of the first with little else in it, a constant, and
# holes in the third.
COMMON_SQL = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 + 6 * l_discount as a, l_quantity / 50 + 8 * l_tax as b,
       l_quantity / 50 + 6.1 * l_discount as near_a, 7.5 as fixed,
       case when l_partkey % 10 = 3 then null else l_quantity / 50 + (l_linenumber % 4) / 4.0 end as c
from lineitem
"""

STEPS_SQL = """
select l_orderkey, l_linenumber, cast(power(2, l_linenumber) as double) as x from lineitem
"""


def emb_sql(base: int) -> str:
    """Embedding fan-out to e0..e7 (Spark arrays are 0-based, DuckDB lists 1-based)."""
    cols = ", ".join(f"cast(embedding[{i + base}] as double) as e{i}" for i in range(8))
    return f"select vec_id, {cols}, label from embeddings"


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "survey":
        views(spark, sf_dir, "orders")
        return spark.sql(SURVEY_SQL)
    if name == "orders_holes":
        views(spark, sf_dir, "orders")
        return spark.sql(HOLES_SQL)
    if name == "mixed_text":
        views(spark, sf_dir, "customer")
        return spark.sql(MIXED_SQL)
    if name in ("islands", "steps", "common"):
        views(spark, sf_dir, "lineitem")
        return spark.sql({"islands": ISLANDS_SQL, "steps": STEPS_SQL, "common": COMMON_SQL}[name])
    if name == "emb_wide":
        views(spark, sf_dir, "embeddings")
        return spark.sql(emb_sql(0))
    raise KeyError(name)


def with_fixtures(sql: str, *names: str) -> str:
    defs = {"survey": SURVEY_SQL, "orders_holes": HOLES_SQL, "mixed_text": MIXED_SQL,
            "emb_wide": emb_sql(1), "islands": ISLANDS_SQL, "steps": STEPS_SQL, "common": COMMON_SQL}
    ctes = ",\n".join(f"{n} as ({defs[n]})" for n in names)
    return f"with {ctes}\n{sql}"

