"""Deterministic samples: the first ``k`` rows of each group in the order of a seeded
row hash. Never sorts a whole group in one task.

Spark turns ``row_number() <= k`` into a partial WindowGroupLimit only for small
``k`` (``spark.sql.optimizer.windowGroupLimitThreshold``). For larger ``k`` each
group is first thinned by a hash threshold chosen from its size so that about
``OVERSAMPLE * k`` rows survive; the surviving rows are exactly the ones with the
smallest hash keys, so the top ``k`` among them is the top ``k`` of the group
(large groups learn their threshold from a broadcast, so their rows are not moved first)
whenever at least ``k`` survive - checked, with an exact pass for any group that
came up short (probability negligible)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.session import pinned

OVERSAMPLE = 3.0
#: A group with more than this share of the rows is large: there are at most 1 / HOT_SHARE.
HOT_SHARE = 1 / 1000
#: Copies of equal rows that one row and task numbers.
CHUNK = 10_000
#: Rows that a task rebuilds.
TASK_ROWS = 1_000_000
_SCALE = float(1 << 32)


def row_hash(seed: int, columns: Sequence[str]) -> Column:
    """The hex md5 of ``seed|value|value...`` (nulls are left out): any engine with md5 draws the
    same sample where the values print alike (integers, texts, dates)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(c).cast("string") for c in columns]))


def unit(hashed: Column) -> Column:
    """A number in [0, 1) from the first eight digits of a hex hash."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / F.lit(_SCALE)


def with_ordinals(df: DataFrame, name: str = "_ordinal") -> DataFrame:
    """Tell equal rows apart: each group of equal rows is numbered 1..m. Without a key column
    this is what makes a row hash a property of the row and not of its values. Copies are made in
    chunks of ``CHUNK``, dealt among the tasks where a group has several."""
    many = df.groupBy(*map(col, df.columns)).agg(F.count(F.lit(1)).alias("_m"))
    chunks = many.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_m - 1) div {CHUNK}"))))
    # by number: small chunk rows are not coalesced; a task makes about a million rows
    rows = many.agg(F.sum("_m")).first()[0] or 0
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    dealt = chunks.repartition(tasks, *map(col, df.columns), "_c")
    first = F.col("_c") * CHUNK
    copies = F.sequence(first + 1, F.least(first + CHUNK, F.col("_m")))
    return dealt.withColumn(name, F.explode(copies)).drop("_m", "_c")


def first_k(df: DataFrame, k: int, seed: int = 42, key: Sequence[str] | None = None,
            by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` that are among the first ``k`` of their group by row hash. ``key``
    names columns that tell rows apart; without it equal rows are numbered first (one
    shuffle of the table)."""
    by, out = list(by), list(df.columns)
    rows = df if key else with_ordinals(df)
    cols = list(key) if key else rows.columns
    keyed = rows.withColumn("_h", row_hash(seed, cols))
    if not key:
        keyed = keyed.drop("_ordinal")
    if not by:
        return keyed.orderBy("_h").limit(k).select(*map(col, out))  # TakeOrderedAndProject
    keyed = keyed.withColumn("_u", unit(F.col("_h")))
    w = Window.partitionBy(*map(col, by)).orderBy("_h")
    counts = pinned(keyed.groupBy(*map(col, by)).agg(F.count(F.lit(1)).alias("_n")), "sample-groups")
    limit = F.col("_u") < F.least(F.lit(1.0), F.lit(OVERSAMPLE * k) / F.col("_n"))
    # groups with more than HOT_SHARE of the rows (1,000 at most) are thinned where their rows lie
    hot = F.col("_n") > (counts.agg(F.sum("_n")).first()[0] or 0) * HOT_SHARE
    large, small = F.broadcast(counts.where(hot)), counts.where(~hot)
    thin = keyed.join(large, by).where(limit)
    if not small.isEmpty():
        thin = thin.unionByName(keyed.join(large, by, "left_anti").join(small, by).where(limit))
    top = thin.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    got = top.groupBy(*map(col, by)).agg(F.count(F.lit(1)).alias("_got"))
    short = counts.join(got, by, "left").where(F.coalesce(F.col("_got"), F.lit(0)) < F.least(F.col("_n"), F.lit(k)))
    if short.limit(1).count() == 0:
        return top.drop("_u", "_h", "_n", "_rn")
    # exact pass for the few groups whose thinning kept fewer than k rows
    redo = (keyed.join(short.select(*map(col, by)), by, "left_semi")
                 .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k))
    good = top.join(short.select(*map(col, by)), by, "left_anti").drop("_n")
    return good.unionByName(redo).drop("_u", "_h", "_rn")
