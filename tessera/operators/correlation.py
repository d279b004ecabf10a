"""Correlation matrices (Pearson from one moments job; Spearman as Pearson of average ranks
that are written beside each row; Kendall tau-b by distributed inversion counting, all pairs
of columns in one table) and category codes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import all_not_null, col, numeric_columns, text_columns
from tessera.operators.moments import moments
from tessera.operators.quantiles import BUCKET_ROWS, row_ranks
from tessera.session import pinned


def category_codes(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Replace a text column by the index of its value in the sorted list of distinct
    values (NULL -> -1). Distinct values are range-sorted by Spark and checkpointed
    (the range bounds come from sampling, so the sorted order is pinned before it is
    numbered); the dense index is the JVM-only partition-offset numbering of
    ``with_row_id``. The code table is joined back (broadcast when small)."""
    from tessera.session import ensure_checkpoint_dir
    from tessera.sources.io import ROW_ID, with_row_id
    ensure_checkpoint_dir(df.sparkSession)
    levels = (df.select(col(column).alias("_lvl")).where(F.col("_lvl").isNotNull()).distinct()
                .orderBy("_lvl").checkpoint(eager=True))
    codes = with_row_id(levels).withColumnRenamed(ROW_ID, "_code")
    # NULLs match nothing and stay where they are: no join key collects them
    out = df.join(codes, col(column) == F.col("_lvl"), "left")
    return out.withColumn(name or column, F.coalesce(F.col("_code"), F.lit(-1)).cast("long")).drop("_lvl", "_code")


def rank_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its average rank (ties share the mean rank); see
    ``quantiles.row_ranks``."""
    return row_ranks(df, columns)


def _prepare(df: DataFrame, columns: Sequence[str] | None, include_categorical: bool) -> tuple[DataFrame, list[str]]:
    if include_categorical:
        for c in text_columns(df):
            if columns is None or c in columns:
                df = category_codes(df, c)
    cols = list(columns) if columns is not None else numeric_columns(df)
    cols = [c for c in cols if c in numeric_columns(df)]
    return df.select(*map(col, cols)).where(all_not_null(cols)), cols


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson",
                       include_categorical: bool = False) -> tuple[list[str], np.ndarray]:
    """p x p matrix over rows complete in every selected column; empty for < 2
    columns; a constant column gives NaN (diagonal included)."""
    data, cols = _prepare(df, columns, include_categorical)
    if len(cols) < 2:
        return cols, np.zeros((0, 0))
    if method == "pearson":
        return cols, moments(data, cols).corr()
    if method == "spearman":
        # the ranked frame feeds two jobs (mean shift, sums): keep it instead of
        # recomputing the rank table and its joins
        ranked = rank_columns(data, cols).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return cols, moments(ranked, cols).corr()
        finally:
            ranked.unpersist()
    if method == "kendall":
        return cols, kendall_matrix(data, cols)
    raise ValueError(f"unsupported correlation method {method!r}")


def correlation(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson",
                include_categorical: bool = False, clip: bool = False) -> DataFrame:
    """Long form ``(x, y, r)`` of the correlation matrix (heat-map cells when
    ``clip`` fixes values to [-1, 1])."""
    cols, m = correlation_matrix(df, columns, method, include_categorical)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = float(m[i, j])
            v = None if np.isnan(v) else (min(1.0, max(-1.0, v)) if clip else v)
            rows.append((a, b, v))
    return df.sparkSession.createDataFrame(rows, "x string, y string, r double")


def weighted_inversions(order: np.ndarray, weight: np.ndarray) -> int:
    """Sum over positions p < q with ``order[p]`` > ``order[q]`` of the product of their weights: bit by bit
    from the highest on, the numbers that agree above a bit meet where they differ in it."""
    code = np.unique(order, return_inverse=True)[1]
    total, w = 0, weight.astype(np.int64)
    for bit in range(int(code.max()).bit_length() - 1 if len(code) else -1, -1, -1):
        one = (code >> bit) & 1 == 1
        node = code >> (bit + 1)  # non-decreasing: codes are kept in order of their higher bits
        ones = np.cumsum(np.where(one, w, 0))
        first = np.flatnonzero(np.r_[True, np.diff(node) > 0])
        before = np.repeat(np.r_[0, ones][first], np.diff(np.r_[first, len(code)]))
        met = w[~one] * (ones - before)[~one]
        total += int(met.sum()) if len(met) < 2 or float(w.sum()) ** 2 < 2.0 ** 62 else sum(met.astype(object))
        where = np.argsort(2 * node + one, kind="stable")
        code, w = code[where], w[where]
    return total


RANGES = "i int, j int, x double, y double, c long, g int, inside decimal(38, 0)"
MEETINGS = "i int, j int, g int, h int, c long, inside decimal(38, 0)"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted partition, all of one pair of columns at a time."""
    held = list(batches)  # about ``bucket`` rows
    if not held:
        return
    table = pa.Table.from_batches(held)
    i, j = table["i"].to_numpy(), table["j"].to_numpy()
    edges = [*np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0)]).tolist(), len(i)]
    for at, end in zip(edges[:-1], edges[1:], strict=True):
        yield table.slice(at, end - at).combine_chunks()


def kendall_matrix(data: DataFrame, columns: Sequence[str], bucket: int = BUCKET_ROWS) -> np.ndarray:
    """Exact Kendall tau-b of all pairs of columns over rows complete in them, without forming
    pairs of rows and in a number of jobs that does not depend on the number of columns.

    The cells (distinct values x and y with their count) of all pairs of columns are cut into ranges g of
    about ``bucket`` cells in the order of (x, y), then into ranges h in the order of (y, x). Two cells are
    discordant where the first by (x, y) has the larger y. Those in one range g are counted in its sorted
    partition, those of other ranges g in one range h are the inversions of g in the order of (y, x), and
    those that differ in both follow from the totals of (g, h). Pairs that are tied in x, y or both are counted by
    value. Every cell is shuffled three times, whatever the number of rows."""
    columns = list(columns)
    p, bucket = len(columns), max(1, bucket)
    m = np.full((p, p), np.nan)
    wide = "decimal(38, 0)"
    ties = F.sum(F.col("c").cast(wide) * (F.col("c") - 1))
    every = data.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), col(c).cast("double").alias("x")) for i, c in enumerate(columns)])).alias("_c")).select("_c.*")
    facts = {r["i"]: r for r in every.groupBy("i", "x").agg(F.count(F.lit(1)).alias("c")).groupBy("i").agg(
        F.sum("c").alias("n"), ties.alias("t")).collect()}  # p rows
    n = max((int(r["n"]) for r in facts.values()), default=0)
    if n < 2:
        return m
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), col(columns[i]).cast("double").alias("x"), col(columns[j]).cast("double").alias("y"))
             for i in range(p) for j in range(i + 1, p)]
    cells = data.select(F.explode(F.array(*pairs)).alias("_c")).select("_c.*").groupBy("i", "j", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    cells = pinned(cells, "kendall-cells")
    both = {(r["i"], r["j"]): r for r in cells.groupBy("i", "j").agg(F.count(F.lit(1)).alias("cells"), ties.alias("t")).collect()}  # pairs of columns
    tasks = -(-sum(r["cells"] for r in both.values()) // bucket)

    def by_xy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = TaskContext.get().partitionId()
        for t in _segments(batches):
            found = weighted_inversions(t["y"].to_numpy(), t["c"].to_numpy())
            yield from t.append_column("g", pa.array(np.full(len(t), g, np.int32))).append_column(
                "inside", pa.array([Decimal(found), *[None] * (len(t) - 1)], pa.decimal128(38, 0))).to_batches()

    def by_yx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = TaskContext.get().partitionId()
        for t in _segments(batches):
            g, c = t["g"].to_numpy(), t["c"].to_numpy()
            found = weighted_inversions(g, c)
            kinds, which = np.unique(g, return_inverse=True)
            added = np.zeros(len(kinds), np.int64)
            np.add.at(added, which, c)
            size = len(kinds)
            same = [pa.array(np.full(size, v, np.int32)) for v in (t["i"][0].as_py(), t["j"][0].as_py(), h)]
            yield pa.RecordBatch.from_arrays([*same[:2], pa.array(kinds.astype(np.int32)), same[2], pa.array(added),
                                              pa.array([Decimal(found), *[None] * (size - 1)], pa.decimal128(38, 0))], names=["i", "j", "g", "h", "c", "inside"])

    ranged = pinned(cells.repartitionByRange(tasks, "i", "j", "x", "y").sortWithinPartitions("i", "j", "x", "y").mapInArrow(by_xy, RANGES), "kendall-ranges")
    met = ranged.repartitionByRange(tasks, "i", "j", "y", "x").sortWithinPartitions("i", "j", "y", "x").mapInArrow(by_yx, MEETINGS)
    totals = ranged.groupBy("i", "j").agg(F.sum("inside").alias("s")).collect()
    discordant = {(r["i"], r["j"]): int(r["s"]) for r in totals}
    grids: dict[tuple[int, int], list] = {}
    for r in met.collect():  # (cells / bucket) ** 2 rows at most
        grids.setdefault((r["i"], r["j"]), []).append((r["g"], r["h"], r["c"]))
        discordant[r["i"], r["j"]] += int(r["inside"] or 0)
    for pair, rows in grids.items():
        g, h = np.unique([r[0] for r in rows], return_inverse=True)[1], np.unique([r[1] for r in rows], return_inverse=True)[1]
        grid = np.zeros((g.max() + 1, h.max() + 1), object)
        grid[g, h] = [int(r[2]) for r in rows]
        upto = grid.cumsum(0).cumsum(1)  # rows in ranges up to g and h
        earlier = upto[:-1, -1:] - upto[:-1, :]  # in ranges up to g, beyond h
        discordant[pair] += int((grid[1:] * earlier).sum())
    free = [n * (n - 1) - int(facts[i]["t"]) for i in range(p)]  # twice the pairs of rows that differ in column i
    for i in range(p):
        if free[i]:
            m[i, i] = 1.0
        for j in range(i + 1, p):
            if free[i] and free[j]:
                # concordant less discordant pairs: all that differ in both columns less twice the discordant
                apart = (free[i] - int(facts[j]["t"]) + int(both[i, j]["t"])) // 2
                m[i, j] = m[j, i] = 2 * (apart - 2 * discordant[i, j]) / (float(free[i]) ** 0.5 * float(free[j]) ** 0.5)
    return m


def kendall_tau_b(df: DataFrame, x: str, y: str, single_task_limit: int | None = None) -> float:
    """Exact Kendall tau-b over rows complete in x and y (NaN below two rows or for a constant)."""
    data = df.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y")).dropna()
    return float(kendall_matrix(data, ["x", "y"], BUCKET_ROWS if single_task_limit is None else single_task_limit)[0, 1])
