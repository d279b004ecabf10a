"""Exact quantiles, ranks and modes that never funnel a whole column into one task.

One plan for all sizes:

1. the number of buckets follows from the number of values (one bucket for each
   ``BUCKET_ROWS``); with more than one, an aggregation learns split points with
   ``percentile_approx`` over a bounded sample (they only balance the buckets);
2. rows are bucketed with ``Bucketizer`` (JVM binary search), reduced to distinct
   ``(keys, variable, bucket, value, cnt)`` with map-side combine (a hot value becomes
   one row), per-bucket totals give each bucket's rank offset, and only the buckets
   that contain a target rank are sorted (window partitioned by bucket).

Linear interpolation between order statistics (the usual ``(n - 1) * p`` definition).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import col
from tessera.session import pinned

BUCKET_ROWS = 1_000_000       # values in a bucket, which one task sorts
RANK_ROWS = 250_000           # values in a range that row_ranks sorts
RANK_TASK_ROWS = 1_000_000    # values of a task of row_ranks
SPLIT_SAMPLE_ROWS = 400_000   # rows sampled to place bucket boundaries (balance only), or 20 a bucket


def bucket_count(n: int, bucket_rows: int, most: int | None = None) -> int:
    """Buckets for ``n`` values; ``most`` bounds them (tests)."""
    wanted = max(1, math.ceil(n / max(1, bucket_rows)))
    return min(wanted, most) if most else wanted


def _split_sample(df: DataFrame, n_rows: int, buckets: int = 1) -> DataFrame:
    """Seeded Bernoulli sample of about ``SPLIT_SAMPLE_ROWS`` rows. Split points only
    balance the buckets (exactness never depends on them), and sketching a bounded
    sample keeps every partition's partial sketch tiny - a global sketch over the
    full data would merge one large buffer per partition in a single task."""
    frac = min(1.0, max(SPLIT_SAMPLE_ROWS, 20 * buckets) / max(1, n_rows))
    return df if frac >= 1.0 else df.sample(withReplacement=False, fraction=frac, seed=17)


def _as_exprs(df: DataFrame, columns: Sequence[str] | Mapping[str, Column]) -> dict[str, Column]:
    if isinstance(columns, Mapping):
        return {k: v.cast("double") for k, v in columns.items()}
    return {c: col(c).cast("double") for c in columns}


def _long(df: DataFrame, exprs: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """Wide -> ``(by..., variable, value)`` by exploding an array of structs (no shuffle)."""
    items = [F.struct(F.lit(name).alias("variable"), e.alias("value")) for name, e in exprs.items()]
    return (df.select(*map(col, by), F.explode(F.array(*items)).alias("_kv"))
              .select(*map(col, by), "_kv.*").where(F.col("value").isNotNull()))


def quantiles(df: DataFrame, columns: Sequence[str] | Mapping[str, Column], probs: Sequence[float],
              by: Sequence[str] = (), single_task_limit: int = BUCKET_ROWS,
              max_buckets: int | None = None, counts: Mapping[str, int] | None = None) -> DataFrame:
    """Exact quantiles -> DataFrame ``(by..., variable, prob, value)``.

    ``columns`` may map output names to column expressions (e.g. filtered views of a
    column). NULLs are skipped; a variable with no values yields no rows. ``counts``
    (non-null values per variable, if already known) saves the sizing job."""
    by = list(by)
    exprs = _as_exprs(df, columns)
    probs = list(dict.fromkeys(float(p) for p in probs))
    if counts is None:
        counts = value_counts(df, exprs)
    counted = pinned(_bucketed_counts(df, exprs, by, counts, single_task_limit, max_buckets), "value-counts")
    return _quantiles_from_counts(counted, by, probs)


def value_counts(df: DataFrame, exprs: Mapping[str, Column]) -> dict[str, int]:
    """Non-null values of each expression (one job)."""
    row = df.agg(*[F.count(e).alias(f"_n{i}") for i, e in enumerate(exprs.values())]).first()
    return {n: row[i] for i, n in enumerate(exprs)}


def _bucketed_counts(df: DataFrame, exprs: Mapping[str, Column], by: list[str], counts: Mapping[str, int],
                     bucket_rows: int = BUCKET_ROWS, max_buckets: int | None = None) -> DataFrame:
    """Distinct ``(by..., variable, bucket, value, cnt)`` with buckets from per-variable
    approximate split points (one sketch job; Bucketizer does a JVM binary search). A
    variable without a split point (empty, constant, small) has the one bucket 0."""
    names = list(exprs)
    n_max = max(counts.values(), default=0)
    buckets = bucket_count(n_max, bucket_rows, max_buckets)
    splits: dict[int, list[float]] = {}
    if buckets > 1:
        grid = [i / buckets for i in range(1, buckets)]
        sketch = _split_sample(df, n_max, buckets).agg(*[F.percentile_approx(e, grid, 4 * buckets).alias(f"_s{i}")
                                                         for i, e in enumerate(exprs.values())]).first()
        for i in range(len(names)):
            inner = sorted({x for x in (sketch[i] or []) if x is not None and math.isfinite(x)})
            if inner:
                splits[i] = [-math.inf, *inner, math.inf]
    wide = df.select(*map(col, by), *[exprs[n].alias(f"_v{i}") for i, n in enumerate(names)])
    if splits:
        wide = Bucketizer(splitsArray=list(splits.values()), inputCols=[f"_v{i}" for i in splits],
                          outputCols=[f"_b{i}" for i in splits], handleInvalid="keep").transform(wide)
    items = [F.struct(F.lit(n).alias("variable"), F.col(f"_v{i}").alias("value"),
                      (F.col(f"_b{i}").cast("int") if i in splits else F.lit(0)).alias("bucket"))
             for i, n in enumerate(names)]
    long = (wide.select(*map(col, by), F.explode(F.array(*items)).alias("_kv")).select(*map(col, by), "_kv.*")
                .where(F.col("value").isNotNull()))
    return long.groupBy(*map(col, by), "variable", "bucket", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _quantiles_from_counts(vc: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles from distinct ``(by..., variable, bucket, value, cnt)`` rows; only
    buckets holding a target rank are sorted."""
    keys = by + ["variable"]
    # 3. bucket totals -> rank offsets (at most variables x buckets rows per group)
    totals = vc.groupBy(*keys, "bucket").agg(F.sum("cnt").alias("bucket_n"))
    wk = Window.partitionBy(*keys).orderBy("bucket")
    totals = (totals.withColumn("start", F.coalesce(F.sum("bucket_n").over(
                  wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                    .withColumn("n", F.sum("bucket_n").over(Window.partitionBy(*keys))))
    # 4. target ranks (0-based) and the bucket holding each
    pr = F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob")
    tg = totals.select(*keys, "bucket", "start", "bucket_n", "n", pr)
    tg = tg.withColumn("h", (F.col("n") - 1) * F.col("prob"))
    tg = tg.select(*keys, "bucket", "start", "bucket_n", "prob", "h",
                   F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("rank"))
    tg = tg.where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("bucket_n")))
    tg = tg.select(*keys, "bucket", "start", "prob", "h", "rank").distinct()
    needed = tg.select(*keys, "bucket").distinct()
    # 5. sort only the needed buckets
    # ``needed``/``tg`` have (groups x probs) rows: Spark broadcasts them when small (AQE)
    part = vc.join(needed, keys + ["bucket"], "left_semi")
    wb = Window.partitionBy(*keys, "bucket").orderBy("value")
    part = part.withColumn("below", F.coalesce(F.sum("cnt").over(
        wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = part.join(tg, keys + ["bucket"]).where(
        (F.col("rank") >= F.col("start") + F.col("below")) &
        (F.col("rank") < F.col("start") + F.col("below") + F.col("cnt")))
    res = hit.groupBy(*keys, "prob").agg(
        F.min_by("value", "rank").alias("v_lo"), F.max_by("value", "rank").alias("v_hi"),
        F.first("h").alias("h"))
    between = F.col("v_lo") + (F.col("h") - F.floor("h")) * (F.col("v_hi") - F.col("v_lo"))
    value = F.when(F.col("v_lo") == F.col("v_hi"), F.col("v_lo")).otherwise(between)  # infinities stay
    return res.select(*keys, "prob", value.alias("value"))


def quantile_map(df: DataFrame, columns: Sequence[str] | Mapping[str, Column],
                 probs: Sequence[float], **kw) -> dict[str, list[float]]:
    """Small driver-side result: ``{variable: [q(p) for p in probs]}`` (None if no values)."""
    rows = quantiles(df, columns, probs, **kw).collect()
    names = list(columns) if not isinstance(columns, Mapping) else list(columns.keys())
    out = {n: [None] * len(probs) for n in names}
    pos = {float(p): i for i, p in enumerate(probs)}
    for r in rows:
        out[r["variable"]][pos[float(r["prob"])]] = r["value"]
    return out


def modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
          value_type: str | None = None) -> DataFrame:
    """Most frequent non-null value per variable (smallest on ties)
    -> ``(by..., variable, value, count)``.

    Counting is a distributed group-by; the per-variable pick is a row_number() <= 1
    filter that Spark plans as a partial WindowGroupLimit before the shuffle."""
    by = list(by)
    vt = value_type or "string"
    long = _long(df, {c: col(c).cast(vt) for c in columns}, by)
    vc = long.groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*by, "variable").orderBy(F.desc("count"), F.asc("value"))
    return vc.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def value_ranks(df: DataFrame, columns: Sequence[str], single_task_limit: int = BUCKET_ROWS,
                max_buckets: int | None = None) -> DataFrame:
    """Average (tie-aware, 1-based) rank of every distinct value of each column
    -> ``(variable, value, rank)``: cumulative counts over a window per (variable, value
    bucket) plus bucket offsets, so no task sorts a whole column."""
    exprs = _as_exprs(df, columns)
    vb = _bucketed_counts(df, exprs, [], value_counts(df, exprs), single_task_limit, max_buckets)
    totals = vb.groupBy("variable", "bucket").agg(F.sum("cnt").alias("bucket_n"))
    wk = Window.partitionBy("variable").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("variable", "bucket", F.coalesce(F.sum("bucket_n").over(wk), F.lit(0)).alias("start"))
    wb = Window.partitionBy("variable", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (vb.join(offsets, ["variable", "bucket"])
                .withColumn("_below", F.col("start") + F.coalesce(F.sum("cnt").over(wb), F.lit(0))))
    return ranked.select("variable", "value", (F.col("_below") + (F.col("cnt") + 1) / 2.0).alias("rank"))


def row_ranks(df: DataFrame, columns: Sequence[str], bucket_rows: int = RANK_ROWS, max_buckets: int | None = None) -> DataFrame:
    """Each row's average (tie-aware, 1-based) ranks beside one another, for rows complete in
    ``columns``; nothing is joined on a value.

    Every (row, column, value) goes to a place: the value range it lies in, and apart from the
    rest of that range if the value is heavy, that is, a quantile split point that repeats (it
    holds more than a bucket's rows). Places are in value order, so their totals give the rank
    each begins at; a heavy place has one rank and is never sorted, the others are ranked on
    their own. One shuffle by place (rows of heavy places stay), one back to the rows, both to as many
    tasks as the number of values asks for, so that a task's share does not grow with the table."""
    columns = list(columns)
    n = df.count()
    buckets = bucket_count(n, bucket_rows, max_buckets)
    values = [col(c).cast("double") for c in columns]
    splits: list[list[float]] = [[] for _ in columns]
    heavy: list[list[float]] = [[] for _ in columns]
    if buckets > 1:
        grid = [i / buckets for i in range(1, buckets)]
        row = _split_sample(df, n, buckets).agg(*[F.percentile_approx(v, grid, 4 * buckets) for v in values]).first()
        for i in range(len(columns)):
            found = [x for x in (row[i] or []) if x is not None and math.isfinite(x)]
            splits[i] = sorted(set(found))
            heavy[i] = sorted({x for x in found if found.count(x) > 1})
    wide = df.select(F.monotonically_increasing_id().alias("_id"), *[v.alias(f"_v{i}") for i, v in enumerate(values)])
    cut = [i for i in range(len(columns)) if splits[i]]
    if cut:
        wide = Bucketizer(splitsArray=[[-math.inf, *splits[i], math.inf] for i in cut], inputCols=[f"_v{i}" for i in cut],
                          outputCols=[f"_b{i}" for i in cut], handleInvalid="keep").transform(wide)
    items = []
    for i in range(len(columns)):
        bucket = F.col(f"_b{i}").cast("int") if i in cut else F.lit(0)
        own = F.col(f"_v{i}").isin(heavy[i]) if heavy[i] else F.lit(False)  # a split point begins its bucket
        items.append(F.struct(F.lit(i).alias("v"), F.col(f"_v{i}").alias("value"), (bucket * 2 + F.when(own, 0).otherwise(1)).alias("place")))
    long = wide.select("_id", F.explode(F.array(*items)).alias("_kv")).select("_id", "_kv.*")
    totals = long.groupBy("v", "place").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("v").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = long.join(F.broadcast(starts), ["v", "place"])  # columns x places rows
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * len(columns) // RANK_TASK_ROWS))
    light = F.col("place") % 2 == 1
    sorted_ = Window.partitionBy("v", "place").orderBy("value")
    tied = F.count(F.lit(1)).over(Window.partitionBy("v", "place", "value"))
    ranked = placed.where(light).repartition(tasks, "v", "place").select("_id", "v", (F.col("start") + F.rank().over(sorted_) + (tied - 1) / 2.0).alias("rank"))
    if any(heavy):
        ranked = ranked.unionByName(placed.where(~light).select("_id", "v", (F.col("start") + (F.col("size") + 1) / 2.0).alias("rank")))
    back = ranked.repartition(tasks, "_id").groupBy("_id").agg(*[F.max(F.when(F.col("v") == i, F.col("rank"))).alias(f"_r{i}") for i in range(len(columns))])
    return back.select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(columns)])


def value_places(df: DataFrame, columns: Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Distinct values of each column with their count, value range and number within it, from 0:
    ``(variable, value, cnt, bucket, place)``; (bucket, place) is in value order."""
    exprs = _as_exprs(df, columns)
    counted = _bucketed_counts(df, exprs, [], value_counts(df, exprs), bucket_rows)
    place = F.row_number().over(Window.partitionBy("variable", "bucket").orderBy("value"))
    return counted.select("variable", "value", "cnt", "bucket", (place - 1).alias("place"))


def grouped_below(cells: DataFrame, keys: Sequence[str], single_task_limit: int = BUCKET_ROWS,
                  max_buckets: int | None = None, largest_group: int | None = None) -> DataFrame:
    """For distinct ``(keys..., value, cnt)`` rows add ``below`` = total ``cnt`` of
    smaller values in the same key group. Values are cut into global buckets (as many as
    the largest group needs; approximate split points), each (group, bucket) is sorted on
    its own and bucket offsets come from per-bucket totals."""
    keys = list(keys)
    biggest = largest_group if largest_group is not None else (
        cells.groupBy(*map(col, keys)).count().agg(F.max("count")).first()[0] or 0)
    buckets = bucket_count(biggest, single_task_limit, max_buckets)
    inner: list[float] = []
    if buckets > 1:
        grid = [i / buckets for i in range(1, buckets)]
        sk = _split_sample(cells, biggest, buckets).agg(F.percentile_approx("value", grid, 4 * buckets)).first()[0] or []
        inner = sorted({x for x in sk if x is not None and math.isfinite(x)})
    if not inner:
        w = Window.partitionBy(*map(col, keys)).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        return cells.withColumn("below", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    b = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="value", outputCol="_bk", handleInvalid="keep")
    vb = b.transform(cells)
    totals = vb.groupBy(*map(col, keys), "_bk").agg(F.sum("cnt").alias("_bn"))
    wk = Window.partitionBy(*map(col, keys)).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*map(col, keys), "_bk", F.coalesce(F.sum("_bn").over(wk), F.lit(0)).alias("_start"))
    wb = Window.partitionBy(*map(col, keys), "_bk").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_bk") == F.col("_obk")
    for i, k in enumerate(keys):  # a NULL key is a group like any other
        offsets = offsets.withColumnRenamed(k, f"_o{i}")
        same = same & col(k).eqNullSafe(F.col(f"_o{i}"))
    return (vb.join(offsets.withColumnRenamed("_bk", "_obk"), same).drop("_obk", *[f"_o{i}" for i in range(len(keys))])
              .withColumn("below", F.col("_start") + F.coalesce(F.sum("cnt").over(wb), F.lit(0)))
              .drop("_bk", "_start"))
