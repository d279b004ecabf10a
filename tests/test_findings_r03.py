"""Findings of round 3: pruned k-means passes, samples of few large classes, Kendall by sorted ranges, ranks of many
rows, windows of crowded anchors without a join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import kmeans_scan as S


def _scan_brute(x, models):
    out = []
    for m in models:
        near = ((x[:, None, :] - m[None, :, :]) ** 2).sum(2).argmin(1)
        out.append((np.bincount(near, minlength=len(m)), near))
    return out


@pytest.mark.parametrize("spread", [1.0, 100.0])
def test_pruned_pass_counts_as_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(9000, 3)) * spread, 6)
    x[:500] = x[0]  # copies of one point
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    blocks = S.pack(df, [F.col(c) for c in "abc"]).persist()
    models = [x[rng.choice(len(x), k, replace=False)] for k in (1, 2, 7, 40)]
    weights, means = S.scan(blocks, models)
    for (count, near), w, mean in zip(_scan_brute(x, models), weights, means, strict=True):
        assert w.tolist() == count.tolist()
        for c in np.flatnonzero(count):
            assert np.allclose(mean[c], x[near == c].mean(0), rtol=1e-9, atol=1e-9)
    blocks.unpersist()


def test_pruning_leaves_few_centres_to_measure():
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, size=(1 << 16, 3))
    x = x[S.neighbours(x.T)].reshape(-1, S.LEAF, 3)
    lo, hi = x.min(1), x.max(1)
    centers = rng.uniform(-2, 2, size=(100, 3))
    able = S.possible((lo + hi) / 2, (hi - lo) / 2, centers)
    near = ((x[:, :, None, :] - centers) ** 2).sum(3).argmin(2)
    assert all(able[i, near[i]].all() for i in range(len(x)))
    assert able.sum(1).mean() < 10


def test_passes_start_a_task_for_each_core(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        prep = K.prepare_clusters(spark.range(5000).select((F.col("id") % 71).cast("double").alias("x"), F.col("id").cast("double").alias("y")))
        assert prep.points().rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        prep.release()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_label_takes_the_first_of_equally_near_centres(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.0],), ([0.6, 0.0],)], "p array<double>")
    labels = [r[0] for r in df.select(S.label(F.col("p"), np.array([[1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]]))).collect()]
    assert labels == [1, 1, 1]
    assert "transform(" not in df.select(S.label(F.col("p"), np.array([[1.0, 0.0]])))._jdf.queryExecution().toString()


def test_large_groups_are_thinned_before_they_move(spark, monkeypatch):
    from tessera.operators import sampling
    df = spark.range(30_000).select("id", F.when(F.col("id") % 1000 == 7, F.concat(F.lit("g"), F.col("id") % 7)).when(F.col("id") % 1000 == 8, None)
                                    .otherwise(F.lit("big")).alias("g"))
    by = {}
    for r in df.where("g is not null").withColumn("h", sampling.row_hash(42, ["id"])).collect():
        by.setdefault(r.g, []).append((r.h, r.id))
    want = sorted(i for rows in by.values() for _, i in sorted(rows)[:60])
    for share in (1 / 1000, 1 / 10, 2.0):  # all groups large, one large, none
        monkeypatch.setattr(sampling, "HOT_SHARE", share)
        assert sorted(r.id for r in sampling.first_k(df, 60, 42, ["id"], by=["g"]).collect()) == want
    monkeypatch.setattr(sampling, "HOT_SHARE", 1 / 1000)
    two = df.select("id", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"))
    plan = sampling.first_k(two, 60, 42, ["id"], by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_weighted_inversions_match_brute_force():
    from tessera.operators.correlation import weighted_inversions
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 300):
        v, w = rng.integers(0, 40, n), rng.integers(1, 9, n)
        assert weighted_inversions(v, w) == sum(int(w[p] * w[q]) for p in range(n) for q in range(p + 1, n) if v[p] > v[q])


def test_kendall_moves_each_cell_a_fixed_number_of_times(spark, monkeypatch):
    """No row for each level of the value order: what is written is one row a cell."""
    from tessera.operators import correlation as C
    written = []
    keep = C.pinned
    monkeypatch.setattr(C, "pinned", lambda df, name: (out := keep(df, name), written.append((name, out.count())))[0])
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 60, 900).tolist(), rng.integers(0, 3000, 900).tolist()
    df = spark.createDataFrame(list(zip(x, y)), "x int, y int")
    cells = len(set(zip(x, y)))
    s = sum(np.sign(x[q] - x[p]) * np.sign(y[q] - y[p]) for p in range(900) for q in range(p))
    fx, fy = (sum(a[p] != a[q] for p in range(900) for q in range(p)) for a in (x, y))
    for bucket in (70, 1_000_000):
        written.clear()
        assert C.kendall_matrix(df, ["x", "y"], bucket)[0, 1] == pytest.approx(s / (fx * fy) ** 0.5, rel=1e-12)
        assert written == [("kendall-cells", cells), ("kendall-ranges", cells)]


def test_rank_tasks_follow_the_number_of_values(spark, monkeypatch):
    from tessera.operators import quantiles as Q
    monkeypatch.setattr(Q, "RANK_TASK_ROWS", 100)
    df = spark.range(1500).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") * 7 % 1500).cast("double").alias("b"))
    ranked = Q.row_ranks(df, ["a", "b"], bucket_rows=100)
    assert ranked.rdd.getNumPartitions() == 30  # 3,000 values
    assert "BroadcastHashJoin" in ranked._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in ranked.collect())
    assert got == sorted((i % 3 * 500 + 250.5, i * 7 % 1500 + 1.0) for i in range(1500))
