"""Round 4: clustering passes at size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import kmeans_scan as S


def _leaves(blocks):
    """(lo, hi) of all leaves in z units, and the partition of each."""
    rows = blocks.select(F.spark_partition_id().alias("part"), "n", "leaves").collect()
    held = [np.frombuffer(r.leaves, float).reshape(-(-r.n // S.LEAF), -1) for r in rows]
    p = (held[0].shape[1] - 1) // 4
    return np.concatenate([x[:, :2 * p] for x in held]).reshape(-1, 2, p) / S.GRID, np.repeat([r.part for r in rows], [len(x) for x in held])


def test_a_task_has_an_area_of_space(spark, monkeypatch):
    """Leaves get smaller with the number of points, however many tasks there are."""
    monkeypatch.setattr(S, "TASK_POINTS", 2000)
    monkeypatch.setattr(S, "AREAS", 8)
    df = spark.range(40_000).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    boxes, part = _leaves(S.pack(df, [F.col("a"), F.col("b")]))
    assert len(set(part)) > 8  # more tasks than areas: those of an area share it
    area = (boxes[:, 1] - boxes[:, 0]).prod(1)
    assert np.median(area) < 3 * 4 * 64 / 40_000  # about three tasks share an area


def test_heavy_and_far_points_keep_exact_sums(spark):
    """Weights, leaves too wide for distances from a corner, a constant column."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 2.5).otherwise(F.randn(1)).alias("a"),
                                  (F.when(F.col("id") == 7, 1e5).when(F.col("id") % 3 == 0, 0.25).otherwise(F.randn(2))).alias("b"), F.lit(1.0).alias("c")).cache()
    x = np.array([tuple(r) for r in df.collect()])
    blocks = S.pack(df, [F.col(c) for c in "abc"]).persist()
    models = [np.array([[0.0, 0, 1], [2.5, 0, 1], [-1, 1, 1]]), np.array([[0.0, 0.0, 0.0]]), np.array([[50.0, 1e5, 1], [0, 0, 1]])]
    weights, means = S.scan(blocks, models)
    for m, w, c, cost in zip(models, weights, means, S.costs(blocks, models)):
        d = ((x[:, None] - m) ** 2).sum(2)
        near = d.argmin(1)
        assert w.tolist() == np.bincount(near, minlength=len(m)).tolist()
        assert np.allclose(c, [x[near == i].mean(0) for i in range(len(m))], atol=1e-10)
        assert cost == pytest.approx(d.min(1).sum(), rel=1e-12)
    blocks.unpersist()
    df.unpersist()


def test_race_measures_only_points_that_can_win(spark, monkeypatch):
    """The same starting centres as with every point measured, from far fewer distances."""
    df = spark.range(30_000).select(F.randn(3).alias("a"), F.randn(4).alias("b"))
    blocks = S.pack(df, [F.col("a"), F.col("b")]).persist()
    x = np.array([tuple(r) for r in df.collect()])
    x = np.rint(x * S.GRID) / S.GRID
    for at_once, k in ((1, 4), (5, 10)):
        want = []
        for step in range(-(-k // at_once)):
            rate = S.nearest_exact(x, np.array(want)) if want else np.ones(len(x))
            with np.errstate(divide="ignore"):
                key = -np.log(S.uniform(np.ascontiguousarray(x.T), 42, 0, step)) / rate
            want += [tuple(x[i]) for i in np.argsort(key, kind="stable")[:at_once]]
        assert [tuple(c) for c in S.starts(blocks, k, 1, 42, at_once)[0]] == want
    blocks.unpersist()


def test_distinct_rows_are_looked_for_in_the_first_ones(spark):
    """No shuffle of all rows to see that there are a few distinct ones; all are read if the first are too alike."""
    known = F.when(F.col("id") < 50_000, F.col("id") % 50).otherwise(F.raise_error(F.lit("a late row was read")).cast("long"))
    first = spark.range(0, 100_000, 1, 8).select(known.cast("double").alias("x"))
    assert len({r.x for r in K.some_distinct(first, 10)}) == 10
    K.Prepared(["x"], None, first).require(10)
    late = spark.range(0, 1000, 1, 4).select(F.greatest(F.col("id") - 900, F.lit(0)).cast("double").alias("x"))
    assert len({r.x for r in K.some_distinct(late, 60)}) == 60
    assert sorted(r.x for r in K.some_distinct(late.where("x < 3"), 60)) == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        K.prepare_clusters(late.where("x < 3")).require(4)


def test_passes_leave_the_batch_size_of_the_session(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    prep = K.prepare_clusters(spark.range(500).select((F.col("id") % 71).cast("double").alias("x")))
    assert K.elbow(prep, k_max=3).count() == 3 and spark.conf.get(key) == held
