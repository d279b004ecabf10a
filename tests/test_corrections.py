"""Cases that once gave wrong answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import discriminant as D
from tessera.operators import factor as FA
from tessera.operators import freq, outliers, profile, repair, sampling, summary
from tessera.operators.correlation import category_codes, correlation_matrix
from tessera.operators.encode import fit_one_hot
from tessera.operators.normality import shapiro_wilk
from tessera.operators.quantiles import grouped_below, quantile_map, value_ranks
from tessera.registry.base import fixture
from tessera.sources.io import read_csv, write_table
from tests.conftest import SF_SMALL


def test_samples_take_rows_not_values(spark):
    df = spark.range(15_000).select((F.col("id") % 5).alias("x"), (F.col("id") % 25 / 5).cast("int").alias("y"))
    got = freq.scatter_sample(df, "x", "y", n=300)
    assert got.count() == 300 and got.distinct().count() == 25
    uneven = spark.range(10_000).select(F.when(F.col("id") < 9_000, 1).otherwise(2).alias("x"), F.lit(0).alias("y"))
    share = freq.scatter_sample(uneven, "x", "y", n=1_000).filter("x = 1").count()
    assert 860 <= share <= 940
    by = sampling.first_k(uneven, 400, by=["x"])
    assert {r[0]: r[1] for r in by.groupBy("x").count().collect()} == {1: 400, 2: 400}
    w = shapiro_wilk(spark.range(20_000).select((F.col("id") % 50).alias("q")), "q", max_n=500).first()
    assert w["shapiro_w"] is not None and 0.8 < w["shapiro_w"] < 1


def test_buckets_hold_empty_and_infinite_columns(spark):
    df = fixture(spark, SF_SMALL, "orders_holes").withColumn("inf", F.lit(math.inf))
    names = ["price", "qty", "empty_col", "sparse_col", "inf"]
    one, many = (quantile_map(df, names, [0.1, 0.5], single_task_limit=n) for n in (10 ** 9, 7))
    assert one == many and one["empty_col"] == [None, None] and one["inf"][0] == math.inf
    ranks = [sorted(map(tuple, value_ranks(df, names, single_task_limit=n).collect())) for n in (10 ** 9, 7)]
    assert ranks[0] == ranks[1]
    cells = df.groupBy("status", "qty").agg(F.count("*").alias("cnt")).withColumnRenamed("qty", "value").filter("value is not null")
    below = [sorted(map(str, grouped_below(cells, ["status"], n).collect())) for n in (10 ** 9, 3)]
    assert below[0] == below[1]
    bounds = outliers.fit_iqr_bounds(df.drop("inf"))
    assert "price" in bounds.columns
    got = summary.central_tendency(df, ["price", "empty_col"]).collect()
    assert {r["variable"]: r["median"] is None for r in got} == {"price": False, "empty_col": True}


def test_imputation_keeps_large_integers(spark):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740995,), (None,)], "v long")
    got = sorted(r[0] for r in repair.impute(df, "median").collect())
    assert {9007199254740993, 9007199254740995} <= set(got)


def test_bootstrap_with_large_means(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=400)
    rows = [(i, *(float(1e9 + f[i] + 0.5 * e) for e in rng.normal(size=3))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    means = {c: df.agg(F.avg(c)).first()[0] for c in "abc"}
    mats = FA.bootstrap_moments(df, ["a", "b", "c"], means, 5, 42, ["id"])
    assert all(np.isfinite(m).all() and 0.6 < m[0, 1] < 0.95 for m in mats.values())
    same = spark.range(4_000).select((F.col("id") % 2).cast("double").alias("a"), (F.col("id") % 2 + F.col("id") % 3).cast("double").alias("b"))
    spread = [m[0, 1] for m in FA.bootstrap_moments(same, ["a", "b"], {"a": 0.5, "b": 1.5}, 30, 42).values()]
    assert np.std(spread) < 0.05  # rows are drawn, not their few values


def test_csv_quotes_line_ends_and_long_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('"Q1. age",note,n,w\n1,"say ""hi"", x",12d,3\n2,"two\nlines",3f,\n3,short\n')
    got = read_csv(spark, str(path)).collect()
    assert [r["note"] for r in got] == ['say "hi", x', "two\nlines", "short"]
    assert [r["n"] for r in got] == ["12d", "3f", None] and [r["w"] for r in got] == [3, None, None]
    assert [r["Q1. age"] for r in got] == [1, 2, 3]
    write_table(read_csv(spark, str(path)), str(tmp_path / "b"), "csv")
    assert sorted(map(str, read_csv(spark, str(tmp_path / "b")).collect())) == sorted(map(str, got))
    path.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more cells"):
        read_csv(spark, str(path)).collect()


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 7), "ab"[i % 2]) for i in range(60)], ["id", "Q1. age", "we`ird", "g.r"])
    assert freq.category_frequencies(df, "g.r").count() == 2
    assert freq.frequency_table(df, "Q1. age", bins=3).count() == 3
    assert freq.box_stats(df, "we`ird").first()["n"] == 60
    names, r = correlation_matrix(df, ["Q1. age", "we`ird"], "spearman")
    assert r.shape == (2, 2)
    assert category_codes(df, "g.r").agg(F.max("`g.r`")).first()[0] == 1
    assert freq.scatter_sample(df, "Q1. age", "we`ird", n=10).count() == 10
    assert profile.null_summary(df).count() == 0  # no column has a NULL


def test_lda_gives_no_class_to_incomplete_rows(spark):
    rows = [("a", float(i), float(i % 5)) for i in range(20)] + [("b", float(i + 30), float(i % 7)) for i in range(20)]
    model = D.fit_lda(spark.createDataFrame(rows, "g string, x double, y double"), "g", ["x", "y"])
    got = model.predict(spark.createDataFrame([("a", None, 1.0), ("a", 1.0, 1.0)], "g string, x double, y double")).collect()
    assert (got[0]["prediction"], got[0]["probability"]) == (None, None) and got[1]["prediction"] == "a"


def test_clusters_need_distinct_points(spark):
    prep = K.prepare_clusters(spark.range(50).select((F.col("id") % 2).cast("double").alias("x")))
    with pytest.raises(ValueError):
        K.kmeans(prep, 3)
    with pytest.raises(ValueError):
        K.hierarchical(prep, 3)
    two = K.hierarchical(prep, 2)
    assert sorted(r["count"] for r in two.labelled.groupBy("cluster").count().collect()) == [25, 25]
    assert len(two.merges) == 1 and sorted(two.micro_sizes) == [25, 25]
    prep.release()


def test_bartlett_of_singular_and_wide_matrices():
    stat, dof, p = FA.bartlett(np.ones((3, 3)), 50)
    assert stat == math.inf and p == 0.0
    wide = np.full((90, 90), 0.9999) + 0.0001 * np.eye(90)  # the determinant itself underflows
    assert math.isfinite(FA.bartlett(wide, 1000)[0])


def test_one_hot_limit_is_exact(spark):
    df = spark.range(30).select((F.col("id") % 12).alias("v"))
    assert len(fit_one_hot(df, ["v"]).levels["v"]) == 12
    fit_one_hot(df, ["v"], max_levels=12)
    with pytest.raises(ValueError):
        fit_one_hot(df, ["v"], max_levels=11)


def test_stream_over_a_folder_named_by_uri(spark, tmp_path):
    from tessera.streaming.quality import parquet_stream, run_to_table
    df = spark.range(100)
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert run_to_table(parquet_stream(spark, f"file://{tmp_path}/t.parquet", df.schema)).count() == 100


def test_equal_rows_are_numbered_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", 500, raising=False)
    rows = spark.range(20_250).select(F.lit(7.0).alias("x"))
    got = sampling.with_ordinals(rows).withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r["_ordinal"] for r in got) == list(range(1, 20_251))
    sizes = np.bincount([r.p for r in got])
    assert max(sizes) < 20_250 / 2
