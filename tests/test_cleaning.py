import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import encode as E
from tessera.operators import freq as Fq
from tessera.operators import outliers as O
from tessera.operators import profile as P
from tessera.operators import summary as S
from tessera.operators.repair import fit_impute
from tessera.plans.cleaning import CleaningConfig, fit_cleaning


def test_half_even_integral_fill(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None)], "id long, x long")
    out = {r["id"]: r["x"] for r in fit_impute(df, "mean").transform(df).collect()}
    assert out[3] == 2  # mean 2.5 rounds half to even


def test_all_null_numeric_profiled_discrete_and_impute_raises(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "id long, x double")
    prof = P.profile_dict(df)
    assert prof["x"]["kind"] == "discrete"
    with pytest.raises(ValueError):
        fit_impute(df, "mean")


def test_drop_order_changes_later_statistics(spark):
    df = spark.createDataFrame([(1, None, 10.0), (2, 1.0, None), (3, 2.0, 20.0), (4, 3.0, 40.0)],
                               "id long, a double, b double")
    plan = fit_impute(df, "mean", {"a": "drop"})
    # b's mean is computed over rows that survive dropping a-nulls: (20 + 40) / 2
    assert plan.fills["b"] == 30.0
    rows = plan.transform(df).orderBy("id").collect()
    assert [r["id"] for r in rows] == [2, 3, 4] and rows[0]["b"] == 30.0


def test_straightliner_needs_two_values(spark):
    df = spark.createDataFrame([(1, 3, None, None), (2, 2, 2, 2), (3, 1, 5, 3), (4, 5, 1, 5), (5, 4, 3, 1)],
                               "id long, q1 long, q2 long, q3 long")
    g = O.fit_scale_groups(df, exclude=["id"])
    assert list(g.groups.values()) == [("q1", "q2", "q3")]
    assert [r["id"] for r in O.straightliners(df, g).collect()] == [2]


def test_iqr_strict_fences(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    b = O.fit_iqr_bounds(df)
    q1, q3, lo, hi = b.bounds["x"]
    assert (q1, q3) == (2.0, 4.0) and (lo, hi) == (-1.0, 7.0)
    assert O.outlier_counts(df, b).first()["n_outliers"] == 1


def test_zscore_population_std_and_binary_skip(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0), (5.0, 5)], "x double, flag long")
    df = df.withColumn("flag01", (F.col("flag") > 0).cast("long"))
    m = E.fit_zscore(df, ["x", "flag01"])
    assert "flag01" not in m.stats
    z = [r["x"] for r in m.transform(df).collect()]
    assert abs(sum(z)) < 1e-12 and abs(sum(v * v for v in z) / len(z) - 1) < 1e-12
    const = spark.createDataFrame([(5.0,), (5.0,)], "c double")
    assert [r["c"] for r in E.zscore(const).collect()] == [0.0, 0.0]


def test_one_hot_null_all_zero(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "z long, k string")
    out = E.one_hot(df, ["k"]).orderBy("z").collect()
    assert out[0].asDict() == {"z": 1, "k_a": 0, "k_b": 1}
    assert out[1].asDict() == {"z": 2, "k_a": 0, "k_b": 0}


def test_frequency_table_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 10]], "x double")
    t = Fq.frequency_table(df, "x", bins=2).orderBy("bin").collect()
    assert [r["frequency"] for r in t] == [4, 1]
    assert math.isclose(t[0]["lower"], -0.01) and t[1]["upper"] == 10.0
    const = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    tc = Fq.frequency_table(const, "x", bins=2).orderBy("bin").collect()
    assert [r["frequency"] for r in tc] == [2, 0]
    gap = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    assert [r["frequency"] for r in Fq.frequency_table(gap, "x", bins=3).orderBy("bin").collect()] == [1, 0, 1]


def test_cv_null_for_zero_mean(spark):
    df = spark.createDataFrame([(-1.0,), (1.0,)], "x double")
    r = S.dispersion(df, ["x"]).first()
    assert r["cv_percent"] is None and r["range"] == 2.0


def test_cleaning_idempotent_on_clean_data(spark):
    df = spark.createDataFrame([(i, float(i % 7), f"s{i % 3}") for i in range(1, 60)], "id long, x double, s string")
    cfg = CleaningConfig(id_columns=("id",))
    once = fit_cleaning(df, cfg).transform(df)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, df.collect()))
    rep = fit_cleaning(df, cfg).report(df).first()
    assert rep["rows_delta"] == 0 and rep["nulls_after"] == 0


def test_mixed_type_detection_guarded_parse(spark):
    vals = ["1", "2.5", " 3 ", "1e3", "12d", "n/d", None, "4"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, t string")
    r = P.mixed_type_columns(df).first()
    assert r["n_non_null"] == 7 and r["n_numeric"] == 5
    bad = {x["value"] for x in P.mixed_type_rows(df, ["t"], "id").collect()}
    assert bad == {"12d", "n/d"}


def test_degenerate_inputs_do_not_divide_by_zero(spark):
    from tessera.operators import discriminant as D
    from tessera.operators.normality import ks_normal
    const = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", 1.0), ("b", 2.0)], "g string, x double")
    ks = {r["g"]: r for r in ks_normal(const, "x", ["g"]).collect()}
    assert ks["a"]["ks_statistic"] is None and ks["b"]["ks_statistic"] is not None
    empty_text = spark.createDataFrame([(1, None), (2, None)], "id long, t string")
    assert P.mixed_type_columns(empty_text).count() == 0
    cents = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0)], "group string, variable string, mean double")
    assert [r["scaled"] for r in D.centroid_profile(cents).collect()] == [None, None]
    rows = spark.createDataFrame([(1, 3.0, None, None)], "id long, q1 double, q2 double, q3 double")
    assert O.straightliners(rows, O.ScaleGroups({"g": ("q1", "q2", "q3")}), threshold=0.5).count() == 0


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 1.0, "b"), (3.0, 9.0, None), (50.0, 4.0, "a")],
                               "`unit price` double, `qty.sold` double, `seg ment` string")
    from tessera.operators.quantiles import quantile_map
    q = quantile_map(df, ["unit price", "qty.sold"], [0.5])
    assert q["unit price"][0] == 2.5 and q["qty.sold"][0] == 3.0
    plan = fit_cleaning(df, CleaningConfig())
    out = plan.transform(df)
    assert out.columns == ["unit price", "qty.sold", "seg ment"] and out.count() == 4
    assert P.profile_dict(df)["seg ment"]["kind"] == "categorical_low"
    assert E.fit_zscore(df).stats.keys() == {"unit price", "qty.sold"}


def test_frequency_table_totals(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    t = Fq.frequency_table(ev, "value").orderBy("bin").collect()
    n = ev.where("value is not null").count()
    assert sum(r["frequency"] for r in t) == n
    assert t[-1]["cumulative_frequency"] == n and math.isclose(t[-1]["cumulative_relative_frequency"], 1.0)
    assert len(t) == Fq.sturges_bins(n)
    cf = Fq.category_frequencies(spark.read.parquet("/root/testdata/sf0.001/part.parquet"), "p_brand").collect()
    assert cf[-1]["cumulative_frequency"] == sum(r["frequency"] for r in cf)


def test_impute_boolean_and_date_by_mode(spark):
    import datetime
    df = spark.createDataFrame([(1, True, datetime.date(2020, 1, 2)), (2, True, datetime.date(2020, 1, 2)),
                                (3, None, None), (4, False, datetime.date(2021, 5, 1))],
                               "id long, b boolean, d date")
    out = {r["id"]: r for r in fit_impute(df, "mean").transform(df).collect()}
    assert out[3]["b"] is True and out[3]["d"] == datetime.date(2020, 1, 2)
    assert dict(fit_impute(df, "mean").transform(df).dtypes)["b"] == "boolean"


def test_sample_values_of_few_distinct_values(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    few = P.sample_values(part.select("p_partkey", (F.col("p_size") % 3).alias("m")), "p_partkey", ["m"]).first()
    assert len(few["sample_values"].split(", ")) == 3


def test_distinct_counts_of_all_kinds_of_columns(spark):
    rows = [(1, 0.0, "a", True, [1], {"k": 1}, bytearray(b"x")), (2, -0.0, "b", None, [1], {"k": 1}, bytearray(b"y")),
            (9007199254740993, 1.5, None, True, [2], None, bytearray(b"x")), (9007199254740992, None, "a", False, None, {"k": 2}, None)]
    df = spark.createDataFrame(rows, "i long, d double, `s. t` string, b boolean, l array<int>, m map<string,int>, x binary")
    got = {r["variable"]: r["n_unique"] for r in P.profile(df).collect()}
    assert got == {"i": 4, "d": 2, "s. t": 2, "b": 2, "l": 2, "m": 2, "x": 2}
    assert {r["n_unique"] for r in P.profile(df.limit(0)).collect()} == {0}


def test_pages_read_their_own_folder(spark, tmp_path):
    from tessera.sources.io import paged_count, read_page, write_paged
    df = spark.range(1_050).select((F.lit(5_000) - F.col("id")).alias("k"), (F.col("id") % 7).alias("v")).repartition(5)
    write_paged(df, str(tmp_path / "t"), order_by=["k"], rows_per_part=100)
    assert paged_count(spark, str(tmp_path / "t")) == 1_050
    for number, size in ((1, 30), (4, 30), (35, 30), (36, 30), (2, 333)):
        got = read_page(spark, str(tmp_path / "t"), number, size)
        assert [r["k"] for r in got.collect()] == [3_951 + i for i in range((number - 1) * size, min(number * size, 1_050))]
    assert len(read_page(spark, str(tmp_path / "t"), 4, 30).inputFiles()) >= 1
    plan = read_page(spark, str(tmp_path / "t"), 4, 30)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "_part" in plan.split("PartitionFilters: ")[1].split("]")[0]
    write_paged(df.limit(0), str(tmp_path / "e"))
    assert paged_count(spark, str(tmp_path / "e")) == 0
