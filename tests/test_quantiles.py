import math

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.quantiles import modes, quantile_map, quantiles, value_ranks
from tests.conftest import SF_SMALL


def _np_quantile(xs, p):
    return float(np.quantile(np.array(xs, dtype=float), p))


def test_small_and_bucketed_paths_agree(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    small = quantile_map(li, cols, probs)
    big = quantile_map(li, cols, probs, single_task_limit=0, max_buckets=16)
    pdf = li.select(*cols).toPandas()
    for c in cols:
        for i, p in enumerate(probs):
            want = _np_quantile(pdf[c], p)
            assert math.isclose(small[c][i], want, rel_tol=1e-12, abs_tol=1e-9)
            assert math.isclose(big[c][i], want, rel_tol=1e-12, abs_tol=1e-9)


def test_grouped_bucketed_quantiles(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    got = {(r["event_type"], r["prob"]): r["value"]
           for r in quantiles(ev, ["value"], [0.25, 0.5], by=["event_type"], single_task_limit=0,
                              max_buckets=8).collect()}
    pdf = ev.select("event_type", "value").toPandas()
    for (g, p), v in got.items():
        assert math.isclose(v, _np_quantile(pdf[pdf.event_type == g].value, p), rel_tol=1e-12)


def test_hot_value_quantiles(spark):
    # one value holds a third of the rows
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("id") * 1.0).alias("x"))
    xs = [7.0 if i % 3 == 0 else float(i) for i in range(3000)]
    got = quantile_map(df, ["x"], [0.1, 0.33, 0.5], single_task_limit=0, max_buckets=32)["x"]
    for v, p in zip(got, [0.1, 0.33, 0.5]):
        assert math.isclose(v, _np_quantile(xs, p), rel_tol=1e-12)


def test_value_ranks_paths_agree(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2, 2, 5, 3, 3, 9]], "x double")
    small = {r["value"]: r["rank"] for r in value_ranks(df, ["x"]).collect()}
    big = {r["value"]: r["rank"] for r in value_ranks(df, ["x"], single_task_limit=0, max_buckets=4).collect()}
    assert small == {1.0: 1.0, 2.0: 2.5, 3.0: 5.0, 5.0: 7.0, 9.0: 8.0}
    assert big == small


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (2,)], "x int")
    r = modes(df, ["x"], value_type="double").first()
    assert r["value"] == 1.0 and r["count"] == 2
