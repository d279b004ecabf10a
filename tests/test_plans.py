"""Physical-plan checks: the scale properties the operators rely on."""

from tessera.operators.freq import category_frequencies, hash_sample
from tessera.operators.quantiles import modes, quantiles
from tessera.registry.base import table
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_mode_uses_partial_window_group_limit(spark):
    li = table(spark, SF_SMALL, "lineitem")
    plan = _plan(modes(li, ["l_quantity", "l_tax"], value_type="double"))
    assert "WindowGroupLimit" in plan


def test_quantiles_avoid_percentile_aggregate_and_prune_columns(spark):
    li = table(spark, SF_SMALL, "lineitem")
    q = quantiles(li, ["l_quantity"], [0.5])
    plan = _plan(q)
    assert "percentile(" not in plan.lower()
    assert "l_comment" not in plan and "l_shipdate" not in plan  # only the needed column is read


def test_top_k_is_take_ordered(spark):
    part = table(spark, SF_SMALL, "part")
    assert "TakeOrderedAndProject" in _plan(hash_sample(part, 50, key=["p_partkey"]))
    cf = category_frequencies(part, "p_brand")
    assert "TakeOrderedAndProject" in _plan(cf) or "limit" in _optimized(cf).lower()


def test_filters_reach_the_scan(spark):
    from tessera.sources.io import load_table
    li = load_table(spark, f"{SF_SMALL}/lineitem.parquet", columns=["l_quantity"], where="l_quantity > 10")
    plan = _plan(li)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double>" in plan
    # filters on non-float columns push down even after the NaN projection
    li2 = table(spark, SF_SMALL, "lineitem").where("l_linenumber = 3").select("l_quantity")
    assert "EqualTo(l_linenumber,3)" in _plan(li2)


def test_row_id_dense_without_python(spark):
    from tessera.sources.io import with_row_id
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").repartition(5)
    ids = sorted(r["_row_id"] for r in with_row_id(li).select("_row_id").collect())
    assert ids == list(range(li.count()))
    assert "PythonRDD" not in with_row_id(li)._jdf.queryExecution().toString()
