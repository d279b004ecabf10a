import __spark_entry__ as E
from tests.conftest import SF_SMALL

FAST = ["profile_columns", "null_summary", "outlier_count", "clean_survey", "category_frequencies",
        "frequency_table", "central_tendency", "correlation_pearson", "lda_predict", "kmo", "cluster_profiles"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 1 and len(df.columns) > 0


def test_every_query_has_callable_and_oracle_subset():
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    assert len(qs) >= 80


def test_fast_queries_run_at_small_scale(spark):
    qs = E.queries()
    for name in FAST:
        df = qs[name](spark, SF_SMALL)
        assert df.count() >= 1, name
