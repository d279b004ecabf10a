"""Registered queries: profiling, structural diagnosis, outliers, straight-lining."""

from __future__ import annotations


from tessera.functions.columns import NUMBER_PATTERN, INFINITY_WORDS, to_number
from tessera.operators import outliers as O
from tessera.operators import profile as P
from tessera.registry.base import fixture, register, rounded, table, with_fixtures

# ---------------------------------------------------------------- SQL helpers

_KIND_SQL = """case
  when fam = 'numeric' then case when not all_integral then 'continuous'
       when unique_ratio > 0.95 and n_unique > 20 then 'id'
       when n_unique <= 20 then 'discrete' else 'continuous' end
  when fam = 'text' then case when unique_ratio > 0.95 and n_unique > 20 then 'id'
       when n_unique <= 20 then 'categorical_low' else 'categorical_high' end
  else case when n_unique <= 10 then 'categorical_low' when unique_ratio > 0.80 then 'id'
       else 'categorical_high' end end"""


def profile_sql(source: str, cols: list[tuple[str, str, str]], ctes: tuple[str, ...] = ()) -> str:
    parts = []
    for name, dtype, fam in cols:
        integral = (f"coalesce(bool_and({name} is null or cast({name} as double) % 1 = 0), true)"
                    if fam == "numeric" else "cast(null as boolean)")
        parts.append(
            f"select '{name}' as variable, '{dtype}' as dtype, '{fam}' as fam, "
            f"count(distinct {name}) as n_unique, count(*) as n_rows, count({name}) as n_non_null, "
            f"{integral} as all_integral, "
            f"case when count(*) > 0 then count(distinct {name}) / count(*) else 0.0 end as unique_ratio "
            f"from {source}")
    body = "\nunion all\n".join(parts)
    sql = (f"select variable, dtype, {_KIND_SQL} as kind, n_unique, round(unique_ratio, 6) as unique_ratio, "
           f"n_rows, n_non_null, all_integral from (\n{body}\n) t")
    return with_fixtures(sql, *ctes) if ctes else sql


def _num_sql(x: str) -> str:
    words = ", ".join(f"'{w}'" for w in INFINITY_WORDS)
    return (f"case when regexp_matches(trim({x}), '{NUMBER_PATTERN}') or lower(trim({x})) in ({words}) "
            f"then try_cast(trim({x}) as double) end")


def _iqr_sql(src: str, cols: list[str]) -> str:
    parts = [f"select '{c}' as variable, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 "
             f"from {src}" for c in cols]
    return "\nunion all\n".join(parts)


def _flag_sql(c: str) -> str:
    return (f"coalesce({c} < (select q1 - 1.5 * (q3 - q1) from b where variable = '{c}') "
            f"or {c} > (select q3 + 1.5 * (q3 - q1) from b where variable = '{c}'), false)")


CUSTOMER_COLS = [("c_custkey", "bigint", "numeric"), ("c_name", "string", "text"),
                 ("c_nationkey", "int", "numeric"), ("c_acctbal", "double", "numeric"),
                 ("c_mktsegment", "string", "text")]
EVENTS_COLS = [("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "other"),
               ("user_id", "bigint", "numeric"), ("event_type", "string", "text"),
               ("value", "double", "numeric"), ("props", "string", "text")]
HOLES_COLS = [("o_orderkey", "bigint", "numeric"), ("price", "double", "numeric"),
              ("qty", "bigint", "numeric"), ("status", "string", "text"),
              ("empty_col", "double", "numeric"), ("sparse_col", "double", "numeric"),
              ("flag01", "bigint", "numeric")]
EVENT_NUM = ["event_id", "user_id", "value"]
EVENT_OUT = "event_id, user_id, event_type, value"
SURVEY_ITEMS = ["q1", "q2", "q3", "q4"]


def _profile_out(df):
    return rounded(df.drop("dtype_family") if "dtype_family" in df.columns else df)


# ---------------------------------------------------------------- profiling

@register("profile_columns", profile_sql("customer", CUSTOMER_COLS))
def q_profile_columns(spark, sf_dir):
    return _profile_out(P.profile(table(spark, sf_dir, "customer")))


@register("profile_columns_events", profile_sql("events", EVENTS_COLS))
def q_profile_columns_events(spark, sf_dir):
    return _profile_out(P.profile(table(spark, sf_dir, "events")))


@register("profile_columns_holes", profile_sql("orders_holes", HOLES_COLS, ("orders_holes",)))
def q_profile_columns_holes(spark, sf_dir):
    return _profile_out(P.profile(fixture(spark, sf_dir, "orders_holes")))


_SAMPLE_COLS = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@register("sample_values", """
with long as (
""" + "\nunion all\n".join(
    f"select '{c}' as variable, cast({c} as varchar) as value, p_partkey as ord from part where {c} is not null"
    for c in _SAMPLE_COLS) + """
), firsts as (select variable, value, min(ord) as f from long group by variable, value),
top as (select *, row_number() over (partition by variable order by f) as rn from firsts)
select variable, string_agg(value, ', ' order by f) as sample_values from top where rn <= 10 group by variable
""")
def q_sample_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return P.sample_values(part, "p_partkey", _SAMPLE_COLS)


@register("null_summary", with_fixtures("\nunion all\n".join(
    f"select '{c}' as variable, '{d}' as dtype, count(*) filter (where {c} is null) as null_count, "
    f"round(count(*) filter (where {c} is null) / count(*), 6) as null_share, count(*) as n_rows "
    f"from orders_holes having count(*) filter (where {c} is null) > 0"
    for c, d, _ in HOLES_COLS), "orders_holes"))
def q_null_summary(spark, sf_dir):
    return rounded(P.null_summary(fixture(spark, sf_dir, "orders_holes")))


@register("null_totals", with_fixtures(
    "select count(*) as n_rows, cast(" + " + ".join(
        f"count(*) filter (where {c} is null)" for c, _, _ in HOLES_COLS) +
    " as bigint) as n_null_cells from orders_holes", "orders_holes"))
def q_null_totals(spark, sf_dir):
    return P.null_totals(fixture(spark, sf_dir, "orders_holes"))


@register("rows_with_nulls", with_fixtures(
    "select * from orders_holes where price is null or qty is null or status is null", "orders_holes"))
def q_rows_with_nulls(spark, sf_dir):
    return P.rows_with_nulls(fixture(spark, sf_dir, "orders_holes"), ["price", "qty", "status"])


@register("structural_columns", with_fixtures("""
select variable, round(share, 6) as null_share, case when share = 1.0 then 'empty' else 'sparse' end as issue
from (""" + "\nunion all\n".join(
    f"select '{c}' as variable, count(*) filter (where {c} is null) / count(*) as share from orders_holes"
    for c, _, _ in HOLES_COLS) + ") t where share >= 0.6", "orders_holes"))
def q_structural_columns(spark, sf_dir):
    return rounded(P.structural_columns(fixture(spark, sf_dir, "orders_holes")))


@register("mixed_type_columns", with_fixtures(f"""
select variable, n_non_null, n_numeric, round(n_numeric / n_non_null, 6) as success_rate from (
  select 'bal_text' as variable, count(bal_text) as n_non_null, count({_num_sql('bal_text')}) as n_numeric
  from mixed_text
  union all
  select 'c_mktsegment', count(c_mktsegment), count({_num_sql('c_mktsegment')}) from mixed_text
) t where n_numeric > 0 and n_numeric / n_non_null > 0.5 and n_numeric < n_non_null""", "mixed_text"))
def q_mixed_type_columns(spark, sf_dir):
    return rounded(P.mixed_type_columns(fixture(spark, sf_dir, "mixed_text")))


@register("mixed_type_rows", with_fixtures(f"""
select c_custkey, 'bal_text' as variable, bal_text as value from mixed_text
where bal_text is not null and {_num_sql('bal_text')} is null""", "mixed_text"))
def q_mixed_type_rows(spark, sf_dir):
    return P.mixed_type_rows(fixture(spark, sf_dir, "mixed_text"), ["bal_text"], "c_custkey")


@register("coerce_numeric", with_fixtures(
    f"select c_custkey, {_num_sql('bal_text')} as bal_text, c_mktsegment from mixed_text", "mixed_text"))
def q_coerce_numeric(spark, sf_dir):
    df = fixture(spark, sf_dir, "mixed_text")
    return df.withColumn("bal_text", to_number("bal_text"))


# ---------------------------------------------------------------- outliers

@register("iqr_bounds", f"""
with b as ({_iqr_sql('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'])})
select variable, round(q1, 6) as q1, round(q3, 6) as q3, round(q1 - 1.5 * (q3 - q1), 6) as lower,
       round(q3 + 1.5 * (q3 - q1), 6) as upper from b""")
def q_iqr_bounds(spark, sf_dir):
    return rounded(O.iqr_bounds_df(table(spark, sf_dir, "customer")))


_EB = f"with b as ({_iqr_sql('events', EVENT_NUM)})\n"


@register("outlier_cells", _EB + "\nunion all\n".join(
    f"select event_id, '{c}' as variable, cast({c} as double) as value from events where {_flag_sql(c)}"
    for c in EVENT_NUM))
def q_outlier_cells(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return O.outlier_cells(ev, O.fit_iqr_bounds(ev, EVENT_NUM), "event_id")


@register("outlier_count", _EB + "select variable, n_outliers from (" + "\nunion all\n".join(
    f"select '{c}' as variable, count(*) filter (where {_flag_sql(c)}) as n_outliers from events"
    for c in EVENT_NUM) + ") t where n_outliers > 0")
def q_outlier_count(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return O.outlier_counts(ev, O.fit_iqr_bounds(ev, EVENT_NUM))


@register("rows_with_outliers", _EB + f"select {EVENT_OUT} from events where " +
          " or ".join(_flag_sql(c) for c in EVENT_NUM))
def q_rows_with_outliers(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(*EVENT_OUT.split(", "))
    return O.rows_with_outliers(ev, O.fit_iqr_bounds(ev, EVENT_NUM))


@register("neutralize_outliers", _EB + "select " + ", ".join(
    f"case when {_flag_sql(c)} then null else {c} end as {c}" if c in EVENT_NUM else c
    for c in EVENT_OUT.split(", ")) + " from events")
def q_neutralize_outliers(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(*EVENT_OUT.split(", "))
    return O.apply_outliers(ev, O.fit_iqr_bounds(ev, EVENT_NUM), "null")


@register("drop_outlier_rows", _EB + f"select {EVENT_OUT} from events where not (" +
          " or ".join(_flag_sql(c) for c in EVENT_NUM) + ")")
def q_drop_outlier_rows(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(*EVENT_OUT.split(", "))
    return O.apply_outliers(ev, O.fit_iqr_bounds(ev, EVENT_NUM), "drop")


# ---------------------------------------------------------------- straight-lining

_STRAIGHT_SQL = ("((q1 is not null)::int + (q2 is not null)::int + (q3 is not null)::int + "
                 "(q4 is not null)::int) >= 2 and least(q1, q2, q3, q4) = greatest(q1, q2, q3, q4)")


@register("scale_groups", with_fixtures("""
select range_label as group_label, string_agg(variable, ',' order by variable) as items, count(*) as n_items
from (select variable, 'range_' || cast(trunc(mn) as bigint) || '_' || cast(trunc(mx) as bigint) as range_label
      from (""" + "\nunion all\n".join(
    f"select '{c}' as variable, min({c})::double as mn, max({c})::double as mx from survey"
    for c in ["q1", "q2", "q3", "q4", "spend"]) + """) s) t
group by range_label having count(*) >= 3""", "survey"))
def q_scale_groups(spark, sf_dir):
    sv = fixture(spark, sf_dir, "survey")
    g = O.fit_scale_groups(sv, exclude=["user_id"])
    rows = [(k, ",".join(sorted(v)), len(v)) for k, v in g.groups.items()]
    return spark.createDataFrame(rows, "group_label string, items string, n_items long")


@register("straightliners", with_fixtures(f"select * from survey where {_STRAIGHT_SQL}", "survey"))
def q_straightliners(spark, sf_dir):
    sv = fixture(spark, sf_dir, "survey")
    return O.straightliners(sv, O.fit_scale_groups(sv, exclude=["user_id"]))


@register("drop_straightliners", with_fixtures(f"select * from survey where not ({_STRAIGHT_SQL})", "survey"))
def q_drop_straightliners(spark, sf_dir):
    sv = fixture(spark, sf_dir, "survey")
    return O.drop_straightliners(sv, O.fit_scale_groups(sv, exclude=["user_id"]))


@register("sample_types", with_fixtures("select * from (" + "\nunion all\n".join(
    f"select '{c}' as variable, '{t}' as value_type, count({c}) as n from orders_holes"
    for c, t in [("o_orderkey", "int"), ("price", "float"), ("qty", "int"), ("status", "str"),
                 ("empty_col", "float"), ("sparse_col", "float"), ("flag01", "int")]) + ") t where n > 0",
    "orders_holes"))
def q_sample_types(spark, sf_dir):
    return P.sample_types(fixture(spark, sf_dir, "orders_holes"))


@register("integral_columns", with_fixtures("select * from (" + "\nunion all\n".join(
    f"select '{c}' as variable from orders_holes having count({c}) > 0 and "
    f"bool_and({c} is null or cast({c} as double) % 1 = 0)"
    for c in ["o_orderkey", "price", "qty", "empty_col", "sparse_col", "flag01"]) + ") t", "orders_holes"))
def q_integral_columns(spark, sf_dir):
    h = fixture(spark, sf_dir, "orders_holes")
    return spark.createDataFrame([(c,) for c in P.integral_columns(h)], "variable string")
