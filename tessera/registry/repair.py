"""Registered queries: imputation, cleaning plan, report, cell flags, encoding, paging."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import encode as E
from tessera.operators import profile as P
from tessera.operators.repair import fit_impute
from tessera.plans.analysis import confirm
from tessera.plans.cleaning import CleaningConfig, fit_cleaning
from tessera.registry.base import ORACLE, fixture, register, rounded, table, views, with_fixtures
from tessera.registry.cleaning import _flag_sql, _iqr_sql
from tessera.session import ensure_checkpoint_dir
from tessera.sources.io import ROW_ID, page, read_csv, read_page, write_paged, write_table

HOLES_KEEP = ["o_orderkey", "price", "qty", "status", "sparse_col", "flag01"]
_HK = "select o_orderkey, price, qty, status, sparse_col, flag01 from orders_holes"


def _holes(spark, sf_dir):
    return fixture(spark, sf_dir, "orders_holes").select(*HOLES_KEEP)


def _mode_sql(src: str, c: str, where: str = "true") -> str:
    return (f"(select {c} from {src} where {c} is not null and {where} group by {c} "
            f"order by count(*) desc, {c} limit 1)")


def _impute_sql(stat: str, drop_price: bool = False) -> str:
    agg = "avg({c})" if stat == "mean" else "quantile_cont({c}, 0.5)"
    alive = "price is not null" if drop_price else "true"
    price = "price" if drop_price else f"coalesce(price, (select {agg.format(c='price')} from h))"
    return with_fixtures(f"""
, h as ({_HK})
select o_orderkey, round({price}, 6) as price,
  cast(round_even(coalesce(qty, (select {agg.format(c='qty')} from h where {alive})), 0) as bigint) as qty,
  coalesce(status, {_mode_sql('h', 'status', alive)}) as status,
  round(coalesce(sparse_col, (select {agg.format(c='sparse_col')} from h where {alive})), 6) as sparse_col,
  flag01
from h where {alive}""", "orders_holes").replace("\n, h as", ", h as", 1)


@register("impute_mean", _impute_sql("mean"))
def q_impute_mean(spark, sf_dir):
    h = _holes(spark, sf_dir)
    return rounded(fit_impute(h, "mean").transform(h))


@register("impute_median", _impute_sql("median"))
def q_impute_median(spark, sf_dir):
    h = _holes(spark, sf_dir)
    return rounded(fit_impute(h, "median").transform(h))


@register("impute_drop_order", _impute_sql("mean", drop_price=True))
def q_impute_drop_order(spark, sf_dir):
    h = _holes(spark, sf_dir)
    return rounded(fit_impute(h, "mean", {"price": "drop"}).transform(h))


@register("impute_mode", with_fixtures(
    f"select o_orderkey, coalesce(status, {_mode_sql('orders_holes', 'status')}) as status from orders_holes",
    "orders_holes"))
def q_impute_mode(spark, sf_dir):
    h = fixture(spark, sf_dir, "orders_holes").select("o_orderkey", "status")
    return fit_impute(h, "mean").transform(h)


# ---------------------------------------------------------------- cleaning plan

_HOLE_NUM = ["o_orderkey", "price", "qty", "flag01"]
_HOLES_STAGE = f"""
, b as ({_iqr_sql('orders_holes', _HOLE_NUM)}),
s as (select o_orderkey, case when {_flag_sql('price')} then null else price end as price,
      case when {_flag_sql('qty')} then null else qty end as qty, status,
      case when {_flag_sql('flag01')} then null else flag01 end as flag01 from orders_holes),
final as (select o_orderkey, coalesce(price, (select avg(price) from s)) as price,
  cast(round_even(coalesce(qty, (select avg(qty) from s)), 0) as bigint) as qty,
  coalesce(status, {_mode_sql('s', 'status')}) as status, flag01 from s)"""


def _cte(sql: str, *fixtures: str) -> str:
    return with_fixtures(sql, *fixtures).replace("\n, b as", ", b as", 1)


_SV_NUM = ["user_id", "q1", "q2", "q3", "q4", "spend"]
_SL = ("((q1 is not null)::int + (q2 is not null)::int + (q3 is not null)::int + (q4 is not null)::int) >= 2 "
       "and least(q1, q2, q3, q4) = greatest(q1, q2, q3, q4)")
_SURVEY_STAGE = f"""
, b as ({_iqr_sql('survey', _SV_NUM)}),
s as (select user_id, {', '.join(f"case when {_flag_sql(c)} then null else {c} end as {c}" for c in _SV_NUM[1:])},
      segment from survey where not ({_SL})),
final as (select user_id, """ + ", ".join(
    f"cast(round_even(coalesce({c}, (select avg({c}) from s)), 0) as bigint) as {c}" for c in ["q1", "q2", "q3", "q4"]) + \
    """, coalesce(spend, (select avg(spend) from s)) as spend,
  coalesce(segment, (select segment from s where segment is not null group by segment
                     order by count(*) desc, segment limit 1)) as segment from s)"""

_SURVEY_CFG = CleaningConfig(id_columns=("user_id",))
_HOLES_CFG = CleaningConfig(id_columns=("o_orderkey",))


@register("clean_holes", _cte(_HOLES_STAGE + "\nselect o_orderkey, round(price, 6) as price, qty, status, flag01 from final",
                              "orders_holes"))
def q_clean_holes(spark, sf_dir):
    h = fixture(spark, sf_dir, "orders_holes")
    return rounded(fit_cleaning(h, _HOLES_CFG).transform(h))


@register("clean_survey", _cte(_SURVEY_STAGE + "\nselect user_id, q1, q2, q3, q4, round(spend, 6) as spend, segment from final",
                               "survey"))
def q_clean_survey(spark, sf_dir):
    sv = fixture(spark, sf_dir, "survey")
    return rounded(fit_cleaning(sv, _SURVEY_CFG).transform(sv))


def _report_sql(stage, fixture_name, key, raw_cols, raw_num, final_cols, sl_raw, sl_struct):
    """Before: raw frame with its own bounds (``rb``); after: the cleaned frame joined
    back to the raw one on the key (outlier remains if flagged on the structural
    frame and unchanged)."""
    rb = _iqr_sql(fixture_name, raw_num)
    raw_flag = lambda c: _flag_sql(c).replace("from b where", "from rb where")
    nulls_b = " + ".join(f"({c} is null)::int" for c in raw_cols)
    outs_b = " + ".join(f"({raw_flag(c)})::int" for c in raw_num)
    nulls_a = " + ".join(f"(f.{c} is null)::int" for c in final_cols)
    struct_num = [c for c in final_cols if c in raw_num]
    remain = " + ".join(f"(coalesce(f.{c} = r.{c}, false) and "
                        f"{_flag_sql(c).replace(c + ' <', 'r.' + c + ' <').replace(c + ' >', 'r.' + c + ' >')})::int"
                        for c in struct_num)
    sl_b = f"count(*) filter (where {sl_raw})" if sl_raw else "cast(0 as bigint)"
    sl_a = f"count(*) filter (where {sl_struct})" if sl_struct else "cast(0 as bigint)"
    return _cte(stage + f""",
rb as ({rb}),
bef as (select count(*) as rows_before, cast(sum({nulls_b}) as bigint) as nulls_before,
        cast(sum({outs_b}) as bigint) as outliers_before, {sl_b} as straightliners_before from {fixture_name}),
aft as (select count(*) as rows_after, cast(sum({nulls_a}) as bigint) as nulls_after,
        cast(coalesce(sum({remain}), 0) as bigint) as outliers_after,
        {sl_a.replace('q', 'r.q') if sl_struct else sl_a} as straightliners_after
        from final f join {fixture_name} r on f.{key} = r.{key})
select rows_before, rows_after, rows_after - rows_before as rows_delta,
  nulls_before, nulls_after, nulls_after - nulls_before as nulls_delta,
  outliers_before, outliers_after, outliers_after - outliers_before as outliers_delta,
  straightliners_before, straightliners_after, straightliners_after - straightliners_before as straightliners_delta
from bef, aft""", fixture_name)


_REPORT_SQL = _report_sql(_HOLES_STAGE, "orders_holes", "o_orderkey",
                          ["o_orderkey", "price", "qty", "status", "empty_col", "sparse_col", "flag01"],
                          ["o_orderkey", "price", "qty", "sparse_col", "flag01"],
                          ["o_orderkey", "price", "qty", "status", "flag01"], None, None)


@register("cleaning_report", _REPORT_SQL)
def q_cleaning_report(spark, sf_dir):
    h = fixture(spark, sf_dir, "orders_holes")
    return fit_cleaning(h, _HOLES_CFG).report(h)


@register("cleaning_report_survey", _report_sql(
    _SURVEY_STAGE, "survey", "user_id", _SV_NUM + ["segment"], _SV_NUM, _SV_NUM + ["segment"], _SL, _SL))
def q_cleaning_report_survey(spark, sf_dir):
    sv = fixture(spark, sf_dir, "survey")
    return fit_cleaning(sv, _SURVEY_CFG).report(sv)


_CF_COLS = ["q1", "q2", "q3", "q4", "spend"]


@register("cell_flags", _cte(f"""
, b as ({_iqr_sql('survey', _SV_NUM)}),
fl as (select *, ({_SL}) as sl from survey)
select user_id, variable, state from (""" + "\nunion all\n".join(
    f"select user_id, '{c}' as variable, case when {c} is null then 'null' when {_flag_sql(c)} then 'outlier' "
    f"when sl then 'straightline' end as state from fl" for c in _CF_COLS) + """
  union all
  select user_id, 'segment', case when segment is null then 'null' when sl then 'straightline' end from fl
) t where state is not null""", "survey"))
def q_cell_flags(spark, sf_dir):
    """Display state of every cell when outliers and straight-liners are kept."""
    sv = fixture(spark, sf_dir, "survey")
    cfg = CleaningConfig(id_columns=("user_id",), outlier_action="ignore", straightline_action="ignore",
                         impute=False)
    return fit_cleaning(sv, cfg).cell_flags(sv, "user_id", include_id=False)


_RA_CELLS = ", ".join(f"case when user_id%3=2 and {_flag_sql(c)} then null else {c} end as {c}" for c in _SV_NUM)
_RA_ANY = " or ".join(f"coalesce({_flag_sql(c)}, false)" for c in _SV_NUM)


@register("clean_row_actions", _cte(f"""
, b as ({_iqr_sql('survey', _SV_NUM)}),
fl as (select *, ({_SL}) as sl, ({_RA_ANY}) as hit from survey)
select {', '.join(_SV_NUM)}, segment from (
  select {_RA_CELLS}, segment from fl
  where not (hit and user_id%3=0) and not (coalesce(sl, false) and user_id%2<>0)) t""", "survey"))
def q_clean_row_actions(spark, sf_dir):
    """Outlier rows dropped, ignored or neutralised one by one; some straight-liners kept."""
    sv = fixture(spark, sf_dir, "survey")
    acts = sv.select("user_id", F.when(F.col("user_id") % 3 == 0, "drop").otherwise("ignore").alias("action")).where("user_id % 3 < 2")
    cfg = CleaningConfig(id_columns=("user_id",), structural=False, impute=False, row_id="user_id", row_actions=acts,
                         keep_rows=sv.select("user_id").where("user_id % 2 = 0"))
    return fit_cleaning(sv, cfg).transform(sv)


# ---------------------------------------------------------------- encoding and paging

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot", "select c_custkey, c_name, c_nationkey, c_acctbal, " + ", ".join(
    f"cast(coalesce(c_mktsegment = '{s}', false) as tinyint) as c_mktsegment_{s}" for s in _SEGMENTS) +
    " from customer")
def q_one_hot(spark, sf_dir):
    cust = table(spark, sf_dir, "customer")
    return E.one_hot(cust, profile=P.profile_dict(cust))


_STATUSES = ["F", "O", "P"]  # order statuses of the table


@register("clean_confirm", _cte(_HOLES_STAGE + """
select o_orderkey, round((price - (select avg(price) from final)) / (select stddev_pop(price) from final), 6) + 0.0 as price,
       round((qty - (select avg(qty) from final)) / (select stddev_pop(qty) from final), 6) + 0.0 as qty, flag01, """ + ", ".join(
    f"cast(status = '{v}' as tinyint) as status_{v}" for v in _STATUSES) + " from final", "orders_holes"))
def q_clean_confirm(spark, sf_dir):
    """The confirm step end to end: cleaned, one-hot by the raw profile, z-scored."""
    scaled = rounded(confirm(fixture(spark, sf_dir, "orders_holes"), _HOLES_CFG)["scaled"])
    return scaled.withColumns({c: F.col(c) + 0.0 for c in ("price", "qty")})  # no negative zeros


@register("zscore", """
select p_partkey, p_name, p_brand, p_type,
  round((p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part), 6) as p_size,
  round((p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_pop(p_retailprice) from part), 6)
    as p_retailprice
from part""")
def q_zscore(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return rounded(E.zscore(part, exclude=["p_partkey"], profile=P.profile_dict(part)))


@register("page", with_fixtures("select * from survey order by user_id limit 200 offset 400", "survey"))
def q_page(spark, sf_dir):
    return page(fixture(spark, sf_dir, "survey"), 3, 200, order_by="user_id")


@register("page_indexed", with_fixtures("select * from survey order by user_id limit 200 offset 1400", "survey"))
def q_page_indexed(spark, sf_dir):
    """A page of the table written for paging: only the folder that holds it is read."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera/pages-{uuid.uuid4().hex}"
    write_paged(fixture(spark, sf_dir, "survey"), path, order_by=["user_id"], rows_per_part=1_000)
    return read_page(spark, path, 8, 200).drop(ROW_ID)


# ---------------------------------------------------------------- streaming

@register("stream_clean_events", ORACLE["neutralize_outliers"])
def q_stream_clean_events(spark, sf_dir):
    """The events table read as a file stream and cleaned by a plan fitted on the
    batch table: flagged cells neutralised, nothing else to repair."""
    from tessera.streaming.quality import clean_stream, parquet_stream, run_to_table
    cols = ["event_id", "user_id", "event_type", "value"]
    ev = table(spark, sf_dir, "events").select(*cols)
    plan = fit_cleaning(ev, CleaningConfig(id_columns=("event_id",), impute=False))
    path = f"{sf_dir}/events.parquet"
    stream = parquet_stream(spark, path, spark.read.parquet(path).schema).select(*cols)
    return run_to_table(clean_stream(plan, stream), name="clean-events")


_BIG = """select o_orderkey, case when o_orderkey%7=0 then null
       else 9007199254740993 + 2*(o_orderkey%1000) end as v from orders"""


@register("impute_bigint", f"""with h as ({_BIG})
select o_orderkey, coalesce(v, (select cast(round_even(quantile_cont(cast(v as double), 0.5), 0) as bigint) from h)) as v
from h""")
def q_impute_bigint(spark, sf_dir):
    """Integers beyond 2^53 keep their value; only NULL cells are filled."""
    views(spark, sf_dir, "orders")
    h = spark.sql(_BIG)
    return fit_impute(h, "median").transform(h)


_QUOTED = """select c_custkey, concat('say "', c_name, '", x', {end}, c_custkey) as note, c_mktsegment from customer"""


@register("csv_roundtrip", _QUOTED.format(end="chr(10)"))
def q_csv_roundtrip(spark, sf_dir):
    """A table with quotes, separators and line ends written as CSV and read back."""
    views(spark, sf_dir, "customer")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-roundtrip-{uuid.uuid4().hex}"
    write_table(spark.sql(_QUOTED.format(end="char(10)")), path, "csv")
    return read_csv(spark, path)
