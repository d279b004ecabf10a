"""Registered queries: frequency tables, chart data, numeric summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import freq as Fq
from tessera.operators import summary as S
from tessera.registry.base import LINE_KEYS, register, rounded, sample_order, table

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts):
    return "\nunion all\n".join(parts)


# ---------------------------------------------------------------- frequencies

_CAT_SQL = """
with vc as (select cast(p_brand as varchar) as category, count(*) as frequency from part
            where p_brand is not null group by 1),
r as (select *, row_number() over (order by frequency desc, category) as position from vc),
tot as (select sum(frequency) as total from vc),
t as (select position, category, frequency from r where position <= 20
      union all
      select 21, 'Other', cast(sum(frequency) as bigint) from r where position > 20 having count(*) > 0)
select cast(position as bigint) as position, category, frequency, round(frequency / total, 6) as relative_frequency,
       cast(sum(frequency) over (order by position) as bigint) as cumulative_frequency
from t, tot"""


def _cat(spark, sf_dir):
    t = Fq.category_frequencies(table(spark, sf_dir, "part"), "p_brand", top_n=20)
    return rounded(t.withColumn("position", F.col("position").cast("bigint")))


@register("category_frequencies", _CAT_SQL)
def q_category_frequencies(spark, sf_dir):
    return _cat(spark, sf_dir)


@register("frequencies_odd_names", _CAT_SQL)
def q_frequencies_odd_names(spark, sf_dir):
    """Column names with dots, spaces and backticks are plain names."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "Q1. br`and")
    t = Fq.category_frequencies(part, "Q1. br`and", top_n=20)
    return rounded(t.withColumn("position", F.col("position").cast("bigint")))


@register("bar_data", "select position, category, frequency from (" + _CAT_SQL + ") z")
def q_bar_data(spark, sf_dir):
    return Fq.bar_data(_cat(spark, sf_dir))


_FREQ_BASE = """
with s as (select min(value) as mn, max(value) as mx, count(value) as n from events),
p as (select mn, mx, n, cast(floor(1 + 3.322 * log10(n)) as integer) as b from s),
e as (select b, n, list_transform(range(0, b + 1), lambda i: case when i = 0 then mn - (mx - mn) * 0.001
        when i = b then mx else mn + i * ((mx - mn) / b) end) as edges from p),
bins as (select unnest(range(1, b + 1)) as bin, edges, n from e),
cnt as (select least(b, greatest(1, len(list_filter(edges, lambda x: x < value)))) as bin, count(*) as frequency
        from events, e where value is not null group by 1),
ft as (select cast(bins.bin as integer) as bin, edges[bins.bin] as lower, edges[bins.bin + 1] as upper,
         (edges[bins.bin] + edges[bins.bin + 1]) / 2 as class_mark, coalesce(frequency, 0) as frequency, n
       from bins left join cnt on bins.bin = cnt.bin),
ftc as (select *, cast(sum(frequency) over (order by bin) as bigint) as cumulative_frequency from ft)
"""


def _ft(spark, sf_dir):
    return Fq.frequency_table(table(spark, sf_dir, "events"), "value")


@register("frequency_table", _FREQ_BASE + """
select bin, round(lower, 6) as lower, round(upper, 6) as upper, round(class_mark, 6) as class_mark, frequency,
  round(frequency / n, 6) as relative_frequency, cumulative_frequency,
  round(cumulative_frequency / n, 6) as cumulative_relative_frequency from ftc""")
def q_frequency_table(spark, sf_dir):
    return rounded(_ft(spark, sf_dir).drop("interval"))


@register("histogram", _FREQ_BASE + "select bin, round(lower, 6) as lower, round(upper, 6) as upper, frequency from ftc")
def q_histogram(spark, sf_dir):
    return rounded(Fq.histogram(_ft(spark, sf_dir)).drop("interval"))


@register("polygon", _FREQ_BASE + "select bin, round(class_mark, 6) as class_mark, frequency from ftc")
def q_polygon(spark, sf_dir):
    return rounded(Fq.polygon(_ft(spark, sf_dir)))


@register("ogive", _FREQ_BASE +
          "select bin, round(class_mark, 6) as class_mark, round(cumulative_frequency / n, 6) as "
          "cumulative_relative_frequency from ftc")
def q_ogive(spark, sf_dir):
    return rounded(Fq.ogive(_ft(spark, sf_dir)))


def _box_sql(group: bool) -> str:
    g = "event_type, " if group else ""
    gb = "group by event_type" if group else ""
    on = "using (event_type)" if group else "on true"
    return f"""
with q as (select {g}quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
                  quantile_cont(value, 0.75) as q3 from events where value is not null {gb}),
f as (select *, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from q)
select {g}count(*) as n, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  round(lower_fence, 6) as lower_fence, round(upper_fence, 6) as upper_fence,
  round(min(value) filter (where value >= lower_fence and value <= upper_fence), 6) as whisker_low,
  round(max(value) filter (where value >= lower_fence and value <= upper_fence), 6) as whisker_high,
  count(*) filter (where value < lower_fence or value > upper_fence) as n_outliers
from events join f {on} where value is not null
group by {g}q1, median, q3, lower_fence, upper_fence"""


@register("box_stats", _box_sql(False))
def q_box_stats(spark, sf_dir):
    return rounded(Fq.box_stats(table(spark, sf_dir, "events"), "value"))


@register("box_stats_by_group", _box_sql(True))
def q_box_stats_by_group(spark, sf_dir):
    return rounded(Fq.box_stats(table(spark, sf_dir, "events"), "value", by=["event_type"]))


@register("box_points", """
with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)
select event_id, value from events, q where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""")
def q_box_points(spark, sf_dir):
    return Fq.box_points(table(spark, sf_dir, "events"), "value", "event_id")


# Samples: the first rows by md5 of the seed and the key, which both engines compute alike.
@register("scatter_sample", f"""
select {', '.join(LINE_KEYS)}, l_quantity, l_extendedprice from lineitem
where l_quantity is not null and l_extendedprice is not null order by {sample_order(LINE_KEYS)} limit 3000""")
def q_scatter_sample(spark, sf_dir):
    return Fq.scatter_sample(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", n=3000, key=LINE_KEYS)


@register("scatter_matrix_sample", f"""
select {', '.join(LINE_KEYS)}, {', '.join(LI_COLS)} from lineitem
where {' and '.join(f'{c} is not null' for c in LI_COLS)} order by {sample_order(LINE_KEYS)} limit 2000""")
def q_scatter_matrix_sample(spark, sf_dir):
    """All numeric columns of the table but its key."""
    return Fq.scatter_matrix_sample(table(spark, sf_dir, "lineitem"), n=2000, key=LINE_KEYS)


# ---------------------------------------------------------------- numeric summaries

@register("central_tendency", _union(
    f"select '{c}' as variable, round(avg({c}), 6) as mean, round(quantile_cont({c}, 0.5), 6) as median, "
    f"(select {c} from lineitem where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as mode "
    f"from lineitem" for c in LI_COLS))
def q_central_tendency(spark, sf_dir):
    return rounded(S.central_tendency(table(spark, sf_dir, "lineitem"), LI_COLS))


@register("dispersion", _union(
    f"select '{c}' as variable, round(max({c}) - min({c}), 6) as range, round(var_samp({c}), 6) as variance, "
    f"round(stddev_samp({c}), 6) as std, round(case when avg({c}) <> 0 then stddev_samp({c}) / avg({c}) * 100 end, 6) "
    f"as cv_percent from lineitem" for c in LI_COLS))
def q_dispersion(spark, sf_dir):
    return rounded(S.dispersion(table(spark, sf_dir, "lineitem"), LI_COLS))


_DEC = [10, 20, 30, 40, 50, 60, 70, 80, 90]


@register("position", _union(
    f"select '{c}' as variable, round(quantile_cont({c}, 0.25), 6) as q1, round(quantile_cont({c}, 0.5), 6) as q2, "
    f"round(quantile_cont({c}, 0.75), 6) as q3, " +
    ", ".join(f"round(quantile_cont({c}, {d / 100}), 6) as p{d}" for d in _DEC) + " from lineitem"
    for c in LI_COLS))
def q_position(spark, sf_dir):
    p = S.position(table(spark, sf_dir, "lineitem"), LI_COLS, decimals=6)
    return rounded(p.select("variable", "q1", "q2", "q3",
                            *[F.col("deciles")[i].alias(f"p{d}") for i, d in enumerate(_DEC)]))


def _moment_sql(c: str, src: str = "lineitem", where: str = "") -> str:
    m = f"(select avg({c}) from {src} {where})"
    return (f"round(avg(power({c} - {m}, 3)) / power(avg(power({c} - {m}, 2)), 1.5), 6) as skewness, "
            f"round(avg(power({c} - {m}, 4)) / power(avg(power({c} - {m}, 2)), 2) - 3, 6) as kurtosis")


@register("shape", _union(f"select '{c}' as variable, {_moment_sql(c)} from lineitem" for c in LI_COLS))
def q_shape(spark, sf_dir):
    return rounded(S.shape(table(spark, sf_dir, "lineitem"), LI_COLS))


@register("interpret_shape", "select variable, " + f"""
case when skewness > 0.5 then '{S.SKEW_RIGHT}' when skewness < -0.5 then '{S.SKEW_LEFT}' else '{S.SKEW_NONE}' end
  as skew_label,
case when kurtosis > 0 then '{S.KURT_HEAVY}' when kurtosis < 0 then '{S.KURT_LIGHT}' else '{S.KURT_NORMAL}' end
  as tail_label
from (""" + _union(f"select '{c}' as variable, {_moment_sql(c)} from lineitem" for c in LI_COLS) + ") t")
def q_interpret_shape(spark, sf_dir):
    return S.shape_interpretation(table(spark, sf_dir, "lineitem"), LI_COLS)


@register("grouped_summary", _union(
    f"select l_returnflag, '{c}' as variable, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std "
    f"from lineitem group by l_returnflag" for c in LI_COLS))
def q_grouped_summary(spark, sf_dir):
    return rounded(S.grouped_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", LI_COLS))
