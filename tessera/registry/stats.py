"""Registered queries: correlation, category codes, normality tests."""

from __future__ import annotations

import re

from tessera.functions.distributions import normal_cdf_sql
from tessera.operators import correlation as C
from tessera.operators import normality as N
from tessera.registry.base import LINE_KEYS, register, rounded, sample_order, table
from tessera.registry.descriptive import LI_COLS


def _union(parts):
    return "\nunion all\n".join(parts)


def _pearson_sql(src: str, cols: list[str], where: str = "") -> str:
    return _union(f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as r from {src} {where}"
                  for a in cols for b in cols)


_COMPLETE = "where " + " and ".join(f"{c} is not null" for c in LI_COLS)


@register("correlation_pearson", _pearson_sql("lineitem", LI_COLS, _COMPLETE))
def q_correlation_pearson(spark, sf_dir):
    return rounded(C.correlation(table(spark, sf_dir, "lineitem"), LI_COLS, "pearson"))


_RANKED = ("(select " + ", ".join(
    f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in LI_COLS) +
    f" from lineitem {_COMPLETE}) rk")


@register("correlation_spearman", _pearson_sql(_RANKED, LI_COLS))
def q_correlation_spearman(spark, sf_dir):
    return rounded(C.correlation(table(spark, sf_dir, "lineitem"), LI_COLS, "spearman"))


_CAT_COLS = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
_CODED = ("(select l_quantity, l_discount, "
          "coalesce(dense_rank() over (order by l_returnflag) - 1, -1) as l_returnflag, "
          "coalesce(dense_rank() over (order by l_linestatus) - 1, -1) as l_linestatus "
          "from lineitem) cd")


@register("correlation_categorical", _pearson_sql(_CODED, _CAT_COLS))
def q_correlation_categorical(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*_CAT_COLS)
    return rounded(C.correlation(li, _CAT_COLS, "pearson", include_categorical=True))


@register("category_codes", """
select l_orderkey, l_linenumber, coalesce(dense_rank() over (order by l_returnflag) - 1, -1) as l_returnflag
from lineitem""")
def q_category_codes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return C.category_codes(li, "l_returnflag")


_PART_NUM = ["p_partkey", "p_size", "p_retailprice"]


@register("correlation_heatmap", _union(
    f"select '{a}' as x, '{b}' as y, round(greatest(-1.0, least(1.0, corr({a}, {b}))), 6) as r from part"
    for a in _PART_NUM for b in _PART_NUM))
def q_correlation_heatmap(spark, sf_dir):
    return rounded(C.correlation(table(spark, sf_dir, "part"), _PART_NUM, "pearson", clip=True))


# Normality: the normal distribution function is the same rational approximation in both engines.

def _plain(sql: str) -> str:
    """Spark's double literals as DuckDB reads them."""
    return re.sub(r"(?<=[0-9])D\b", "::double", sql)


_KS_SQL = """
with base as (select event_type, cast(value as double) as value from events where value is not null),
stats as (select event_type, count(*) as n, avg(value) as mean, stddev_samp(value) as std from base group by event_type),
steps as (select event_type, value, count(*) as cnt from base group by event_type, value),
ranked as (select s.*, n, mean, std, (value - mean) / std as z,
                  sum(cnt) over (partition by s.event_type order by value) as upto
           from steps s join stats using (event_type)),
gaps as (select *, """ + _plain(normal_cdf_sql("z")) + """ as cdf from ranked),
d as (select event_type, n, mean, std, max(greatest(upto / n - cdf, cdf - (upto - cnt) / n)) as d from gaps group by all)
"""


@register("ks_normal", _KS_SQL + """
select event_type, n, round(mean, 6) as mean, round(std, 6) as std, round(d, 6) as ks_statistic from d""")
def q_ks_normal(spark, sf_dir):
    """The p-value of a short series is a matrix power, which the tests check."""
    return rounded(N.ks_normal(table(spark, sf_dir, "events"), "value", by=["event_type"]).drop("ks_p"))


def _shapiro_sql(source: str, by: str, value: str, keys: list[str], most: int = N.SHAPIRO_MAX) -> str:
    """CTEs up to ``shapiro`` (by, n, w, p) for series of 12 values or more: Royston's weights from
    Wichura's normal quantiles."""
    def ratio(r: str, top: list[float], bottom: list[float]) -> str:
        nest = lambda c: "(" * (len(c) - 1) + repr(c[-1]) + "::double" + "".join(f" * {r} + {v!r}::double)" for v in c[-2::-1])
        return f"{nest(top)} / ({nest([1.0, *bottom])})"

    poly = lambda c, x: " + ".join(f"({v!r}::double) * power({x}, {i})" for i, v in enumerate(c))
    return f"""
with drawn as (
  select {by} as g, cast({value} as double) as x from {source} where {value} is not null
  qualify row_number() over (partition by {by} order by {sample_order(keys)}) <= {most}
), placed as (
  select g, x, row_number() over (partition by g order by x) as i, count(*) over (partition by g) as n from drawn
), probability as (
  select *, (i - 0.375::double) / (n + 0.25::double) - 0.5::double as q from placed
), scores as (
  select *, case when abs(q) <= 0.425 then q * {ratio('(0.180625::double - q * q)', _WICHURA_A, _WICHURA_B)}
       else sign(q) * {ratio('(sqrt(-ln(0.5::double - abs(q))) - 1.6::double)', _WICHURA_C, _WICHURA_D)} end as m
  from probability
), series as (
  select g, n, sum(m * m) as mm, max(case when i = n then m end) as m1, max(case when i = n - 1 then m end) as m2,
         sum(x) / n as mean, 1 / sqrt(n::double) as u from scores group by g, n
), ends as (
  select *, m1 / sqrt(mm) + {poly(N._C1, 'u')} as an, m2 / sqrt(mm) + {poly(N._C2, 'u')} as an1 from series
), phis as (
  select *, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * an * an - 2 * an1 * an1) as phi from ends
), ws as (
  select s.g, s.n, power(sum(x * case when i = 1 then -an when i = 2 then -an1 when i = s.n - 1 then an1 when i = s.n then an
                                      else m / sqrt(phi) end), 2) / sum((x - mean) * (x - mean)) as w
  from scores s join phis p on p.g is not distinct from s.g group by s.g, s.n
), zs as (
  select *, (ln(1 - w) - ({poly(N._MU_LARGE, 'ln(n)')})) / exp({poly(N._SD_LARGE, 'ln(n)')}) as z from ws
), shapiro as (
  select g, n, w, {_plain(normal_cdf_sql('(-z)'))} as p from zs
)"""


# Wichura's (1988) coefficients of the normal quantile, centre and nearer tail.
_WICHURA_A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
              4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
_WICHURA_B = [4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
              3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
_WICHURA_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
              1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
_WICHURA_D = [2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
              1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]


@register("shapiro_wilk", _shapiro_sql("events", "event_type", "value", ["event_id"]) + """
select g as event_type, n as n_tested, round(w, 6) as shapiro_w, round(p, 6) as shapiro_p from shapiro""")
def q_shapiro_wilk(spark, sf_dir):
    return rounded(N.shapiro_wilk(table(spark, sf_dir, "events"), "value", by=["event_type"], key=["event_id"]))


_VERDICT_KS = """
, base as (select cast(l_extendedprice as double) as value from lineitem where l_extendedprice is not null),
stats as (select count(*) as n, avg(value) as mean, stddev_samp(value) as std from base),
steps as (select value, count(*) as cnt from base group by value),
ranked as (select s.*, n, mean, std, (value - mean) / std as z, sum(cnt) over (order by value) as upto from steps s, stats),
gaps as (select *, """ + _plain(normal_cdf_sql("z")) + """ as cdf from ranked),
d as (select n, max(greatest(upto / n - cdf, cdf - (upto - cnt) / n)) as d from gaps group by n),
lam as (select *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d as l from d),
ks as (select n, d, greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: 2 * power(-1, k - 1) * exp(-2 * k * k * l * l))))) as kp from lam)
"""


@register("normality_verdict", _shapiro_sql("lineitem", "1", "l_extendedprice", LINE_KEYS) + _VERDICT_KS + f"""
select ks.n, round(w, 6) as shapiro_w, round(p, 6) as shapiro_p, round(d, 6) as ks_statistic, round(kp, 6) as ks_p,
       p > {N.ALPHA} as normal_shapiro, kp > {N.ALPHA} as normal_ks,
       case when p > {N.ALPHA} and kp > {N.ALPHA} then '{N.PARAMETRIC}' else '{N.NON_PARAMETRIC}' end as recommended_tests
from ks, shapiro""")
def q_normality_verdict(spark, sf_dir):
    return rounded(N.normality(table(spark, sf_dir, "lineitem"), "l_extendedprice", key=LINE_KEYS))


def _kendall_sql(a: str, b: str) -> str:
    return f"""
select '{a}' as x, '{b}' as y, round(s / sqrt((n0 - tx) * (n0 - ty)), 6) as r from
  (select sum(sign(p.u - q.u) * sign(p.v - q.v)) as s from kd_{a}_{b} p join kd_{a}_{b} q on p.rid < q.rid),
  (select count(*) * (count(*) - 1) / 2.0 as n0 from kd_{a}_{b}),
  (select coalesce(sum(t * (t - 1) / 2.0), 0) as tx from (select count(*) as t from kd_{a}_{b} group by u)),
  (select coalesce(sum(t * (t - 1) / 2.0), 0) as ty from (select count(*) as t from kd_{a}_{b} group by v))"""


_KCOLS = ["p_size", "p_retailprice", "p_partkey"]
_KPAIRS = [(a, b) for i, a in enumerate(_KCOLS) for b in _KCOLS[i + 1:]]
_KENDALL_SQL = "with " + ",\n".join(
    f"kd_{a}_{b} as (select row_number() over () as rid, {a} as u, {b} as v from part "
    f"where {' and '.join(f'{c} is not null' for c in _KCOLS)})" for a, b in _KPAIRS) + "\n" + "\nunion all\n".join(
    [_kendall_sql(a, b) for a, b in _KPAIRS] +
    [f"select '{b}', '{a}', r from ({_kendall_sql(a, b)}) z" for a, b in _KPAIRS] +
    [f"select '{c}', '{c}', 1.0" for c in _KCOLS])


@register("correlation_kendall", _KENDALL_SQL)
def q_correlation_kendall(spark, sf_dir):
    return rounded(C.correlation(table(spark, sf_dir, "part"), _KCOLS, "kendall"))


_KL = ["l_quantity", "l_discount", "l_tax"]


def _kendall_cells_sql(a: str, b: str) -> str:
    """tau-b of columns of few distinct values from the counts of their cells."""
    return f"""
select '{a}' as x, '{b}' as y, round(s / sqrt((n0 - tx) * (n0 - ty)), 6) as r from
  (select sum(p.c * q.c * sign(p.u - q.u) * sign(p.v - q.v)) / 2 as s from c_{a}_{b} p, c_{a}_{b} q),
  (select sum(c) * (sum(c) - 1) / 2.0 as n0 from c_{a}_{b}),
  (select sum(t * (t - 1) / 2.0) as tx from (select sum(c) as t from c_{a}_{b} group by u)),
  (select sum(t * (t - 1) / 2.0) as ty from (select sum(c) as t from c_{a}_{b} group by v))"""


_KLP = [(a, b) for i, a in enumerate(_KL) for b in _KL[i + 1:]]
_KENDALL_CELLS = "with " + ",\n".join(
    f"c_{a}_{b} as (select {a} as u, {b} as v, cast(count(*) as double) as c from lineitem "
    f"where {' and '.join(f'{c} is not null' for c in _KL)} group by {a}, {b})" for a, b in _KLP) + "\n" + "\nunion all\n".join(
    [_kendall_cells_sql(a, b) for a, b in _KLP] +
    [f"select '{b}', '{a}', r from ({_kendall_cells_sql(a, b)}) z" for a, b in _KLP] +
    [f"select '{c}', '{c}', 1.0" for c in _KL])


@register("correlation_kendall_cells", _KENDALL_CELLS)
def q_correlation_kendall_cells(spark, sf_dir):
    """Whole lineitem table, columns of few distinct values."""
    return rounded(C.correlation(table(spark, sf_dir, "lineitem"), _KL, "kendall"))


@register("correlation_kendall_lineitem")
def q_correlation_kendall_lineitem(spark, sf_dir):
    """Whole lineitem table; SQL brute force over all pairs is too slow here, the
    algorithm is checked against brute force in the tests and on ``part``."""
    return rounded(C.correlation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "kendall"))
