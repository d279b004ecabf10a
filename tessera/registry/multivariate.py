"""Registered queries: factor analysis and clustering."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions.distributions import erfc_sql
from tessera.operators import cluster as K
from tessera.operators import factor as A
from tessera.operators.moments import moments
from tessera.registry.base import LINE_KEYS, fixture, register, rounded, sample_order, table, with_fixtures
from tessera.registry.descriptive import LI_COLS

FA_COLS = ["l_quantity", "l_discount", "l_tax"]
EMB = [f"e{i}" for i in range(8)]

_R3 = """
with r as (select corr(l_quantity, l_discount) as r12, corr(l_quantity, l_tax) as r13,
                  corr(l_discount, l_tax) as r23, count(*) as n from lineitem
           where l_quantity is not null and l_discount is not null and l_tax is not null),
pc as (select *, (r12 - r13 * r23) / sqrt((1 - r13 * r13) * (1 - r23 * r23)) as a12,
              (r13 - r12 * r23) / sqrt((1 - r12 * r12) * (1 - r23 * r23)) as a13,
              (r23 - r12 * r13) / sqrt((1 - r12 * r12) * (1 - r13 * r13)) as a23,
              1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 as det from r)
"""


def _fa_lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return A.factor_analysis(li, FA_COLS)


@register("kmo", _R3 + """
select round((r12 * r12 + r13 * r13 + r23 * r23) /
             (r12 * r12 + r13 * r13 + r23 * r23 + a12 * a12 + a13 * a13 + a23 * a23), 6) as kmo from pc""")
def q_kmo(spark, sf_dir):
    res = _fa_lineitem(spark, sf_dir)
    return rounded(spark.createDataFrame([(float(res.kmo),)], "kmo double"))


@register("bartlett", _R3 + """
select round(-(n - 1 - (2 * 3 + 5) / 6.0) * ln(det), 6) as chi2, cast(3 as double) as df from pc""")
def q_bartlett(spark, sf_dir):
    res = _fa_lineitem(spark, sf_dir)
    return rounded(spark.createDataFrame([(float(res.bartlett_chi2), float(res.bartlett_df))],
                                         "chi2 double, df double"))


@register("drop_collinear", """
with c as (""" + "\nunion all\n".join(
    f"select '{b}' as variable, {i} as pos, abs(corr({a}, {b})) as r from lineitem"
    for i, b in enumerate(LI_COLS) for a in LI_COLS[:i]) + """)
select v.variable, coalesce(max(c.r) <= 0.95, true) as kept from (""" + "\nunion all\n".join(
    f"select '{c}' as variable" for c in LI_COLS) + """) v left join c using (variable) group by v.variable""")
def q_drop_collinear(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = moments(li, LI_COLS)
    kept = set(A.drop_collinear(LI_COLS, m.corr()))
    return spark.createDataFrame([(c, i in kept) for i, c in enumerate(LI_COLS)], "variable string, kept boolean")


def _fa_emb(spark, sf_dir, bootstrap=0):
    emb = fixture(spark, sf_dir, "emb_wide")
    return emb, A.factor_analysis(emb, EMB, bootstrap=bootstrap, key=["vec_id"])


@register("scree")
def q_scree(spark, sf_dir):
    _, res = _fa_emb(spark, sf_dir)
    return res.eigen_table(spark)


@register("factor_summary")
def q_factor_summary(spark, sf_dir):
    _, res = _fa_emb(spark, sf_dir)
    return spark.createDataFrame([(float(res.kmo), float(res.bartlett_chi2), float(res.bartlett_df),
                                   float(res.bartlett_p), int(res.n_factors), ",".join(res.columns))],
                                 "kmo double, bartlett_chi2 double, bartlett_df double, bartlett_p double, "
                                 "n_factors int, columns string")


@register("loadings")
def q_loadings(spark, sf_dir):
    _, res = _fa_emb(spark, sf_dir)
    return res.loadings_long(spark)


@register("factor_scores")
def q_factor_scores(spark, sf_dir):
    emb, res = _fa_emb(spark, sf_dir)
    return res.scores(emb, keep=["vec_id"])


@register("sort_loadings")
def q_sort_loadings(spark, sf_dir):
    _, res = _fa_emb(spark, sf_dir)
    return A.sort_loadings(res.loadings_long(spark))


@register("loading_edges")
def q_loading_edges(spark, sf_dir):
    _, res = _fa_emb(spark, sf_dir)
    return A.loading_edges(res.loadings_long(spark))


@register("bootstrap_loadings")
def q_bootstrap_loadings(spark, sf_dir):
    _, res = _fa_emb(spark, sf_dir, bootstrap=A.BOOTSTRAP)
    return A.bootstrap_table(res, spark)


# One common factor in three columns: the loadings are sqrt(r12 r13 / r23) and so on, everything that
# follows from them is a closed form.

COMMON = ["a", "b", "near_a", "fixed", "c"]

_COMMON_CTE = with_fixtures("", "common").rstrip() + """, filled as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, a, b, near_a, fixed, coalesce(c, (select avg(c) from common)) as c from common
), r as (
  select corr(a, b) as r12, corr(a, c) as r13, corr(b, c) as r23, count(*) as n from filled
), l as (
  select *, sqrt(r12 * r13 / r23) as l1, sqrt(r12 * r23 / r13) as l2, sqrt(r13 * r23 / r12) as l3,
         1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 as det from r
), eigen as (
  select p, acos(greatest(-1, least(1, r12 * r13 * r23 / (p * p * p)))) / 3 as phi from (
    select *, sqrt((r12 * r12 + r13 * r13 + r23 * r23) / 3) as p from r)
), long as (
  select 'a' as variable, 'factor_1' as factor, l1 as loading from l
  union all select 'b', 'factor_1', l2 from l
  union all select 'c', 'factor_1', l3 from l
)"""


def _common(spark, sf_dir, **options):
    rows = fixture(spark, sf_dir, "common")
    return rows, A.factor_analysis(rows, COMMON, key=LINE_KEYS, **options)


@register("factor_columns", _COMMON_CTE + """
select 'a' as variable, 'kept' as use union all select 'b', case when abs(corr(a, b)) > 0.95 then 'collinear' else 'kept' end from filled
union all select 'near_a', case when greatest(abs(corr(a, near_a)), abs(corr(b, near_a))) > 0.95 then 'collinear' else 'kept' end from filled
union all select 'fixed', case when min(fixed) = max(fixed) then 'constant' else 'kept' end from filled
union all select 'c', case when greatest(abs(corr(a, c)), abs(corr(b, c)), abs(corr(near_a, c))) > 0.95 then 'collinear' else 'kept' end from filled""")
def q_factor_columns(spark, sf_dir):
    """What becomes of each column: a constant one and a near copy go."""
    _, res = _common(spark, sf_dir)
    use = {c: "kept" for c in res.columns} | {c: "collinear" for c in res.dropped_collinear}
    return spark.createDataFrame([(c, use.get(c, "constant")) for c in COMMON], "variable string, use string")


@register("scree_common", _COMMON_CTE + """
select 1 as factor, round(1 + 2 * p * cos(phi), 6) as eigenvalue from eigen
union all select 2, round(1 + 2 * p * cos(phi - 2 * pi() / 3), 6) from eigen
union all select 3, round(1 + 2 * p * cos(phi + 2 * pi() / 3), 6) from eigen""")
def q_scree_common(spark, sf_dir):
    return rounded(_common(spark, sf_dir)[1].eigen_table(spark))


@register("factor_summary_common", _COMMON_CTE + """
, partial as (
  select *, (r12 - r13 * r23) / sqrt((1 - r13 * r13) * (1 - r23 * r23)) as a12,
         (r13 - r12 * r23) / sqrt((1 - r12 * r12) * (1 - r23 * r23)) as a13,
         (r23 - r12 * r13) / sqrt((1 - r12 * r12) * (1 - r13 * r13)) as a23 from l
), counted as (
  select *, r12 * r12 + r13 * r13 + r23 * r23 as r2, a12 * a12 + a13 * a13 + a23 * a23 as a2,
         -(n - 1 - 11 / 6.0) * ln(det) as chi2 from partial
)
select round(r2 / (r2 + a2), 6) as kmo, round(chi2, 4) as bartlett_chi2, cast(3 as double) as bartlett_df,
       round(""" + re.sub(r"(?<=[0-9])D\b", "::double", erfc_sql("sqrt(chi2 / 2)")) + """ + sqrt(2 * chi2 / pi()) * exp(-chi2 / 2), 6) as bartlett_p,
       cast(greatest((select count(*) from (select 1 + 2 * p * cos(phi) as e from eigen union all select 1 + 2 * p * cos(phi - 2 * pi() / 3) from eigen
                                   union all select 1 + 2 * p * cos(phi + 2 * pi() / 3) from eigen) where e > 1), 1) as integer) as n_factors,
       'a,b,c' as columns
from counted""")
def q_factor_summary_common(spark, sf_dir):
    _, res = _common(spark, sf_dir)
    return spark.createDataFrame([(round(float(res.kmo), 6), round(float(res.bartlett_chi2), 4), float(res.bartlett_df), round(float(res.bartlett_p), 6),
                                   int(res.n_factors), ",".join(res.columns))],
                                 "kmo double, bartlett_chi2 double, bartlett_df double, bartlett_p double, n_factors int, columns string")


@register("loadings_common", _COMMON_CTE + " select variable, factor, round(loading, 6) as loading from long")
def q_loadings_common(spark, sf_dir):
    return rounded(_common(spark, sf_dir)[1].loadings_long(spark))


@register("sort_loadings_common", _COMMON_CTE + """
select variable, factor as dominant_factor, round(loading, 6) as max_abs_loading,
       cast(row_number() over (order by factor, loading desc, variable) as integer) as "order" from long""")
def q_sort_loadings_common(spark, sf_dir):
    return rounded(A.sort_loadings(_common(spark, sf_dir)[1].loadings_long(spark)))


@register("loading_edges_common", _COMMON_CTE + """
select variable, factor, round(loading, 6) as loading, case when loading > 0 then 'positive' else 'negative' end as sign
from long where abs(loading) >= 0.4""")
def q_loading_edges_common(spark, sf_dir):
    return rounded(A.loading_edges(_common(spark, sf_dir)[1].loadings_long(spark)))


@register("factor_scores_common", _COMMON_CTE + """
, weights as (
  select ((1 - r23 * r23) * l1 + (r13 * r23 - r12) * l2 + (r12 * r23 - r13) * l3) / det as w1,
         ((r13 * r23 - r12) * l1 + (1 - r13 * r13) * l2 + (r12 * r13 - r23) * l3) / det as w2,
         ((r12 * r23 - r13) * l1 + (r12 * r13 - r23) * l2 + (1 - r12 * r12) * l3) / det as w3 from l
), spread as (
  select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, avg(c) as mc, stddev_pop(c) as sc from filled
)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(w1 * (a - ma) / sa + w2 * (b - mb) / sb + w3 * (c - mc) / sc, 4) + 0.0 as factor_1
from filled, weights, spread""")
def q_factor_scores_common(spark, sf_dir):
    rows, res = _common(spark, sf_dir)
    scores = res.scores(rows, keep=LINE_KEYS)
    return scores.withColumn("factor_1", F.round("factor_1", 4) + 0.0)  # no negative zeros


_REPLICATES = """, hashed as (
  select a - (select avg(a) from filled) as a, b - (select avg(b) from filled) as b, c - (select avg(c) from filled) as c, t.k as rep,
         (('0x' || substr({order}, 1, 8))::bigint + t.k * 2654435769) % 4294967296 as h
  from filled, range({n}) t(k)
), mixed1 as (
  select *, ((xor(h, h >> 16))::hugeint * 2246822507 % 4294967296)::bigint as h1 from hashed
), mixed2 as (
  select *, ((xor(h1, h1 >> 13))::hugeint * 3266489909 % 4294967296)::bigint as h2 from mixed1
), weighed as (
  select rep, a, b, c, ({steps}) as w from (select *, (xor(h2, h2 >> 16) + 0.5) / 4294967296::double as u from mixed2)
), added as (
  select rep, sum(w) as n, sum(w * a) / sum(w) as ma, sum(w * b) / sum(w) as mb, sum(w * c) / sum(w) as mc, sum(w * a * a) / sum(w) as qaa,
         sum(w * b * b) / sum(w) as qbb, sum(w * c * c) / sum(w) as qcc, sum(w * a * b) / sum(w) as qab, sum(w * a * c) / sum(w) as qac,
         sum(w * b * c) / sum(w) as qbc from weighed group by rep
), replicates as (
  select rep, (qab - ma * mb) / sqrt((qaa - ma * ma) * (qbb - mb * mb)) as r12, (qac - ma * mc) / sqrt((qaa - ma * ma) * (qcc - mc * mc)) as r13,
         (qbc - mb * mc) / sqrt((qbb - mb * mb) * (qcc - mc * mc)) as r23 from added
)""".format(order=sample_order(LINE_KEYS), n=A.BOOTSTRAP, steps=" + ".join(f"case when {v!r}::double < u then 1 else 0 end" for v in A._POISSON_CDF))


@register("bootstrap_correlations", _COMMON_CTE + _REPLICATES + """
select cast(rep as integer) as replicate, 'a' as x, 'b' as y, round(r12, 6) as r from replicates
union all select cast(rep as integer), 'a', 'c', round(r13, 6) from replicates
union all select cast(rep as integer), 'b', 'c', round(r23, 6) from replicates""")
def q_bootstrap_correlations(spark, sf_dir):
    """The correlation matrices of all replicates, by the same weights in both engines."""
    return rounded(A.bootstrap_correlations(fixture(spark, sf_dir, "common"), ["a", "b", "c"], key=LINE_KEYS))


@register("bootstrap_loadings_common", _COMMON_CTE + _REPLICATES + """
, spread as (
  select stddev_pop(sqrt(r12 * r13 / r23)) as s1, stddev_pop(sqrt(r12 * r23 / r13)) as s2, stddev_pop(sqrt(r13 * r23 / r12)) as s3 from replicates
)
select variable, factor, round(loading, 6) as loading, round(case variable when 'a' then s1 when 'b' then s2 else s3 end, 6) as se
from long, spread""")
def q_bootstrap_loadings_common(spark, sf_dir):
    _, res = _common(spark, sf_dir, bootstrap=A.BOOTSTRAP)
    return rounded(A.bootstrap_table(res, spark).drop("z", "p"))


# ---------------------------------------------------------------- clustering
# ``lineitem`` has no clear groups, so what k-means finds there is checked by the tests; the
# "islands" are three far groups of the same rows whose clusters SQL can name.

LINE = ["l_orderkey", "l_linenumber"]


def _prep(spark, sf_dir):
    return K.prepare_clusters(table(spark, sf_dir, "lineitem"), LI_COLS)


def _islands(spark, sf_dir):
    return K.prepare_clusters(fixture(spark, sf_dir, "islands"), ["x", "y"])


@register("elbow")
def q_elbow(spark, sf_dir):
    return K.elbow(_prep(spark, sf_dir), k_max=K.K_MAX)


@register("kmeans")
def q_kmeans(spark, sf_dir):
    res = K.kmeans(_prep(spark, sf_dir), 3)
    return res.labelled.select("l_orderkey", "l_linenumber", *LI_COLS, "cluster")


@register("silhouette")
def q_silhouette(spark, sf_dir):
    res = K.kmeans(_prep(spark, sf_dir), 3)
    return spark.createDataFrame([(3, K.silhouette(res.labelled, key=LINE))], "k int, silhouette double")


@register("cluster_centers")
def q_cluster_centers(spark, sf_dir):
    return K.kmeans(_prep(spark, sf_dir), 3).centers_table(spark)


@register("hierarchical")
def q_hierarchical(spark, sf_dir):
    res = K.hierarchical(_prep(spark, sf_dir), 3, "ward")
    return res.labelled.select("l_orderkey", "l_linenumber", *LI_COLS, "cluster")


@register("merge_table")
def q_merge_table(spark, sf_dir):
    return K.hierarchical(_prep(spark, sf_dir), 3, "ward").merge_table(spark)


@register("kmeans_profiles")
def q_kmeans_profiles(spark, sf_dir):
    res = K.kmeans(_prep(spark, sf_dir), 3)
    return K.cluster_profiles(res.labelled, LI_COLS)


_SCALED = """, scaled as (
  select i.*, (x - mx) / sx as zx, (y - my) / sy as zy
  from islands i, (select avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, stddev_pop(y) as sy from islands)
)"""


def _islands_sql(sql: str) -> str:
    head, tail = with_fixtures("", "islands").rstrip(), sql
    return head + _SCALED + tail


@register("elbow_islands", _islands_sql("""
, g as (
  select island, count(*) as n, sum(zx) as sx, sum(zy) as sy, sum(zx * zx + zy * zy) as q from scaled group by island
), sets as (
  select island as a, island as b, q - (sx * sx + sy * sy) / n as w from g
  union all
  select u.island, v.island, u.q + v.q - ((u.sx + v.sx) * (u.sx + v.sx) + (u.sy + v.sy) * (u.sy + v.sy)) / (u.n + v.n)
  from g u join g v on u.island < v.island
)
select 1 as k, round(2.0 * count(*), 4) as wcss from scaled
union all
select 2, round(min(p.w + s.w), 4) from sets p join sets s on p.a < p.b and s.a = s.b and s.a <> p.a and s.a <> p.b
union all
select 3, round(sum(w), 4) from sets where a = b"""))
def q_elbow_islands(spark, sf_dir):
    return rounded(K.elbow(_islands(spark, sf_dir), k_max=3), 4)


@register("kmeans_islands", with_fixtures(
    "select l_orderkey, l_linenumber, x, y, cast(island + 1 as varchar) as cluster from islands", "islands"))
def q_kmeans_islands(spark, sf_dir):
    return K.kmeans(_islands(spark, sf_dir), 3).labelled.select(*LINE, "x", "y", "cluster")


_ISLAND_MEANS = "\nunion all\n".join(f"select cast(island + 1 as varchar) as cluster, '{c}' as variable, round(avg({c}), 6) as "
                                      "{} from islands group by island" for c in "xy")


@register("cluster_centers_islands", with_fixtures(_ISLAND_MEANS.format("center", "center"), "islands"))
def q_cluster_centers_islands(spark, sf_dir):
    return rounded(K.kmeans(_islands(spark, sf_dir), 3).centers_table(spark))


@register("kmeans_profiles_islands", with_fixtures(_ISLAND_MEANS.format("mean", "mean"), "islands"))
def q_kmeans_profiles_islands(spark, sf_dir):
    return rounded(K.cluster_profiles(K.kmeans(_islands(spark, sf_dir), 3).labelled, ["x", "y"]))


@register("silhouette_islands", _islands_sql(f"""
, drawn as (
  select row_number() over () as id, island, zx, zy from (
    select * from scaled order by md5(concat_ws('|', '{K.SEED}', l_orderkey, l_linenumber)) limit {K.SILHOUETTE_ROWS})
), sizes as (
  select island, count(*) as n from drawn group by island
), sums as (
  select p.id, p.island, q.island as other,
         sum(sqrt((p.zx - q.zx) * (p.zx - q.zx) + (p.zy - q.zy) * (p.zy - q.zy))) as d
  from drawn p, drawn q group by all
), each_row as (
  select id,
         max(case when s.island = other then d / (n - 1) end) as a, min(case when s.island <> other then d / n end) as b
  from sums s join sizes z on z.island = s.other group by id
)
select 3 as k, round(avg((b - a) / greatest(a, b)), 6) as silhouette from each_row"""))
def q_silhouette_islands(spark, sf_dir):
    res = K.kmeans(_islands(spark, sf_dir), 3)
    return rounded(spark.createDataFrame([(3, K.silhouette(res.labelled, key=LINE))], "k int, silhouette double"))


@register("hierarchical_islands", with_fixtures(
    "select l_orderkey, l_linenumber, x, y, cast(island + 1 as varchar) as cluster from islands", "islands"))
def q_hierarchical_islands(spark, sf_dir):
    """More distinct rows than micro-clusters: summarised by k-means first, every row labelled."""
    return K.hierarchical(_islands(spark, sf_dir), 3, "ward").labelled.select(*LINE, "x", "y", "cluster")


@register("merge_table_steps", with_fixtures("""
, points as (
  select dense_rank() over (order by x) - 1 as place, x, count(*) as n from steps group by x
), run as (
  select place, (x - lag(x) over (order by place)) / (select stddev_pop(x) from steps) as height,
         sum(n) over (order by place) as size, (select count(*) from points) as m from points
)
select cast(place as integer) as step, cast(case when place = 1 then 0 else m + place - 2 end as bigint) as "left", cast(place as bigint) as "right",
       round(height, 6) as height, cast(size as bigint) as size
from run where place >= 1""", "steps"))
def q_merge_table_steps(spark, sf_dir):
    """Few distinct rows: the points themselves are merged, nearest first (single linkage)."""
    prep = K.prepare_clusters(fixture(spark, sf_dir, "steps"), ["x"])
    return rounded(K.hierarchical(prep, 2, "single").merge_table(spark))


@register("cluster_profiles", "select cast(l_linenumber as varchar) as cluster, variable, round(mean, 6) as mean from (" +
          "\nunion all\n".join(f"select l_linenumber, '{c}' as variable, avg({c}) as mean from lineitem "
                               f"group by l_linenumber" for c in LI_COLS) + ") t")
def q_cluster_profiles(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("cluster", F.col("l_linenumber").cast("string"))
    return rounded(K.cluster_profiles(li, LI_COLS))


@register("scree_lineitem", """
with r as (select abs(corr(l_quantity, l_discount)) as a from lineitem
           where l_quantity is not null and l_discount is not null)
select 1 as factor, round(1 + a, 9) as eigenvalue from r
union all
select 2, round(1 - a, 9) from r""")
def q_scree_lineitem(spark, sf_dir):
    s = A.scree(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return s.select("factor", F.round("eigenvalue", 9).alias("eigenvalue"))
