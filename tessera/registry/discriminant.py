"""Registered queries: LDA (closed-form 2-predictor oracle), classification tables,
centroids, Box's M; wider discriminant outputs on the embedding fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import discriminant as D
from tessera.registry.base import LINE_KEYS, fixture, register, rounded, sample_order, table

TARGET = "l_returnflag"
PRED = ["l_quantity", "l_discount"]
KEYS = ["l_orderkey", "l_linenumber"]

_LDA_CTE = f"""
with d as (select row_number() over () as rid, {', '.join(KEYS)}, {TARGET} as g, l_quantity as x, l_discount as y from lineitem
           where {TARGET} is not null and l_quantity is not null and l_discount is not null),
gs as (select g, count(*) as n, avg(x) as mx, avg(y) as my, var_samp(x) as vx, var_samp(y) as vy,
              covar_samp(x, y) as cxy from d group by g),
tot as (select sum(n) as n, count(*) as k, sum(n * mx) / sum(n) as xb, sum(n * my) / sum(n) as yb from gs),
w as (select sum((gs.n - 1) * vx) / (tot.n - tot.k) as wxx, sum((gs.n - 1) * vy) / (tot.n - tot.k) as wyy,
             sum((gs.n - 1) * cxy) / (tot.n - tot.k) as wxy from gs, tot group by tot.n, tot.k),
inv as (select wyy / (wxx * wyy - wxy * wxy) as ixx, wxx / (wxx * wyy - wxy * wxy) as iyy,
               -wxy / (wxx * wyy - wxy * wxy) as ixy from w),
cf as (select g, mx - xb as dx, my - yb as dy, ln(gs.n / tot.n) as lp, xb, yb,
              (mx - xb) * ixx + (my - yb) * ixy as cx, (mx - xb) * ixy + (my - yb) * iyy as cy from gs, tot, inv),
cls as (select g, cx, cy, -0.5 * (cx * dx + cy * dy) + lp - (cx * xb + cy * yb) as c0,
               row_number() over (order by g) as fn from cf),
dec as (select d.*, cls.g as cg, c0 + cx * d.x + cy * d.y as v from d, cls),
best as (select rid, {', '.join(KEYS)}, g, x, y, arg_max(cg, v) as prediction, max(v) as vmax,
                sum(exp(v)) as se from dec group by rid, {', '.join(KEYS)}, g, x, y),
pred as (select {', '.join(KEYS)}, g as {TARGET}, x as l_quantity, y as l_discount, prediction,
                exp(vmax) / se as probability from best)
"""


def _scored(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*KEYS, TARGET, *PRED)
    model = D.fit_lda(li, TARGET, PRED)
    return model, model.predict(D.complete_rows(li, TARGET, PRED))


@register("lda_coefficients", _LDA_CTE + """
select 'function_' || fn as function, round(c0, 6) as constant, round(cx, 6) as l_quantity,
       round(cy, 6) as l_discount from cls""")
def q_lda_coefficients(spark, sf_dir):
    model, _ = _scored(spark, sf_dir)
    return rounded(model.functions_table(spark))


@register("lda_predict", _LDA_CTE + """
select l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount, prediction,
       round(probability, 6) as probability from pred""")
def q_lda_predict(spark, sf_dir):
    return rounded(_scored(spark, sf_dir)[1])


@register("confusion_matrix", _LDA_CTE + """
select a.g as actual, b.g as predicted, count(p.prediction) as n
from cls a cross join cls b left join pred p on p.l_returnflag = a.g and p.prediction = b.g
group by a.g, b.g""")
def q_confusion_matrix(spark, sf_dir):
    model, scored = _scored(spark, sf_dir)
    return D.confusion(scored, TARGET, model.classes)


@register("accuracy", _LDA_CTE + """
select count(*) as n_cases, cast(sum((l_returnflag = prediction)::int) as bigint) as n_correct,
       cast(count(*) - sum((l_returnflag = prediction)::int) as bigint) as n_wrong,
       round(avg((l_returnflag = prediction)::int), 6) as accuracy from pred""")
def q_accuracy(spark, sf_dir):
    return rounded(D.accuracy(_scored(spark, sf_dir)[1], TARGET))


@register("per_group_accuracy", _LDA_CTE + """
select l_returnflag as "group", count(*) as total, cast(sum((l_returnflag = prediction)::int) as bigint) as correct,
       round(sum((l_returnflag = prediction)::int) / count(*) * 100, 1) as percent_correct
from pred group by l_returnflag""")
def q_per_group_accuracy(spark, sf_dir):
    return D.per_group_accuracy(_scored(spark, sf_dir)[1], TARGET)


@register("misclassified", _LDA_CTE + """
select l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount, prediction,
       round(probability, 6) as probability from pred where l_returnflag <> prediction""")
def q_misclassified(spark, sf_dir):
    return rounded(D.misclassified(_scored(spark, sf_dir)[1], TARGET))


@register("reclassification_table", _LDA_CTE + """
select l_returnflag as actual, prediction as predicted, count(*) as n from pred group by 1, 2""")
def q_reclassification_table(spark, sf_dir):
    return D.reclassification(_scored(spark, sf_dir)[1], TARGET)


@register("centroids", _LDA_CTE + """
select g as "group", 'l_quantity' as variable, round(mx, 6) as mean from gs
union all select g, 'l_discount', round(my, 6) from gs""")
def q_centroids(spark, sf_dir):
    model, _ = _scored(spark, sf_dir)
    return rounded(model.centroids(spark))


@register("centroid_profile", _LDA_CTE + """
, c as (select g as "group", 'l_quantity' as variable, mx as mean from gs
        union all select g, 'l_discount', my from gs)
select "group", variable, round(mean, 6) as mean,
       round((mean - min(mean) over (partition by variable)) /
             (max(mean) over (partition by variable) - min(mean) over (partition by variable)), 6) as scaled
from c""")
def q_centroid_profile(spark, sf_dir):
    model, _ = _scored(spark, sf_dir)
    return rounded(D.centroid_profile(model.centroids(spark)))


@register("box_m", _LDA_CTE + """
, q as (select * from gs where n > 2),
sp as (select sum((n - 1) * vx) / sum(n - 1) as px, sum((n - 1) * vy) / sum(n - 1) as py,
              sum((n - 1) * cxy) / sum(n - 1) as pxy from q)
select round(sum((n - 1) * ln((px * py - pxy * pxy) / (vx * vy - cxy * cxy))) filter
             (where vx * vy - cxy * cxy > 0), 6) as statistic_m,
       cast(0.5 * 2 * 3 * ((select count(*) from gs) - 1) as double) as df
from q, sp""")
def q_box_m(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    res = D.box_m_test(li, TARGET, PRED)
    return rounded(spark.createDataFrame([(float(res["statistic_m"]), float(res["df"]))],
                                         "statistic_m double, df double"))


# ---------------------------------------------------------------- wider models (rows-only)

EMB = [f"e{i}" for i in range(8)]


def _emb_model(spark, sf_dir):
    emb = fixture(spark, sf_dir, "emb_wide")
    return emb, D.fit_lda(emb, "label", EMB)


@register("discriminant_scores")
def q_discriminant_scores(spark, sf_dir):
    emb, model = _emb_model(spark, sf_dir)
    return model.transform(emb).select("vec_id", "label", *[f"LD{i + 1}" for i in range(model.scalings.shape[1])])


@register("discriminant_centroids")
def q_discriminant_centroids(spark, sf_dir):
    emb, model = _emb_model(spark, sf_dir)
    scores = model.transform(emb)
    lds = [c for c in scores.columns if c.startswith("LD")]
    return scores.groupBy("label").agg(*[F.avg(c).alias(c) for c in lds])


@register("lda_eigenvalues")
def q_lda_eigenvalues(spark, sf_dir):
    _, model = _emb_model(spark, sf_dir)
    return model.eigen_table(spark)


@register("predictor_importance")
def q_predictor_importance(spark, sf_dir):
    _, model = _emb_model(spark, sf_dir)
    return model.importance(spark)


@register("stratified_sample", f"""
select {', '.join(LINE_KEYS)}, {TARGET}, {', '.join(PRED)} from lineitem
qualify row_number() over (partition by {TARGET} order by {sample_order(LINE_KEYS)}) <= (select 1500 // count(distinct {TARGET}) from lineitem)""")
def q_stratified_sample(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*LINE_KEYS, TARGET, *PRED)
    return D.stratified_sample(li, TARGET, 1500, key=LINE_KEYS)


@register("box_m_embeddings")
def q_box_m_embeddings(spark, sf_dir):
    emb = fixture(spark, sf_dir, "emb_wide")
    res = D.box_m_test(emb, "label", EMB)
    return spark.createDataFrame([(res["statistic_m"], res["df"], res["p_value"], res["interpretation"])],
                                 "statistic_m double, df double, p_value double, interpretation string")


# ---------------------------------------------------------------- 2-predictor closed forms

@register("lda_eigenvalues_lineitem", _LDA_CTE + """
, ws as (select sum((n - 1) * vx) as a, sum((n - 1) * cxy) as b, sum((n - 1) * vy) as d from gs),
bs as (select sum(gs.n * (mx - xb) * (mx - xb)) as e, sum(gs.n * (mx - xb) * (my - yb)) as f,
              sum(gs.n * (my - yb) * (my - yb)) as h from gs, tot),
m as (select (d * e - b * f) / (a * d - b * b) as m11, (d * f - b * h) / (a * d - b * b) as m12,
             (-b * e + a * f) / (a * d - b * b) as m21, (-b * f + a * h) / (a * d - b * b) as m22 from ws, bs),
ev as (select (m11 + m22) / 2 + sqrt(((m11 + m22) / 2) * ((m11 + m22) / 2) - (m11 * m22 - m12 * m21)) as l1,
              (m11 + m22) / 2 - sqrt(((m11 + m22) / 2) * ((m11 + m22) / 2) - (m11 * m22 - m12 * m21)) as l2 from m)
select 1 as function, round(l1, 9) as eigenvalue, round(l1 / (l1 + l2), 9) as explained_variance from ev
union all
select 2, round(l2, 9), round(l2 / (l1 + l2), 9) from ev""")
def q_lda_eigenvalues_lineitem(spark, sf_dir):
    model, _ = _scored(spark, sf_dir)
    t = model.eigen_table(spark)
    return t.select(F.col("function").cast("int").alias("function"), F.round("eigenvalue", 9).alias("eigenvalue"),
                    F.round("explained_variance", 9).alias("explained_variance"))


@register("predictor_importance_lineitem", _LDA_CTE + """
, imp as (select 'l_quantity' as variable, abs(avg(cx)) as importance from cls
          union all select 'l_discount', abs(avg(cy)) from cls)
select cast(row_number() over (order by importance desc) as integer) as rank, variable,
       round(importance, 6) as importance from imp""")
def q_predictor_importance_lineitem(spark, sf_dir):
    model, _ = _scored(spark, sf_dir)
    return rounded(model.importance(spark))


def _box_by_flag_sql(c: str) -> str:
    return f"""
select '{c}' as variable, l_returnflag, count(*) as n, round(q1, 6) as q1, round(median, 6) as median,
  round(q3, 6) as q3, round(lf, 6) as lower_fence, round(uf, 6) as upper_fence,
  round(min({c}) filter (where {c} >= lf and {c} <= uf), 6) as whisker_low,
  round(max({c}) filter (where {c} >= lf and {c} <= uf), 6) as whisker_high,
  count(*) filter (where {c} < lf or {c} > uf) as n_outliers
from lineitem join (
  select l_returnflag, q1, median, q3, q1 - 1.5 * (q3 - q1) as lf, q3 + 1.5 * (q3 - q1) as uf from (
    select l_returnflag, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as median,
           quantile_cont({c}, 0.75) as q3 from lineitem
    where l_returnflag is not null and l_quantity is not null and l_discount is not null group by l_returnflag)
) f using (l_returnflag)
where l_quantity is not null and l_discount is not null
group by l_returnflag, q1, median, q3, lf, uf"""


@register("discriminant_boxes", "\nunion all\n".join(_box_by_flag_sql(c) for c in PRED))
def q_discriminant_boxes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*KEYS, TARGET, *PRED)
    model = D.fit_lda(li, TARGET, PRED)
    return rounded(D.predictor_boxes(model, li))


@register("lda_summary", _LDA_CTE + """
select 'l_returnflag' as target, (select count(*) from gs)::integer as n_groups,
       greatest(1, (select count(*) from gs) - 1)::integer as n_functions,
       count(*) as n_cases, cast(sum((l_returnflag = prediction)::int) as bigint) as n_correct,
       cast(count(*) - sum((l_returnflag = prediction)::int) as bigint) as n_wrong,
       round(avg((l_returnflag = prediction)::int), 6) as accuracy from pred""")
def q_lda_summary(spark, sf_dir):
    from tessera.plans.analysis import discriminant_analysis
    li = table(spark, sf_dir, "lineitem").select(*KEYS, TARGET, *PRED)
    return rounded(discriminant_analysis(li, TARGET, PRED, key=KEYS)["summary"])
