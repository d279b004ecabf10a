import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import discriminant as D
from tessera.operators import factor as A
from tessera.operators.correlation import correlation_matrix
from tests.conftest import SF_SMALL


def test_box_m_one_predictor_and_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 1.0), ("b", 5.0), ("b", 9.0)],
                               "g string, x double")
    res = D.box_m_test(df, "g", ["x"])
    va, vb = np.var([1, 2, 4], ddof=1), np.var([1, 5, 9], ddof=1)
    sp = (2 * va + 2 * vb) / 4
    assert math.isclose(res["statistic_m"], 2 * math.log(sp / va) + 2 * math.log(sp / vb), rel_tol=1e-10)
    tiny = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("b", 1.0, 1.0), ("b", 3.0, 0.0)],
                                 "g string, x double, y double")
    assert math.isnan(D.box_m_test(tiny, "g", ["x", "y"])["statistic_m"])


def test_lda_rejects_small_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, x double")
    with pytest.raises(ValueError):
        D.fit_lda(df, "g", ["x"])


def test_perfect_lda(spark):
    rows = [("a", float(i), float(i % 3)) for i in range(10)] + [("b", float(i + 100), float(i % 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    m = D.fit_lda(df, "g", ["x", "y"])
    scored = m.predict(df)
    acc = D.accuracy(scored, "g").first()
    assert acc["accuracy"] == 1.0 and D.misclassified(scored, "g").count() == 0


def test_lda_invariant_to_rescaling(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_discount")
    p1 = D.fit_lda(li, "l_returnflag", ["l_quantity", "l_discount"]).predict(li).select("prediction").collect()
    li2 = li.withColumn("l_discount", li["l_discount"] * 1000)
    p2 = D.fit_lda(li2, "l_returnflag", ["l_quantity", "l_discount"]).predict(li2).select("prediction").collect()
    assert p1 == p2


def test_collinear_column_dropped():
    r = np.array([[1.0, 0.99, 0.1], [0.99, 1.0, 0.1], [0.1, 0.1, 1.0]])
    assert A.drop_collinear(["x", "x2", "y"], r) == [0, 2]


def test_constant_column_correlation_is_nan(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    cols, m = correlation_matrix(df, ["x", "c"])
    assert math.isnan(m[1, 1]) and math.isnan(m[0, 1]) and math.isclose(m[0, 0], 1.0)


def test_factor_loadings_reproduce_correlations():
    lam = np.array([[0.8, 0.0], [0.7, 0.1], [0.75, 0.0], [0.0, 0.8], [0.1, 0.7], [0.0, 0.6]])
    r = lam @ lam.T
    np.fill_diagonal(r, 1.0)
    lo = A.fit_loadings(r, 2)
    fitted = lo @ lo.T
    off = ~np.eye(6, dtype=bool)
    assert np.max(np.abs(fitted[off] - r[off])) < 1e-4
    unrot = A.minres(r, 2)
    assert np.allclose(np.sum(unrot ** 2, 1), np.sum(lo ** 2, 1), atol=1e-8)  # rotation keeps communalities


def test_factor_analysis_and_bootstrap(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    emb = emb.selectExpr("vec_id", *[f"cast(embedding[{i}] as double) as e{i}" for i in range(6)])
    res = A.factor_analysis(emb, [f"e{i}" for i in range(6)], n_factors=2, bootstrap=5, key=["vec_id"])
    assert 0 < res.kmo < 1 and res.loadings.shape == (6, 2)
    assert res.bootstrap["se"].shape == (6, 2) and np.all(res.bootstrap["se"] >= 0)
    assert res.scores(emb, ["vec_id"]).count() == emb.count()


def test_kmeans_elbow_and_hierarchical(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    cols = ["l_quantity", "l_discount", "l_tax"]
    prep = K.prepare_clusters(li, cols)
    n = prep.data.count()
    assert math.isclose(K.total_sum_squares(prep), n * len(cols), rel_tol=1e-9)
    res = K.kmeans(prep, 3)
    labels = {r["cluster"] for r in res.labelled.select("cluster").distinct().collect()}
    assert labels == {"1", "2", "3"}
    h = K.hierarchical(prep, 3, "ward", micro=30)
    assert h.labelled.count() == n and len(h.merges) == 29
    assert {r["cluster"] for r in h.labelled.select("cluster").distinct().collect()} == {"1", "2", "3"}


def _kendall_brute(xs, ys):
    from collections import Counter
    n = len(xs)
    s = sum(np.sign(xs[i] - xs[j]) * np.sign(ys[i] - ys[j]) for i in range(n) for j in range(i + 1, n))
    n0 = n * (n - 1) / 2
    tx = sum(t * (t - 1) / 2 for t in Counter(xs).values())
    ty = sum(t * (t - 1) / 2 for t in Counter(ys).values())
    return s / math.sqrt((n0 - tx) * (n0 - ty))


@pytest.mark.parametrize("limit", [None, 0])
def test_kendall_matches_brute_force(spark, limit):
    from tessera.operators.correlation import kendall_tau_b
    rng = np.random.default_rng(11)
    xs = [float(v) for v in rng.integers(0, 9, 150)]
    ys = [float(a + b) for a, b in zip(xs, rng.integers(0, 4, 150))]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    assert math.isclose(kendall_tau_b(df, "x", "y", single_task_limit=limit), _kendall_brute(xs, ys), rel_tol=1e-12)


def _naive_ward(points):
    clusters = {i: [i] for i in range(len(points))}
    heights = []
    while len(clusters) > 1:
        best = None
        keys = sorted(clusters)
        for ia, a in enumerate(keys):
            for b in keys[ia + 1:]:
                pa, pb = points[clusters[a]], points[clusters[b]]
                na, nb = len(pa), len(pb)
                delta = na * nb / (na + nb) * np.sum((pa.mean(0) - pb.mean(0)) ** 2)
                if best is None or delta < best[0]:
                    best = (delta, a, b)
        delta, a, b = best
        heights.append(math.sqrt(2 * delta))
        clusters[a] = clusters[a] + clusters.pop(b)
    return heights


def test_lance_williams_ward_matches_naive():
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(25, 3))
    merges, history = K._agglomerate(pts, np.ones(len(pts)), "ward")
    assert np.allclose([m[2] for m in merges], _naive_ward(pts), rtol=1e-10)
    assert len(history[-1]) == 1 and sorted(next(iter(history[-1].values()))) == list(range(25))
    # weighted points: merging two coincident unit points equals one point of weight 2
    w_merges, _ = K._agglomerate(np.array([[0.0], [3.0]]), np.array([2.0, 1.0]), "ward")
    assert math.isclose(w_merges[0][2], math.sqrt(2 * (2 * 1 / 3) * 9.0))


def test_moments_exact_zero_variance_for_awkward_constant(spark):
    from tessera.operators.moments import grouped_moments, moments
    df = spark.createDataFrame([(0.1, float(i), "a" if i % 2 else "b") for i in range(7)], "c double, x double, g string")
    m = moments(df, ["c", "x"])
    assert m.cov[0, 0] == 0.0 and m.cov[0, 1] == 0.0 and math.isclose(m.cov[1, 1], np.var(range(7), ddof=1))
    assert math.isnan(m.corr()[0, 1])
    g = grouped_moments(df, ["c", "x"], "g")
    assert g["a"].cov[0, 0] == 0.0 and g["a"].n == 3


def test_first_k_thinning_is_exact(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tessera.operators.sampling import first_k, row_hash
    df = spark.range(0, 5000).select("id", (F.col("id") % 3).alias("g"))
    got = first_k(df, 700, 42, ["id"], by=["g"])
    keyed = df.withColumn("_h", row_hash(42, ["id"]))
    w = Window.partitionBy("g").orderBy("_h")
    want = keyed.withColumn("rn", F.row_number().over(w)).where("rn <= 700").select("id", "g")
    assert sorted(map(tuple, got.select("id", "g").collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 2100


def test_lda_scalings_whiten_within_and_compat_eigenvalues(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    m = D.fit_lda(li, "l_returnflag", ["l_quantity", "l_discount", "l_tax"])
    s = m.scalings
    assert np.allclose(s.T @ m.within @ s, np.eye(s.shape[1]), atol=1e-8)  # unit within-class variance
    ev = [r["eigenvalue"] for r in m.eigen_table(spark, compat=True).collect()]
    assert len(ev) == 2 and ev[0] >= ev[1] > 0


def test_composed_analyses(spark):
    from tessera.plans.analysis import cluster_report, discriminant_analysis, factor_report
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    lda = discriminant_analysis(li, "l_returnflag", ["l_quantity", "l_discount", "l_tax"], key=["l_orderkey", "l_linenumber"])
    s = lda["summary"].first()
    assert s["n_groups"] == 3 and s["n_cases"] == li.count() and 0 < s["accuracy"] <= 1
    assert lda["confusion"].count() == 9 and lda["map_sample"].count() <= 1500
    fa = factor_report(li, ["l_quantity", "l_discount", "l_tax"], bootstrap=3)
    assert fa["loadings"].count() == 3 * fa["n_factors"] and fa["scores"].count() == li.count()
    cr = cluster_report(li, ["l_quantity", "l_discount"], 3, method="hierarchical")
    assert cr["labelled"].count() == li.count() and cr["profiles"].count() == 6


def test_elbow_decreases_from_one_cluster(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    prep = K.prepare_clusters(li, ["l_quantity", "l_discount"])
    w = [r["wcss"] for r in K.elbow(prep, k_max=4).orderBy("k").collect()]
    assert w[0] > w[1] > w[3] > 0


# ---------------------------------------------------------------- shared-scan k-means

def _blobs(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    centers = np.array([[0.0, 0.0], [8.0, 1.0], [1.0, 9.0], [-7.0, 4.0]])
    rows = [(i, *(centers[i % 4] + rng.normal(size=2)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, y double"), np.array([r[1:] for r in rows])


def _lloyd(x, w, centers, tolerance, most):
    """Plain iterations on the driver."""
    for _ in range(most):
        d = ((x[:, None] - centers[None]) ** 2).sum(2)
        own = d.argmin(1)
        new = np.array([np.average(x[own == c], axis=0, weights=w[own == c]) if (own == c).any() else centers[c] for c in range(len(centers))])
        moved = ((new - centers) ** 2).sum()
        centers = new
        if moved <= tolerance:
            break
    return centers, (w * ((x[:, None] - centers[None]) ** 2).sum(2).min(1)).sum()


def test_shared_scan_equals_plain_iterations(spark):
    """All models advance as if each were fitted on its own."""
    from tessera.operators import kmeans_scan as S
    df, _ = _blobs(spark)
    df = df.unionByName(df.limit(50)).unionByName(df.limit(10))  # weights
    prep = K.prepare_clusters(df, ["x", "y"])
    x = np.array([r[0] for r in prep.data.select(K.FEATURES).collect()])
    blocks = prep.points()
    begun = S.starts(blocks, 5, 4, 42)
    assert [c.shape for c in begun] == [(5, 2)] * 4
    points = {tuple(np.round(p, 9)) for p in x}
    assert all(tuple(np.round(p, 9)) in points for c in begun for p in c)
    models = [c[:k] for k in (1, 3, 5) for c in begun]
    passes = []
    ended = S.advance(blocks, models, 1e-4, 300, lambda step, n: passes.append(n))
    assert passes[0] == 12 and passes == sorted(passes, reverse=True) and len(passes) < 80
    got = S.costs(blocks, ended)
    for model, centers, cost in zip(models, ended, got):
        want, at = _lloyd(x, np.ones(len(x)), model.copy(), 1e-4, 300)
        assert np.allclose(centers, want, atol=1e-9) and math.isclose(cost, at, rel_tol=1e-9)
    prep.release()


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_kmeans_does_not_depend_on_partitions(spark, parts):
    df, _ = _blobs(spark, 900, 8)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    want = K.kmeans(K.prepare_clusters(df.coalesce(1), ["x", "y"]), 4)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = K.kmeans(K.prepare_clusters(df.repartition(parts), ["x", "y"]), 4)
        assert np.array_equal(got.centers, want.centers)
        assert sorted(map(tuple, got.labelled.select("id", "cluster").collect())) == sorted(map(tuple, want.labelled.select("id", "cluster").collect()))
        assert {r["cluster"]: r["count"] for r in got.labelled.groupBy("cluster").count().collect()} == {c: 225 for c in "1234"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_kmeans_hot_value_and_few_distinct_rows(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") < 20_000, 1.0).otherwise(F.col("id") % 3 * 10.0).alias("x"))
    prep = K.prepare_clusters(hot, ["x"])
    sizes = prep.points().select(F.sum("n")).first()[0]
    assert sizes <= 4 + 20_000 // 4096 + 3 * 2  # a hot value is a few points
    prep.release()
    res = K.kmeans(prep, 3)
    assert res.cost < 1.5 * 20_000 and {r[0] for r in res.labelled.select("cluster").distinct().collect()} == {"1", "2", "3"}
    few = K.elbow(K.prepare_clusters(spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "x double"), ["x"]), k_max=4)
    costs = {r["k"]: r["wcss"] for r in few.collect()}
    assert math.isclose(costs[1], 3.0, rel_tol=1e-9) and all(abs(costs[k]) < 1e-12 for k in (2, 3, 4))
    with pytest.raises(ValueError):
        K.kmeans(K.prepare_clusters(spark.createDataFrame([(1.0,)], "x double"), ["x"]), 2)


def test_fits_leave_no_cached_rows(spark):
    df, _ = _blobs(spark, 200)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    prep = K.prepare_clusters(df, ["x", "y"])
    K.kmeans(prep, 2).labelled.count()
    K.elbow(prep, k_max=2).count()
    K.hierarchical(prep, 2).labelled.count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def _silhouette(x, labels):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = labels == labels[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[labels == c].mean() for c in set(labels) if c != labels[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_euclidean_silhouette_equals_brute_force(spark, monkeypatch):
    df, _ = _blobs(spark, 300)
    labelled = K.kmeans(K.prepare_clusters(df, ["x", "y"]), 5).labelled
    rows = labelled.select(K.FEATURES, "cluster").collect()
    want = _silhouette(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert math.isclose(K.silhouette(labelled, key=["id"]), want, rel_tol=1e-9)
    monkeypatch.setattr(K, "TILE", 37)
    assert math.isclose(K.silhouette(labelled, key=["id"]), want, rel_tol=1e-9)
    assert -1 <= K.silhouette(labelled, sample_size=50, key=["id"]) <= 1
    assert math.isclose(K.silhouette(labelled, metric="squared"), K.silhouette(labelled, metric="squared"))
    with pytest.raises(ValueError):
        K.silhouette(labelled.withColumn("cluster", F.lit("1")), key=["id"])
    with pytest.raises(ValueError):
        K.silhouette(labelled, metric="cosine")
    alone = spark.createDataFrame([([0.0], "1"), ([1.0], "1"), ([9.0], "2")], f"{K.FEATURES} array<double>, cluster string")
    assert math.isclose(K.silhouette(alone), ((9 - 1) / 9 + (8 - 1) / 8 + 0) / 3, rel_tol=1e-12)


# ---------------------------------------------------------------- ranks, Kendall, bootstrap

def _ranks(values):
    order = sorted(values)
    return [(2 * order.index(v) + order.count(v) + 1) / 2 for v in values]


@pytest.mark.parametrize("rows", [10 ** 9, 40, 7])
def test_row_ranks_are_average_ranks_beside_the_row(spark, rows):
    """Small buckets: heavy values get places of their own, and ranks carry over bucket edges."""
    from tessera.operators.quantiles import row_ranks
    rng = np.random.default_rng(2)
    x = [3.0] * 120 + rng.integers(-5, 9, 150).astype(float).tolist() + rng.normal(size=90).tolist()
    y = rng.permutation(360).astype(float).tolist()
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double").repartition(5)
    got = sorted(map(tuple, row_ranks(df, ["x", "y"], bucket_rows=rows).collect()))
    assert got == sorted(zip(_ranks(x), _ranks(y)))


def test_kendall_of_many_columns_takes_a_fixed_number_of_jobs(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(float(v) for v in r) for r in rng.integers(0, 6, (80, 5))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    tracker = spark.sparkContext.statusTracker()

    def jobs(names):
        spark.sparkContext.setJobGroup(f"kendall-{len(names)}", "")
        cols, m = correlation_matrix(df, names, "kendall")
        done = len(tracker.getJobIdsForGroup(f"kendall-{len(names)}"))
        spark.sparkContext.setJobGroup("", "")
        return m, done

    m2, two = jobs(["a", "b"])
    m5, five = jobs(list("abcde"))
    assert five <= two + 3 and five <= 20
    columns = list(zip(*rows))
    for i in range(5):
        for j in range(5):
            assert math.isclose(m5[i, j], 1.0 if i == j else _kendall_brute(columns[i], columns[j]), rel_tol=1e-12)


def test_bootstrap_weights_are_poisson_and_rows_are_not_multiplied(spark):
    w = A.poisson_weights(np.arange(20_000) * 7919 % (1 << 32), 20)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.03
    df, x = _blobs(spark, 400)
    mats = A.bootstrap_moments(df, ["x", "y"], {"x": 1.0, "y": 2.0}, 6, 42, ["id"])
    hashed = np.array([int(__import__("hashlib").md5(f"42|{i}".encode()).hexdigest()[:8], 16) for i in range(400)])
    weights = A.poisson_weights(hashed, 6)
    for b in range(6):
        assert np.allclose(mats[b], np.corrcoef(np.repeat(x, weights[b].astype(int), axis=0).T), atol=1e-9)


def test_number_of_factors_is_checked(spark):
    df, _ = _blobs(spark, 100)
    for wrong in (0, 3):
        with pytest.raises(ValueError):
            A.factor_analysis(df, ["x", "y"], n_factors=wrong)


def test_exact_ks_tail_and_normal_column(spark):
    from tessera.functions.distributions import erfc_sql, normal_cdf_sql
    from tessera.operators.normality import ks_exact, ks_pvalue
    assert math.isclose(1 - ks_exact(0.274, 10), 0.6284796154565043, rel_tol=1e-12)  # published value
    assert ks_exact(0.5, 1) == 1.0 and math.isclose(ks_exact(0.75, 1), 0.5) and ks_exact(0.9, 100) == 0.0
    assert abs(ks_pvalue(0.0136, 10_000) - ks_pvalue(0.0136, 10_001)) < 2e-3  # exact and asymptotic meet
    xs = [0.0, 1e-9, 0.3, 0.46875, 0.469, 1.0, 3.9, 4.0, 4.1, 9.0, 26.0, 28.0]
    rows = spark.createDataFrame([(s * x,) for x in xs for s in (1, -1)], "x double")
    for r in rows.select("x", F.expr(erfc_sql("x")).alias("e"), F.expr(normal_cdf_sql("x")).alias("p")).collect():
        assert math.isclose(r["e"], math.erfc(r["x"]), rel_tol=1e-13, abs_tol=1e-300)
        assert math.isclose(r["p"], 0.5 * math.erfc(-r["x"] / math.sqrt(2)), rel_tol=1e-13, abs_tol=1e-300)


def test_wide_moments_equal_the_aggregate_expressions(spark, monkeypatch):
    from tessera.operators import moments as M
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6)) * [1, 10, 1e-3, 5, 0, 1] + [1e6, 0, 3, -2, 0.1, 0]
    rows = [(f"g{i % 3}" if i % 7 else None, *(float(v) for v in r[:5]), None if i % 11 == 0 else float(r[5])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double, `e.f` double, h double").repartition(4)
    names = ["a", "b", "c", "d", "e.f", "h"]
    narrow, by = M.moments(df, names), M.grouped_moments(df, names, "g")
    monkeypatch.setattr(M, "WIDE", 2)
    monkeypatch.setattr(M, "HELD", 40)
    monkeypatch.setattr(M, "ROWS_AT_ONCE", 17)
    wide, wide_by = M.moments(df, names), M.grouped_moments(df, names, "g")
    assert wide.n == narrow.n and np.allclose(wide.mean, narrow.mean, rtol=1e-12) and np.allclose(wide.cov, narrow.cov, rtol=1e-9, atol=1e-12)
    assert set(wide_by) == set(by) == {"g0", "g1", "g2"} and wide.cov[4, 4] == 0.0
    for g in by:
        assert wide_by[g].n == by[g].n and np.allclose(wide_by[g].cov, by[g].cov, rtol=1e-9, atol=1e-12)
    assert M.moments(df.limit(0), names).n == 0
