"""End-to-end analyses composed from the operators, one call each (the counterparts
of a factor / discriminant / cluster "run everything" entry point). Every value
is a small Python object or a Spark DataFrame; nothing row-sized is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import cluster as K
from tessera.operators import discriminant as D
from tessera.operators import factor as A
from tessera.operators.encode import one_hot, zscore
from tessera.operators.profile import profile_dict
from tessera.operators.summary import grouped_summary
from tessera.plans.cleaning import CleaningConfig, fit_cleaning
from tessera.session import pinned


def confirm(df: DataFrame, config: CleaningConfig) -> dict[str, DataFrame]:
    """The confirm step: the raw table's profile, then ``clean`` (by a plan fitted on it), ``encoded``
    (its columns profiled as low categorical, one-hot) and ``scaled`` (z-scores of the rest; the
    id columns and 0/1 columns stay). The cleaned table is written once for all three."""
    profile = profile_dict(df)
    clean = pinned(fit_cleaning(df, config).transform(df), "confirmed")
    encoded = one_hot(clean, profile=profile)
    scaled = zscore(encoded, profile=profile, exclude=config.id_columns)
    return {"clean": clean, "encoded": encoded, "scaled": scaled}


def discriminant_analysis(df: DataFrame, target: str, predictors: Sequence[str],
                          key: Sequence[str] | None = None) -> dict:
    """Validate, fit and score an LDA model and build every result table."""
    predictors = list(predictors)
    model = D.fit_lda(df, target, predictors)
    data = D.complete_rows(df, target, predictors)
    scored = model.predict(data)
    spark = df.sparkSession
    acc = D.accuracy(scored, target)
    out = {
        "model": model,
        "summary": acc.select(F.lit(target).alias("target"), F.lit(len(model.classes)).alias("n_groups"),
                              F.lit(max(1, len(model.classes) - 1)).alias("n_functions"), "*"),
        "functions": model.functions_table(spark),
        "confusion": D.confusion(scored, target, model.classes),
        "per_group": D.per_group_accuracy(scored, target),
        "misclassified": D.misclassified(scored, target),
        "reclassification": D.reclassification(scored, target),
        "centroids": model.centroids(spark),
        "centroid_profile": D.centroid_profile(model.centroids(spark)),
        "group_summary": grouped_summary(data, target, predictors),
        "eigenvalues": model.eigen_table(spark),
        "box_m": D.box_m(model.groups),
        "boxes": D.predictor_boxes(model, df),
        "importance": model.importance(spark),
    }
    if len(model.classes) >= 3 and len(predictors) >= 2:
        scores = model.transform(data)
        lds = [c for c in scores.columns if c.startswith("LD")]
        out["scores"] = scores
        out["score_centroids"] = scores.groupBy(target).agg(*[F.avg(c).alias(c) for c in lds])
        out["map_sample"] = D.stratified_sample(scores.select(*(key or []), target, *lds), target, key=key)
    return out


def factor_report(df: DataFrame, columns: Sequence[str] | None = None, n_factors: int | None = None,
                  bootstrap: int = A.BOOTSTRAP, seed: int = 42, key: Sequence[str] | None = None) -> dict:
    """Factor analysis with automatic (eigenvalue > 1) or fixed factor count."""
    res = A.factor_analysis(df, columns, n_factors=n_factors, bootstrap=bootstrap, seed=seed, key=key)
    spark = df.sparkSession
    long = res.loadings_long(spark)
    out = {"result": res, "kmo": res.kmo, "bartlett_chi2": res.bartlett_chi2, "bartlett_p": res.bartlett_p,
           "n_factors": res.n_factors, "columns": res.columns, "dropped_collinear": res.dropped_collinear,
           "eigenvalues": res.eigen_table(spark), "loadings": long, "sorted_loadings": A.sort_loadings(long),
           "edges": A.loading_edges(long), "scores": res.scores(df, keep=list(key or []))}
    if bootstrap:
        out["bootstrap"] = A.bootstrap_table(res, spark)
    return out


def cluster_report(df: DataFrame, columns: Sequence[str] | None, k: int, method: str = "kmeans",
                   linkage: str = "ward", with_elbow: bool = False, key: Sequence[str] | None = None) -> dict:
    """Prepare (complete rows, z-scores), cluster, and describe the clusters."""
    prep = K.prepare_clusters(df, columns, persist=with_elbow)
    out = {"prepared": prep}
    if with_elbow:
        out["elbow"] = K.elbow(prep)
    if method == "kmeans":
        res = K.kmeans(prep, k)
        out["centers"] = res.centers_table()
        labelled = res.labelled
    elif method == "hierarchical":
        h = K.hierarchical(prep, k, linkage)
        out["merges"] = h.merge_table()
        labelled = h.labelled
    else:
        raise ValueError(f"unknown clustering method {method!r}")
    prep.release()
    out["labelled"] = labelled.drop(K.FEATURES)
    out["silhouette"] = K.silhouette(labelled, sample_size=K.SILHOUETTE_ROWS if method == "kmeans" else K.SILHOUETTE_ROWS_HIERARCHICAL, key=key)
    out["profiles"] = K.cluster_profiles(labelled, prep.columns)
    return out
