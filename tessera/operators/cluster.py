"""Clustering on z-scored columns: k-means (all k and restarts in one shared scan per
iteration, see ``kmeans_scan``), the elbow curve, silhouette, a scalable hierarchical variant
and cluster profiles.

Hierarchical clustering is re-aimed at scale: k-means first summarises the
rows into at most ``micro`` weighted centroids (exactly, where there are no more distinct rows), those are merged on the driver
with Lance-Williams updates (ward / complete / average / single), and every row takes the
cluster of its nearest centroid (at most ``micro`` of them, as literals) - nothing is sampled away."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import all_not_null, col, numeric_columns
from tessera.operators import kmeans_scan
from tessera.operators.encode import ZScoreModel, fit_zscore
from tessera.operators.sampling import first_k

K_MAX = 10            # fixed: elbow curve k = 1..10
RESTARTS = 10         # fixed: runs from different seeds, the cheapest one counts
MAX_ITER = 300        # fixed: iterations at most (they stop at the tolerance)
TOLERANCE = 1e-4      # fixed: of the summed squared movements of a model's centres, in variances
SEED = 42             # fixed: k-means seed
SILHOUETTE_ROWS = 10_000          # fixed: sample of the Euclidean silhouette of k-means
SILHOUETTE_ROWS_HIERARCHICAL = 2_500  # fixed: of hierarchical clustering
MICRO_CLUSTERS = 200  # micro-clusters summarising the rows for hierarchical merging
MICRO_ROUNDS = 5      # passes that draw their starting centres
FIRST_ROWS = 8        # rows read for each distinct row that is looked for, before all are
FEATURES = "_features"


@dataclass
class Prepared:
    columns: list[str]
    scaler: ZScoreModel
    data: DataFrame        # complete rows, original columns + z-scored array ``_features``
    persist: bool = False
    _blocks: DataFrame | None = field(default=None, repr=False)

    def points(self) -> DataFrame:
        """The distinct rows in packed blocks, kept until :meth:`release`."""
        if self._blocks is None:
            self._blocks = kmeans_scan.pack(self.data, [F.col(FEATURES)[j] for j in range(len(self.columns))])
            self._blocks = self._blocks.persist(StorageLevel.MEMORY_AND_DISK)
            self._blocks.count()  # packed now: the passes read them in smaller batches than rows are packed in
        return self._blocks

    def release(self) -> None:
        """Free the packed rows."""
        if self._blocks is not None:
            self._blocks.unpersist()
            self._blocks = None

    def done(self) -> None:
        """After a fit: the packed rows stay only if asked for."""
        if not self.persist:
            self.release()

    def require(self, k: int) -> None:
        """Raise ``ValueError`` unless there are at least ``k`` distinct points."""
        have = len(some_distinct(self.data.select(*map(col, self.columns)), k))
        if have < k:
            raise ValueError(f"{k} clusters asked of {have} distinct row(s)")


def some_distinct(rows: DataFrame, many: int) -> list:
    """``many`` distinct rows, or all if there are fewer. Mostly the first rows hold as many: then no others are read."""
    first = rows.limit(FIRST_ROWS * many)  # FIRST_ROWS x many rows at most
    found = rows.sparkSession.createDataFrame(first.collect(), rows.schema).distinct().limit(many).collect()
    return found if len(found) == many else rows.distinct().limit(many).collect()


def prepare_clusters(df: DataFrame, columns: Sequence[str] | None = None, persist: bool = False) -> Prepared:
    """Rows complete in ``columns`` (default: all numeric), z-scored with the population std as an
    array. Fits work on packed distinct rows; ``persist`` keeps those for several fits until
    ``release()``."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    clean = df.where(all_not_null(cols))
    scaler = fit_zscore(clean, cols, skip_binary=False)
    scaled = [(col(c).cast("double") - F.lit(scaler.stats[c][0])) / F.lit(scaler.stats[c][1]) if c in scaler.stats else F.lit(0.0) for c in cols]
    return Prepared(cols, scaler, clean.withColumn(FEATURES, F.array(*scaled)), persist)


def total_sum_squares(prep: Prepared) -> float:
    """WCSS for k = 1: squared deviations from the mean in z units (one aggregation)."""
    aggs = [F.sum((col(c).cast("double") - F.lit(m)) ** 2 / F.lit(s * s)).alias(f"t{i}")
            for i, (c, (m, s)) in enumerate(prep.scaler.stats.items())]
    row = prep.data.agg(*aggs).first()
    return float(sum(row[f"t{i}"] or 0.0 for i in range(len(aggs))))


def elbow(prep: Prepared, k_max: int = K_MAX, seed: int = SEED, restarts: int = RESTARTS) -> DataFrame:
    """``(k, wcss)`` for k = 1..k_max, all models in one shared scan per iteration. With fewer
    distinct rows than k the extra centres have nothing left to explain."""
    try:
        best = kmeans_scan.fit(prep.points(), range(1, k_max + 1), restarts, seed, TOLERANCE, MAX_ITER)
    finally:
        prep.done()
    return prep.data.sparkSession.createDataFrame([(k, cost) for k, (_, cost) in best.items()], "k int, wcss double")


@dataclass
class KMeansResult:
    prep: Prepared
    centers: np.ndarray       # (k, p) in z units, relabelled order
    labelled: DataFrame       # rows + ``cluster`` ("1".."k")
    cost: float

    def centers_table(self, spark=None) -> DataFrame:
        """Centres in original units, long form ``(cluster, variable, center)``."""
        spark = spark or self.labelled.sparkSession
        rows = []
        for i, c in enumerate(self.centers):
            for j, name in enumerate(self.prep.columns):
                m, s = self.prep.scaler.stats[name]
                rows.append((str(i + 1), name, float(c[j] * s + m)))
        return spark.createDataFrame(rows, "cluster string, variable string, center double")


def kmeans(prep: Prepared, k: int, seed: int = SEED, restarts: int = RESTARTS, label: str = "cluster") -> KMeansResult:
    """K-means (cheapest of ``restarts``); clusters renumbered by sorted
    centre so labels are stable; label is the text "1".."k"."""
    prep.require(k)
    try:
        centers, cost = kmeans_scan.fit(prep.points(), [k], restarts, seed, TOLERANCE, MAX_ITER)[k]
    finally:
        prep.done()
    order = sorted(range(k), key=lambda i: tuple(np.round(centers[i], 12)))
    centers = centers[order]
    labelled = prep.data.withColumn(label, kmeans_scan.label(F.col(FEATURES), centers).cast("string"))
    return KMeansResult(prep, centers, labelled, float(cost))


def silhouette(labelled: DataFrame, label: str = "cluster", metric: str = "euclidean", sample_size: int | None = SILHOUETTE_ROWS,
               seed: int = SEED, key: Sequence[str] | None = None) -> float:
    """Mean silhouette. ``euclidean``: over the first ``sample_size`` rows by seeded row hash (``key``
    names columns that tell rows apart), all distances among those; a row alone in its cluster
    counts 0. ``squared``: MLlib's exact form for squared distances over all rows, without a sample."""
    if metric == "squared":
        data = labelled.select(array_to_vector(FEATURES).alias(FEATURES), F.col(label).cast("double").alias("_lbl"))
        ev = ClusteringEvaluator(featuresCol=FEATURES, predictionCol="_lbl", metricName="silhouette",
                                 distanceMeasure="squaredEuclidean")
        return float(ev.evaluate(data))
    if metric != "euclidean":
        raise ValueError(f"unsupported metric {metric!r}")
    row = silhouette_samples(labelled, label, sample_size, seed, key).agg(F.avg("silhouette")).first()
    return float(row[0])


#: Rows of a tile: a task measures this many rows against as many others at once.
TILE = 500


def silhouette_samples(labelled: DataFrame, label: str = "cluster", sample_size: int = SILHOUETTE_ROWS, seed: int = SEED,
                       key: Sequence[str] | None = None) -> DataFrame:
    """``(row, cluster, silhouette)`` of the sampled rows. The sample (bounded by ``sample_size``) is
    cut into tiles; a task gets pairs of tiles, adds up the distances of each row to each cluster
    of the other tile, and Spark adds those sums."""
    spark = labelled.sparkSession
    names = list(key or [])
    rows = labelled.select(*map(col, names), F.col(label).cast("string").alias("_label"), F.col(FEATURES).alias("_point")).where(F.col("_label").isNotNull())
    drawn = [(r["_label"], tuple(r["_point"])) for r in first_k(rows, sample_size, seed, names or None).collect()]  # sample_size rows at most
    drawn.sort()
    sizes: dict[str, int] = {}
    for c, _ in drawn:
        sizes[c] = sizes.get(c, 0) + 1
    if not 2 <= len(sizes) < max(len(drawn), 3):
        raise ValueError(f"a silhouette needs 2 clusters at least and fewer than rows: {len(sizes)} of {len(drawn)} rows")
    number = {c: i for i, c in enumerate(sorted(sizes))}
    points = np.array([x for _, x in drawn], float)
    labels = np.array([number[c] for c, _ in drawn])
    sample = spark.sparkContext.broadcast((points, labels))  # sample_size rows at most
    tiles = -(-len(drawn) // TILE)
    pairs = [(a, b) for a in range(tiles) for b in range(tiles)]
    tasks = min(len(pairs), spark.sparkContext.defaultParallelism * 4)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, cs = sample.value
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y, c = xs[a * TILE:(a + 1) * TILE], xs[b * TILE:(b + 1) * TILE], cs[b * TILE:(b + 1) * TILE]
                d = np.zeros((len(x), len(y)))
                for j in range(xs.shape[1]):
                    d += (x[:, j, None] - y[None, :, j]) ** 2
                d = np.sqrt(d, out=d)
                for other in np.unique(c):
                    yield pa.RecordBatch.from_arrays([pa.array(a * TILE + np.arange(len(x)), pa.int32()), pa.array(np.full(len(x), other), pa.int32()),
                                                      pa.array(d[:, c == other].sum(1))], names=["row", "other", "distance"])

    sums = (spark.createDataFrame(pairs, "a int, b int").repartition(tasks).mapInArrow(measured, "row int, other int, distance double")
            .groupBy("row", "other").agg(F.sum("distance").alias("distance")))
    own = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "row int, own int")
    named = spark.createDataFrame([(i, c, sizes[c]) for c, i in number.items()], "other int, cluster string, size int")
    met = sums.join(F.broadcast(own), "row").join(F.broadcast(named), "other")  # sample_size rows; clusters
    mine = F.col("other") == F.col("own")
    each = met.groupBy("row").agg(
        F.max(F.when(mine, F.col("cluster"))).alias("cluster"), F.max(F.when(mine, F.col("size"))).alias("size"),
        F.max(F.when(mine & (F.col("size") > 1), F.col("distance") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~mine, F.col("distance") / F.col("size"))).alias("b"))
    value = F.when(F.col("size") == 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.select("row", "cluster", value.alias("silhouette"))


@dataclass
class HierarchicalResult:
    labelled: DataFrame
    merges: list[tuple[int, int, float, int]]    # (left, right, height, size); ids >= m are merges
    micro_sizes: np.ndarray

    def merge_table(self, spark=None) -> DataFrame:
        spark = spark or self.labelled.sparkSession
        rows = [(i + 1, int(a), int(b), float(h), int(s)) for i, (a, b, h, s) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "step int, left long, right long, height double, size long")


def _agglomerate(centers: np.ndarray, sizes: np.ndarray, linkage: str):
    """Lance-Williams agglomeration of weighted points; returns merges and, for every
    stage, the membership (list of point ids) of active clusters."""
    m = len(centers)
    diff = centers[:, None, :] - centers[None, :, :]
    d = np.sqrt(np.sum(diff ** 2, axis=2))
    if linkage == "ward":
        d = np.sqrt(2.0 * (sizes[:, None] * sizes[None, :]) / (sizes[:, None] + sizes[None, :])) * d
    np.fill_diagonal(d, np.inf)
    size = sizes.astype(float).copy()
    active = {i: [i] for i in range(m)}
    ids = {i: i for i in range(m)}
    merges = []
    next_id = m
    history = [dict(active)]
    alive = list(range(m))
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        flat = int(np.argmin(sub))
        ia, ib = alive[flat // len(alive)], alive[flat % len(alive)]
        h = float(d[ia, ib])
        na, nb = size[ia], size[ib]
        for kk in alive:
            if kk in (ia, ib):
                continue
            nk = size[kk]
            if linkage == "ward":
                v = np.sqrt(((na + nk) * d[ia, kk] ** 2 + (nb + nk) * d[ib, kk] ** 2 - nk * h ** 2) / (na + nb + nk))
            elif linkage == "complete":
                v = max(d[ia, kk], d[ib, kk])
            elif linkage == "single":
                v = min(d[ia, kk], d[ib, kk])
            elif linkage == "average":
                v = (na * d[ia, kk] + nb * d[ib, kk]) / (na + nb)
            else:
                raise ValueError(f"unknown linkage {linkage!r}")
            d[ia, kk] = d[kk, ia] = v
        size[ia] = na + nb
        d[ib, :] = d[:, ib] = np.inf
        merges.append((ids[ia], ids[ib], h, int(na + nb)))
        active[ia] = active[ia] + active.pop(ib)
        ids[ia] = next_id
        next_id += 1
        alive.remove(ib)
        history.append({k: list(v) for k, v in active.items()})
    return merges, history


def hierarchical(prep: Prepared, k: int, linkage: str = "ward", micro: int = MICRO_CLUSTERS,
                 seed: int = SEED, label: str = "cluster") -> HierarchicalResult:
    prep.require(k)
    try:
        few = some_distinct(prep.data.select(FEATURES), micro + 1)
        if len(few) <= micro:  # few distinct rows: they are the points themselves
            centers = np.array(sorted(tuple(x) for (x,) in few))
        else:
            begun = kmeans_scan.starts(prep.points(), micro, 1, seed, -(-micro // MICRO_ROUNDS))
            centers = kmeans_scan.advance(prep.points(), begun, TOLERANCE, MAX_ITER)[0]
        sizes = kmeans_scan.scan(prep.points(), [centers])[0][0]
    finally:
        prep.done()
    used = np.flatnonzero(sizes > 0)
    if len(used) < k:
        raise ValueError(f"{k} clusters asked of {len(used)} micro-clusters")
    centers, sizes = centers[used], sizes[used]
    merges, history = _agglomerate(centers, sizes, linkage)
    # "1".."k" by their sorted centres, as in k-means
    groups = sorted(history[len(used) - k].values(), key=lambda g: tuple(np.round(np.average(centers[g], axis=0, weights=sizes[g]), 12)))
    cluster_of = {pt: str(g + 1) for g, members in enumerate(groups) for pt in members}
    names = F.array(*[F.lit(cluster_of[i]) for i in range(len(used))])
    labelled = prep.data.withColumn(label, F.element_at(names, kmeans_scan.label(F.col(FEATURES), centers)))
    return HierarchicalResult(labelled, merges, sizes)


def cluster_profiles(labelled: DataFrame, columns: Sequence[str], label: str = "cluster") -> DataFrame:
    """Mean of each original variable per cluster, long form ordered by numeric
    cluster then variable: ``(cluster, variable, mean)``."""
    means = labelled.groupBy(label).agg(*[F.avg(col(c)).alias(c) for c in columns])
    long = means.select(F.col(label).cast("string").alias("cluster"),
                        F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), col(c).cast("double")
                                                    .alias("mean")) for c in columns])))
    return long.orderBy(F.col("cluster").cast("int"), "variable")
