"""Approximate nearest neighbours over randomly rotated one-bit codes.

Each vector is reduced by the centre of its cell, scaled to length one and turned by a random
rotation; its code is the signs of the result, packed. Two correction scalars are kept: the
distance to the centre and the code's inner product with the turned vector. From the packed
bits and these, the inner product with a query is estimated without bias, with an error of
order 1/sqrt(dimensions); candidates whose lower distance bound reaches the k-th upper bound are
ranked again by exact distances, the others are not.

Every row is indexed. Only the cells' centres are fitted on a bounded sample. A query scans the
codes of all cells or of the nearest ones. The index stays where it lies: queries come to it in
rounds of about ``ASKED`` (a broadcast of bounded size), each task keeps the best of its rows for every
query of the round, and only those results are shuffled. So no row of the index is copied, however many
queries there are, and what a task holds is bounded. Queries meet rows in slices of ``QUERIES_AT_ONCE``."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.session import ensure_checkpoint_dir

#: Rows the centres are fitted on at most (those with the smallest id hashes), numbers (queries x
#: dimensions) of a round, queries compared at once.
SAMPLE, ASKED, QUERIES_AT_ONCE = 20_000, 1 << 20, 256
#: Error bound in standard deviations of the estimate.
EPSILON = 4.0


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, cells: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's algorithm on the sample."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    cells = max(1, min(cells, len(sample)))
    centre = sample[rng.choice(len(sample), cells, replace=False)] if len(sample) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds):
        near = ((centre ** 2).sum(1) - 2 * sample @ centre.T).argmin(1)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=len(centre))
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def usable(df: DataFrame, vector: str, dim: int) -> "F.Column":
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, distance to the centre, inner product of code and turned vector."""
    rest = vectors - centre
    length = np.linalg.norm(rest, axis=1)
    unit = (rest / np.where(length > 0, length, 1)[:, None]) @ turn.T
    dim = vectors.shape[1]
    return np.packbits(unit > 0, axis=1), length, np.abs(unit).sum(1) / np.sqrt(dim)


def estimates(query: np.ndarray, centre: np.ndarray, turn: np.ndarray, code: np.ndarray, length: np.ndarray,
              inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated squared distances (queries x rows) and the bound of their error."""
    dim = query.shape[1]
    rest = query - centre
    q_length = np.linalg.norm(rest, axis=1)
    unit = (rest / np.where(q_length > 0, q_length, 1)[:, None]) @ turn.T
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    dot = unit.astype(np.float32) @ signs.T / np.sqrt(dim)
    known = np.where(inner > 0, inner, 1.0)
    cosine = dot / known
    error = EPSILON * np.sqrt(np.maximum(1 - known ** 2, 0) / known ** 2 / max(dim - 1, 1))
    scale = 2 * q_length[:, None] * length[None, :]
    return q_length[:, None] ** 2 + length[None, :] ** 2 - scale * cosine, scale * error[None, :]


class Best:
    """The k nearest of each query among the rows met so far: distances and ids, nearest first,
    ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.d, self.id = np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, i: int, d: np.ndarray, ids: np.ndarray) -> None:
        k = self.d.shape[1]
        d, ids = np.concatenate([self.d[i], d]), np.concatenate([self.id[i], ids])
        best = np.lexsort((ids, d))[:k]
        self.d[i], self.id[i] = d[best], ids[best]


def meet(best: Best, asked: np.ndarray, q: np.ndarray, own: np.ndarray, centre: np.ndarray, turn: np.ndarray, rows: tuple) -> None:
    """Rows of one cell (ids, vectors, codes, lengths, inner products) against the queries numbered
    ``asked``: the codes choose what is measured."""
    ids, v, code, length, inner = rows
    k = best.d.shape[1]
    for at in range(0, len(asked), QUERIES_AT_ONCE):
        part = asked[at:at + QUERIES_AT_ONCE]
        guess, error = estimates(q[part], centre, turn, code, length, inner)
        guess[own[part][:, None] == ids[None, :]] = np.inf
        upper = guess + error
        limit = best.d[part, -1] ** 2
        if len(ids) >= k:
            limit = np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1])
        worth = (guess - error <= limit[:, None]) & np.isfinite(guess)
        for i in np.flatnonzero(worth.any(1)).tolist():
            near = np.flatnonzero(worth[i])
            best.add(part[i], np.sqrt(((v[near] - q[part[i]]) ** 2).sum(1)), ids[near])


def nearest(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", is_query: "F.Column | None" = None, k: int = 10,
            cells: int = 16, visits: int | None = None, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``is_query`` chooses its ``k``
    nearest others found, by Euclidean distance in double precision, ties to the smaller id (all
    others, if there are fewer).

    Vectors that are null, zero, of another length than most or hold null or non-finite
    components take no part; rows without an id neither; of rows that repeat an id the one with
    the smallest vector counts; equal vectors tie; an empty table gives none; other columns
    are not read. A query scans the codes of all cells, or of the ``visits`` nearest ones: vectors
    that form clusters need few, vectors without structure need most of them (of 64 cells over
    51,282 random directions, 32 visits find 90 % of the neighbours, 48 find 98 %)."""
    spark = rows.sparkSession
    found = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null")
    sizes = found.filter(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], result)
    dim = sizes[0]
    table = written(found.filter(usable(found, "v", dim)).groupBy("id").agg(F.min("v").alias("v")), "ann-vectors")
    picked = table.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"].combine_chunks()
    sample = picked.flatten().to_numpy().reshape(-1, dim) if len(picked) else np.zeros((0, dim))
    if not len(sample):
        return spark.createDataFrame([], result)
    shared = spark.sparkContext.broadcast((centres(sample, cells, seed), rotation(dim, seed)))  # cells x dim and dim x dim

    def index(batches):
        centre, turn = shared.value
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, dim))
            cell = ((centre ** 2).sum(1) - 2 * v @ centre.T).argmin(1) if len(pdf) else np.zeros(0, int)
            code, length, inner = encode(v, centre[cell], turn)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "id": pdf["id"], "code": [c.tobytes() for c in code],
                                "length": length, "inner": inner, "v": pdf["v"]})

    index_schema = "cell int, id long, code binary, length double, inner double, v array<double>"
    indexed = written(table.mapInPandas(index, index_schema).sortWithinPartitions("cell"), "ann-index")
    asked = written(table.filter(is_query) if is_query is not None else table, "ann-asked")
    total, most = asked.count(), max(ASKED // dim, 1)
    rounds = -(-total // most)
    hits = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-llm/ann-hits-{uuid.uuid4().hex}"
    for r in range(rounds):
        some = asked.filter(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(rounds)) == r).toArrow()  # about ``most`` queries
        if not len(some):
            continue
        own, q = some["id"].to_numpy(), some["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        centre, _ = shared.value
        n = min(visits or len(centre), len(centre))
        cells_of = np.argsort((centre ** 2).sum(1) - 2 * q @ centre.T, axis=1, kind="stable")[:, :n]
        round_ = spark.sparkContext.broadcast((own, q, cells_of))

        def search(batches, round_=round_):
            centre, turn = shared.value
            own, q, cells_of = round_.value
            best = Best(len(own), k)
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                ids, length, inner = (batch.column(c).to_numpy() for c in ("id", "length", "inner"))
                v = batch.column("v").flatten().to_numpy().reshape(-1, dim)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                for c in np.unique(cell).tolist():
                    at = np.flatnonzero(cell == c)
                    queries = np.flatnonzero((cells_of == c).any(1))
                    meet(best, queries, q, own, centre[c], turn, (ids[at], v[at], code[at], length[at], inner[at]))
            i, j = np.nonzero(np.isfinite(best.d))
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(best.id[i, j]), pa.array(best.d[i, j])], names=["query_id", "vec_id", "score"])

        indexed.mapInArrow(search, "query_id long, vec_id long, score double").write.mode("append").parquet(hits)
        round_.unpersist()
    if not rounds:
        return spark.createDataFrame([], result)
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(hits)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
