"""Helpers shared by the operators: written intermediate tables, a join that splits hot
keys, Arrow batches of bounded bytes, and result schemas.

Conventions of every operator here: a result column replaces an input column of the
same name; names that start with ``__`` are internal; null texts count as empty."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir

#: Word separators of the contracts: the class [\x20\x09-\x0D], which is also what
#: ``bytes.split()`` separates on.
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more than this share of a table's rows is hot; there are at most
#: ``1 / HOT_SHARE`` such keys, so a table of hot keys may be broadcast at any size.
HOT_SHARE = 1 / 1000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` (shared by all executors)
    and read back: lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_by_key(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """Join ``left`` to ``right`` on ``key``, where ``right`` has one row for each key and
    counts in ``rows`` the rows of ``left`` that hold it.

    Keys that hold more than ``HOT_SHARE`` of all rows (at most 1,000 of them, whatever the
    size) are broadcast, so their rows are never brought together; the rest is a shuffle
    join. ``left`` is read twice: pass a written table."""
    total = right.agg(F.sum(rows)).first()[0] or 0
    limit = total * HOT_SHARE
    hot = right.filter(F.col(rows) > F.lit(limit)).drop(rows)
    cold = right.filter(F.col(rows) <= F.lit(limit)).drop(rows)
    few = F.broadcast(hot)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(few, key, "inner").unionByName(rest.join(cold, key, how), allowMissingColumns=True)


#: Bits of a sieve at most: a broadcast of 16 MB, whatever the number of keys.
MOST_BITS = 1 << 27


def sieve(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``df`` whose columns ``on`` may be a row of ``keys``: a Bloom filter with a bit
    set in Spark for two hashes of every key. It lets a few strangers through (all, if the keys
    are very many), so an exact join has to follow; what it keeps out is not shuffled."""
    spark = df.sparkSession
    bits = 1 << 10
    while bits < min(12 * keys.count(), MOST_BITS):
        bits *= 2
    places = [F.pmod(F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in on]), F.lit(bits)) for k in (1, 2, 3)]
    at = keys.select(F.explode(F.array(*places)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    mark = np.zeros(bits // 64, np.int64)  # the driver sees this many words at most
    mark[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(mark.astype("<i8").tobytes())

    def known(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        held = np.frombuffer(shared.value, np.uint8)
        for columns in batches:
            yield pd.Series(np.logical_and.reduce([(held[(x := c.to_numpy(np.int64)) >> 3] >> (x & 7).astype(np.uint8)) & 1 for c in columns]).astype(bool))

    return df.filter(F.pandas_udf(known, "boolean")(*places))


def with_fields(schema: T.StructType, fields: Iterable[T.StructField]) -> T.StructType:
    """``schema`` with ``fields`` appended; columns of the same name are replaced."""
    fields = list(fields)
    names = {f.name for f in fields}
    return T.StructType([f for f in schema.fields if f.name not in names] + fields)


def with_arrays(batch: pa.RecordBatch, arrays: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with ``arrays`` appended; columns of the same name are replaced."""
    keep = [n for n in batch.schema.names if n not in arrays]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + list(arrays.values()),
                                      names=keep + list(arrays))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of ``column`` (one row at
    least): memory stays bounded with long texts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(batch.column(column).nbytes // n, 1)
        step = max(1, most // size)
        for at in range(0, n, step):
            yield batch.slice(at, step)
    pa.default_memory_pool().release_unused()  # the worker process lives on


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null is the empty text."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]
