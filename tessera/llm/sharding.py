"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over the
global row numbers 0..n-1.

Row i goes to position p = feistel(i); its shard is p mod s and its slot p div s, so the
counts of the shards are at most one apart and the slots of a shard have no gap. Any row's
shard and slot follow from its number, the number of rows and the seed alone, and
``unpermute`` gives the row number that a shard and slot hold.

Global row numbers come from one range-partitioned sort of the key columns; only the row
counts of the partitions pass through the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

ROUNDS = 6


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Addend (below 2^30) and odd multiplier (below 2^30) of each round."""
    keys, x = [], (seed * 2654435761 + 97) % (1 << 61)
    for _ in range(ROUNDS):
        x = (x * 25214903917 + 11) % (1 << 61)
        y = (x * 25214903917 + 11) % (1 << 61)
        keys.append(((x >> 20) % (1 << 30), ((y >> 20) % (1 << 30)) | 1))
        x = y
    return keys


def half_bits(n: int) -> int:
    """Bits of each half: the smallest h with 4^h >= n."""
    h = 1
    while 1 << (2 * h) < n:
        h += 1
    return h


def mix(x: np.ndarray, h: int, key: tuple[int, int]) -> np.ndarray:
    """The round function: h bits of a product, all below 2^62."""
    t = (x + key[0]) * key[1]
    return (t ^ (t >> 17)) & ((1 << h) - 1)


def once(x: np.ndarray, h: int, keys: list[tuple[int, int]]) -> np.ndarray:
    left, right = x >> h, x & ((1 << h) - 1)
    for key in keys:
        left, right = right, left ^ mix(right, h, key)
    return (left << h) | right


def back(x: np.ndarray, h: int, keys: list[tuple[int, int]]) -> np.ndarray:
    left, right = x >> h, x & ((1 << h) - 1)
    for key in reversed(keys):
        left, right = right ^ mix(left, h, key), left
    return (left << h) | right


def walk(step, index: np.ndarray, n: int, seed: int) -> np.ndarray:
    h, keys = half_bits(n), round_keys(seed)
    out = step(np.asarray(index, np.int64), h, keys)
    while (outside := out >= n).any():  # cycle walking: back into 0..n-1, still one to one
        out[outside] = step(out[outside], h, keys)
    return out


def permute(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Positions of row numbers ``index`` among n rows (n below 2^60)."""
    return walk(once, index, n, seed)


def unpermute(position: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers at ``position``: the inverse of :func:`permute`."""
    return walk(back, position, n, seed)


def row_numbers(df: DataFrame, order: list[str], out: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with its 0-based row number in the order of the columns ``order`` (nulls first),
    and the number of rows. The sorted table is written first: a range partitioning samples
    its bounds anew whenever it is computed, so counts and rows must come from one run."""
    spark = df.sparkSession
    columns = [F.col(f"`{c}`") for c in order]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(tasks, *columns).sortWithinPartitions(*columns)
    at = F.monotonically_increasing_id()
    table = written(spread.withColumns({"__part": F.shiftright(at, 33), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}),
                    "row-numbers")
    counts = sorted((r[0], r[1]) for r in table.groupBy("__part").count().collect())  # one for each partition
    starts, n = [], 0
    for part, count in counts:
        starts.append((part, n))
        n += count
    if not starts:
        return table.withColumn(out, F.lit(0).cast("long")).drop("__part", "__at"), 0
    offsets = spark.createDataFrame(starts, "__part long, __start long")
    numbered = table.join(F.broadcast(offsets), "__part")
    return numbered.withColumn(out, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start"), n


def shard(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Append shard (0..shards-1) and slot (0.. without gap in each shard).

    ``order`` names the columns that number the rows; rows equal in them are interchangeable
    there, so name enough to tell rows apart. Nulls sort first; empty texts and repeated rows
    are rows like any other; an empty table stays empty; columns named shard or slot are
    replaced. Same rows, seed and shards: same result, however the input is partitioned."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    numbered, n = row_numbers(df.drop("shard", "slot"), order, "__row")

    def positions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for index in batches:
            yield pd.Series(permute(index.to_numpy(), n, seed))

    place = F.pandas_udf(positions, "long")(F.col("__row").cast("long"))
    placed = numbered.withColumn("__position", place)
    return placed.withColumns({"shard": F.pmod("__position", F.lit(shards)).cast("int"),
                               "slot": F.floor(F.col("__position") / shards).cast("long")}).drop("__row", "__position")
