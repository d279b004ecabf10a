"""Symbol n-grams of texts: every character is one of 64 classes, an n-gram of four symbols
is a 24-bit key. The key space, and so every table of n-grams, is bounded by 2^24 entries
whatever the corpus; the counts in it come from all of the corpus. The queries count n-grams of
true characters instead (:mod:`tessera.llm.ngrams`)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, texts_of

BITS, ORDER = 6, 4
SIZE = 1 << BITS
#: Longest sum of characters whose keys are made at once.
AT_ONCE = 2 << 20


def classes() -> np.ndarray:
    """Class of each code point below U+3000: 0 the edge of a text, 1 a blank, 2 a line end,
    3-28 small Latin letters, 29 capital Latin letters, 30 digits, 31 full stop, 32 comma,
    33-40 other ASCII by code, 41-63 all others by code."""
    code = np.arange(0x3000)
    out = 41 + code % 23
    out[:128] = 33 + code[:128] % 8
    out[0], out[ord("\n")] = 0, 2
    out[[9, 11, 12, 13, 32]] = 1
    out[ord("a"):ord("z") + 1] = np.arange(26) + 3
    out[ord("A"):ord("Z") + 1] = 29
    out[ord("0"):ord("9") + 1] = 30
    out[ord(".")], out[ord(",")] = 31, 32
    return out.astype(np.uint8)


CLASSES = classes()
EDGE = "\0" * (ORDER - 1)


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all four-symbol windows that end in a character of a text, one for each
    character (each text begins after an edge of three symbols), and the bounds of the texts
    in them. U+0000 in a text counts as an edge."""
    code = np.frombuffer((EDGE + EDGE.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    symbol = np.where(code < len(CLASSES), CLASSES[np.minimum(code, len(CLASSES) - 1)], 41 + code % 23).astype(np.uint32)
    keys = symbol[3:] | symbol[2:-1] << 6 | symbol[1:-2] << 12 | symbol[:-3] << 18
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    inside = np.ones(len(keys), bool)
    for k in range(1, ORDER):
        inside[starts[1:] - k] = False
    return keys[inside], np.concatenate([[0], np.cumsum(sizes)])


def text_blocks(batches, column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in slices(batches, column, AT_ONCE):
        yield batch, texts_of(batch, column)


def count_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """key int, n long: how often each key occurs in all texts. Each task adds up its own
    counts before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SIZE ** ORDER, np.uint32)
        for _, texts in text_blocks(batches, text):
            keys, n = np.unique(keys_of(texts)[0], return_counts=True)
            counts[keys] += n.astype(np.uint32)
        found = np.flatnonzero(counts)
        for at in range(0, len(found), 1 << 16):
            part = found[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int64))],
                                             names=["key", "n"])

    return df.select(F.col(f"`{text}`").alias(text)).mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Tables:
    """The table of logarithms that a worker used last: one is kept, whatever models it meets."""
    last: tuple[str, np.ndarray] | None = None


def kept_table(name: str, make) -> np.ndarray:
    if Tables.last is None or Tables.last[0] != name:
        Tables.last = None  # free the former table before the new one is made
        Tables.last = (name, make())
    return Tables.last[1]
