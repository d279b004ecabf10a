"""Line dedup: lines that many documents hold go from all documents but one.

Lines are exploded to (key, document, position), where the key is a 128-bit hash of the line
stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. Distinct documents are
counted for each key; lines of keys above the threshold are dropped except in the largest id
that holds the key; each document is put together again from the positions that stay.

How the work is dealt: texts are exploded where they lie and only hashes and numbers are
shuffled; documents are made distinct by (key, id) and counted with partial sums, so a line of
a third of all documents is spread over all tasks; the keys found go back to the lines by
:func:`common.join_by_key` (hot keys broadcast, at most 1,000 of them); whole texts move once,
to meet their dropped positions. No part depends on the size of the input.

Edge cases: a null or empty text is one empty line; null ids are one document, smaller than any
other; repeated rows count as one document and lose the same lines; rows of one id with other
texts count as one document too; an empty table stays empty; result columns replace columns of
the same name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import join_by_key, slices, texts_of, with_arrays, with_fields, written

LEAST_CHARS = 20
LEAST_DOCS = 3
BLANK = b" \t\n\v\f\r"


def key_of(line: bytes, least_chars: int) -> bytes | None:
    """Hash of the normalised line, or None if that is too short."""
    bare = line.strip(BLANK).lower()  # bytes.lower() changes A-Z only
    if len(bare) < least_chars or (len(bare) < 4 * least_chars and len(bare.decode()) < least_chars):
        return None
    return xxhash.xxh3_128_digest(bare)


def exploded(docs: DataFrame, least_chars: int) -> DataFrame:
    """(__id, __text, key, position) for each line with a key; __text is a hash of the text."""
    schema = "__id " + docs.schema["__id"].dataType.simpleString() + ", __text long, key binary, position int"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at, keys, positions = [], [], []
            for row, text in enumerate(texts_of(batch, "text")):
                for position, line in enumerate(text.encode().split(b"\n")):
                    if (key := key_of(line, least_chars)) is not None:
                        at.append(row)
                        keys.append(key)
                        positions.append(position)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(take), batch.column("__text").take(take),
                                              pa.array(keys, pa.binary()), pa.array(positions, pa.int32())],
                                             names=["__id", "__text", "key", "position"])

    return docs.select("__id", "__text", "text").mapInArrow(lines, schema)


def repeated_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """(key, last, rows): keys of at least ``least_docs`` documents, the largest id that holds
    each, and the number of its lines."""
    held = lines.groupBy("key", "__id").agg(F.count(F.lit(1)).alias("rows"))
    counted = held.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("__id").alias("last"), F.sum("rows").alias("rows"))
    return counted.filter(F.col("docs") >= least_docs).drop("docs")


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                        id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept (the text without the dropped lines)."""
    keyed = docs.withColumns({"__text": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "__id": F.col(id)})
    lines = written(exploded(keyed.select("__id", "__text", F.col(text).alias("text")), least_chars), "line-keys")
    found = written(repeated_keys(lines, least_docs), "line-found")
    gone = join_by_key(lines, found, "key", "rows").filter(~F.col("__id").eqNullSafe(F.col("last")))
    dropped = gone.groupBy("__id", "__text").agg(F.collect_set("position").alias("__dropped"))
    dropped = dropped.select(F.col("__id").alias("__of"), F.col("__text").alias("__in"), "__dropped")
    # the same plan at every size: texts and positions meet by a shuffle
    met = keyed.join(dropped.hint("merge"), F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__text") == F.col("__in")), "left")
    met = met.drop("__id", "__text", "__of", "__in")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            counts, drops, kept = [], [], []
            for body, gone in zip(texts_of(batch, text), batch.column("__dropped").to_pylist(), strict=True):
                counts.append(body.count("\n") + 1)
                drops.append(len(gone or ()))
                if gone:
                    out = set(gone)
                    body = "\n".join(line for k, line in enumerate(body.split("\n")) if k not in out)
                kept.append(body)
            yield with_arrays(batch, {"n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(drops, pa.int64()),
                                      "kept": pa.array(kept, pa.string())})

    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]
    return met.mapInArrow(whole, with_fields(met.schema, fields)).drop("__dropped")
