"""RFC 4180 files read by many tasks: quoted cells may hold line ends, yet a file is split.

Spark reads physical lines in its usual splits. Whether a line begins inside a quoted cell
depends on all of the file before it, so a first pass finds for every split how it ends if it
begins outside a quoted cell and how if it begins inside. One row for each split goes to the
driver, where these composed in file order say how each split truly begins. A second pass puts
lines together to records; only a record that crosses splits is assembled by a shuffle of its
pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "path string, block long, line string"


def open_after(line: str, inside: bool, separator: str = ",") -> bool:
    """Whether a quoted cell is open behind ``line``, which begins inside one or not. Quotes count
    at the beginning of a cell and in quoted cells (there a doubled one is a character)."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            while not line.startswith('"', at):
                at = line.find(separator, at) + 1
                if not at:
                    return False
            inside, at = True, at + 1
        at = line.find('"', at)
        if at < 0:
            return True
        if line.startswith('""', at):
            at += 2
            continue
        inside, at = False, line.find(separator, at) + 1
        if not at:
            return False


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, line): lines in file order within a split; ``block`` is where the split begins."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Lines of one split in portions."""
    for batch in batches:
        paths, blocks, lines = (batch.column(c).to_pylist() for c in ("path", "block", "line"))
        begin = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or (paths[k], blocks[k]) != (paths[begin], blocks[begin]):
                yield paths[begin], blocks[begin], lines[begin:k]
                begin = k


def beginnings(lines: DataFrame, separator: str) -> dict[tuple[str, int], int]:
    """For each split that begins inside a quoted cell, the split in which that record begins."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for path, block, part in runs(batches):
            state = found.setdefault((path, block), [False, True, False])
            for line in part:
                if '"' in line:
                    state[:2] = [open_after(line, s, separator) for s in state[:2]]
                state[2] |= not state[1]
        for (path, block), state in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (path, block, *state)], names=["path", "block", "outside", "inside", "closes"])

    owners: dict[tuple[str, int], int] = {}
    last, opened = None, None  # the open record's split
    wanted = "path string, block long, outside boolean, inside boolean, closes boolean"
    for r in sorted(lines.mapInArrow(ends, wanted).collect()):  # one row for each split
        if r.path != last:
            last, opened = r.path, None
        if opened is None:
            opened = r.block if r.outside else None
        else:
            owners[r.path, r.block] = opened
            if r.closes:  # the record that was open ends here; another may be open behind it
                opened = r.block if r.inside else None
    return owners


def records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(record, first): the records of the files at ``path``, in no order; ``first`` marks each
    file's first one. Blank lines outside of quoted cells are no records."""
    lines = physical_lines(spark, path)
    owners = spark.sparkContext.broadcast(beginnings(lines, separator))  # splits that begin inside a cell at most

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, owner, held, inside, fresh = None, None, [], False, False

        def end(whole: bool) -> None:
            """The lines held are a record, or a piece of one that crosses splits."""
            nonlocal owner, held, fresh
            if held:
                text = "\n".join(held)
                piece = owner is not None or not whole
                if piece or text.strip("\r"):
                    rows.append((now[0], (owner if owner is not None else now[1]) if piece else None, now[1], text, fresh))
                    fresh = False
            owner, held = None, []

        for path_, block, part in runs(batches):
            if (path_, block) != now:
                if now is not None:
                    end(not inside)
                now = (path_, block)
                owner = owners.value.get(now)
                inside, fresh = owner is not None, block == 0
            for line in part:
                held.append(line)
                inside = open_after(line, inside, separator)
                if not inside:
                    end(True)
            if len(rows) >= 5_000:
                yield packed(rows)
                rows.clear()
        if now is not None:
            end(not inside)
        if rows:
            yield packed(rows)

    pieces = lines.mapInArrow(joined, "path string, owner long, block long, record string, first boolean")
    whole = pieces.where("owner is null").select("record", "first")
    parts = F.array_sort(F.collect_list(F.struct("block", "record")))
    crossing = pieces.where("owner is not null").groupBy("path", "owner").agg(parts.alias("parts"), F.max("first").alias("first"))
    crossing = crossing.select(F.array_join(F.col("parts.record"), "\n").alias("record"), "first")
    return whole.unionByName(crossing).select(F.regexp_replace("record", "\r$", "").alias("record"), "first")


def packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=["path", "owner", "block", "record", "first"])
