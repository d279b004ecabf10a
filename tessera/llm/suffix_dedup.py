"""Suffix-array dedup: remove every byte covered by a string of ``LENGTH`` bytes that also
starts anywhere else, by bucket-pointer refinement.

Windows of 200 bytes are dealt out by content: each window's anchor is the smallest hash among
its 32-byte grams, so equal windows share it, and neighbouring windows mostly do as well. A run
of windows with one anchor is a *segment* (its bytes reach from the first window's start to the
last one's end); a document has one for about every 85 bytes, and only (document, start,
windows, anchor, content hash) is shuffled for it. Then

* a segment found twice or more, byte for byte, is covered as a whole;
* an anchor with one segment, met at one place in it, is done: nothing in it repeats;
* among the distinct segments of each other anchor, a task sorts suffixes: buckets of 8-byte
  grams are refined by sorting on pairs of bucket identifiers, an offset's own and that of a
  later offset, which doubles the compared length each time (8, 16, 32, 64, 128, 200); buckets
  of one offset drop out.

Hot anchors: equal segments are counted by partial aggregation and found again by a join that
splits hot keys. The distinct segments of an anchor with more than ``MOST`` of them never come
together: there the bucket identifiers are 128-bit hashes, which all tasks refine alike (an
offset's own and that of a later offset give the next, 8, 16, 32, 64, 128, 200), and the buckets of
the last round are counted as rows by Spark, with partial sums. Only windows that are alone in
their bucket come back to their documents: the others of a segment are its repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import join_by_key, sieve, slices, with_arrays, with_fields, written

LENGTH, GRAM = 200, 32
WIDTH = LENGTH - GRAM + 1
#: Distinct segments of an anchor that a task sorts at most; segments dealt to a task.
MOST, TASK_ROWS = 2_000, 100_000
#: Bytes hashed at once, and bytes of segments whose suffixes are sorted together.
AT_ONCE, SORTED_AT_ONCE = 1 << 18, 3 << 20
#: Odd multipliers of the gram hashes: the powers of one odd number.
MULTIPLIERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 9)]


def grams(data: bytes, which: int = 0) -> np.ndarray:
    """Hash of the 32-byte gram at each offset; ``which`` chooses the hash function."""
    n = len(data) - 7
    word = np.ndarray((n,), "<u8", buffer=data, strides=(1,))
    m = n - GRAM + 8
    h = word[:m] * np.uint64(MULTIPLIERS[0])
    for k in range(1, GRAM // 8):
        h += word[8 * k:8 * k + m] * np.uint64(MULTIPLIERS[k])
    h ^= np.uint64((which * 0x5851F42D4C957F2D) % (1 << 64))
    h ^= h >> np.uint64(32)
    h *= np.uint64(MULTIPLIERS[4 + which % 4])
    h ^= h >> np.uint64(29)
    return h


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """``best`` of the ``width`` values from each offset on, by running bests of blocks."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    worst = np.iinfo(values.dtype).max if best is np.minimum else 0
    padded = np.full(rows * width, worst, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(rows, width)
    front = best.accumulate(blocks, axis=1).reshape(-1)
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[:n], front[width - 1:width - 1 + n])


def anchors(data: bytes, which: int = 0) -> np.ndarray:
    """Smallest gram hash of the window at each offset."""
    return sliding(grams(data, which), WIDTH)


def repeats_inside(h: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether a run of windows meets its anchor at more than one place: only then can two of
    its own windows be equal."""
    edge = np.zeros(WIDTH - 1, np.uint64)
    held = np.flatnonzero(h == sliding(np.r_[edge, anchor, edge], WIDTH, np.maximum))  # anchors of some window
    lo, hi = np.searchsorted(held, first), np.searchsorted(held, last + WIDTH)
    count = hi - lo
    run = np.repeat(np.arange(len(first)), count)
    at = held[np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + lo[run]]
    return np.bincount(run[h[at] == anchor[first][run]], minlength=len(first)) > 1


def segments_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, content hash, may repeat itself) of all segments of the texts."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    if len(data) < LENGTH:
        return (*(np.zeros(0, np.int64) for _ in range(5)), np.zeros(0, bool))
    h = grams(data)
    anchor = sliding(h, WIDTH)
    inside = np.zeros(len(anchor), bool)
    for s, n in zip(starts.tolist(), sizes.tolist()):
        if n >= LENGTH:
            inside[s:s + n - LENGTH + 1] = True
    turn = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(inside & np.r_[True, turn | ~inside[:-1]])
    last = np.flatnonzero(inside & np.r_[turn | ~inside[1:], True])
    digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
    content = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist())), np.uint64, len(first))
    text = np.searchsorted(starts, first, "right") - 1  # an empty text shares its start with the next, which is meant
    return (text, first - starts[text], last - first + 1, anchor[first].view(np.int64), content.view(np.int64),
            repeats_inside(h, anchor, first, last))


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def segments(docs: DataFrame, text: str, row: str) -> DataFrame:
    """(row, start, windows, anchor, content, inner) of every segment of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, AT_ONCE):
            which, start, windows, anchor, content, inner = segments_of(raw_texts(batch, text))
            rows = batch.column(row).to_numpy()[which]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor), pa.array(content),
                 pa.array(inner)], names=["row", "start", "windows", "anchor", "content", "inner"])

    return docs.select(row, text).mapInArrow(run, "row long, start int, windows int, anchor long, content long, inner boolean")


def refine(data: bytes, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Offsets whose string of ``length`` bytes is found at another offset too. ``ends`` holds
    for each offset the end of its segment; strings never reach beyond it."""
    n = len(data)
    room = ends - np.arange(n)
    word = np.ndarray((max(n - 7, 0),), "<u8", buffer=data, strides=(1,))
    active = np.flatnonzero(room >= 8)
    active, bucket = regroup(active, word[active], n)
    height = 8
    while height < length and len(active):
        ahead = min(height, length - height)  # the later offset whose bucket decides
        active = active[room[active] >= height + ahead]
        active, bucket = regroup(active, bucket[active] * (2 * n) + bucket[active + ahead], n)
        height += ahead
    return active[room[active] >= length]


def regroup(at: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The offsets ``at`` that share their key with another, and every offset's bucket: the
    rank of its key, or one of its own."""
    _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
    shared = times[name] > 1
    bucket = np.arange(n, 2 * n)
    bucket[at[shared]] = name[shared]
    return at[shared], bucket


def repeated_parts(rows: list[tuple[bytes, int]]) -> list[list[tuple[int, int]]]:
    """For each (bytes, windows) of distinct segments: the parts of it, as (from, to), that are
    covered by strings found elsewhere among them."""
    data = b"".join(r[0] for r in rows)
    sizes = np.array([len(r[0]) for r in rows], np.int64)
    stops = np.cumsum(sizes)
    found = refine(data, np.repeat(stops, sizes))
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    if len(found):
        found.sort()
        which = np.searchsorted(stops, found, "right")
        new = np.r_[True, (np.diff(found) > 1) | (np.diff(which) > 0)]
        begin, end = found[new], found[np.r_[new[1:], True]]
        for k, a, b in zip(which[new].tolist(), begin.tolist(), end.tolist()):
            at = int(stops[k] - sizes[k])
            out[k].append((a - at, b - at + LENGTH))
    return out


def bucket_ids(piece: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit bucket identifiers of the string of ``length`` bytes at each offset of a segment,
    refined by pairs of identifiers as in :func:`refine`; equal strings share them everywhere."""
    word = np.ndarray((len(piece) - 7,), "<u8", buffer=piece, strides=(1,))
    out = []
    for which in (1, 2):
        odd, other = np.uint64(MULTIPLIERS[which]), np.uint64(MULTIPLIERS[which + 4])
        mixed = lambda x, y: (h := (x * odd) ^ ((y + other) * other), (h ^ (h >> np.uint64(31))) * odd)[1]  # noqa: B023, E731
        bucket, height = mixed(word, np.uint64(which) ^ (word >> np.uint64(29))), 8
        while height < length:
            ahead = min(height, length - height)
            bucket = mixed(bucket[:-ahead] ^ (bucket[:-ahead] >> np.uint64(33)), bucket[ahead:])
            height += ahead
        out.append(bucket ^ (bucket >> np.uint64(32)))
    return out[0], out[1]


PIECE = "anchor long, row long, start int, alone boolean, piece binary"
SPAN = "row long, `from` int, `to` int"
WINDOW = "row long, `from` int, alone boolean, bucket binary"


def picks_of(kinds: DataFrame, variants: DataFrame) -> DataFrame:
    """row, picks: for each document the segments that stand first for their content and whose anchor
    is among ``variants`` (anchor, rows)."""
    open_ = kinds.select("copies", "one", F.col("seg.anchor").alias("anchor"))
    return join_by_key(open_, variants, "anchor", "rows").groupBy(F.col("one.row").alias("row")).agg(F.collect_list(F.struct(
        F.col("one.start").alias("start"), F.col("one.windows").alias("windows"), "anchor", (F.col("copies") == 1).alias("alone"))).alias("picks"))


def picked_pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(anchor, row, start, alone, bytes) of the segments listed in ``picks`` of each document."""
    for row, raw, picks in zip(batch.column("row").to_pylist(), raw_texts(batch, "text"), batch.column("picks").to_pylist()):
        for p in picks:
            yield p["anchor"], row, p["start"], p["alone"], raw[p["start"]:p["start"] + p["windows"] + LENGTH - 1]


def pieces(picked: DataFrame) -> DataFrame:
    """The bytes of the segments of uncrowded anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = list(picked_pieces(batch))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)],
                                             names=["anchor", "row", "start", "alone", "piece"])

    return picked.mapInArrow(run, PIECE)


def windows(picked: DataFrame) -> DataFrame:
    """A row for each window of the segments of crowded anchors: its place and its bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for _, row, start, alone, piece in picked_pieces(batch):
                ids = np.stack(bucket_ids(piece), axis=1)
                n = len(ids)
                offsets = np.arange(0, 16 * n + 1, 16, dtype=np.int32)
                buckets = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row, np.int64)), pa.array(start + np.arange(n, dtype=np.int32)),
                                                  pa.array(np.full(n, alone)), buckets], names=["row", "from", "alone", "bucket"])

    return picked.mapInArrow(run, WINDOW)


def crowded_spans(picked: DataFrame, picks: DataFrame) -> DataFrame:
    """Spans of the windows of crowded anchors that are found twice or more, in maximal runs. Buckets
    are counted with partial sums; the windows alone in theirs go back to their documents, and what the
    segments of ``picks`` have besides is repeated."""
    buckets = windows(picked).groupBy("bucket").agg(F.count("*").alias("rows"), *[F.min(c).alias(c) for c in ("row", "from", "alone")])
    lone = buckets.filter("rows = 1 and alone").groupBy("row").agg(F.collect_list("from").alias("lone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "lone"):
            out = []
            for row, found, at in zip(batch.column("row").to_pylist(), batch.column("picks").to_pylist(), batch.column("lone")):
                once = np.sort(at.values.to_numpy()) if at.is_valid else np.zeros(0, np.int32)
                for p in found:
                    if p["alone"]:
                        stop = p["start"] + p["windows"]
                        lo, hi = np.searchsorted(once, (p["start"], stop))
                        edges = np.r_[p["start"] - 1, once[lo:hi], stop]
                        some = np.flatnonzero(np.diff(edges) > 1)
                        out += zip([row] * len(some), (edges[some] + 1).tolist(), (edges[some + 1] - 1 + LENGTH).tolist())
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                                              pa.array(columns[2], pa.int32())], names=["row", "from", "to"])

    return written(picks.join(lone, "row", "left").mapInArrow(run, SPAN), "suffix-windows")


def sorted_spans(dealt: DataFrame, tasks: int) -> DataFrame:
    """Spans covered by repeats among the distinct segments of each anchor. The rows of a
    partition come sorted by it and are cut between anchors."""
    def spans(rows: list) -> pa.RecordBatch:
        out = [(r[1], r[2] + a, r[2] + b) for r, found in zip(rows, repeated_parts([(r[4], 0) for r in rows])) if r[3] for a, b in found]
        columns = list(zip(*out)) if out else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                                           pa.array(columns[2], pa.int32())], names=["row", "from", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SORTED_AT_ONCE and r[0] != last:
                    yield spans(held)
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r[4]), r[0]
        if held:
            yield spans(held)

    return dealt.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(run, SPAN)


def covered_spans(docs: DataFrame, text: str = "text", row: str = "row") -> DataFrame:
    """row, spans: the covered parts of each document that has any (they may overlap).
    ``docs`` has ``row`` (64 bits) and the texts, and may have other columns."""
    found = written(segments(docs, text, row), "suffix-segments")
    anchors_of = written(found.groupBy("anchor").agg(F.count("*").alias("rows"), F.max("inner").alias("again"))
                         .filter("rows > 1 or again").drop("again"), "suffix-anchors")
    shared = written(join_by_key(found, anchors_of, "anchor", "rows").select(
        "row", "start", "windows", "inner", F.struct("anchor", "content").alias("seg")), "suffix-shared")
    kinds = written(shared.groupBy("seg").agg(F.count("*").alias("copies"), F.max("inner").alias("inner"),
                                              F.min(F.struct("row", "start", "windows")).alias("one")), "suffix-kinds")
    whole = join_by_key(shared, kinds.filter("copies > 1").select("seg", F.col("copies").alias("rows")), "seg", "rows") \
        .select("row", F.col("start").alias("from"), (F.col("start") + F.col("windows") + (LENGTH - 1)).cast("int").alias("to"))
    variants = written(kinds.groupBy(F.col("seg.anchor").alias("anchor")).agg(F.count("*").alias("rows"), F.max("inner").alias("again"))
                       .filter("rows > 1 or again").drop("again"), "suffix-variants")
    texts = docs.select(F.col(row).alias("row"), F.col(text).alias("text"))
    few, many = variants.filter(F.col("rows") <= MOST), variants.filter(F.col("rows") > MOST)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(few.agg(F.sum("rows")).first()[0] or 0) // TASK_ROWS))
    parts = sorted_spans(pieces(texts.join(picks_of(kinds, few), "row")), tasks)
    if not many.isEmpty():
        picks = written(picks_of(kinds, many), "suffix-crowded")
        parts = parts.unionByName(crowded_spans(sieve(texts, picks, ["row"]).join(picks.hint("merge"), "row"), picks))
    return whole.unionByName(parts).groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", as_text: bool = False) -> DataFrame:
    """Append n_bytes, n_removed, n_spans (maximal removed runs), removed (array of from, to in
    bytes) and kept (binary: the remaining bytes; with ``as_text`` a string, where characters that
    lost a part of their bytes are left out).

    Null and empty texts have no bytes; texts shorter than 200 bytes stay whole; repeated rows
    count as places of their own, so they remove each other; an empty table stays empty; columns
    named like a result are replaced. Rows are told apart by a 64-bit hash of key and text."""
    results = ["n_bytes", "n_removed", "n_spans", "removed", "kept"]
    docs = docs.drop(*results).withColumn("__row", F.xxhash64(F.col(key), F.col(text)))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("__row", text)]
    narrow = docs.select(F.col("__row").alias("row"), F.col(text).alias("text"), F.struct(*rest).alias("rest"))
    spans = covered_spans(narrow)
    joined = narrow.join(spans, "row", "left")
    fields = [T.StructField(c, T.LongType()) for c in results[:3]] + [
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))),
        T.StructField("kept", T.StringType() if as_text else T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for raw, found in zip(raw_texts(batch, "text"), batch.column("spans").to_pylist()):
                gone = merged([(s["from"], s["to"]) for s in found or ()])
                edges = [0, *(x for ab in gone for x in ab), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(raw), len(raw) - len(rest), len(gone), [{"from": a, "to": b} for a, b in gone],
                            rest.decode("utf-8", "ignore") if as_text else rest))
            arrays = dict(zip(results, (pa.array(c, k) for c, k in zip(zip(*out), [
                pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])),
                pa.string() if as_text else pa.binary()]))))
            yield with_arrays(batch, arrays)

    done = joined.mapInArrow(run, with_fields(joined.schema, fields))
    return done.select("rest.*", F.col("text").alias(text), *results)
