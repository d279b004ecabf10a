"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming
distance by self-joins of binary tries.

A trie is a sorted array of fingerprints, a node the range that shares its leading bits. The
join starts with the pairs (node, node), goes down bit by bit to the pairs of children, adds
one to a pair's distance where the children's bits differ, and drops a pair as soon as the
distance exceeds the budget.

Distribution: with d differing bits allowed, cut into d + 1 blocks two fingerprints agree in
one block at least. So every distinct fingerprint is sent to d + 1 tries, each rooted at one
block's value, and a task joins all tries of its partition. A root that more than ``MOST``
fingerprints share is cut again by the same rule over its remaining bits, until none is left
or fewer than 2^FEW_BITS fingerprints can share it: no trie is unbounded. Within a task, links
are contracted to a spanning forest, so dense groups never emit all their pairs; exact copies
share one fingerprint and are joined back at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import join_by_key, sieve, slices, texts_of, with_arrays, with_fields, written
from tessera.llm.components import components

SEED = 42
#: Fingerprints below one trie root before it is cut again, and free bits where cutting ends.
MOST, FEW_BITS = 20_000, 15
#: Node pairs expanded at once, and fingerprints in a task's tries.
PAIRS_AT_ONCE, TASK_ROWS = 1 << 20, 400_000


def fingerprint(text: str, words: int) -> int:
    """Bit k is set if it is set in more than half of the shingles' hashes."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # lowers A-Z only, splits at ASCII blanks
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(len(parts) - words + 1, 1)
    last = ends[min(words, len(parts)) - 1:].tolist()
    first = [0, *(ends[:n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    majority = bits.sum(axis=0, dtype=np.int64) * 2 > n
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, out: str = "fp") -> DataFrame:
    """Append ``out``: the fingerprint as a signed 64-bit integer. Texts with fewer words than a
    shingle have one shingle, those without words (null too) the fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = np.array([fingerprint(t, words) for t in texts_of(batch, text)], np.uint64)
            yield with_arrays(batch, {out: pa.array(found.view(np.int64))})

    return docs.mapInArrow(run, with_fields(docs.schema, [T.StructField(out, T.LongType())]))


def block_sizes(bits: int, blocks: int) -> list[int]:
    return [bits // blocks + (k < bits % blocks) for k in range(blocks)]


def cut(rows: DataFrame, fixed: int, distance: int) -> tuple[DataFrame, list[int]]:
    """Every row once for each block of its free bits (all but the ``fixed`` leading ones of
    ``turned``), that block turned to directly behind the fixed bits; ``trie`` tells the
    tries apart, ``fixed`` counts the leading bits that a trie shares, ``root`` are those bits."""
    sizes = block_sizes(64 - fixed, distance + 1)
    free = 64 - fixed
    bits = F.col("turned")
    head = bits if fixed == 0 else F.shiftleft(F.shiftrightunsigned(bits, free), free)
    tail = bits if fixed == 0 else bits.bitwiseAND(F.lit((1 << free) - 1))
    made, at = [], 0
    for k, size in enumerate(sizes):
        # rotate the free bits left by ``at``
        turned = tail if at == 0 else F.shiftleft(tail, at).bitwiseOR(F.shiftrightunsigned(tail, free - at))
        if fixed:
            turned = head.bitwiseOR(turned.bitwiseAND(F.lit((1 << free) - 1)))
        made.append(F.struct((F.col("trie") * (distance + 1) + k).alias("trie"), turned.alias("turned"),
                             F.lit(fixed + size).alias("fixed"), F.shiftrightunsigned(turned, free - size).alias("root")))
        at += size
    parts = rows.withColumn("part", F.explode(F.array(*made)))
    return parts.select("fp", "part.trie", "part.turned", "part.fixed", "part.root"), sizes


def join_tries(turned: np.ndarray, roots: np.ndarray, fixed: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Self-join of the tries in a sorted array: ``turned`` ascends within a root, ``roots``
    numbers the root of each element, ``fixed`` counts a root's shared bits. Returns the index
    pairs of a forest that spans every group linked at ``distance`` or less."""
    parent = np.arange(len(turned))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges: list[tuple[int, int]] = []
    start = np.flatnonzero(np.r_[True, roots[1:] != roots[:-1]]) if len(roots) else np.zeros(0, int)
    end = np.r_[start[1:], len(roots)] if len(roots) else start
    many = end - start > 1
    start, end = start[many], end[many]
    stack = [(start, end, start, end, np.zeros(len(start), np.int64), 63 - fixed[start].astype(np.int64))]
    while stack:
        a0, a1, b0, b1, off, bit = stack.pop()
        if len(a0) > PAIRS_AT_ONCE:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, off, bit)), tuple(x[half:] for x in (a0, a1, b0, b1, off, bit))]
            continue
        # small pairs of nodes: compare their leaves
        small = ((a1 - a0) * (b1 - b0) <= 16) | (bit < 0)
        if small.any():
            s0, s1, t0, t1 = a0[small], a1[small], b0[small], b1[small]
            width = t1 - t0
            count = (s1 - s0) * width
            pair = np.repeat(np.arange(len(count)), count)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            x, y = s0[pair] + at // width[pair], t0[pair] + at % width[pair]
            near = (x < y) & (np.bitwise_count(turned[x] ^ turned[y]) <= distance)
            x, y = x[near], y[near]
            if len(x):
                while (up := parent[parent]) is not None and (up != parent).any():
                    parent[:] = up
                px, py = parent[x], parent[y]
                apart = px != py
                x, y = x[apart], y[apart]
                _, one = np.unique(px[apart] * len(turned) + py[apart], return_index=True)
                for i, j in zip(x[one].tolist(), y[one].tolist()):  # one link for each pair of groups
                    p, q = find(i), find(j)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        edges.append((i, j))
            a0, a1, b0, b1, off, bit = (v[~small] for v in (a0, a1, b0, b1, off, bit))
        if not len(a0):
            continue
        same = a0 == b0
        am = split(turned, a0, a1, bit)
        bm = np.where(same, am, split(turned, b0, b1, bit))
        kids = [(a0, am, b0, bm, off), (am, a1, bm, b1, off), (a0, am, bm, b1, off + 1)]
        cross = ~same
        kids.append(tuple(v[cross] for v in (am, a1, b0, bm, off + 1)))
        down = [bit - 1] * 3 + [bit[cross] - 1]
        parts = [np.concatenate([k[i] for k in kids]) for i in range(5)] + [np.concatenate(down)]
        alive = (parts[1] > parts[0]) & (parts[3] > parts[2]) & (parts[4] <= distance)
        alive &= ~((parts[0] == parts[2]) & (parts[1] - parts[0] == 1))  # a single leaf with itself
        if alive.any():
            stack.append(tuple(v[alive] for v in parts))
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.array(edges, np.int64)
    return found[:, 0], found[:, 1]


def split(turned: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the bit turns from 0 to 1 within each range (its higher bits are all equal)."""
    one = np.uint64(1)
    shift = bit.astype(np.uint64)
    prefix = (turned[lo] >> shift) | one
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        right = np.zeros(len(lo), bool)
        m = mid[open_]
        right[open_] = (turned[m] >> shift[open_]) < prefix[open_]
        lo = np.where(open_ & right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


def near_links(distinct: DataFrame, rows: int, distance: int) -> DataFrame:
    """a, b: links that span all groups of the distinct fingerprints ``fp`` within ``distance``
    differing bits of each other."""
    spark = distinct.sparkSession
    level = distinct.select("fp", F.lit(0).cast("long").alias("trie"), F.col("fp").alias("turned"))
    fixed, ready = [0], []
    while True:
        made = [cut(level if f == 0 else level.filter(F.col("fixed") == f), f, distance) for f in fixed]
        level = made[0][0]
        for part, _ in made[1:]:
            level = level.unionByName(part)
        fixed = sorted({f + s for f, (_, sizes) in zip(fixed, made) for s in sizes})
        over = written(level.groupBy("trie", "fixed", "root").agg(F.count("*").alias("n")).filter(F.col("n") > MOST), "simhash-hot")
        if max(fixed) >= 64 - FEW_BITS or over.isEmpty():
            ready.append(level)
            break
        # every root cut again has more than MOST rows: there are few of them
        ready.append(level.join(over.drop("n"), ["trie", "fixed", "root"], "left_anti"))
        level = written(level.join(over.drop("n"), ["trie", "fixed", "root"], "left_semi").drop("root"), "simhash-level")
    every = ready[0]
    for part in ready[1:]:
        every = every.unionByName(part)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(distance + 1) * rows // TASK_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        held = pa.Table.from_batches(got)
        fp, turned = held["fp"].to_numpy(), held["turned"].to_numpy().view(np.uint64)
        trie, bits = held["trie"].to_numpy(), held["fixed"].to_numpy()
        order = np.lexsort((turned, bits, trie))
        fp, turned, trie, bits = fp[order], turned[order], trie[order], bits[order]
        top = turned >> (64 - bits).astype(np.uint64)
        fresh = np.r_[True, (trie[1:] != trie[:-1]) | (bits[1:] != bits[:-1]) | (top[1:] != top[:-1])]
        i, j = join_tries(turned, np.cumsum(fresh), bits, distance)
        yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["a", "b"])

    spread = every.repartition(tasks, "trie", "fixed", "root").select("fp", "trie", "turned", "fixed")
    return spread.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` without its text, with fingerprint (16 hex digits), component_id (the smallest
    ``key`` reachable over links of at most ``distance`` bits, its own included) and copies (the
    rows that share the fingerprint).

    Null texts count as empty: they have the fingerprint zero and link like any other; repeated
    rows stay and share a component; null keys take no part in the smallest key (a component of
    null keys alone has none); an empty table stays empty; columns named like a result are
    replaced."""
    docs = docs.drop("fingerprint", "component_id", "copies", "group")
    marked = written(fingerprints(docs, text, words, "__fp").drop(text), "simhash-fingerprints")
    distinct = written(marked.groupBy(F.col("__fp").alias("fp")).agg(F.count("*").alias("n"), F.min(key).alias("first")),
                       "simhash-distinct")
    links = near_links(distinct, distinct.count(), distance)
    groups = written(components(links, "simhash-links"), "simhash-groups")
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    linked = named.join(least, "component").select("fp", "least", "component")
    classes = written(distinct.join(linked, "fp", "left").select(
        F.col("fp").alias("__fp"), F.col("n").alias("__rows"), F.col("n").alias("copies"),
        F.coalesce("least", "first").alias("component_id"), F.coalesce("component", "fp").alias("group")), "simhash-classes")
    out = join_by_key(marked, classes, "__fp", "__rows")
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("__fp"), 16, "0"))).drop("__fp")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3, distance: int = 3) -> DataFrame:
    """One row of ``docs`` of each group of near-duplicates: that of the smallest ``key`` (a null key
    comes last), and of the smallest text hash among rows of that key.

    Rows are told apart by key and text, not by key alone: rows that share a key and have other
    texts are judged each with its own group, of rows equal in both one stays."""
    names = ["__h1", "__h2"]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = docs.withColumns({"__h1": F.xxhash64(body), "__h2": F.xxhash64(F.lit(1), body)})
    judged = written(near_duplicates(marked.select(key, text, *names), text, key, words, distance).select(key, *names, "group"), "simhash-judged")
    first = judged.groupBy("group").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias(key), *names)).alias("of")) \
        .select(F.col(f"of.{key}").alias("__key"), F.col("of.__h1").alias("__k1"), F.col("of.__h2").alias("__k2"))
    rows = judged.groupBy(F.col(key).alias("__key"), F.col("__h1").alias("__k1"), F.col("__h2").alias("__k2")).agg(F.count("*").alias("__n"))
    same = [F.col("f.__key").eqNullSafe(F.col("r.__key")), F.col("f.__k1") == F.col("r.__k1"), F.col("f.__k2") == F.col("r.__k2")]
    first = written(first.alias("f").join(rows.alias("r"), same).select("f.*", "__n"), "simhash-first")
    held = [F.col(key).eqNullSafe(F.col("__key")), F.col("__h1") == F.col("__k1"), F.col("__h2") == F.col("__k2")]
    kept = marked.join(first.filter("__n = 1").hint("merge"), held, "left_semi")
    repeated = first.filter("__n > 1")
    if not repeated.isEmpty():  # of equal rows one stays; copies meet in partial aggregates first
        some = sieve(marked, repeated.select(F.col("__key").alias(key), F.col("__k1").alias("__h1"), F.col("__k2").alias("__h2")), [key, *names])
        kept = kept.unionByName(some.join(repeated.hint("merge"), held, "left_semi").dropDuplicates([key, *names]))
    return kept.drop(*names)
