"""Phrase collocations of each language by best-first branch and bound.

f(phrase) counts contiguous occurrences inside pieces of text (overlaps included). A candidate
has 2 to ``longest`` words and a = f >= ``least``; cut after its first k words it scores
floor(2000000 a / (l + r)) with l and r the counts of the two parts; its lowest-scoring cut
counts. A candidate is dropped if its words lie inside a longer candidate that has at least
``share`` percent of its count. Each language's first ``most`` are wanted.

The search tree grows phrases by a word. As an extension occurs no more often than the phrase,
counts of a phrase p bound every score that its extensions can reach:

    forward(p)  = floor(2000000 f(p) / (f(first word) + f(p)))   for phrases that p begins
    backward(p) = floor(2000000 f(p) / (f(p) + f(last word)))    for phrases that p ends

(the cuts next to the first and the last word). All prefixes of a phrase that scores s have
forward >= s, all its suffixes backward >= s, and forward(p) is no less than p's own score. So
with a limit t, expanding by a word on both sides exactly the nodes with either bound >= t
yields the counts and all parts' counts of every phrase that scores t or more, and the longer
candidates that may drop it: a phrase inside a longer one is inside one with a word more whose
count is no smaller.

Best first means waves: a wave takes, for each open language, the frontier nodes whose bound
reaches its limit, which is the score of its ``FIRST_WAVE * most``-th pair in the first wave and
of ranks ``NEXT_WAVE`` times as far in the following ones (0 when there are no more). A language
is settled once ``most`` candidates that score its limit or more survive, ties included; then
nothing that was not expanded can be among its first ``most``.

How the work is dealt: each level is one pass over the texts that counts the one-word extensions
of the frontier (numpy over Arrow batches, partial counts, then a hash aggregation). Words are
64-bit hashes until the end; two words of one language with the same hash are found and the
search starts again with another seed. Tasks know the frontier as a Bloom filter of at most
2^27 bits, whatever the corpus: what passes by chance is counted exactly and does no harm.
Counts, bounds and survivors stay in Spark tables; the driver sees one row for each wave, the
filter's words and a few hot languages.

Edge cases: null texts count as empty; null languages are ``und``; empty texts, texts without
pieces and empty tables give no rows; repeated rows count as often as they occur; very long
texts are cut at piece ends into batches of bounded bytes; ties go by count, then by phrase in
UTF-8 byte order; other columns are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import join_by_key, slices, written

MOST = 2000
LEAST = 30
LONGEST = 4
SHARE = 80               # percent
FIRST_WAVE, NEXT_WAVE = 2, 8
STEP = 500               # scores (0..1000000) in one bucket of the limits' histogram
MOST_BITS = 1 << 27      # of a frontier's filter
BATCH = 4 << 20          # bytes of text worked on at once

#: Kinds of byte: 0 in words, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2

END = re.compile(rb"[.,;:!?\x0A-\x0D]")
MIX = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- words and hashes of a batch

def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(row numbers, offsets behind the rows, lower-cased bytes) of parts of about ``BATCH`` bytes,
    every row ended by a newline. A longer text comes in several parts that end between pieces."""
    rows, held, size = [], [], 0

    def part() -> tuple[np.ndarray, np.ndarray, bytes]:
        return np.array(rows), np.cumsum([len(x) + 1 for x in held]), b"\n".join(held) + b"\n"

    for row, text in enumerate(texts.to_pylist()):
        raw = (text or "").encode().lower()  # bytes.lower() changes A-Z only
        while raw:
            cut = len(raw)
            if cut > BATCH:
                at = END.search(raw, BATCH)
                cut = at.start() + 1 if at else cut
            if held and size + cut > BATCH:
                yield part()
                rows, held, size = [], [], 0
            rows.append(row)
            held.append(raw[:cut])
            size += cut + 1
            raw = raw[cut:]
    if held:
        yield part()


def words_of(data: bytes) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """Words, their start offsets and the number of their piece."""
    raw = np.frombuffer(data, np.uint8)
    kind = KIND[raw]
    inside = kind == 0
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.flatnonzero(kind == 2)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())])
    return words, starts, np.searchsorted(breaks, starts)


def hashes_of(words: list[bytes], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, seed=seed) for w in words], np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def gram_hash(language: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of language and words (uint64 arrays of one length)."""
    with np.errstate(over="ignore"):
        return reduce(lambda h, w: scramble(h * MIX + w), words, scramble(language))


def probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of a hash in a filter of ``bits`` (a power of two)."""
    with np.errstate(over="ignore"):
        more = scramble(h + MIX)
    return [(x % np.uint64(bits)).astype(np.int64) for x in (h, h >> np.uint64(32), more, more >> np.uint64(32))]


def held(filter_bytes: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = len(filter_bytes) * 8
    return np.logical_and.reduce([(filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in probes(h, bits)]).astype(bool)


def distinct_counts(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns and how often each occurs."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    order = np.argsort(gram_hash(columns[0], columns[1:]), kind="stable")
    sorted_ = [c[order] for c in columns]
    new = np.logical_or.reduce([np.concatenate([[True], c[1:] != c[:-1]]) for c in sorted_])
    at = np.flatnonzero(new)  # equal hashes of different rows only split a count in two
    return [c[at] for c in sorted_], np.diff(np.append(at, len(order)))


# ---------------------------------------------------------------- passes over the texts

def word_columns(k: int) -> list[str]:
    return [f"w{j}" for j in range(1, k + 1)]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def passed(docs: DataFrame, k: int, seed: int, frontier: Broadcast | None, both: bool) -> DataFrame:
    """Partial counts of phrases of k words in ``docs`` (lang, text): (lang, w1..wk, c), and for k = 1
    the column word. ``frontier`` filters phrases of k - 1 words: those counted have their first
    and (``both``) or else their last k - 1 words in it."""
    names = ["lang", *word_columns(k), *(["word"] if k == 1 else []), "c"]
    schema = "lang string, " + ", ".join(f"{w} long" for w in word_columns(k)) + (", word string" if k == 1 else "") + ", c long"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if frontier is None else np.frombuffer(frontier.value, np.uint8)
        for batch in slices(batches, "text", BATCH):
            tongues = batch.column("lang").dictionary_encode()
            of_row = tongues.indices.to_numpy(zero_copy_only=False)
            tongue = hashes_of([t.encode() for t in tongues.dictionary.to_pylist()], seed)
            for rows, ends, data in chunks(batch.column("text")):
                words, starts, piece = words_of(data)
                if len(words) < k:
                    continue
                speech = of_row[rows[np.searchsorted(ends, starts, side="right")]].astype(np.uint64)
                coded = words.dictionary_encode()
                code, entries = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
                hashed = hashes_of(entries, seed)
                if k == 1:
                    (s, c), n = distinct_counts([speech, code.astype(np.uint64)])
                    made = [signed(hashed[c.astype(np.int64)]), pa.array([entries[x].decode() for x in c], pa.string())]
                else:
                    hashed = hashed[code]
                    at = np.flatnonzero(piece[k - 1:] == piece[:len(piece) - k + 1])
                    if marks is not None:
                        m = len(hashed) - k + 2
                        known = held(marks, gram_hash(tongue[speech[:m].astype(np.int64)], [hashed[j:m + j] for j in range(k - 1)]))
                        at = at[known[at] & known[at + 1]] if both else at[known[at] | known[at + 1]]
                    (s, *grams), n = distinct_counts([speech[at], *[hashed[at + j] for j in range(k)]])
                    made = [signed(w) for w in grams]
                if len(n):
                    yield pa.RecordBatch.from_arrays([tongues.dictionary.take(pa.array(s.astype(np.int64))), *made, pa.array(n, pa.int64())], names=names)

    return docs.mapInArrow(counted, schema)


def phrase_counts(docs: DataFrame, k: int, seed: int, nodes: DataFrame, least: int, both: bool = False) -> DataFrame:
    """(lang, w1..wk, f) of phrases with f >= least that extend the written table ``nodes`` of
    phrases of k - 1 words."""
    schema = "lang string, " + ", ".join(f"{w} long" for w in word_columns(k)) + ", f long"
    rows = nodes.count()
    if not rows:
        return nodes.sparkSession.createDataFrame([], schema)
    frontier = frontier_filter(nodes, k - 1, seed, rows)
    total = passed(docs, k, seed, frontier, both).groupBy("lang", *word_columns(k)).agg(F.sum("c").alias("f"))
    counts = written(total.filter(F.col("f") >= least), f"phrases-{k}")
    frontier.unpersist()
    return counts


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, w1, word, f) of all words."""
    total = passed(docs, 1, seed, None, False).groupBy("lang", "w1", "word").agg(F.sum("c").alias("f"))
    return written(total, "phrases-words")


def frontier_filter(nodes: DataFrame, k: int, seed: int, rows: int) -> Broadcast:
    """Bloom filter of the phrases in ``nodes`` (lang, w1..wk). Spark sets the bits; at most
    ``MOST_BITS`` / 64 words of 64 bits come to the driver."""
    nodes = nodes.select("lang", *word_columns(k))
    bits = 1 << 10
    while bits < min(12 * rows, MOST_BITS):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tongues = batch.column("lang").dictionary_encode()
            tongue = hashes_of([t.encode() for t in tongues.dictionary.to_pylist()], seed)
            words = [batch.column(w).to_numpy(zero_copy_only=False).view(np.uint64) for w in word_columns(k)]
            at = np.unique(np.concatenate(probes(gram_hash(tongue[tongues.indices.to_numpy(zero_copy_only=False)], words), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6, pa.int64()), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64), pa.int64())],
                                             names=["at", "bit"])

    set_ = nodes.mapInArrow(places, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    mark = np.zeros(bits // 64, np.int64)
    mark[set_["at"].to_numpy()] = set_["bits"].to_numpy()
    return nodes.sparkSession.sparkContext.broadcast(mark.astype("<i8").tobytes())


# ---------------------------------------------------------------- scores, bounds, survivors

def exact(column: str) -> str:
    return f"cast({column} as decimal(20, 0))"


def ratio(a: str, left: str, right: str) -> F.Column:
    """floor(2000000 a / (left + right)); the product is a decimal, as it may pass 64 bits."""
    return F.expr(f"(cast(2000000 as decimal(7, 0)) * {exact(a)}) div ({exact(left)} + {exact(right)})")


def part(counts: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``counts`` of phrases as (lang, the given word columns, name)."""
    own = word_columns(len(columns))
    return counts.select("lang", *[F.col(o).alias(c) for o, c in zip(own, columns, strict=True)], F.col("f").alias(name))


def scored(phrases: DataFrame, tables: dict[int, DataFrame], k: int) -> DataFrame:
    """``phrases`` of k words whose parts are all known, with l, r and score of the lowest-scoring cut."""
    words = word_columns(k)
    for j in range(1, k):
        phrases = phrases.join(part(tables[j], words[:j], f"l{j}"), ["lang", *words[:j]])
        phrases = phrases.join(part(tables[k - j], words[j:], f"r{j}"), ["lang", *words[j:]])
    cuts = F.array(*[F.struct(ratio("f", f"l{j}", f"r{j}").alias("score"), F.lit(j).alias("k"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r"))
                     for j in range(1, k)])
    phrases = phrases.withColumn("__cut", F.array_min(cuts))
    parts = [f"{side}{j}" for side in "lr" for j in range(1, k)]
    return phrases.withColumns({c: F.col("__cut")[c] for c in ("l", "r", "score")}).drop("__cut", *parts)


def reach(phrases: DataFrame, tables: dict[int, DataFrame], k: int) -> DataFrame:
    """``phrases`` of k words with the larger of their forward and backward bounds."""
    words = word_columns(k)
    both = phrases.join(part(tables[1], words[:1], "first"), ["lang", words[0]]).join(part(tables[1], words[-1:], "last"), ["lang", words[-1]])
    return both.withColumn("reach", F.greatest(ratio("f", "first", "f"), ratio("f", "f", "last"))).drop("first", "last")


def survivors(candidates: DataFrame, longer: DataFrame | None, k: int, share: int) -> DataFrame:
    """``candidates`` of k words that no phrase of ``longer`` (k + 1 words) drops."""
    if longer is None:
        return candidates
    words, more = word_columns(k), word_columns(k + 1)
    ends = [longer.select("lang", *[F.col(m).alias(w) for m, w in zip(side, words, strict=True)], F.col("f").alias("most"))
            for side in (more[:-1], more[1:])]
    most = ends[0].unionByName(ends[1]).groupBy("lang", *words).agg(F.max("most").alias("most"))
    kept = F.expr(f"most is null or 100 * {exact('most')} < {share} * {exact('f')}")
    return candidates.join(most, ["lang", *words], "left").filter(kept).drop("most")


def limits(pairs: DataFrame, rank: int) -> DataFrame:
    """(lang, rows, limit): a language's number of pairs, and the bucket of scores that its pair of
    the given rank lies in (0 when there are fewer). A language has 1000000 / STEP + 1 buckets."""
    steps = pairs.groupBy("lang", F.expr(f"score div {STEP}").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    run = steps.withColumn("above", F.expr("sum(n) over (partition by lang order by step desc)"))
    at = F.max(F.when(F.col("above") >= rank, F.col("step")))
    return run.groupBy("lang").agg(F.sum("n").alias("rows"), (F.coalesce(at, F.lit(0)) * STEP).alias("limit"))


def first_of_each(found: DataFrame, most: int) -> DataFrame:
    """Each language's first ``most`` rows with their rank: the firsts of parts of about 100,000
    rows, then the firsts of those, so no task sorts a language whole."""
    order = [F.col("score").desc(), F.col("f").desc(), F.col("phrase").asc()]

    def ranked(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)

    sizes = found.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).withColumn("__parts", 1 + F.expr("rows div 100000"))
    dealt = join_by_key(found, sizes, "lang", "rows").withColumn("__part", F.expr("pmod(xxhash64(phrase), __parts)"))
    return ranked(ranked(dealt, "lang", "__part"), "lang").drop("__parts", "__part")


def spelled(found: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """``found`` with the words of its hashes as the column phrase."""
    for w in word_columns(longest):
        found = found.join(words.select("lang", F.col("w1").alias(w), F.col("word").alias(f"__{w}")), ["lang", w], "left")
    return found.withColumn("phrase", F.concat_ws(" ", *[f"__{w}" for w in word_columns(longest)]))


def mine(docs: DataFrame, most: int = MOST, least: int = LEAST, longest: int = LONGEST, share: int = SHARE,
         lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases of each language."""
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seed = 0
    words = word_counts(docs, seed)
    while words.groupBy("lang", "w1").count().filter("count > 1").limit(1).count():  # two words with one hash
        seed += 1
        words = word_counts(docs, seed)
    common = words.filter(F.col("f") >= least)
    tables = {1: common.drop("word")}
    tables[2] = phrase_counts(docs, 2, seed, tables[1], least, both=True)
    pairs = written(scored(tables[2], tables, 2).select("lang", "score"), "phrases-pairs")

    spans = word_columns(longest)
    settled, rank, open_ = [], FIRST_WAVE * most, None
    while True:
        wave = limits(pairs, rank)
        wave = wave.withColumn("before", F.lit(1_000_001).cast("long")) if open_ is None else wave.join(open_, "lang")
        wave = written(wave, "phrases-wave")
        for k in range(2, longest):
            nodes = reach(join_by_key(tables[k], wave, "lang", "rows"), tables, k)
            nodes = written(nodes.filter("reach >= limit and reach < before").select("lang", *word_columns(k)), f"phrases-frontier-{k}")
            grown = phrase_counts(docs, k + 1, seed, nodes, least)
            tables[k + 1] = grown if k + 1 not in tables else written(tables[k + 1].union(grown).distinct(), f"phrases-{k + 1}")
        found = []
        for k in range(2, longest + 1):
            likely = scored(join_by_key(tables[k], wave, "lang", "rows"), tables, k).filter("score >= limit")
            kept = survivors(likely, tables.get(k + 1), k, share)
            found.append(kept.select("lang", *[F.col(w) if w in word_columns(k) else F.lit(None).cast("long").alias(w) for w in spans], "f", "l", "r", "score"))
        found = written(reduce(DataFrame.unionByName, found), "phrases-found")
        judged = wave.join(found.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left")
        judged = judged.withColumn("settled", (F.coalesce("kept", F.lit(0)) >= most) | (F.col("limit") == 0))
        judged = written(judged.select("lang", "rows", "limit", "settled"), "phrases-judged")
        settled.append(join_by_key(found, judged.filter("settled").select("lang", "rows"), "lang", "rows"))
        open_ = judged.filter("not settled").select("lang", F.col("limit").alias("before"))
        if not open_.limit(1).count():
            break
        rank *= NEXT_WAVE

    named = written(spelled(reduce(DataFrame.unionByName, settled), common, longest), "phrases-named")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return first_of_each(named, most).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
