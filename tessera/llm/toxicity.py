"""Toxicity: a linear-chain conditional random field tags toxic tokens; forward-backward
marginals give each document its score and the offsets of the offending spans.

Labels name documents, so tokens are labelled first: features of tokens (the word, its first
four and five letters) that stand almost only in toxic documents, by far more often than chance
allows, tag the tokens of toxic documents; all other tokens are not tagged. They are counted over
all learnable documents. Near-copies would pass for chance-proof evidence, so one document is kept
for each smallest shingle hash.

The field has two states. With odds instead of probabilities both recursions are one number
for each token: r = e (a01 + a11 r') / (a00 + a10 r') forward, and the mirror image backward.
Ends of sentences are tokens that are never toxic, so sentences run side by side as vectors.

Only the field and the score are fitted on a sample, of at most ``MOST_EACH`` documents of either
label by the hash of their texts; its gradients are added up by Spark. A sampled document weighs as many documents
as it stands for, in units of a toxic one, so the shares of the labels are those of all learnable
documents however few are sampled. Every document is scored, whole."""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import sieve, slices, texts_of, with_arrays, with_fields, written

#: Learnable documents of either label fitted on at most.
MOST_EACH = 4_000
#: Hashed features, steps of the fit, parts of the sample, words remembered by a worker.
SIZE, STEPS, PARTS, REMEMBER = 1 << 17, 30, 8, 300_000
#: Bytes of text tagged at once.
AT_ONCE = 2 << 20
#: Standard deviations above chance that a feature needs, and its rate in toxic documents as a share
#: of its rates in both kinds.
SURE, PURE = 6.0, 0.97
#: Weights of the score before it is calibrated.
PLAIN = (-4.0, 2.0, 4.0, 0.0)
TOKENS = re.compile(r"\w+|[.!?\n]")
ENDS = frozenset(".!?\n")
SPANS = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType()),
                                  T.StructField("probability", T.DoubleType())]))


def tell(word: str) -> list[str]:
    """The features that may mark a word as toxic."""
    return ["=" + word] + [word[:n] for n in (4, 5) if len(word) > n]


def hashed(word: str) -> list[int]:
    """The field's features of a word, hashed (repeats add up)."""
    names = ["=" + word, "^" + word[:3], "^" + word[:4], "^" + word[:5], "$" + word[-3:], "$" + word[-4:], f"#{min(len(word), 12)}"]
    return [xxhash.xxh32_intdigest(n) % SIZE for n in names]


class Field:
    """Weights of the features and logarithms of the transition weights 0-1, 1-0, 1-1 (0-0 is 0)."""

    def __init__(self):
        self.weight = np.zeros(SIZE)
        self.step = np.array([-3.0, 0.0, 0.0])
        self.bias = -3.0


def steps_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    return order, lengths[order]


def sequences(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs between ends (odds 0); the first token is an end."""
    stop = odds == 0
    start = np.flatnonzero(~stop[1:] & stop[:-1]) + 1
    end = np.flatnonzero(~stop & np.r_[stop[1:], True])
    return start, end - start + 1


def forward_backward(odds: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward odds and backward odds of each token; ``odds`` begins and ends with an end."""
    a01, a10, a11 = np.exp(step)
    r, b = np.zeros(len(odds)), np.full(len(odds), a10)
    start, length = sequences(odds)
    order, length = steps_of(length)
    first, last = start[order], start[order] + length - 1
    live = len(first)
    for t in range(int(length[0]) if live else 0):
        while live and length[live - 1] <= t:
            live -= 1
        i, j = first[:live] + t, last[:live] - t
        r[i] = odds[i] * (a01 + a11 * r[i - 1]) / (1 + a10 * r[i - 1])
        ahead = odds[j + 1] * b[j + 1]
        b[j] = (a10 + a11 * ahead) / (1 + a01 * ahead)
    return r, b


def marginals(odds: np.ndarray, step: np.ndarray) -> np.ndarray:
    r, b = forward_backward(odds, step)
    return r * b / (1 + r * b)


def weights(totals: dict[int, int]) -> dict[int, float]:
    """Inverse sampling rate of a document of each label, in units of a toxic one's, from the
    learnable documents of each label."""
    inverse = {v: max(totals.get(v, 0) / MOST_EACH, 1.0) for v in (0, 1)}
    return {0: inverse[0] / inverse[1], 1: 1.0}


#: Smallest shingle hashes that two documents must share to count as copies.
MINIMA = 4


def signatures(docs: DataFrame) -> DataFrame:
    """``docs`` (id, hash, text) with the column sign, a hash of the smallest ``MINIMA`` hashes of three-word
    shingles, in place of the text."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField("sign", T.LongType())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            signs = []
            for t in texts_of(batch, "text"):
                words = t.encode("utf-8", "surrogatepass").split()
                hashes = {xxhash.xxh3_64_intdigest(b" ".join(words[k:k + 3])) for k in range(max(len(words) - 2, 1))}
                signs.append(xxhash.xxh3_64_intdigest(repr(sorted(hashes)[:MINIMA]).encode()) >> 1)
            yield with_arrays(batch.drop_columns(["text"]), {"sign": pa.array(signs, pa.int64())})

    return docs.mapInArrow(sketch, schema)


def learnable(docs: DataFrame, labels: DataFrame, key: str, text: str, flag: str, held_out) -> DataFrame:
    """toxic, hash, text of the documents that may be learned from, one for each signature: copies
    and near-copies share theirs, documents that share a passage don't. Documents are chosen by
    id, hash and signature alone; only the texts chosen move, once, behind a sieve."""
    learn = written(labels.filter(F.col(flag).isin(0, 1) & ~held_out).groupBy(F.col(key).alias("id")).agg(F.max(flag).alias("toxic")), "toxic-labels")
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("hash"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    signed = signatures(sieve(texts, learn, ["id"])).join(learn.hint("merge"), "id")
    one = signed.groupBy("toxic", "sign").agg(F.min(F.struct("id", "hash")).alias("of")).select("of.id", "of.hash", "toxic")
    one = written(one, "toxic-chosen")
    found = sieve(texts, one, ["id", "hash"]).join(one.hint("merge"), ["id", "hash"])
    return written(found.groupBy("id", "hash", "toxic").agg(F.first("text").alias("text")).drop("id"), "toxic-learnable")


def sampled(learned: DataFrame) -> DataFrame:
    """toxic, weight, text of the fitted sample. Its hashes are bounded, so they are broadcast."""
    weight = weights(dict(learned.groupBy("toxic").count().collect()))
    few = [learned.filter(F.col("toxic") == v).select("toxic", "hash").orderBy("hash").limit(MOST_EACH).withColumn("weight", F.lit(weight[v]))
           for v in (0, 1)]
    hashes = written(few[0].unionByName(few[1]), "toxic-sample-hashes").dropDuplicates(["toxic", "hash"])
    return written(learned.join(F.broadcast(hashes), ["toxic", "hash"]).select("toxic", "weight", "text")
                   .repartition(PARTS, F.xxhash64("text")), "toxic-sample")


def told(docs: DataFrame) -> DataFrame:
    """feature, bad, fine: in how many toxic and other documents each feature stands."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def counted() -> Iterator[pa.RecordBatch]:
            names = list(found[0].keys() | found[1].keys())
            for at in range(0, len(names), 50_000):
                part = names[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([found[1][n] for n in part], pa.int64()),
                                                  pa.array([found[0][n] for n in part], pa.int64())], names=["feature", "bad", "fine"])
            found[0].clear()
            found[1].clear()

        for batch in slices(batches, "text"):
            for text, toxic in zip(texts_of(batch, "text"), batch.column("toxic").to_pylist()):
                found[toxic].update({f for w in set(TOKENS.findall(lowered(text))) - ENDS for f in tell(w)})
            if len(found[0]) + len(found[1]) > REMEMBER:
                yield from counted()
        yield from counted()

    return docs.select("toxic", "text").mapInArrow(count, "feature string, bad long, fine long").groupBy("feature") \
        .agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))


def lexicon(learned: DataFrame, sample: DataFrame) -> set[str]:
    """The features of the sample that mark tokens as toxic, by their counts over all learnable documents."""
    totals = dict(learned.groupBy("toxic").count().collect())
    bad, fine = totals.get(1, 0), totals.get(0, 0)
    if not bad or not fine:
        return set()
    share = bad / (bad + fine)
    n = F.col("bad") + F.col("fine")
    sure = (F.col("bad") - share * n) / F.sqrt(share * (1 - share) * n) >= SURE
    pure = F.col("bad") / bad >= PURE * (F.col("bad") / bad + F.col("fine") / fine)
    found = told(learned).filter(sure & pure).select("feature")
    return {r[0] for r in found.join(told(sample.filter("toxic = 1")), "feature", "left_semi").collect()}  # bounded by the sample


def lowered(text: str) -> str:
    """Small letters, one for each character, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens_of(text: str) -> list[str]:
    return ["\n", *TOKENS.findall(lowered(text)), "\n"]


def prepare(sample: DataFrame, taken: set[str]) -> DataFrame:
    """One blob for each part of the sample: features of its word types, the tokens' types
    (-1: an end), tags and weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: dict[str, int] = {}
        ids, tags, heavy = [], [], []
        for batch in slices(batches, "text"):
            for text, toxic, weight in zip(texts_of(batch, "text"), batch.column("toxic").to_pylist(), batch.column("weight").to_pylist()):
                tokens = tokens_of(text)
                heavy.append(np.full(len(tokens), weight, np.float32))
                for w in tokens:
                    ids.append(-1 if w in ENDS else types.setdefault(w, len(types)))
                    tags.append(bool(toxic) and w not in ENDS and not taken.isdisjoint(tell(w)))
        if ids:
            blob = pickle.dumps((np.array([hashed(w) for w in types], np.int32).reshape(-1, 7), np.array(ids, np.int32), np.array(tags),
                                 np.concatenate(heavy)))
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

    return written(sample.mapInArrow(run, "blob binary"), "toxic-tokens")


def gradient(blob: bytes, field: Field) -> tuple[np.ndarray, np.ndarray, int]:
    """Gradient of the log likelihood: features and bias, transitions; and the tokens."""
    features, ids, tags, *heavy = pickle.loads(blob)
    weight = heavy[0] if heavy else np.ones(len(ids), np.float32)
    word = ids >= 0
    score = np.clip(field.weight[features].sum(1) + field.bias, -30, 30)
    odds = np.zeros(len(ids))
    odds[word] = np.exp(score[ids[word]])
    r, b = forward_backward(odds, field.step)
    p = r * b / (1 + r * b)
    by_type = np.bincount(ids[word], weights=((tags - p) * weight)[word], minlength=len(features))
    g = np.bincount(features.reshape(-1), weights=np.repeat(by_type, features.shape[1]), minlength=SIZE)
    a01, a10, a11 = np.exp(field.step)
    before, after = r[:-1], odds[1:] * b[1:]
    all_ = 1 + a01 * after + a10 * before + a11 * before * after
    was, now, w = tags[:-1], tags[1:], weight[1:]  # pairs of two documents are pairs of ends, which add nothing
    steps = np.array([(w * ((~was & now) - a01 * after / all_)).sum(), (w * ((was & ~now) - a10 * before / all_)).sum(),
                      (w * ((was & now) - a11 * before * after / all_)).sum()])
    return np.r_[g, by_type.sum()], steps, int(word.sum())


def fit(blobs: DataFrame) -> Field:
    """Adaptive gradient ascent; each step adds up the gradients of the parts."""
    field, spread, steps_spread = Field(), np.full(SIZE + 1, 1e-2), np.full(3, 1e-2)
    for _ in range(STEPS):
        def run(batches: Iterator[pa.RecordBatch], field: Field = field) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    g, s, n = gradient(blob, field)
                    at = np.flatnonzero(g)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((at.astype(np.int32), g[at].astype(np.float32), s, n))],
                                                               pa.binary())], names=["g"])

        g, s = np.zeros(SIZE + 1), np.zeros(3)
        for row in blobs.mapInArrow(run, "g binary").collect():  # one small row for each part
            at, values, steps, _ = pickle.loads(row[0])
            g[at] += values
            s += steps
        g -= 0.05 * np.r_[field.weight, 0.0]  # a normal prior
        spread += g * g
        steps_spread += s * s
        moved = 0.7 * g / np.sqrt(spread)
        fresh = Field()
        fresh.weight, fresh.bias = field.weight + moved[:-1], field.bias + moved[-1]
        fresh.step = np.clip(field.step + 0.5 * s / np.sqrt(steps_spread), -12, 12)
        field = fresh
    return field


class Odds(dict):
    """Odds of each word met so far."""

    def __init__(self, field: Field):
        super().__init__({w: 0.0 for w in ENDS})
        self.field = field

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBER:
            self.clear()
            self.update({w: 0.0 for w in ENDS})
        score = self.field.weight[hashed(word)].sum() + self.field.bias
        value = self[word] = float(np.exp(min(max(score, -30.0), 30.0)))
        return value


#: Kind of each code point: 1 in words (``\\w``), 2 an end, 0 neither.
class Kinds:
    table: np.ndarray | None = None

    @classmethod
    def of(cls, code: np.ndarray) -> np.ndarray:
        if cls.table is None:
            every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
            cls.table = np.zeros(0x110000, np.uint8)
            for m in re.finditer(r"\w+", every):
                cls.table[m.start():m.end()] = 1
            cls.table[[ord(c) for c in ENDS]] = 2
        return cls.table[code]


def located(texts: list[str]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts as by ``tokens_of``, as UTF-32 bytes: the tokens, their start and end in
    the joined texts, the first token of each text, and where each text starts."""
    code = np.frombuffer("".join(f"\n{lowered(t)}\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = Kinds.of(code)
    word = kind == 1
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    stop = np.flatnonzero(kind == 2)
    start, end = np.concatenate([np.flatnonzero(edge == 1), stop]), np.concatenate([np.flatnonzero(edge == -1), stop + 1])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(4 * (end - start), out=offsets[1:])
    tokens = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(code[kind > 0].tobytes())])
    size = np.array([len(t) + 2 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    return tokens, start, end, np.searchsorted(start, begin), begin


def tag(df: DataFrame, field: Field, text: str = "text", spans: str = "spans") -> DataFrame:
    """Append __sum and __max of the tokens' toxic probabilities, __tokens and ``spans``: the tokens of
    probability 0.5 or more, from and to in characters of the text."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Odds(shared.value)
        for batch in slices(batches, text, AT_ONCE):
            texts = texts_of(batch, text)
            tokens, start, end, first, begin = located(texts)
            coded = tokens.dictionary_encode()
            odds = np.array([known[w.decode("utf-32-le", "surrogatepass")] for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy(zero_copy_only=False)]
            p = marginals(odds, known.field.step)
            total, most = np.add.reduceat(p, first), np.maximum.reduceat(p, first)
            found = [[] for _ in texts]
            for i in np.flatnonzero(p >= 0.5).tolist():
                k = int(np.searchsorted(first, i, side="right")) - 1
                found[k].append({"from": int(start[i] - begin[k]) - 1, "to": int(end[i] - begin[k]) - 1, "probability": float(p[i])})
            yield with_arrays(batch, {"__sum": pa.array(total), "__max": pa.array(most),
                                      "__tokens": pa.array(np.diff(np.append(first, len(start))).astype(np.int64)), spans: pa.array(found, kind)})

    fields = [T.StructField("__sum", T.DoubleType()), T.StructField("__max", T.DoubleType()), T.StructField("__tokens", T.LongType()),
              T.StructField(spans, SPANS)]
    return df.mapInArrow(run, with_fields(df.schema, fields))


def calibrate(scored: list, steps: int = 3000) -> np.ndarray:
    """Logistic weights (constant, log of one plus the sum, maximum, log of one plus the tokens)
    on the sample's documents, weighted."""
    x = np.array([[1.0, np.log1p(r["__sum"]), r["__max"], np.log1p(r["__tokens"])] for r in scored])
    y = np.array([float(r["toxic"]) for r in scored])
    share = np.array([r["weight"] for r in scored])
    share /= share.sum()
    w = np.array(PLAIN)
    for _ in range(steps):  # Newton steps would diverge where the labels separate; a prior keeps w finite
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 0.2 * (x.T @ (share * (y - p)) - 1e-4 * w)
    return w


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", flag: str = "toxic", held_out=None) -> DataFrame:
    """``docs`` without its text, with score (0 to 1), predicted (1 if the score is at least 0.5)
    and spans (from, to, probability of each offending token).

    ``held_out`` chooses label rows that are never learned from. Null and empty texts have no
    tokens and get the score of a document without toxic tokens; null ids and labels are not
    learned from; of labels that repeat an id the largest counts; repeated rows are scored alike;
    an empty table stays empty; without labels of both kinds every token keeps the initial
    weights; columns named like a result are replaced."""
    held_out = F.lit(False) if held_out is None else held_out
    docs = docs.drop("score", "predicted", "spans")
    learned = learnable(docs, labels.filter(F.col(key).isNotNull()), key, text, flag, held_out)
    sample = sampled(learned)
    field = fit(prepare(sample, lexicon(learned, sample)))
    known = tag(sample, field).select("toxic", "weight", "__sum", "__max", "__tokens").collect()  # bounded by the sample
    w = [float(v) for v in (calibrate(known) if known else PLAIN)]
    tagged = tag(docs, field, text).drop(text)
    x = F.lit(w[0]) + w[1] * F.log1p("__sum") + w[2] * F.col("__max") + w[3] * F.log1p("__tokens")
    scored = tagged.withColumn("score", 1 / (1 + F.exp(-x))).drop("__sum", "__max", "__tokens")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
