"""Byte-level BPE encoding and decoding.

Encoding keeps the symbols of a piece in a doubly linked list and a priority queue of
merge ranks; an entry whose symbols have changed since it was queued is stale and is
skipped when it comes up. A piece of n symbols so costs O(n log n), however long. Decoding
concatenates the byte strings of the vocabulary.

Documents are independent: each task reads its own, no shuffle. Pieces that were encoded
before are looked up in a table of bounded size in the worker (it only saves time)."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import slices, texts_of, with_arrays, with_fields

#: Fixed value: the published pattern that cuts a text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers newly before it lets the older half go; the longest it remembers.
REMEMBER, LONGEST = 150_000, 64
#: Texts of characters below this one are cut by the standard library's engine, which is faster.
NARROW = 0x250


def narrow_pieces() -> re.Pattern:
    """``PIECES`` for texts of characters below ``NARROW``, their classes spelled out."""
    letter, digit, blank = ("".join(re.escape(chr(c)) for c in range(NARROW) if regex.fullmatch(kind, chr(c)))
                            for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{digit}]+| ?[^{blank}{letter}{digit}]+"
                      rf"|[{blank}]+(?![^{blank}])|[{blank}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary strings: a byte of the
    printable Latin-1 ranges is its own character, the others follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merge ranks and strings of one tokenizer file (``tokenizers`` JSON, byte level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"]]
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") \
                or not cut.get("use_regex", True) or spec.get("normalizer") or odd:
            raise ValueError(f"{path}: only plain byte-level BPE files are read")
        ids = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [ids[c] for c in letters]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = {**{i: s for s, i in ids.items()}, **{i: s for s, i in self.special.items()}}
        self.strings = {i: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
                        for i, s in known.items()}
        self.pieces, self.narrow_pieces = regex.compile(PIECES), narrow_pieces()
        self.narrow = re.compile(f"[\0-{chr(NARROW - 1)}]*")
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        symbol = [self.first[b] for b in piece]
        n, merges = len(symbol), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := merges.get((symbol[i], symbol[i + 1])):
                queue.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # stale: one of the two has been merged meanwhile
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((new, symbol[k])):
                    heapq.heappush(queue, (found[0], i, new, symbol[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((symbol[h], new))):
                heapq.heappush(queue, (found[0], h, symbol[h], new, found[1]))
        return [s for s in symbol if s >= 0]

    def piece_ids(self, piece: str) -> bytes:
        ids = self.older.get(piece) or np.asarray(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self.known) >= REMEMBER:
                self.known, self.older = {}, self.known
            self.known[piece] = ids
        return ids

    def plain(self, text: str) -> bytes:
        cut = self.narrow_pieces if self.narrow.fullmatch(text) else self.pieces
        out = []
        for piece in cut.findall(text):
            ids = self.known.get(piece)
            out.append(ids if ids is not None else self.piece_ids(piece))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. The strings of added tokens in a
        text are those tokens."""
        if not any(mark in text for mark in self.special):
            return self.plain(text)
        return b"".join(np.asarray([self.special[t]], "<u4").tobytes() if i % 2 else self.plain(t)
                        for i, t in enumerate(self.marks.split(text)))

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings concatenated; unknown ids have none."""
        try:
            raw = b"".join(map(self.strings.__getitem__, ids))
        except KeyError:
            raw = b"".join(self.strings.get(i, b"") for i in ids)
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each worker."""
    return Vocabulary(path)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Append ``out``: array<int> of the ids of each whole text by the tokenizer file ``path``
    (it must exist on every worker). Null and empty texts give an empty array; other columns
    are kept, one named ``out`` is replaced; repeated rows stay; an empty table stays empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in slices(batches, text):
            parts = [voc.encode(t) for t in texts_of(batch, text)]
            ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
            flat = np.frombuffer(b"".join(parts), "<i4")
            yield with_arrays(batch, {out: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return df.mapInArrow(run, with_fields(df.schema, [T.StructField(out, T.ArrayType(T.IntegerType()))]))


def id_lists(column: pa.ListArray) -> Iterator[list[int]]:
    """Each row's ids; a null row and null ids have none."""
    for at in range(len(column)):
        row = column[at].values
        if row is None:
            yield []
        else:
            yield (row if not row.null_count else row.drop_null()).to_numpy().tolist()


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Append ``out``: the text of each array of ids. A null array gives the empty text, null or
    unknown ids give nothing, bytes that are no UTF-8 become U+FFFD."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in slices(batches, ids):
            texts = [voc.decode(r) for r in id_lists(batch.column(ids))]
            yield with_arrays(batch, {out: pa.array(texts, pa.string())})

    return df.mapInArrow(run, with_fields(df.schema, [T.StructField(out, T.StringType())]))


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df``'s columns but ``text``, with n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (of the text decoded from the ids), both in
    lowercase hex. Encoding and decoding run in one pass: one worker process for each task."""
    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    rest = with_fields(df.drop(text).schema, [T.StructField(n, k) for n, k in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in slices(batches, text):
            sizes, ids, decoded = [], [], []
            for t in texts_of(batch, text):
                coded = voc.encode(t)
                sizes.append(len(coded) // 4)
                ids.append(hashlib.sha256(coded).hexdigest())
                decoded.append(hashlib.sha256(voc.decode(np.frombuffer(coded, "<u4").tolist()).encode()).hexdigest())
            yield with_arrays(batch, {"n_tokens": pa.array(sizes, pa.int64()), "ids_sha256": pa.array(ids, pa.string()),
                                      "decoded_sha256": pa.array(decoded, pa.string())}).select(rest.names)

    return df.mapInArrow(run, rest)
