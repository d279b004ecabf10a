"""Fill-in-the-middle transformation over a piece table.

A document is a list of descriptors ``(buffer, start, length)`` over two immutable buffers:
its own text (code points) and the sentinels ``<P><S><M>``. Cutting splits the one descriptor
of the text at two token boundaries; an arrangement permutes the three parts and puts a
sentinel's descriptor before each; the inverse permutation of the descriptors read back from
an output restores the text; hashes take the descriptors one after another, in slices. No text
is copied until an output is asked for.

Tokens are ``[A-Za-z]+|[^A-Za-z]``; where the cuts fall and which form a document takes follow
from the sha256 of ``<seed>:<doc_id>`` alone. A text that is empty or holds a sentinel stays
plain, so an output is never ambiguous: no sentinel can arise across the edge of a text and a
sentinel, as a sentinel starts with ``<`` and ends with ``>``.

Every document is treated where it lies (no shuffle), one text at a time, whole.

Edge cases: null text counts as empty (plain, empty output); a null id is hashed as the empty
string; repeated rows get equal results; one token and very long texts are cut like any other;
an empty table stays empty; result columns replace columns of the same name."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import slices, texts_of, with_arrays, with_fields

#: Buffers of a piece table, and the sentinels' places in theirs.
TEXT, SENTINELS = 0, 1
SENTINEL_TEXT = "<P><S><M>"
P, S, M = ((SENTINELS, 3 * k, 3) for k in range(3))
MARK = re.compile("<[PSM]>")

#: Order of prefix (0), middle (1) and suffix (2) in an output, each after its sentinel.
ARRANGEMENTS = {"psm": ((P, 0), (S, 2), (M, 1)), "spm": ((S, 2), (P, 0), (M, 1))}

PLAIN_FROM = 90   # percent: documents from here on stay plain
SPM_BELOW = 20    # percent of the others that put the suffix first
SLICE = 1 << 20   # code points hashed or joined at once

Descriptor = tuple[int, int, int]


def token_starts(text: str) -> np.ndarray:
    """Code point offsets at which the tokens ``[A-Za-z]+|[^A-Za-z]`` start."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
    inside = np.zeros(len(code), bool)
    inside[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def draws(key: str, seed: str = "1") -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]


def split(pieces: list[Descriptor], at: int) -> list[Descriptor]:
    """The descriptors with a boundary ``at`` code points from their start; nothing is copied."""
    out = []
    for buffer, start, length in pieces:
        if 0 <= at <= length:
            out += [(buffer, start, at), (buffer, start + at, length - at)]
            at = -1  # done
        else:
            out.append((buffer, start, length))
            at -= length if at > length else 0
    return out


def cut(text: str, h: list[int]) -> tuple[int, list[Descriptor]]:
    """Number of tokens, and the descriptors of prefix, middle and suffix."""
    starts = token_starts(text)
    n = len(starts)
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(starts[k]) if k < n else len(text) for k in (first, second))
    prefix, rest = split([(TEXT, 0, len(text))], a)
    return n, [prefix, *split([rest], b - a)]


def form_of(text: str, h: list[int], plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> str:
    if not text or MARK.search(text) or h[2] % 100 >= plain_from:
        return "plain"
    return "spm" if h[3] % 100 < spm_below else "psm"


def arrange(parts: list[Descriptor], form: str) -> list[Descriptor]:
    """Descriptors of the output: the parts permuted, each after its sentinel."""
    if form == "plain":
        return list(parts)
    return [d for mark, part in ARRANGEMENTS[form] for d in (mark, parts[part])]


def inverse(output: str, form: str) -> list[Descriptor]:
    """Descriptors over ``output`` that spell the text it was made of: the sentinels are found,
    the parts between them are put back by the inverse permutation."""
    if form == "plain":
        return [(TEXT, 0, len(output))]
    ends = [m.end() for m in MARK.finditer(output)]
    stops = [e - 3 for e in ends[1:]] + [len(output)]
    placed = {part: (TEXT, a, b - a) for (_, part), a, b in zip(ARRANGEMENTS[form], ends, stops, strict=True)}
    return [placed[k] for k in range(3)]


def stream(pieces: list[Descriptor], text: str) -> Iterator[str]:
    """The descriptors' code points, in slices."""
    for buffer, start, length in pieces:
        source = text if buffer == TEXT else SENTINEL_TEXT
        for at in range(start, start + length, SLICE):
            yield source[at:min(at + SLICE, start + length)]


def spell(pieces: list[Descriptor], text: str) -> str:
    return "".join(stream(pieces, text))


def sha256(pieces: list[Descriptor], text: str) -> str:
    h = hashlib.sha256()
    for part in stream(pieces, text):
        h.update(part.encode())
    return h.hexdigest()


PIECE = T.ArrayType(T.StructType([T.StructField("buffer", T.IntegerType()), T.StructField("start", T.LongType()),
                                  T.StructField("length", T.LongType())]))
FIELDS = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(),
          "pieces": PIECE, "output": T.StringType(), "output_sha256": T.StringType(), "restored_sha256": T.StringType()}
ARROW = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
         "pieces": pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])),
         "output": pa.string(), "output_sha256": pa.string(), "restored_sha256": pa.string()}


def transform(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: str = "1", plain_from: int = PLAIN_FROM,
              spm_below: int = SPM_BELOW, returns: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output")) -> DataFrame:
    """``docs`` with the columns named in ``returns``: n (tokens), form (plain, psm, spm),
    prefix_chars and middle_chars (null if plain), pieces (the output's descriptors; buffer 0 is
    the text, 1 the sentinels), output (the text to train on), output_sha256, and
    restored_sha256 (of the text rebuilt from output and form)."""
    wanted = [c for c in FIELDS if c in returns]
    spells = {"output", "restored_sha256"} & set(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out: dict[str, list] = {c: [] for c in FIELDS}
            keys = batch.column(id).to_pylist()
            for key, whole in zip(keys, texts_of(batch, text), strict=True):
                h = draws("" if key is None else str(key), seed)
                form = form_of(whole, h, plain_from, spm_below)
                n, parts = cut(whole, h)
                pieces = arrange(parts, form)
                output = spell(pieces, whole) if spells else ""
                out["n"].append(n)
                out["form"].append(form)
                out["prefix_chars"].append(None if form == "plain" else parts[0][2])
                out["middle_chars"].append(None if form == "plain" else parts[1][2])
                if "pieces" in wanted:
                    out["pieces"].append([dict(zip(("buffer", "start", "length"), d, strict=True)) for d in pieces])
                if "output" in wanted:
                    out["output"].append(output)
                if "output_sha256" in wanted:
                    out["output_sha256"].append(sha256(pieces, whole))
                if "restored_sha256" in wanted:
                    out["restored_sha256"].append(sha256(inverse(output, form), output))
            yield with_arrays(batch, {c: pa.array(out[c], ARROW[c]) for c in wanted})

    return docs.mapInArrow(rows, with_fields(docs.schema, [T.StructField(c, FIELDS[c]) for c in wanted]))


def restore(rows: DataFrame, output: str = "output", form: str = "form", out: str = "text") -> DataFrame:
    """``rows`` with the texts rebuilt from their outputs and forms (nulls stay null)."""
    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, output):
            made = [None if o is None or f is None else spell(inverse(o, f), o)
                    for o, f in zip(batch.column(output).to_pylist(), batch.column(form).to_pylist(), strict=True)]
            yield with_arrays(batch, {out: pa.array(made, pa.string())})

    return rows.mapInArrow(rebuilt, with_fields(rows.schema, [T.StructField(out, T.StringType())]))
