"""BPE, sharding and mixing against the tokenizers library, arithmetic and SQL."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import bpe, mixing, queries, sharding  # noqa: E402


def odd_texts():
    rng = random.Random(7)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x300, 0x370), 0x2028, 0x3000, 0x1F600, 0x4E00, 0xFFFD, 0x85, 0xA0, 0x200B]]
    out = [None, "", " ", "\n", "a", "  two  spaces ", "it's we'll I'D", "x<|endoftext|>y<|endoftext|>", "a" * 5000, "ab" * 3000,
           "1234567", "é" * 10, "tab\t\tend  \n\n x", "word " * 20_000, "\x1c\x1d a\x1f b"]
    out += ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(600)]
    return out


def test_bpe_equals_library(spark):
    path = queries.tokenizer_path()
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(0, None, 5)], "doc_id long, text string, token_ids int")
    got = {r.doc_id: r for r in bpe.digests(df, path).collect()}
    t = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids), (i, text)
        assert got[i].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), (i, text)
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe.digests(df.limit(0), path).count() == 0
    voc = bpe.vocabulary(path)
    for ids in ([200, 5], [50256], [999_999, 13], [230, 187]):
        assert voc.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_encode_and_decode_round_trip(spark):
    path = queries.tokenizer_path()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts()[:80])] + [(0, None)], "doc_id long, text string")
    coded = bpe.encode(df, path)
    for r in bpe.decode(coded, path).collect():
        assert r.decoded == (r.text or "") and r.token_ids is not None
    odd = spark.createDataFrame([(None,), ([],), ([464, None, 999_999],)], "token_ids array<int>")
    assert sorted(r.decoded for r in bpe.decode(odd, path).collect()) == ["", "", "The"]
    assert bpe.decode(bpe.encode(df.limit(0), path), path).count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 5, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 3)
        assert sorted(p) == list(range(n))
        assert (sharding.unpermute(p, n, 3) == np.arange(n)).all()
    assert (sharding.permute(np.arange(1000), 1000, 3) != sharding.permute(np.arange(1000), 1000, 4)).any()


def test_shards(spark):
    rows = [(i % 97, f"t{i % 13}", 1) for i in range(500)] + [(None, None, 2)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    a = sharding.shard(df.repartition(5), ["doc_id", "text"], 8).collect()
    b = sharding.shard(df.repartition(3, "text"), ["doc_id", "text"], 8).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "", r.shard, r.slot)
    assert sorted(map(key, a)) == sorted(map(key, b))
    places = {(r.shard, r.slot) for r in a}
    assert len(places) == len(rows)
    counts = [sum(s == k for s, _ in places) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    for k in range(8):
        assert sorted(x for s, x in places if s == k) == list(range(counts[k]))
    assert sharding.shard(df.limit(0), ["doc_id"], 8).count() == 0


def test_mixing_edges(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "d", None), (3, "d", None), (4, "", "y"), (5, "e " * 1000, "z")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[4].target == 0 and by[4].copies == 0
    assert by[1].target == 6 and by[1].copies == 2
    assert by[3].target == 4 and by[5].target == 1.5 * 1005 - 6 - 4
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.repeated(mixing.mix(df), ["doc_id"]).count() == sum(r.copies for r in got)


def test_mixing_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE["op9_mixing"]).fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["op9_mixing"](spark, sf).collect())
    assert got == want
    total, taken = sum(r[1] for r in got), sum(r[4] for r in got)
    assert abs(taken - 1.5 * total) < 0.05 * total
