"""The registered queries of this subpackage: each applies one operator to its whole table
and derives the columns of its contract. ``ORACLE`` holds the SQL of those that SQL can
express; the others are tested against brute force in ``tests/llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (ann, bpe, fill_in_middle, html_extraction, line_dedup, mixing, phrases, quality_classifier, quality_rules, sharding,
                         simhash, suffix_dedup, toxicity)
from tessera.llm.common import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_path() -> str:
    """The public byte-level tokenizer file of the workers' installation."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digests(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs, words=3, distance=3).select("doc_id", "fingerprint", "component_id")


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return quality_rules.judge(docs, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality_classifier.classify(docs, labels).select("doc_id", "log_perplexity", "lower", "upper", "kept")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    done = suffix_dedup.remove_repeats(docs)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_one_bit_codes")
def op6_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(rows, is_query=F.col("id") % 100 == 0, k=10)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # a null id is never learned from
    scored = toxicity.score(docs, labels, held_out=held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")


@query("op8_feistel_shards")
def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.shard(rows, ["doc_id", "size", "text_crc32"], shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


OP9_SQL = r"""
with docs as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents
), sources as (
  select source, sum(size) as s, row_number() over (order by source is null, source) - 1 as k from docs group by source
), weighed as (
  select *, case k % 3 when 0 then 5.0::double when 1 then 2.0 else 1.0 end as w, 2.0::double * s as cap from sources
), steps as (
  select *, 1.5::double * sum(s) over () as total,
         coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0) as stopped,
         sum(w) over (order by cap / w, k rows between current row and unbounded following) as open_w
  from weighed
), level as (
  select max((total - stopped) / open_w) as l from steps  -- rises until the last source that stops, then falls
), rates as (
  select source, s, case when l is null then cap else least(cap, w * l) end as target from weighed, level
), drawn as (
  select d.doc_id, d.size, r.s as source_size, r.target, case when r.s > 0 then r.target / r.s else 0 end as rate,
         ('0x' || substr(md5(concat_ws(':', '0', d.doc_id)), 1, 8))::ubigint / 4294967296.0::double as u
  from docs d join rates r on d.source is not distinct from r.source
)
select doc_id, size::bigint as size, source_size::bigint as source_size, round(target, 6) as target,
       (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken
from drawn
"""


@query("op9_mixing", OP9_SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = written(docs.select("doc_id", "source", mixing.word_count("text").alias("size")), "op9-sizes")
    mixed = mixing.mix(sized, size="size")
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"),
                        (F.col("size") * F.col("copies")).alias("taken"))


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_extraction.extract(pages).select("page_id", "url", "text", "n_chars")


OP11_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), worded as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces
), grams as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from worded, (values (1), (2), (3), (4)) t(k) where len(ws) >= k
), f as (
  select lang, k, phrase, count(*) as a from grams group by all
), candidates as (
  select *, string_split(phrase, ' ') as ws from f where k >= 2 and a >= 30
), cuts as (
  select c.lang, c.phrase, c.k, c.a, j, l.a as l, r.a as r, (2000000::hugeint * c.a) // (l.a + r.a) as score
  from (select *, unnest(range(1, k)) as j from candidates) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1:c.j], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(c.ws[c.j + 1:], ' ')
), lowest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1
), inside as (
  select lang, phrase, max(a) as most from (
    select lang, a, array_to_string(ws[s:s + m - 1], ' ') as phrase
    from (select *, unnest(range(1, k - m + 2)) as s from (select *, unnest(range(2, k)) as m from candidates)))
  group by lang, phrase
), kept as (
  select c.* from lowest c left join inside i on i.lang = c.lang and i.phrase = c.phrase
  where i.most is null or 100::hugeint * i.most < 80::hugeint * c.a
), totals as (
  select lang, sum(a) as n from f where k = 1 group by lang
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept
)
select r.lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""


@query("op11_phrase_collocations", OP11_SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents", "lang", "text"))


OP12_SQL = r"""
with texts as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), exploded as (
  select doc_id, unnest(range(1, len(ls) + 1)) as position, unnest(ls) as line from texts
), keyed as (
  select doc_id, position, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from exploded
), repeated as (
  select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), judged as (
  select k.*, r.key is not null and k.doc_id <> r.last as gone from keyed k left join repeated r on k.key = r.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by position) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""


@query("op12_line_dedup", OP12_SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
with hashed as (
  select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as h from documents
), drawn as (
  select *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as tokens,
         ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2,
         ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4 from hashed
), placed as (
  select *, len(tokens) as n, least(h1 % (n + 1), h2 % (n + 1))::bigint as c1, greatest(h1 % (n + 1), h2 % (n + 1))::bigint as c2 from drawn
), cut as (
  select *, coalesce(array_to_string(tokens[1:c1], ''), '') as p, coalesce(array_to_string(tokens[c1 + 1:c2], ''), '') as m,
         coalesce(array_to_string(tokens[c2 + 1:], ''), '') as s,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form from placed
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from cut
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    return fill_in_middle.transform(table(spark, sf_dir, "documents", "doc_id", "text"), returns=columns).select("doc_id", *columns)
