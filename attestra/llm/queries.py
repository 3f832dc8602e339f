"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attestra.llm import near_dedup, quality, substring_dedup, toxicity
from attestra.llm.byte_bpe import byte_bpe
from attestra.llm.common import Workspace
from attestra.llm.exact_dedup import ExactDedup
from attestra.llm.html_text import html_text
from attestra.llm.line_dedup import line_dedup
from attestra.llm.media_ogg import texts_as_ogg
from attestra.llm.packing import pack


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(Workspace(spark, "near"), _table(spark, sf_dir, "documents")).drop("h")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(Workspace(spark, "lines"), _table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ExactDedup(Workspace(spark, "exact"), keep="max").decisions(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(Workspace(spark, "packing"), _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(_table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(Workspace(spark, "quality"), docs, _table(spark, sf_dir, "labels"))
    return quality.quality(docs, model)


def op7_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts_as_ogg(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(Workspace(spark, "substring"), _table(spark, sf_dir, "documents")).drop("h")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(Workspace(spark, "toxicity"), docs, _table(spark, sf_dir, "labels")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_line_dedup, op3_exact_dedup, op4_best_fit_packing, op5_html_extraction, op6_quality_classifier, op7_media_ogg, op8_substring_dedup, op9_toxicity, op10_byte_bpe)}

ORACLE_SQL = {
    "op2_line_dedup": r"""
with rows_ as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
lines as (select rid, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from rows_),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
frequent as (select k, max(doc_id) as top from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select rid, keyed.doc_id, line, pos, frequent.k is not null and keyed.doc_id <> frequent.top as gone from keyed left join frequent using (k))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by rid, doc_id
""",
    "op3_exact_dedup": r"""
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from documents),
g as (select doc_id, k, max(doc_id) over (partition by k) as keep_id, count(*) over (partition by k) as group_size,
             row_number() over (partition by k, doc_id) as copy from n)
select doc_id, keep_id, group_size, doc_id = keep_id and copy = 1 as kept, sha256(k) as text_sha256 from g
""",
}
