"""The queries opN_<name> and pipeline, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, line_dedup, pii, quality, sentencepiece_codec, sharding, simhash, suffix_dedup, token_output

KEY = 20240229
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_documents(spark, sf_dir), policy="frequent", min_docs=10, min_key_chars=1)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "distance", "first_word", "last_word")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(_documents(spark, sf_dir), length=400)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir)).drop("tag")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(RANKS, "rb") as f:
        ranks = f.read()
    return token_output.record_digests(_documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, KEY)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.token_digests(_documents(spark, sf_dir), sentencepiece_codec.load_model(PIECES))


def op10_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(_documents(spark, sf_dir), n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_decontamination, op3_suffix_dedup, op4_quality_rules, op5_token_output, op6_simhash, op7_pii, op8_html_extraction, op9_sentencepiece, op10_hilbert_sharding, pipeline)
}

_BLANKS = r"[\x20\x09-\x0D]"

SQL = {
    "op1_line_dedup": r"""
with lines as (
  select d.doc_id, u.pos, u.line,
         translate(trim(u.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents) d,
       unnest(range(len(d.ls))) as r(i), lateral (select r.i as pos, d.ls[r.i + 1] as line) u
), gone as (select key from lines where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(g.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where g.key is null), '')) as kept_sha256
from lines left join gone g using (key) group by doc_id""",
    "op4_quality_rules": r"""
with d as (select doc_id, coalesce(text, '') as text, source from documents),
w as (select doc_id, text, source, list_filter(regexp_split_to_array(text, 'BLANKS+'), lambda x: x <> '') as w from d),
grams as (select doc_id, i, list_aggregate(w[i + 1:i + 5], 'string_agg', chr(1)) as g from w, unnest(range(len(w) - 4)) as r(i) where len(w) >= 5),
twice as (select doc_id, g from grams group by doc_id, g having count(*) > 1),
rep as (select doc_id, count(distinct i + k) as n from grams join twice using (doc_id, g), unnest(range(5)) as o(k) group by doc_id),
lines as (select doc_id, source, pos, line, trim(regexp_replace(lower(line), 'BLANKS+', ' ', 'g')) as norm
          from (select doc_id, source, unnest(range(len(ls))) as pos, unnest(ls) as line from (select doc_id, source, string_split(text, chr(10)) as ls from d))),
worded as (select * from lines where norm <> ''),
above as (select source, norm from worded group by source, norm having count(distinct doc_id) > 10),
gone as (select doc_id, count(*) as lines, sum(len(string_split(worded.norm, ' '))) as words from worded join above on worded.source is not distinct from above.source and worded.norm = above.norm group by doc_id),
dup as (select doc_id, count(*) - count(distinct line) as n from worded group by doc_id),
s as (select w.doc_id, len(w.w) as n_words, length(coalesce(array_to_string(w.w, ''), '')) as word_chars,
             length(w.text) - length(translate(w.text, '#*$%&|<>', '')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines,
             coalesce(rep.n, 0) as n_repeat_words, coalesce(gone.lines, 0) as n_removed_lines, cast(coalesce(gone.words, 0) as bigint) as n_removed_words
      from w left join rep using (doc_id) left join dup using (doc_id) left join gone using (doc_id))
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * (n_words - n_removed_words) >= 30 * n_words as kept
from s""".replace("BLANKS", _BLANKS),
}
