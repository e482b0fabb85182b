"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, license_scan, line_dedup, media_ogg, packing, quality, secret_scan, simhash, toxicity
from .common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.to_hex(F.col("fp")).alias("fingerprint"), "component_id")


#: The chain's categories over the labels, in order: toxic at all, then toxic junk, which only some of the toxic are.
TOXIC = {"toxic": "toxic = 1", "toxic_junk": "toxic = 1 and quality = 0"}


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"), TOXIC))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ogg.stored(read(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digest(chat.render(chat.messages(chat.events_of(rows.unionByName(extra)))))


OP5_SQL = """with t as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256,
  cast(coalesce(sum(length(x)) filter (where r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(x, '' order by turn, r, x) filter (where r = 'assistant'), '')) loss_sha256,
  cast(sum(length(replace(replace(r, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(x, '&', '&amp;'), '<', '&lt;')) + 13) as bigint) formatted_chars
from t group by conv_id"""


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.findings(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    n = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *n, F.sha2(secret_scan.joined_spans(base), 256).alias("base_sha256"), secret_scan.joined_spans(F.col("spans")).alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality.fit(docs, read(spark, sf_dir, "labels"))
    out = quality.judged(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", *(F.col(f"__stats.{c}") for c in quality.BASE), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.kept_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_kept", F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_packing, op4_media_ogg, op5_chat, op6_bpe, op7_license_scan, op8_secret_scan, op9_quality_rules, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat": OP5_SQL, "op7_license_scan": license_scan.oracle()}
