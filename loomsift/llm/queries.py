"""Queries over the training-data tables, one for each operator, and the SQL that some can be checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact, htmlmodel, langid, linedup, minhash, mixing, quality, warc
from .session import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines of all documents: how many lines each loses and what is left."""
    out = linedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_cut", "chars_before", "chars_after", F.sha2("text", 256).alias("text_sha256"), (F.col("n_cut") > 0).alias("changed"))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs, ~F.coalesce(langid.held_out(), F.lit(False))))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.conversation_records(table(spark, sf_dir, "conversations"))
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_variant_object(F.struct(F.lit(said).alias("prompt"), F.lit(said).alias("response"))).alias("record"))
    return chat.digest(chat.format_records(rows.unionByName(own)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmodel.extract_text(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc_index": op2_warc_index,
    "op3_language_id": op3_language_id,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality": op7_quality,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_mixing": op10_mixing,
}
SQL: dict[str, str] = {
    "op1_line_dedup": linedup.SQL,
    "op2_warc_index": warc.SQL,
    "op4_chat_formatting": chat.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op6_exact_dedup": exact.SQL,
    "op8_minhash_near_dedup": minhash.SQL,
}
