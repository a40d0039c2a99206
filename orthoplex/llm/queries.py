"""Queries over the text tables and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoplex.llm import decontaminate, htmltext, langid, linedup, mixing, quality, simhash, storage, tokencount, tokenfile, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    storage.reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark")))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), keep=["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.digest(quality.judge(docs, _table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.digest(htmltext.main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.digest(linedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.digest(langid.identify(docs.select("doc_id", "text"), docs))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.fresh_path(spark, "token-files")
    tokenfile.write_tokens(_table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), end_id=2)
    return tokenfile.read_tokens(spark, path, with_ids=False)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(toxicity.score(docs, _table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.plan(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontaminate.ORACLE_SQL}
