"""A training corpus from documents: five stages, each over everything its predecessor kept.

Toxic documents go; of each group of near duplicates (5-word
shingles, similarity of 0.8 or more) one stays; documents that
contain benchmark passages go; sources are mixed to their target weights (a row
per copy that is taken); the rest becomes a token-id file set, whose digest, read
back from the files, is the result.  All stages but the last return the columns
of ``documents``; each result is written and read again before the next stage.

Edge cases: a null text counts as empty, is not toxic by itself and has no words;
texts without words are near duplicates of one another, so one of them stays (the
mix, whose rates it cannot change, takes it as often as the whole part of its
source's rate).  Of equal rows one stays.  Null ids, sources
and languages are values of their own.  Without labels no document is toxic, without
benchmark items none is contaminated, without documents the result is empty.  Extra
columns pass through the stages, whatever their names; the digest has its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orthoplex.llm import decontaminate, mixing, neardup, storage, tokenfile, toxicity

END_ID = 2


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    storage.reachable(spark)
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, width=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), mode="documents")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = storage.fresh_path(spark, "token-files")
    tokenfile.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=END_ID)
    return tokenfile.read_tokens(spark, path, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token_files", token_files),
]

#: A trained classifier, components of near duplicates, seeded rounding and Huffman files are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage.reachable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = storage.stored(docs, name)
    return docs
