"""The corpus pipeline: language ID, near-duplicates, repeated passages, packing. Each stage is written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import language, neardup, packing, suffixes
from sievemill.llm.queries import training_rows
from sievemill.llm.shared import free_name, shared_folder

#: SQL can't express the stages: a fitted model, links between sets, a tokenizer's ids. tests/llm holds them against brute force.
ORACLE_SQL = None


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: those without a letter or a text (null, empty) go. Where no training document has a
    language, all texts with a letter stay. Repeated rows all stay or go; other columns stay as they are, whatever their names. Empty
    table: no rows."""
    model = language.train(training_rows(docs))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # the prediction's columns meet no others
    found = language.identify(plain, model, text=plain.columns[[c.lower() for c in docs.columns].index("text")]).where("lang_pred <> 'und'")
    return found.select(*plain.columns).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest doc_id (one row of those that share its doc_id and text,
    any of them); documents without an id, and texts that are null, empty or blank, stay. Other columns stay as they are, whatever
    their names. Empty table: no rows."""
    kept = neardup.near_duplicates(docs, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    digest = free_name("_text", docs.columns)
    found = docs.join(kept, "doc_id", "left_semi").withColumn(digest, F.sha2("text", 256)).dropDuplicates(["doc_id", digest])
    return found.select(*docs.columns).union(docs.where("doc_id is null"))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with all but the first of each repeated passage (by doc_id, then place) taken out of the text; n_chars follows
    the text. Null and empty texts and null ids stay as they are; so do other columns, whatever their names. Empty table: no rows."""
    return suffixes.with_length(suffixes.without_repeats(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids; a null or empty text is its end alone. Other columns go. Empty table: no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [("language ID", known_languages), ("near-duplicates", one_of_each_group), ("repeated passages", without_repeated_passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{number}")
        docs = spark.read.parquet(f"{at}/{number}")
    return docs
