"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.llm import langid, linecrf, packing, secrets, setjoin
from dockflow.llm.shared import prepared, probably_in, stage, table

LEAST_POSTERIOR = 0.5  # of a language, to keep a document
OTHER_BITS = 24  # size of the bitmap of ids that don't stay once (2 MB), whatever the input


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found; learned from those with a language, one quarter held out as in the operator's query."""
    prepared(spark)
    learn = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2).select("doc_id", "lang")
    return langid.keep_known(docs, langid.train(docs, learn, public_tokenizers.path("piece_bpe_32k.model")), LEAST_POSTERIOR)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and are content by their lines' labels."""
    return linecrf.keep_good(docs, linecrf.train(docs, table(spark, sf_dir, "labels")))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: that with the smallest id, once. Documents without an id all stay.

    Of several rows with that id the smallest by content stays, whatever their order: the least of all columns, from left to right.
    Texts of ids that stay once aren't shuffled: a bitmap holds the other ids, and a join decides on the few texts whose bit is set.
    """
    prepared(spark)
    counts = setjoin.similar_classes(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("k"))
    other = stage(counts.where("k <> 1"), "pipeline-other")
    asked = probably_in(F.col("doc_id"), other, "doc_id", OTHER_BITS)
    once = docs.where(asked).join(other, "doc_id", "left_anti").select(*docs.columns)
    several = docs.where(asked).join(other.where("k > 1"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return docs.where(~asked).unionByName(once).unionByName(several)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every found secret by a mark; the number of characters follows."""
    clean = secrets.redact(docs, secrets.model_of(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' words into the permitted lengths."""
    return packing.best_fit(packing.word_lengths(docs))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("ngram_join", ngram_join), ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]

ORACLE_SQL = None  # trained models and packing aren't SQL; tests/llm compares the stages with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
