"""Corpus pipeline: quality, near-dedup, substring dedup, decontamination, mixing.

Each stage takes the documents its predecessor kept; run() writes each stage's
rows to the shared folder and reads them again.

Nulls in any column, empty and very long texts, repeated rows and ids are handled as
the stages' operators say; rows are told apart by id and text, of rows alike in both
one stays. Extra columns are carried along, whatever their names, but for the four
that the mix adds. Empty tables give an empty result; without labels the classifier,
without benchmark items the decontamination keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.llm import decontaminate, mixing, quality, simhash, substring
from spanweave.llm.common import BATCH_BYTES, join_by_key, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    said = quality.classify(docs, table(spark, sf_dir, "labels"))
    rejected = written(said.where(~F.col("kept")).select("did", "tk").distinct(), "rejected")
    return join_by_key(docs, rejected, "left_anti")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    return simhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated words are cut out; a document that loses all its words goes."""
    own = {c: f"in{i}" for i, c in enumerate(docs.columns)}  # no column of the input clashes with a result
    done = substring.substring_dedup(docs.withColumnsRenamed(own), own["doc_id"], own["text"]).where("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return done.select(*[(F.when(changed, new[c]).otherwise(F.col(x)) if c in new else F.col(x)).alias(c) for c, x in own.items()])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix of sources."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, BATCH_BYTES)
    return docs
