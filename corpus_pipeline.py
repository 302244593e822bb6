"""The corpus pipeline: documents to packed training sequences, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catchment.llm import lines, mixing, neardup, packing, toxicity
from catchment.llm.store import scratch, small_batches, stored

# Stages compute what they decide within shorter batches and return the plan that applies it.

#: No SQL: token log-odds, signatures and packing can't be expressed in it.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The model is learnt from the labels of sf_dir that aren't held out."""
    with small_batches(spark):
        labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
        model = toxicity.fit(docs.select("doc_id", "text"), labels, ~toxicity.held_out())
        return toxicity.drop_toxic(docs, model, 0.7)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 or more documents leave every text. No document goes, even if its text is empty now."""
    with small_batches(spark):
        return lines.without_frequent_lines(docs, threshold=10)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (likeness 0.8) stays, the one with the smallest doc_id."""
    with small_batches(spark):
        return neardup.drop_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: 0 to 3 rows each."""
    with small_batches(spark):
        return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in their sequences; a document that the mix repeats is packed as often."""
    with small_batches(spark):
        return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and reread; the last one's rows, the only table that stays. Batches are shorter meanwhile; the session's own settings return afterwards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark), scratch():
        for name, stage in STAGES:
            with scratch():  # a stage's own tables go once its result is stored, and that at the end
                docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=2 if name == STAGES[-1][0] else 1)
    return docs
