"""Corpus pipeline: quality rules, toxicity, near-dedup, secret scans and packing, each over all that the last kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import neardup, packing, quality_rules, secrets, toxicity
from llm.stages import table, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; see ``llm.quality_rules``."""
    judged = quality_rules.judged(docs, table(spark, sf_dir, "labels"))
    return judged.where("kept").select("row.*")


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; see ``llm.toxicity``."""
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels"), keep_row=True)
    return scored.where("predicted = 0").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one with the smallest id; see ``llm.neardup``."""
    groups = neardup.near_duplicates(docs)
    return groups.where("chosen").select("row.*", "text").select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their text and ``n_chars`` following it; see ``llm.secrets``."""
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence; see ``llm.packing``."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good),
    ("toxicity", harmless),
    ("near duplicates", distinct),
    ("secret scans", redacted),
    ("best-fit packing", packed),
]

#: The toxicity model can't be expressed in SQL, so every stage is tested against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
