"""The table of saved visits: partitioned by month, appended to, exported as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitgauge.sources.survey import read_or_fail

PARTITION = "visit_month"
TIMESTAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX",
              "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}


def _or_now(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.current_timestamp()) if name in df.columns else (
        F.current_timestamp()
    )


def visit_documents(scored: DataFrame) -> DataFrame:
    """Scored visits ready to be saved: identifier, save times and partition filled in."""
    named = scored.withColumns(
        {"created_at": _or_now(scored, "created_at"), "timestamp": _or_now(scored, "timestamp")}
    )
    if "visit_id" not in named.columns:
        named = named.withColumn("visit_id", F.expr("uuid()"))
    return named.withColumn(PARTITION, F.date_format("created_at", "yyyy-MM"))


def write_visits(documents: DataFrame, path: str, mode: str) -> None:
    """Write by month of saving, clustered by patient inside a file.

    The rebalance splits large months and joins small ones, so neither tiny files
    nor one huge task come out, and sorted patients let readers skip row groups.
    """
    clustered = documents.hint("rebalance", PARTITION).sortWithinPartitions(
        PARTITION, "patient_id", "created_at"
    )
    clustered.write.mode(mode).partitionBy(PARTITION).parquet(path)


def append_visits(scored: DataFrame, path: str) -> None:
    """Append scored visits to the visit table."""
    write_visits(visit_documents(scored), path, "append")


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    return read_or_fail(
        lambda: spark.read.parquet(path), f"No saved visits found: {path}"
    )


def as_json(visits: DataFrame) -> DataFrame:
    """Every visit as one JSON text: nested fields kept, times in ISO form."""
    shown = [
        F.col(c).cast("string").alias(c) if c == "visit_id" else F.col(c) for c in visits.columns
    ]
    return visits.select(F.to_json(F.struct(*shown), TIMESTAMPS).alias("document"))
