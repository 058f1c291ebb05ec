"""Joining the two survey tables by respondent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitgauge.schema import DEMOGRAPHIC_COLUMNS, KEY, QUESTIONNAIRE_COLUMNS


def merge_raw(demographic: DataFrame, questionnaire: DataFrame) -> DataFrame:
    """Inner join on the respondent key. Null keys match nothing."""
    return demographic.select(*DEMOGRAPHIC_COLUMNS).join(
        questionnaire.select(*QUESTIONNAIRE_COLUMNS), KEY, "inner"
    )


def merge_unmatched(demographic: DataFrame, questionnaire: DataFrame) -> DataFrame:
    """One row of row counts: merged, one-sided and without a key.

    Both sides shrink to (key, rows) before they meet, so a repeated key
    crosses the shuffle once per map task however many rows carry it.
    """
    sides = demographic.select(KEY, F.lit(1).alias("d"), F.lit(0).alias("q")).unionByName(
        questionnaire.select(KEY, F.lit(0).alias("d"), F.lit(1).alias("q"))
    )
    per_key = sides.groupBy(KEY).agg(F.sum("d").alias("d"), F.sum("q").alias("q"))
    keyed = F.col(KEY).isNotNull()

    def rows(condition, value):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    d, q = F.col("d"), F.col("q")
    return per_key.agg(
        rows(keyed, d * q).alias("merged_rows"),
        rows(keyed & (q == 0), d).alias("demographic_only_rows"),
        rows(keyed & (d == 0), q).alias("questionnaire_only_rows"),
        rows(~keyed, d).alias("demographic_null_keys"),
        rows(~keyed, q).alias("questionnaire_null_keys"),
    )
