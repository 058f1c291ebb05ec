"""Reading the two survey files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitgauge.functions.cleaning import respondent_key
from visitgauge.operators.merging import merge_raw
from visitgauge.operators.quality import require_columns, require_unique_key
from visitgauge.schema import DEMOGRAPHIC_COLUMNS, KEY, QUESTIONNAIRE_COLUMNS


def read_or_fail(read: Callable[[], DataFrame], problem: str) -> DataFrame:
    """The table, or ``FileNotFoundError`` with ``problem`` when its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}:
            raise FileNotFoundError(problem) from error
        raise


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns as text: one bad cell cannot change a type."""
    problem = "Please place demographic.csv and questionnaire.csv inside data/raw/"
    return read_or_fail(lambda: spark.read.option("header", True).csv(path), problem)


def read_survey(
    spark: SparkSession, path: str, required: list[str], check_keys: bool = True
) -> DataFrame:
    """Required columns of one survey file with a whole-number key."""
    table = require_columns(read_text_table(spark, path), required, path).select(*required)
    table = table.withColumn(KEY, respondent_key(F.col(KEY)))
    return require_unique_key(table, KEY, path) if check_keys else table


def read_surveys(
    spark: SparkSession, demographic_path: str, questionnaire_path: str
) -> tuple[DataFrame, DataFrame]:
    return (
        read_survey(spark, demographic_path, DEMOGRAPHIC_COLUMNS),
        read_survey(spark, questionnaire_path, QUESTIONNAIRE_COLUMNS),
    )


def load_raw(spark: SparkSession, demographic_path: str, questionnaire_path: str) -> DataFrame:
    """Both files, checked and merged."""
    return merge_raw(*read_surveys(spark, demographic_path, questionnaire_path))
