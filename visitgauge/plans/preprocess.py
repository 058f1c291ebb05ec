"""From the two raw tables to stored, split and transformed training data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitgauge.functions.cleaning import add_phq9_total, answered_fully, clean_demographics
from visitgauge.functions.scoring import age_group, severity
from visitgauge.operators.features import FeatureModel, fit_features, transformed_table
from visitgauge.operators.merging import merge_raw
from visitgauge.operators.split import require_feasible_split, stratified_split
from visitgauge.schema import AGE, AGE_GROUP, RAW_OUTPUT, TARGET, TOTAL
from visitgauge.sources.artifacts import store
from visitgauge.sources.survey import read_surveys


def label_rows(merged: DataFrame) -> DataFrame:
    """Clean codes, score, label and group; every row stays."""
    return (
        merged.transform(clean_demographics)
        .transform(add_phq9_total)
        .withColumn(TARGET, severity(F.col(TOTAL), "null"))
        .withColumn(AGE_GROUP, age_group(F.col(AGE), closed=True))
    )


def clean_dataset(demographic: DataFrame, questionnaire: DataFrame) -> DataFrame:
    """Merged complete cases in output column order.

    Rows with an invalid answer are dropped first, at the questionnaire scan and
    before the join. All nine answers valid means a total and a label exist, so
    nothing is left to drop after labelling.
    """
    merged = merge_raw(demographic, answered_fully(questionnaire))
    return merged.transform(label_rows).select(*RAW_OUTPUT)


@dataclass(frozen=True)
class Prepared:
    train_raw: DataFrame
    test_raw: DataFrame
    train: DataFrame
    test: DataFrame
    features: FeatureModel


def preprocess(
    spark: SparkSession,
    demographic_path: str,
    questionnaire_path: str,
    output_dir: str,
    test_size: float = 0.3,
    seed: int = 42,
) -> Prepared:
    """Run the whole preparation; each stage is stored and the next starts from it."""
    demographic, questionnaire = read_surveys(spark, demographic_path, questionnaire_path)
    clean = store(clean_dataset(demographic, questionnaire), f"{output_dir}/clean")
    require_feasible_split(clean, test_size)
    side = F.when(F.col("is_test"), "test").otherwise("train").alias("split")
    split = stratified_split(clean, test_size, seed).select(*RAW_OUTPUT, side)
    store(split, f"{output_dir}/raw", "split")
    train_raw = spark.read.parquet(f"{output_dir}/raw/split=train")
    test_raw = spark.read.parquet(f"{output_dir}/raw/split=test")
    features = fit_features(train_raw)
    features.save(spark, f"{output_dir}/features")
    return Prepared(
        train_raw=train_raw,
        test_raw=test_raw,
        train=store(transformed_table(features, train_raw), f"{output_dir}/train"),
        test=store(transformed_table(features, test_raw), f"{output_dir}/test"),
        features=features,
    )
