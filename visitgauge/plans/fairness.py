"""Fairness of a trained model on held-out rows, and the whole bootstrap run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitgauge.operators.fairness import (
    fairness_disparities, fairness_report, fairness_summary,
)
from visitgauge.operators.features import FeatureModel
from visitgauge.operators.quality import require_columns
from visitgauge.plans.preprocess import preprocess
from visitgauge.plans.scoring import with_model_estimate
from visitgauge.plans.training import TrainedModel, train_and_save
from visitgauge.schema import FAIRNESS_GROUPS, FEATURES, TARGET
from visitgauge.sources.artifacts import read_fairness_report, write_fairness_report
from visitgauge.sources.survey import read_or_fail


def trained_fairness(
    test_raw: DataFrame, model: TrainedModel, features: FeatureModel
) -> DataFrame:
    """Fairness report of the model on raw held-out rows."""
    require_columns(test_raw, [*FEATURES, TARGET, *FAIRNESS_GROUPS], "test_raw")
    estimated = with_model_estimate(test_raw, model, features)
    pairs = estimated.withColumns(
        {
            "y_true": F.col(TARGET).cast("string"),
            "y_pred": F.col("model_predicted_severity"),
        }
    )
    return fairness_report(pairs, FAIRNESS_GROUPS, model.labels)


def evaluate_fairness(
    spark: SparkSession, test_raw_path: str, features_path: str, model_path: str, output_path: str
) -> tuple[DataFrame, DataFrame]:
    """Write the report of stored artifacts; return it and its disparities."""
    missing = "Required fairness artifact is missing: {}"
    test_raw = read_or_fail(
        lambda: spark.read.parquet(test_raw_path), missing.format(test_raw_path)
    )
    fitted = read_or_fail(
        lambda: spark.read.parquet(features_path), missing.format(features_path)
    )
    model = TrainedModel.load(spark, model_path)
    report = trained_fairness(test_raw, model, FeatureModel.from_table(fitted))
    write_fairness_report(report, output_path)
    stored = read_fairness_report(spark, output_path)
    return stored, fairness_disparities(stored)


def stored_summary(spark: SparkSession, report_path: str) -> DataFrame | None:
    """Summary of a stored report, ``None`` when there is none."""
    try:
        return fairness_summary(read_fairness_report(spark, report_path))
    except FileNotFoundError:
        return None


def bootstrap(
    spark: SparkSession,
    demographic_path: str,
    questionnaire_path: str,
    output_dir: str,
    test_size: float = 0.3,
    seed: int = 42,
    trees: int = 200,
    **options,
) -> dict[str, str]:
    """Prepare, train and report; returns the paths of everything written. Options go to ``train_models``."""
    preprocess(spark, demographic_path, questionnaire_path, output_dir, test_size, seed)
    paths = {
        "train": f"{output_dir}/train",
        "test": f"{output_dir}/test",
        "train_raw": f"{output_dir}/raw/split=train",
        "test_raw": f"{output_dir}/raw/split=test",
        "preprocessor": f"{output_dir}/features",
        "model": f"{output_dir}/model",
        "fairness_report": f"{output_dir}/fairness_report",
    }
    train_and_save(spark, paths["train"], paths["test"], paths["model"], seed=seed, trees=trees, **options)
    evaluate_fairness(
        spark, paths["test_raw"], paths["preprocessor"], paths["model"], paths["fairness_report"]
    )
    return paths
