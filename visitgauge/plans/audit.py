"""One nested row that describes data, split, model, samples, fairness and artifacts.

Every part is its own small aggregate, read as a scalar into a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitgauge.operators.agreement import agreement_summary
from visitgauge.operators.fairness import fairness_inventory
from visitgauge.operators.features import FeatureModel
from visitgauge.operators.quality import item_quality, split_leakage, total_consistency
from visitgauge.operators.split import value_distribution
from visitgauge.plans.preprocess import clean_dataset
from visitgauge.plans.scoring import boundary_checks
from visitgauge.plans.training import TrainedModel
from visitgauge.schema import (
    DEMOGRAPHIC_COLUMNS, FEATURES, ITEM_VALUES, ITEMS, KEY, LEAKAGE_CAVEAT, MAX_TOTAL,
    PRIMARY_SEVERITY_NOTE, QUESTIONNAIRE_COLUMNS, RAW_OUTPUT, SEVERITY_TOPS,
    SUSPICIOUS_ACCURACY, TARGET,
)
from visitgauge.sources.artifacts import (
    artifact_manifest, read_fairness_report, write_json_report,
)
from visitgauge.sources.survey import read_or_fail, read_surveys


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct."""
    return df.select(F.struct(*df.columns)).scalar()


def _distribution(df: DataFrame, column: str) -> Column:
    """Counts by value as a map; used on labels, so the map has a handful of entries."""
    entries = F.array_sort(F.collect_list(F.struct("value", "n")))
    return value_distribution(df, column).agg(F.map_from_entries(entries)).scalar()


def _texts(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def data_audit(demographic: DataFrame, questionnaire: DataFrame, clean: DataFrame) -> dict:
    """Parts about the input tables and the cleaned one."""
    return {
        "raw_csv_usage": F.struct(
            _count(demographic).alias("demographic_rows"),
            _count(questionnaire).alias("questionnaire_rows"),
            _count(clean).alias("merged_valid_rows"),
            _texts(DEMOGRAPHIC_COLUMNS).alias("required_demographic_columns"),
            _texts(QUESTIONNAIRE_COLUMNS).alias("required_questionnaire_columns"),
        ),
        "phq_cleaning": F.struct(
            _texts(list(ITEM_VALUES)).alias("valid_answer_values"),
            one_row(item_quality(questionnaire)).alias("cells"),
            F.lit(True).alias("invalid_values_not_counted_in_total"),
        ),
        "phq9_total_and_severity": F.struct(
            F.create_map(
                *[
                    c
                    for i, (name, top) in enumerate(SEVERITY_TOPS)
                    for c in (
                        F.lit(name),
                        _texts([SEVERITY_TOPS[i - 1][1] + 1 if i else 0, top]),
                    )
                ]
            ).alias("severity_bins"),
            _texts([0, MAX_TOTAL]).alias("valid_total_range"),
            total_consistency(clean).select("totals_match").scalar().alias(
                "processed_totals_match_cleaned_phq_sum"
            ),
            _distribution(clean, TARGET).alias("severity_distribution"),
        ),
    }


def split_audit(train_raw: DataFrame, test_raw: DataFrame, seed: int = 42) -> dict:
    """Part about the two sides of the split."""
    return {
        "train_test_split": F.struct(
            _count(train_raw).alias("train_rows"),
            _count(test_raw).alias("test_rows"),
            _distribution(train_raw, TARGET).alias("train_label_distribution"),
            _distribution(test_raw, TARGET).alias("test_label_distribution"),
            one_row(split_leakage(train_raw, test_raw, KEY)).alias("leakage"),
            F.lit(seed).alias("random_state"),
            F.lit(True).alias("stratified_split_expected"),
        ),
        "features": F.struct(
            _texts(FEATURES).alias("feature_columns"),
            _texts(RAW_OUTPUT).alias("raw_output_columns"),
            _texts(ITEMS).alias("phq_columns_used_as_features"),
            F.lit(LEAKAGE_CAVEAT).alias("leakage_caveat"),
            F.lit(PRIMARY_SEVERITY_NOTE).alias("api_primary_severity_note"),
        ),
    }


def model_audit(
    spark: SparkSession, model: TrainedModel, features: FeatureModel, test: DataFrame
) -> dict:
    """Parts about the model and its answers at the level boundaries."""
    metrics = model.metrics
    checks = boundary_checks(spark, model, features)
    number = {k: v for k, v in metrics.items() if isinstance(v, (int, float))}
    accuracy = float(metrics.get("accuracy", 0.0))
    return {
        "model": F.struct(
            F.lit(model.model_type).alias("model_type"),
            F.lit(metrics.get("best_model_name", model.model_type)).alias("best_model_name"),
            F.lit(metrics.get("trained_at")).cast("string").alias("trained_at"),
            _texts(model.feature_names).alias("feature_names"),
            F.struct(*[F.lit(v).alias(k) for k, v in number.items()]).alias("metrics")
            if number
            else F.lit(None).alias("metrics"),
            _distribution(model.predict(test), "y_pred").alias("prediction_label_distribution"),
            F.lit(accuracy >= SUSPICIOUS_ACCURACY).alias("accuracy_suspiciously_high"),
            F.lit(LEAKAGE_CAVEAT).alias("accuracy_note"),
        ),
        "sample_prediction_summary": one_row(
            agreement_summary(checks, "rule_based_severity", "model_predicted_severity")
        ),
        "sample_prediction_checks": _checks_in_order(checks),
    }


def _checks_in_order(checks: DataFrame) -> Column:
    # Structs with maps cannot be compared, so the totals give the order.
    fields = F.struct(*checks.columns).alias("check")
    listed = checks.select("phq9_total", fields).agg(
        F.map_from_entries(F.collect_list(F.struct("phq9_total", "check"))).alias("by_total")
    )
    return listed.select(
        F.transform(
            F.array_sort(F.map_keys("by_total")), lambda t: F.element_at(F.col("by_total"), t)
        )
    ).scalar()


def audit(
    spark: SparkSession,
    demographic_path: str,
    questionnaire_path: str,
    paths: dict[str, str],
    output_path: str | None = None,
) -> DataFrame:
    """Audit of stored artifacts (as named by the bootstrap run); optionally written as JSON."""
    demographic, questionnaire = read_surveys(spark, demographic_path, questionnaire_path)
    missing = "Required generated artifact is missing: {}"
    tables = {
        name: read_or_fail(
            lambda name=name: spark.read.parquet(paths[name]), missing.format(paths[name])
        )
        for name in ("train", "test", "train_raw", "test_raw", "preprocessor")
    }
    model = TrainedModel.load(spark, paths["model"])
    features = FeatureModel.from_table(tables["preprocessor"])
    clean = clean_dataset(demographic, questionnaire)
    try:
        report = read_fairness_report(spark, paths["fairness_report"])
        fairness = F.struct(F.lit(True).alias("exists"), one_row(fairness_inventory(report)).alias("report"))
    except FileNotFoundError:
        fairness = F.struct(F.lit(False).alias("exists"))
    named = {
        **paths,
        "raw_demographic": demographic_path,
        "raw_questionnaire": questionnaire_path,
    }
    manifest = artifact_manifest(spark, named)
    artifacts = manifest.agg(
        F.array_sort(F.collect_list(F.struct(*manifest.columns)))
    ).scalar()
    parts = {
        "generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
        **data_audit(demographic, questionnaire, clean),
        **split_audit(tables["train_raw"], tables["test_raw"]),
        **model_audit(spark, model, features, tables["test"]),
        "fairness_report": fairness,
        "artifacts": artifacts,
    }
    row = spark.range(1).select(*[c.alias(n) for n, c in parts.items()])
    if output_path:
        write_json_report(row, output_path)
    return row
