"""Scoring many requests at once: rules first, the trained model beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitgauge.functions.cleaning import clean_demographics, item_sum
from visitgauge.functions.identity import filled, first_filled, patient_identity
from visitgauge.functions.scoring import (
    age_group, binary_half_even, explanation_text, explanation_text_form, half_up, model_note,
    pattern_for_total, recommendation_text, risk_band, severity, warning_text,
)
from visitgauge.operators.fairness import with_fairness_flag
from visitgauge.operators.features import FeatureModel
from visitgauge.operators.quality import accepted, input_violations, rejected
from visitgauge.plans.training import TrainedModel
from visitgauge.schema import (
    AGE, AGE_GROUP, BOUNDARY_PERSON, BOUNDARY_TOTALS, DEMOGRAPHIC_CODES, ITEMS, MAX_TOTAL,
)

INPUT_FIELDS = [
    "patient_id", "patient_name", "visit_date", "visit_time", "doctor_notes",
    AGE, *DEMOGRAPHIC_CODES, AGE_GROUP, *ITEMS,
]
OUTPUT_FIELDS = [
    "patient_id", "patient_name", "visit_date", "visit_time", "doctor_notes",
    "predicted_severity", "rule_based_severity", "model_predicted_severity", "model_agreement",
    "model_note", "severity", "risk_score", "risk_percentage", "risk_band", "phq9_total",
    "recommendation", "warning", "fairness_flag", "explanation", "probabilities", "timestamp",
    "model_type",
]


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that meet the input contract, and the others with their violations."""
    checked = input_violations(requests)
    return accepted(checked).drop("violations"), rejected(checked)


def with_identity(requests: DataFrame) -> DataFrame:
    """Fill patient id and name, age group and absent optional fields."""
    optional = ["patient_id", "patient_name", "visit_date", "visit_time", "doctor_notes", AGE_GROUP]
    absent = {c: F.lit(None).cast("string") for c in optional if c not in requests.columns}
    full = requests.withColumns(absent) if absent else requests
    identity = patient_identity(
        F.col("patient_id"), F.col("patient_name"), F.col(AGE), F.col("RIAGENDR")
    )
    return full.withColumns(
        {
            **identity,
            AGE_GROUP: F.coalesce(filled(F.col(AGE_GROUP)), age_group(F.col(AGE), closed=False)),
        }
    )


def score_rules(requests: DataFrame) -> DataFrame:
    """Identity, total, level, band and texts by the scoring rules alone."""
    scored = with_identity(requests).withColumn("phq9_total", item_sum())
    level = severity(F.col("phq9_total"), "clamp")
    leveled = scored.withColumn("rule_based_severity", level)
    rule = F.col("rule_based_severity")
    return leveled.withColumns(
        {
            "predicted_severity": rule,
            "severity": rule,
            "risk_band": risk_band(rule),
            "recommendation": recommendation_text(rule),
            "warning": warning_text(rule),
        }
    )


def with_model_estimate(
    requests: DataFrame, model: TrainedModel, features: FeatureModel, clean: bool = False
) -> DataFrame:
    """Add the model's label and class probabilities.

    Scoring does not null refused or unknown codes the way training does, so such a
    code has no indicator set; ``clean`` treats it as missing instead.
    """
    kept = requests.columns
    source = clean_demographics(requests) if clean else requests
    wide = source.select(*kept, *[c.alias(n) for n, c in features.columns().items()])
    estimate = model.predict_proba(wide) if model.gives_probabilities else model.predict(wide)
    extra = ["class_probabilities"] if model.gives_probabilities else []
    return estimate.select(*kept, F.col("y_pred").alias("model_predicted_severity"), *extra)


def score_batch(
    requests: DataFrame,
    model: TrainedModel,
    features: FeatureModel,
    summary: DataFrame | None = None,
    clean: bool = False,
) -> DataFrame:
    """Full scoring of accepted requests; other columns pass through in ``input_data``."""
    rules = score_rules(requests)
    estimated = with_model_estimate(rules, model, features, clean)
    agreement = F.col("model_predicted_severity").eqNullSafe(F.col("rule_based_severity"))
    if model.gives_probabilities:
        chances = F.col("class_probabilities")
        names = F.array(*[F.lit(x) for x in model.labels])
        rounded = F.transform(chances, lambda p: binary_half_even(p, 4))
        score, by_label = binary_half_even(F.array_max(chances), 4), F.map_from_arrays(names, rounded)
    else:
        score, by_label = F.lit(0.0), F.create_map().cast("map<string,double>")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    full = estimated.withColumns({"risk_score": score, "probabilities": by_label}).withColumns(
        {
            "model_agreement": agreement,
            "model_note": model_note(agreement),
            "risk_percentage": binary_half_even(F.col("risk_score") * 100, 1),
            "explanation": explanation_text(
                F.col("rule_based_severity"),
                F.col("phq9_total"),
                F.col("risk_band"),
                F.col("model_predicted_severity"),
            ),
            "timestamp": now,
            "model_type": F.lit(model.model_type),
        }
    )
    flagged = with_fairness_flag(full, summary)
    passed = [c for c in requests.columns if c not in OUTPUT_FIELDS and c not in INPUT_FIELDS]
    return flagged.select(
        *passed, *OUTPUT_FIELDS, F.struct(*INPUT_FIELDS).alias("input_data")
    )


def normalize_results(results: DataFrame) -> DataFrame:
    """Fill what a stored result lacks from its own answers and rules.

    Columns of the result are used where they are filled; the answers must be there.
    """

    def known(name: str):
        return F.col(name) if name in results.columns else F.lit(None).cast("string")

    answers = item_sum(missing_as_zero=True)
    level = first_filled(
        known("predicted_severity"), known("severity"), severity(answers, "clamp")
    )
    leveled = results.withColumns(
        {
            "_level": level,
            "phq9_total": F.coalesce(known("phq9_total").cast("bigint"), answers.cast("bigint")),
            "risk_score": F.coalesce(known("risk_score").cast("double"), F.lit(0.0)),
        }
    )
    rule = first_filled(known("rule_based_severity"), F.col("_level"))
    estimate = first_filled(known("model_predicted_severity"), known("model_severity"), F.col("_level"))
    band = first_filled(known("risk_band"), risk_band(F.col("_level"), "Low"))
    agreement = F.coalesce(known("model_agreement").cast("boolean"), estimate == rule)
    percent = half_up(F.col("risk_score") * 100)
    return leveled.withColumns(
        {
            "predicted_severity": F.col("_level"),
            "severity": F.col("_level"),
            "rule_based_severity": rule,
            "model_predicted_severity": estimate,
            "model_agreement": agreement,
            "model_note": F.coalesce(known("model_note"), F.lit("")),
            "risk_band": band,
            "risk_percentage": F.coalesce(known("risk_percentage").cast("double"), percent),
            "recommendation": first_filled(
                known("recommendation"), recommendation_text(F.col("_level"))
            ),
            "warning": first_filled(known("warning"), warning_text(F.col("_level"))),
            "explanation": first_filled(
                known("explanation"),
                explanation_text_form(F.col("_level"), F.col("phq9_total"), band),
            ),
        }
    ).drop("_level")


def boundary_cases(df: DataFrame, total: str = "total") -> DataFrame:
    """Add answers adding up to ``total`` and the level by both scoring rules."""
    value = F.col(total)
    in_range = df.withColumn(total, F.when(value.between(0, MAX_TOTAL), value))
    return in_range.withColumns(
        {name: F.when(value.isNotNull(), c) for name, c in pattern_for_total(value).items()}
    ).withColumns(
        {
            "expected_severity": severity(value, "null"),
            "rule_based_severity": severity(item_sum(), "clamp"),
            "risk_band": risk_band(severity(item_sum(), "clamp")),
        }
    )


def boundary_requests(spark: SparkSession, totals: tuple[int, ...] = BOUNDARY_TOTALS) -> DataFrame:
    """One request of the standard person for each of the given totals."""
    rows = spark.range(1).select(
        F.explode(F.array(*[F.lit(t).cast("bigint") for t in totals])).alias("total"),
        *[F.lit(v).alias(k) for k, v in BOUNDARY_PERSON.items()],
    )
    return rows.withColumns(pattern_for_total(F.col("total")))


def boundary_checks(
    spark: SparkSession,
    model: TrainedModel,
    features: FeatureModel,
    totals: tuple[int, ...] = BOUNDARY_TOTALS,
) -> DataFrame:
    """How the model and the rule judge the boundary totals. Percentages are not pre-rounded."""
    scored = score_rules(boundary_requests(spark, totals))
    checked = with_model_estimate(scored, model, features)
    expected = severity(F.col("total"), "raise")
    has = model.gives_probabilities
    top = F.array_max("class_probabilities") if has else F.lit(0.0)
    names = F.array(*[F.lit(x) for x in model.labels])
    chances = (
        F.map_from_arrays(names, F.col("class_probabilities"))
        if has
        else F.create_map().cast("map<string,double>")
    )
    return checked.select(
        F.col("phq9_total").cast("bigint").alias("phq9_total"),
        expected.alias("expected_severity"),
        expected.alias("manual_severity"),
        "rule_based_severity",
        "predicted_severity",
        "model_predicted_severity",
        F.col("model_predicted_severity")
        .eqNullSafe(F.col("rule_based_severity"))
        .alias("model_agreement"),
        (F.col("rule_based_severity") == expected).alias("matches_expected"),
        "risk_band",
        binary_half_even(top * 100, 1).alias("risk_percentage"),
        "recommendation",
        chances.alias("probabilities"),
    )
