"""Every registered query as a function of (spark, table folder)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitgauge.functions import cleaning, identity, scoring
from visitgauge.operators import (
    agreement, fairness, features, history, merging, quality, split,
)
from visitgauge.operators.neighbours import nearest_in_class
from visitgauge.operators.oversample import distinct_points, oversample
from visitgauge.plans import audit as audit_plan
from visitgauge.plans import fairness as fairness_plan
from visitgauge.plans import preprocess as prep
from visitgauge.plans import scoring as score_plan
from visitgauge.plans import training
from visitgauge.schema import (
    AGE, AGE_GROUP, DEMOGRAPHIC_CODES, ITEMS, KEY, TARGET, TOTAL,
)
from visitgauge.session import materialise, shared_folder
from visitgauge.sources.visits import as_json
from visitgauge.streaming import visits as streams
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merge_raw(views.respondents(spark, sf), views.questionnaire(spark, sf))


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return prep.clean_dataset(views.respondents(spark, sf), views.questionnaire(spark, sf))


def _split(spark: SparkSession, sf: str) -> DataFrame:
    """Split of the clean table, which is stored once since the split reads it three times."""
    return split.stratified_split(materialise(_clean(spark, sf)))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in predictions with age groups, as the fairness operators want them."""
    return views.scored(spark, sf).withColumn(
        AGE_GROUP, scoring.age_group(F.col(AGE), closed=True)
    )


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.fairness_report(_scored(spark, sf))


def _three_models(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of three stand-in models in one table."""
    scored = views.scored(spark, sf)
    guesses = [("Eight items", "y_pred"), ("Seven items", "y_pred_7"), ("First item", "y_pred_1")]
    return scored.select(
        "y_true",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ordinal"),
                        F.lit(name).alias("candidate"),
                        F.col(column).alias("y_pred"),
                    )
                    for i, (name, column) in enumerate(guesses)
                ]
            )
        ),
    )


# Sources, checks and cleaning


@query
def merge_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)


@query
def merge_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return merging.merge_unmatched(views.demographic(spark, sf), views.visits(spark, sf))


@query
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(views.visits(spark, sf), KEY)


@query
def split_feasibility(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_feasibility(_clean(spark, sf), 0.3)


@query
def input_violations(spark: SparkSession, sf: str) -> DataFrame:
    checked = quality.input_violations(views.requests(spark, sf))
    return checked.select(
        "visit_id",
        (F.size("violations") == 0).alias("accepted"),
        F.array_join("violations", "; ").alias("messages"),
    )


@query
def form_violations(spark: SparkSession, sf: str) -> DataFrame:
    checked = quality.form_violations(views.requests(spark, sf))
    return checked.select("visit_id", F.array_join("violations", " ").alias("messages"))


@query
def item_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.item_quality(views.visits(spark, sf))


@query
def item_invalid_values(spark: SparkSession, sf: str) -> DataFrame:
    return quality.invalid_values(views.visits(spark, sf))


@query
def total_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return quality.total_consistency(
        views.history(spark, sf).withColumnRenamed("phq9_total", TOTAL)
    )


@query
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Patients on both sides when visits, not patients, are split by date."""
    visits = views.history(spark, sf)
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    early = visits.where(F.col("created_at") < cut)
    late = visits.where(F.col("created_at") >= cut)
    return quality.split_leakage(early, late, "patient_id")


@query
def row_completeness(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["patient_name", AGE, *DEMOGRAPHIC_CODES, "visit_date", "visit_time", *ITEMS]
    return quality.row_completeness(views.requests(spark, sf), fields).select(
        "visit_id", "completeness"
    )


@query
def accuracy_flag(spark: SparkSession, sf: str) -> DataFrame:
    metrics = agreement.model_metrics(_three_models(spark, sf), by=["ordinal", "candidate"])
    return quality.accuracy_flag(metrics).select(
        "candidate", "accuracy", "accuracy_suspiciously_high"
    )


@query
def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    text = views.raw_text(spark, sf)
    return cleaning.coerce_numeric(
        text.withColumn("value", F.col("raw_value")), ["value"]
    )


@query
def clean_demographics(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_demographics(views.demographic(spark, sf))


@query
def phq9_total(spark: SparkSession, sf: str) -> DataFrame:
    visits = views.visits(spark, sf)
    answered = visits.withColumn("answered_total", cleaning.item_sum(missing_as_zero=True))
    return cleaning.add_phq9_total(answered).select("visit_id", *ITEMS, TOTAL, "answered_total")


@query
def severity_bins(spark: SparkSession, sf: str) -> DataFrame:
    total = F.col("total")
    return views.raw_totals(spark, sf).select(
        "visit_id",
        "total",
        scoring.severity(total, "null").alias("severity_in_range"),
        scoring.severity(total, "clamp").alias("severity_clamped"),
    )


@query
def age_groups(spark: SparkSession, sf: str) -> DataFrame:
    age = F.col("age")
    return views.raw_totals(spark, sf).select(
        "visit_id",
        "age",
        scoring.age_group(age, closed=True).alias("closed_group"),
        scoring.age_group(age, closed=False).alias("open_group"),
    )


@query
def complete_cases(spark: SparkSession, sf: str) -> DataFrame:
    labelled = prep.label_rows(_merged(spark, sf))
    return cleaning.complete_cases(labelled).select(KEY, TOTAL, TARGET)


@query
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.select_features(_clean(spark, sf))


@query
def clean_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return _clean(spark, sf)


# Levels, texts and identity


@query
def risk_bands(spark: SparkSession, sf: str) -> DataFrame:
    level = F.col("level")
    return views.raw_totals(spark, sf).select(
        "visit_id",
        "level",
        scoring.risk_band(level, "High").alias("band_unknown_high"),
        scoring.risk_band(level, "Low").alias("band_unknown_low"),
    )


@query
def guidance(spark: SparkSession, sf: str) -> DataFrame:
    level = F.col("level")
    return views.raw_totals(spark, sf).select(
        "visit_id",
        "level",
        scoring.warning_text(level).alias("warning"),
        scoring.recommendation_text(level).alias("recommendation"),
    )


@query
def explanations(spark: SparkSession, sf: str) -> DataFrame:
    total = F.col("total")
    level = scoring.severity(total, "clamp")
    band = scoring.risk_band(level)
    return views.raw_totals(spark, sf).select(
        "visit_id",
        scoring.explanation_text(level, total, band, F.col("model_level")).alias("with_model"),
        scoring.explanation_text(level, total, band).alias("without_model"),
        scoring.explanation_text_form(level, total, band).alias("form_text"),
    )


@query
def model_agreement(spark: SparkSession, sf: str) -> DataFrame:
    same = F.col("level").eqNullSafe(F.col("model_level"))
    return views.raw_totals(spark, sf).select(
        "visit_id", same.alias("model_agreement"), scoring.model_note(same).alias("model_note")
    )


@query
def agreement_summary(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.agreement_summary(
        views.history(spark, sf), "predicted_severity", "model_severity"
    )


@query
def patient_ids(spark: SparkSession, sf: str) -> DataFrame:
    names = identity.patient_identity(
        F.col("patient_id"), F.col("patient_name"), F.col(AGE), F.col("RIAGENDR")
    )
    return views.requests(spark, sf).select("visit_id", *[c.alias(n) for n, c in names.items()])


@query
def group_labels(spark: SparkSession, sf: str) -> DataFrame:
    people = views.demographic(spark, sf).withColumn(
        AGE_GROUP, scoring.age_group(F.col(AGE), closed=True)
    )
    return people.select(
        KEY,
        *[
            scoring.group_label(F.lit(g), fairness.group_text(g)).alias(f"{g}_label")
            for g in ("RIAGENDR", "AGE_GROUP", "RIDRETH1", "INDHHIN2")
        ],
    )


@query
def item_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    score = F.coalesce("score", F.lit(0)).cast("bigint")
    return (
        views.visits(spark, sf)
        .select("visit_id", *ITEMS)
        .unpivot("visit_id", ITEMS, "code", "score")
        .select(
            "visit_id",
            "code",
            scoring.item_question(F.col("code")).alias("question"),
            score.alias("score"),
            scoring.item_meaning(score).alias("meaning"),
        )
    )


@query
def identity_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    patient = identity.first_filled(
        F.col("patient_id"), F.col("id"), F.col("input_data.patient_id"), F.lit("")
    )
    name = identity.first_filled(
        F.col("patient_name"), F.col("input_data.patient_name"), F.lit("")
    )
    return views.records(spark, sf).select(
        "visit_id",
        F.trim(F.coalesce(patient, F.lit(""))).alias("patient_id"),
        F.trim(F.coalesce(name, F.lit(""))).alias("patient_name"),
        F.coalesce(
            identity.first_filled(F.col("visit_date"), F.col("saved_at")), F.lit("")
        ).alias("visit_value"),
    )


@query
def normalize_results(spark: SparkSession, sf: str) -> DataFrame:
    stored = views.visits(spark, sf).select(
        "visit_id",
        *ITEMS,
        F.expr("CASE visit_id % 3 WHEN 0 THEN 'Severe' WHEN 1 THEN '' END").alias(
            "predicted_severity"
        ),
        F.expr("CASE visit_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN '' END").alias("risk_band"),
        F.expr("CASE WHEN visit_id % 5 = 0 THEN 12 END").alias("phq9_total"),
        F.expr("CASE WHEN visit_id % 6 > 0 THEN CAST(visit_id % 100 AS DOUBLE) / 128 END").alias(
            "risk_score"
        ),
        F.expr("CASE WHEN visit_id % 7 = 0 THEN 'See notes.' END").alias("recommendation"),
    )
    return score_plan.normalize_results(stored).select(
        "visit_id", "predicted_severity", "rule_based_severity", "model_predicted_severity",
        "model_agreement", "model_note", "risk_band", "phq9_total", "risk_score",
        "risk_percentage", "recommendation", "warning", "explanation",
    )


@query
def boundary_cases(spark: SparkSession, sf: str) -> DataFrame:
    totals = views.raw_totals(spark, sf).select("visit_id", "total")
    return score_plan.boundary_cases(totals)


@query
def score_rules(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = score_plan.split_requests(views.requests(spark, sf))
    return score_plan.score_rules(good).select(
        "visit_id", "patient_id", "patient_name", "AGE_GROUP", "phq9_total",
        "predicted_severity", "risk_band", "recommendation", "warning",
    )


# Quality of predictions and fairness


@query
def severity_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return split.value_distribution(prep.label_rows(_merged(spark, sf)), TARGET)


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.confusion_matrix(views.scored(spark, sf))


@query
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.model_metrics(views.scored(spark, sf))


@query
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.classification_report(views.scored(spark, sf))


@query
def select_best(spark: SparkSession, sf: str) -> DataFrame:
    metrics = agreement.model_metrics(_three_models(spark, sf), by=["ordinal", "candidate"])
    return agreement.select_best(metrics)


@query
def fairness_overall(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.fairness_overall(_scored(spark, sf))


@query
def fairness_report(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)


@query
def fairness_disparities(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.fairness_disparities(_report(spark, sf))


@query
def fairness_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.fairness_ranking(_report(spark, sf))


@query
def fairness_bands(spark: SparkSession, sf: str) -> DataFrame:
    report = _report(spark, sf)
    return report.select(
        "group_column", "group_value", scoring.report_band(F.col("risk_percentage")).alias("band")
    )


@query
def risk_percentage(spark: SparkSession, sf: str) -> DataFrame:
    absent = F.when(F.col("sample_size") % 2 == 0, F.col("risk_percentage"))
    return _report(spark, sf).select(
        "group_column",
        "group_value",
        scoring.risk_percent(absent, F.col("selection_rate")).alias("risk_percentage"),
    )


@query
def fairness_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict, with the order of the groups of each column as text; see ``fairness_records`` for their records."""
    summary = fairness.fairness_summary(_report(spark, sf))
    order = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("groups")),
            lambda g: F.concat_ws("=", g["key"], F.array_join(F.transform(g["value"], lambda r: r["group_value"]), ">")),
        ),
        "; ",
    )
    return summary.withColumn("groups", order)


@query
def fairness_records(spark: SparkSession, sf: str) -> DataFrame:
    """All report records inside the summary, by column and place."""
    return fairness.summary_records(fairness.fairness_summary(_report(spark, sf)))


@query
def fairness_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return fairness.fairness_inventory(_report(spark, sf))


@query
def patient_fairness_flags(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = score_plan.split_requests(views.requests(spark, sf))
    summary = fairness.fairness_summary(_report(spark, sf))
    rules = score_plan.score_rules(good)
    both = fairness.with_fairness_flag(rules, summary)
    alone = fairness.with_fairness_flag(
        both.withColumnRenamed("fairness_flag", "with_report"), None
    )
    return alone.select(
        "visit_id", AGE_GROUP, "risk_band", "with_report",
        F.col("fairness_flag").alias("without_report"),
    )


# Saved visits


@query
def recent_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return history.newest(views.history(spark, sf), 100).drop(*ITEMS, KEY)


@query
def patient_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.patient_history(views.history(spark, sf), "P-11", 100).drop(*ITEMS, KEY)


@query
def recent_activity(spark: SparkSession, sf: str) -> DataFrame:
    return history.recent_activity(views.history(spark, sf))


@query
def patient_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return history.patient_comparison(views.history(spark, sf))


@query
def patient_comparison_service(spark: SparkSession, sf: str) -> DataFrame:
    return history.patient_comparison(views.history(spark, sf), history.SERVICE_WORDS).select(
        "patient_id", "has_comparison", "phq9_change", "status", "summary"
    )


@query
def patient_trend(spark: SparkSession, sf: str) -> DataFrame:
    return history.patient_trend(views.history(spark, sf))


@query
def trend_points(spark: SparkSession, sf: str) -> DataFrame:
    """Trend arrays by month, unfolded again."""
    arrays = history.trend_arrays(views.history(spark, sf))
    return arrays.select("patient_id", "part", F.inline("trend")).drop("created_at")


@query
def latest_report(spark: SparkSession, sf: str) -> DataFrame:
    return history.latest_report(views.history(spark, sf))


@query
def patient_prefill(spark: SparkSession, sf: str) -> DataFrame:
    requests = views.requests(spark, sf)
    nested = requests.select(
        "visit_id",
        "created_at",
        F.concat(F.lit("P-"), F.col(KEY).cast("string")).alias("patient_id"),
        "patient_name",
        F.struct(AGE, "RIAGENDR", "RIDRETH1", "INDHHIN2").alias("input_data"),
        "DMDEDUC2",
        "DMDMARTL",
    )
    return history.patient_prefill(nested)


@query
def patient_directory(spark: SparkSession, sf: str) -> DataFrame:
    return history.patient_directory(views.history(spark, sf))


def _with_map_texts(stats: DataFrame) -> DataFrame:
    return stats.withColumns({c: history.map_text(c) for c in ("severity_counts", "risk_band_counts")})


@query
def dashboard_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _with_map_texts(history.dashboard_stats(views.history(spark, sf)))


@query
def dashboard_stats_all(spark: SparkSession, sf: str) -> DataFrame:
    return _with_map_texts(history.dashboard_stats(views.history(spark, sf), newest_only=None))


@query
def stats_variant(spark: SparkSession, sf: str) -> DataFrame:
    return _with_map_texts(history.stats_variant(views.history(spark, sf)))


@query
def daily_activity(spark: SparkSession, sf: str) -> DataFrame:
    return history.daily_activity(views.history(spark, sf))


@query
def mean_nonzero_total(spark: SparkSession, sf: str) -> DataFrame:
    return history.mean_nonzero_total(views.history(spark, sf))


@query
def history_search(spark: SparkSession, sf: str) -> DataFrame:
    found = history.history_search(
        views.history(spark, sf), name="PATIENT 1", level="Severe", band="High",
        since="1996-01-01", until="2000-12-31",
    )
    return found.select("visit_id", "patient_id", "patient_name", "visit_date", "risk_band")


@query
def visit_json(spark: SparkSession, sf: str) -> DataFrame:
    visits = views.history(spark, sf).select(
        "visit_id",
        "patient_id",
        "created_at",
        "phq9_total",
        F.struct(*ITEMS[:2]).alias("input_data"),
    )
    return as_json(visits)


# Splits and features


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select(KEY, TARGET, "is_test")


@query
def split_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_distribution(_split(spark, sf))


@query
def fit_statistics(spark: SparkSession, sf: str) -> DataFrame:
    counts = materialise(features.value_counts(_clean(spark, sf)))
    return features.fit_statistics(counts)


@query
def category_domains(spark: SparkSession, sf: str) -> DataFrame:
    return features.category_domains(features.value_counts(_clean(spark, sf)))


@query
def scaled_features(spark: SparkSession, sf: str) -> DataFrame:
    clean = _clean(spark, sf)
    scaled = features.fit_features(clean).scaled()
    return clean.select(KEY, *[c.alias(n) for n, c in scaled.items()])


@query
def onehot_features(spark: SparkSession, sf: str) -> DataFrame:
    """Indicator columns, read from the sparse vectors."""
    clean = _clean(spark, sf)
    fitted = features.fit_features(clean)
    first = len(fitted.scaled())
    values = fitted.encode(clean, [KEY]).select(KEY, vector_to_array("features").alias("values"))
    return values.select(
        KEY, *[F.col("values")[first + k].alias(name) for k, name in enumerate(fitted.feature_names[first:])]
    )


@query
def label_index(spark: SparkSession, sf: str) -> DataFrame:
    return training.label_index(_clean(spark, sf).select(KEY, TARGET))


# Training and scoring with a trained model


class Trained(NamedTuple):
    train_raw: DataFrame
    test_raw: DataFrame
    fitted: features.FeatureModel
    model: training.TrainedModel
    compared: DataFrame


def _transformed(spark: SparkSession, sf: str):
    side = materialise(_split(spark, sf))
    train_raw = side.where(~F.col("is_test")).drop("is_test")
    test_raw = side.where("is_test").drop("is_test")
    return train_raw, test_raw, features.fit_features(train_raw)


def _trained(spark: SparkSession, sf: str) -> Trained:
    train_raw, test_raw, fitted = _transformed(spark, sf)
    model, compared = training.train_models(
        features.transformed_table(fitted, train_raw),
        features.transformed_table(fitted, test_raw),
        fitted.feature_names,
    )
    return Trained(train_raw, test_raw, fitted, model, compared)


def _oversampled(spark: SparkSession, sf: str) -> DataFrame:
    train_raw, _, fitted = _transformed(spark, sf)
    return oversample(
        fitted.transform(train_raw, [KEY, TARGET]), fitted.feature_names
    )


@query
def smote(spark: SparkSession, sf: str) -> DataFrame:
    return _oversampled(spark, sf)


#: Codes whose indicator columns count in ``smote_neighbours``, with their number of values.
NEIGHBOUR_CODES = {"RIAGENDR": 2, "RIDRETH1": 5, "DMDMARTL": 6}


@query
def smote_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest rows of each class on answers, age and codes, as oversampling finds them; whole numbers, so ties are exact."""
    indicators = {
        f"{name}_{v}": F.coalesce(F.col(name) == v, F.lit(False)).cast("double")
        for name, values in NEIGHBOUR_CODES.items()
        for v in range(1, values + 1)
    }
    numbers = {name: F.coalesce(F.col(name), F.lit(0)).cast("double") for name in [*ITEMS, AGE]}
    columns = {**numbers, **indicators}
    coded = _clean(spark, sf).select(KEY, TARGET, *[c.alias(f"x_{n}") for n, c in columns.items()])
    points = materialise(distinct_points(coded, [f"x_{n}" for n in columns]).select(TARGET, "vid", "x"))
    found = nearest_in_class(points, 5, TARGET)
    return found.select(TARGET, F.col("vid").alias(KEY), "neighbour", "rank", "distance")


@query
def smote_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        _oversampled(spark, sf)
        .groupBy(TARGET)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if("synthetic").alias("n_synthetic"),
        )
    )


@query
def train_models(spark: SparkSession, sf: str) -> DataFrame:
    return _trained(spark, sf).compared


@query
def train_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What SQL can tell of the trained candidates: their order, the resampled rows, and that measures are shares."""
    compared = _trained(spark, sf).compared
    shares = reduce(Column.__and__, [F.col(c).between(0, 1) for c in ("accuracy", "precision", "recall", "f1")])
    return compared.select("ordinal", "candidate", "train_size", shares.alias("measures_are_shares"))


@query
def train_fairness_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and sizes of the trained model's fairness report, and that its rates are shares."""
    trained = _trained(spark, sf)
    report = fairness_plan.trained_fairness(trained.test_raw, trained.model, trained.fitted)
    rates = ["accuracy", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "selection_rate"]
    shares = reduce(Column.__and__, [F.col(c).between(0, 1) for c in rates])
    return report.select("group_column", "group_value", "group_label", "sample_size", shares.alias("rates_are_shares"))


@query
def train_fairness(spark: SparkSession, sf: str) -> DataFrame:
    trained = _trained(spark, sf)
    return fairness_plan.trained_fairness(trained.test_raw, trained.model, trained.fitted)


@query
def score_batch(spark: SparkSession, sf: str) -> DataFrame:
    trained = _trained(spark, sf)
    report = fairness_plan.trained_fairness(trained.test_raw, trained.model, trained.fitted)
    good, _ = score_plan.split_requests(views.requests(spark, sf))
    scored = score_plan.score_batch(
        good, trained.model, trained.fitted, fairness.fairness_summary(report)
    )
    return scored.drop("timestamp")


@query
def score_batch_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Rule columns of fully scored requests, and that probabilities, score and agreement fit together."""
    scored = score_batch(spark, sf)
    chances = F.map_values("probabilities")
    total = F.aggregate(chances, F.lit(0.0), lambda a, x: a + x)
    # Each of the five is rounded to four decimals.
    return scored.select(
        "visit_id", "patient_id", "phq9_total", "predicted_severity", "risk_band",
        (F.abs(total - 1) < 0.0005).alias("probabilities_sum_to_one"),
        (F.col("risk_score") == F.array_max(chances)).alias("score_is_largest"),
        (F.element_at("probabilities", F.col("model_predicted_severity")) == F.col("risk_score")).alias("label_is_likeliest"),
        (F.col("model_agreement") == (F.col("model_predicted_severity") == F.col("rule_based_severity"))).alias("agreement_fits"),
    )


@query
def boundary_checks(spark: SparkSession, sf: str) -> DataFrame:
    trained = _trained(spark, sf)
    return score_plan.boundary_checks(spark, trained.model, trained.fitted)


@query
def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric part of the audit, with the stand-in model's report."""
    demographic, questionnaire = views.respondents(spark, sf), views.questionnaire(spark, sf)
    clean = materialise(prep.clean_dataset(demographic, questionnaire))
    divided = materialise(split.stratified_split(clean))
    parts = {
        **audit_plan.data_audit(demographic, questionnaire, clean),
        **audit_plan.split_audit(
            divided.where(~F.col("is_test")), divided.where(F.col("is_test"))
        ),
        "fairness": audit_plan.one_row(fairness.fairness_inventory(_report(spark, sf))),
        "samples": audit_plan.one_row(
            agreement.agreement_summary(views.scored(spark, sf), "y_true", "y_pred")
        ),
    }
    row = spark.range(1).select(*[c.alias(n) for n, c in parts.items()])
    return row.select(
        "raw_csv_usage.demographic_rows",
        "raw_csv_usage.questionnaire_rows",
        "raw_csv_usage.merged_valid_rows",
        "phq_cleaning.cells.*",
        F.col("phq9_total_and_severity.processed_totals_match_cleaned_phq_sum").alias(
            "totals_match"
        ),
        "train_test_split.train_rows",
        "train_test_split.test_rows",
        "train_test_split.leakage.duplicate_key_count",
        F.col("fairness.row_count").alias("fairness_rows"),
        "fairness.low_sample_size_rows",
        F.col("samples.agreement_count").alias("agreement_count"),
        F.col("samples.mismatch_count").alias("mismatch_count"),
    )


# Streams over the same visits. Results are written below the shared folder and read back.


def _order_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = views.table(spark, sf, "orders").schema
    # The pattern covers a single file and a folder of files alike.
    return streams.read_stream(spark, f"{sf}/orders.parquet*", schema)


def _visit_stream(spark: SparkSession, sf: str) -> DataFrame:
    return views.as_history(views.with_answers(_order_stream(spark, sf), views.VISIT_HEAD))


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query
def stream_daily_activity(spark: SparkSession, sf: str) -> DataFrame:
    folder = _run_folder(spark)
    streams.daily_activity(_visit_stream(spark, sf), f"{folder}/out", f"{folder}/checkpoint")
    return streams.read_daily_activity(spark, f"{folder}/out")


@query
def stream_visit_changes(spark: SparkSession, sf: str) -> DataFrame:
    folder = _run_folder(spark)
    streams.visit_changes(_visit_stream(spark, sf), f"{folder}/out", f"{folder}/checkpoint")
    return streams.read_visit_changes(spark, f"{folder}/out").withColumn(
        "created_at", F.col("created_at").cast("timestamp_ntz")
    )


@query
def stream_running_counts(spark: SparkSession, sf: str) -> DataFrame:
    folder = _run_folder(spark)
    counts = streams.running_counts(_visit_stream(spark, sf))
    streams.publish_counts(counts, f"{folder}/out", f"{folder}/checkpoint")
    return streams.published(spark, f"{folder}/out")


@query
def stream_score_and_append(spark: SparkSession, sf: str) -> DataFrame:
    """Rule scoring of arriving requests, appended to a visit table."""
    folder = _run_folder(spark)

    def score(batch: DataFrame) -> DataFrame:
        good, _ = score_plan.split_requests(batch)
        return score_plan.score_rules(good)

    requests = views.with_answers(_order_stream(spark, sf), views.REQUEST_HEAD)
    streams.score_and_append(requests, score, f"{folder}/out", f"{folder}/checkpoint")
    fields = T.StructType.fromDDL(
        "visit_id bigint, patient_id string, created_at timestamp_ntz, phq9_total bigint, "
        "predicted_severity string, risk_band string, batch int, visit_month string"
    )
    return spark.read.schema(fields).parquet(f"{folder}/out").drop("batch")
