"""Subgroup fairness of a classifier: report, disparities, summary and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgauge.functions.scoring import group_label, half_even, report_band
from visitgauge.operators.agreement import (
    class_f1, class_precision, class_recall, class_totals, hits, pair_counts, ratio, sum_where,
    weighted,
)
from visitgauge.schema import (
    BIAS_FOUND, BIAS_NOT_FOUND, BIAS_POINTS, BIAS_UNKNOWN, CLASS_LABELS, FAIRNESS_GROUPS,
    GAP_LIMIT, HIGH_RISK, MIN_GROUP_SIZE,
)

BASELINES = [
    "accuracy", "f1", "false_negative_rate", "selection_rate",
    "high_risk_false_negative_rate", "high_risk_selection_rate",
]
REPORT_COLUMNS = [
    "group_column", "group_value", "group_label", "sample_size", "min_group_size",
    "accuracy", "precision", "recall", "f1", "false_positive_rate", "false_negative_rate",
    "selection_rate", "risk_percentage", "high_risk_false_negative_rate",
    "high_risk_selection_rate", "overall_accuracy", "overall_f1", "accuracy_gap", "f1_gap",
    "false_negative_rate_gap", "selection_rate_gap", "high_risk_false_negative_rate_gap",
    "high_risk_selection_rate_gap", "fairness_flag", "notes",
]


def group_text(name: str) -> Column:
    """Group value as text: whole codes without a decimal point, other texts as they are."""
    value = F.col(name).try_cast("double")
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(F.col(name).cast("string"))


def _aggregates(labels: Sequence[str]) -> list[Column]:
    levels = ", ".join(f"'{x}'" for x in HIGH_RISK)
    true_high = f"coalesce(y_true IN ({levels}), false)"
    predicted_high = f"coalesce(y_pred IN ({levels}), false)"
    return [
        F.expr("coalesce(sum(n), 0)").alias("n_rows"),
        *class_totals(labels),
        F.expr(sum_where("NOT y_pred <=> 'Minimal'")).alias("n_selected"),
        F.expr(sum_where(true_high)).alias("n_high"),
        F.expr(sum_where(predicted_high)).alias("n_high_predicted"),
        F.expr(sum_where(f"{true_high} AND NOT {predicted_high}")).alias("n_high_missed"),
    ]


def _rates(labels: Sequence[str]) -> dict[str, Column]:
    """Metric expressions over the aggregates.

    Summed over all classes, every wrong row is one false negative and one false
    positive, which gives the two error rates in closed form.
    """
    right = hits(labels)
    texts = {
        "accuracy": ratio(right, "n_rows"),
        "precision": weighted(class_precision, labels),
        "recall": weighted(class_recall, labels),
        "f1": weighted(class_f1, labels),
        "false_positive_rate": ratio(f"n_rows - {right}", f"n_rows * {len(labels) - 1}"),
        "false_negative_rate": ratio(f"n_rows - {right}", "n_rows"),
        "selection_rate": ratio("n_selected", "n_rows"),
        "high_risk_false_negative_rate": ratio("n_high_missed", "n_high"),
        "high_risk_selection_rate": ratio("n_high_predicted", "n_rows"),
    }
    return {name: F.expr(text) for name, text in texts.items()}


def fairness_overall(df: DataFrame, labels: Sequence[str] = CLASS_LABELS) -> DataFrame:
    """The six baseline metrics over all rows."""
    rates = _rates(labels)
    return (
        pair_counts(df)
        .agg(*_aggregates(labels))
        .select(*[rates[name].alias(name) for name in BASELINES])
    )


def fairness_flag(size: Column, fnr_gap: Column, f1_gap: Column, accuracy_gap: Column) -> Column:
    return (
        F.when(size < MIN_GROUP_SIZE, "Low Sample Size")
        .when(fnr_gap > GAP_LIMIT, "Warning")
        .when((f1_gap < -GAP_LIMIT) | (accuracy_gap < -GAP_LIMIT), "Review")
        .otherwise("OK")
    )


def fairness_note(flag: Column, label: Column) -> Column:
    few = f" has fewer than {MIN_GROUP_SIZE} test rows; interpret with caution."
    ending = (
        F.when(flag == "Low Sample Size", few)
        .when(flag == "Warning", " has a higher false-negative gap than the overall test set.")
        .when(flag == "Review", " has lower model performance than the overall test set.")
        .otherwise(" is within the configured review thresholds.")
    )
    return F.concat(label, ending)


def fairness_report(
    df: DataFrame,
    groups: Sequence[str] = FAIRNESS_GROUPS,
    labels: Sequence[str] = CLASS_LABELS,
) -> DataFrame:
    """Metrics of every value of every group column against the overall row.

    Rows are first counted per combination of groups and labels, before any
    shuffle; the four group columns are then unfolded over these few counts.
    """
    texts = {g: group_text(g) for g in groups}
    cells = pair_counts(df.withColumns(texts), by=groups)
    per_group = (
        cells.unpivot(["y_true", "y_pred", "n"], list(groups), "group_column", "group_value")
        .where(F.col("group_value").isNotNull())
        .groupBy("group_column", "group_value")
        .agg(*_aggregates(labels))
    )
    rates = _rates(labels)
    baseline = (
        cells.agg(*_aggregates(labels))
        .select(F.struct(*[rates[name].alias(name) for name in BASELINES]).alias("overall"))
        .scalar()
    )
    measured = per_group.withColumns({**rates, "overall": baseline})
    gaps = {f"{m}_gap": F.col(m) - F.col(f"overall.{m}") for m in BASELINES}
    label = group_label(F.col("group_column"), F.col("group_value"))
    judged = measured.withColumns(
        {
            **gaps,
            "group_label": label,
            "sample_size": F.col("n_rows"),
            "min_group_size": F.lit(MIN_GROUP_SIZE),
            "risk_percentage": F.col("selection_rate") * 100,
            "overall_accuracy": F.col("overall.accuracy"),
            "overall_f1": F.col("overall.f1"),
        }
    ).withColumn(
        "fairness_flag",
        fairness_flag(
            F.col("sample_size"),
            F.col("false_negative_rate_gap"),
            F.col("f1_gap"),
            F.col("accuracy_gap"),
        ),
    ).withColumn("notes", fairness_note(F.col("fairness_flag"), F.col("group_label")))
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("group_column"))
    whole = {"group_column", "group_value", "group_label", "sample_size", "min_group_size",
             "fairness_flag", "notes"}
    return judged.orderBy(place, "group_value").select(
        *[F.col(c) if c in whole else half_even(F.col(c), 4).alias(c) for c in REPORT_COLUMNS]
    )


def fairness_disparities(report: DataFrame) -> DataFrame:
    """Largest differences inside each group column that has at least two groups."""

    def spread(column: str) -> Column:
        return F.max(column) - F.min(column)

    return (
        report.groupBy("group_column")
        .agg(
            F.count(F.lit(1)).alias("n_groups"),
            spread("accuracy").alias("accuracy_disparity"),
            spread("false_positive_rate").alias("fpr_disparity"),
            spread("false_negative_rate").alias("fnr_disparity"),
            spread("selection_rate").alias("selection_rate_disparity"),
        )
        .where(F.col("n_groups") >= 2)
    )


def fairness_ranking(report: DataFrame) -> DataFrame:
    """Groups of each group column by risk, highest first, with their band."""
    order = Window.partitionBy("group_column").orderBy(
        F.desc("risk_percentage"), "group_value"
    )
    return report.select(
        "group_column",
        "group_value",
        "group_label",
        "risk_percentage",
        F.row_number().over(order).alias("risk_rank"),
        report_band(F.col("risk_percentage")).alias("band"),
    )


def fairness_summary(report: DataFrame) -> DataFrame:
    """One row: extreme groups, bias verdict and the full report records of each column in ``groups``.

    The records of a column (a map entry) come by risk, highest first. An empty report gives the
    "not available" row.
    """
    risk = F.col("risk_percentage")
    per_column = report.groupBy("group_column").agg(
        F.min_by("group_value", F.struct(-risk, "group_value")).alias("highest"),
        F.max_by("group_value", F.struct(-risk, "group_value")).alias("lowest"),
        F.count(F.lit(1)).alias("n_groups"),
        (F.max(risk) - F.min(risk)).alias("spread"),
        F.transform(
            F.array_sort(
                F.collect_list(F.struct((-risk).alias("r"), "group_value", F.struct(*report.columns).alias("record")))
            ),
            lambda g: g["record"],
        ).alias("groups"),
    )

    def of(column: str, value: str) -> Column:
        return F.max(F.when(F.col("group_column") == column, F.col(value)))

    widest = F.max(F.when(F.col("n_groups") >= 2, F.col("spread")))
    return per_column.agg(
        of("AGE_GROUP", "highest").alias("highest_risk_age_group"),
        of("AGE_GROUP", "lowest").alias("lowest_risk_age_group"),
        of("RIAGENDR", "highest").alias("highest_risk_gender"),
        of("RIAGENDR", "lowest").alias("lowest_risk_gender"),
        of("RIDRETH1", "highest").alias("highest_risk_race"),
        F.coalesce(widest, F.lit(0.0)).alias("max_disparity"),
        (F.coalesce(widest, F.lit(0.0)) >= BIAS_POINTS).alias("bias_detected"),
        F.when(F.count(F.lit(1)) == 0, BIAS_UNKNOWN)
        .when(F.coalesce(widest, F.lit(0.0)) >= BIAS_POINTS, BIAS_FOUND)
        .otherwise(BIAS_NOT_FOUND)
        .alias("fairness_warning"),
        F.map_from_entries(F.collect_list(F.struct("group_column", "groups"))).alias("groups"),
    )


def summary_records(summary: DataFrame) -> DataFrame:
    """The report records inside a summary as rows, with their ``place`` in their column, from 1."""
    columns = summary.select(F.explode("groups").alias("group_column", "records"))
    return columns.select(F.posexplode("records").alias("_place", "_record")).select(
        (F.col("_place") + 1).alias("place"), "_record.*"
    )


def with_fairness_flag(
    visits: DataFrame, summary: DataFrame | None, band: str = "risk_band"
) -> DataFrame:
    """Add ``fairness_flag``: in a biased report, high band or the highest-risk age group.

    The summary is one row, read once as a scalar. Without a report only the
    band counts.
    """
    high = F.col(band).eqNullSafe("High")
    if summary is None:
        return visits.withColumn("fairness_flag", high)
    verdict = summary.select(F.struct("bias_detected", "highest_risk_age_group")).scalar()
    in_group = F.col("AGE_GROUP").eqNullSafe(verdict["highest_risk_age_group"])
    return visits.withColumn("fairness_flag", verdict["bias_detected"] & (high | in_group))


def fairness_inventory(report: DataFrame) -> DataFrame:
    """Rows, group columns and small groups of a report."""
    return report.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array_join(F.array_sort(F.collect_set("group_column")), ",").alias("group_columns"),
        F.count_if(F.col("fairness_flag") == "Low Sample Size").alias("low_sample_size_rows"),
    )
