"""Saved visits: lists, comparisons, trends, directories and dashboard numbers.

A visit table has ``visit_id``, ``patient_id``, ``patient_name``, ``created_at``,
``visit_date``, ``phq9_total``, ``predicted_severity``, ``risk_band`` and
``risk_score``. Ties in ``created_at`` are broken by ``visit_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgauge.functions.identity import filled, first_filled, visit_day
from visitgauge.functions.scoring import binary_half_even, binary_half_up, half_up, risk_band
from visitgauge.operators.sequence import HOT_ROWS, with_previous
from visitgauge.schema import (
    AGE, DEMOGRAPHIC_CODES, NOT_ENOUGH_VISITS, SEVERITIES, STATS_WINDOW, TOTAL,
)

ORDER = ["created_at", "visit_id"]
BANDS = ["High", "Medium", "Low"]

STORE_WORDS = {
    "less": ("improved", "Patient improved by ", " PHQ-9 points since last visit."),
    "more": ("worsened", "Patient worsened by ", " PHQ-9 points since last visit."),
    "same": ("no_change", "No major PHQ-9 score change since last visit."),
    "none": ("insufficient_history", NOT_ENOUGH_VISITS),
}
SERVICE_WORDS = {
    "less": ("Improved", "Patient condition improved by ", " PHQ-9 points."),
    "more": ("Worsened", "Patient condition worsened by ", " PHQ-9 points."),
    "same": ("No major change", "Patient PHQ-9 score did not change."),
    "none": (None, NOT_ENOUGH_VISITS),
}


def _saved_total(visits: DataFrame, nested: bool) -> Column:
    """The total as a whole number; with ``nested`` that of the saved input stands in for none and for 0."""
    total = F.col("phq9_total")
    fields = dict(visits.dtypes).get("input_data", "")
    if nested and fields.startswith("struct") and TOTAL in visits.schema["input_data"].dataType.names:
        total = F.coalesce(F.nullif(total, F.lit(0)), F.col("input_data")[TOTAL])
    return F.coalesce(total, F.lit(0)).cast("bigint")


def _newest_order() -> list[Column]:
    return [F.desc(c) for c in ORDER]


def visit_value(df: DataFrame) -> Column:
    """Text by which visits are compared: the visit date, else the save time."""
    saved = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(filled(F.col("visit_date")), saved, F.lit(""))


def newest(visits: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` visits."""
    return visits.orderBy(*_newest_order()).limit(n)


def patient_history(visits: DataFrame, patient_id: str, n: int = 100) -> DataFrame:
    """Newest visits of one patient; filter and limit reach the scan."""
    return newest(visits.where(F.col("patient_id") == patient_id), n)


def recent_activity(visits: DataFrame, n: int = 8) -> DataFrame:
    """Newest visits as shown on the dashboard, blanks filled in."""
    level = first_filled(F.col("predicted_severity"), F.lit("Unknown"))
    return newest(visits, n).select(
        "visit_id",
        first_filled(F.col("patient_name"), F.lit("Unnamed")).alias("patient_name"),
        first_filled(F.col("patient_id"), F.lit("No ID")).alias("patient_id"),
        visit_day(F.col("visit_date"), F.col("created_at")).alias("visit_day"),
        F.coalesce(F.col("phq9_total").cast("string"), F.lit("-")).alias("phq9_total"),
        level.alias("severity"),
        F.coalesce(filled(F.col("risk_band")), risk_band(level, "Low")).alias("risk_band"),
        half_up(F.coalesce("risk_score", F.lit(0.0)) * 100).cast("int").alias("risk_percent"),
    )


def change_status(change: Column, words: dict = STORE_WORDS) -> Column:
    return (
        F.when(change < 0, words["less"][0])
        .when(change > 0, words["more"][0])
        .otherwise(words["same"][0])
    )


def change_summary(change: Column, words: dict = STORE_WORDS) -> Column:
    amount = F.abs(change).cast("string")
    return (
        F.when(
            change < 0, F.concat(F.lit(words["less"][1]), amount, F.lit(words["less"][2]))
        )
        .when(
            change > 0, F.concat(F.lit(words["more"][1]), amount, F.lit(words["more"][2]))
        )
        .otherwise(words["same"][1])
    )


def patient_comparison(visits: DataFrame, words: dict = STORE_WORDS) -> DataFrame:
    """Latest against previous visit of every patient.

    The filter on the row number lets Spark keep two rows per patient before the
    shuffle, so a patient with very many visits costs no more than another one.
    """
    newest_first = Window.partitionBy("patient_id").orderBy(*_newest_order())
    two = (
        visits.where(filled(F.col("patient_id")).isNotNull())
        .select("patient_id", *ORDER, _saved_total(visits, words is SERVICE_WORDS).alias("total"), "risk_score")
        .withColumn("rn", F.row_number().over(newest_first))
        .where(F.col("rn") <= 2)
    )

    def at(rank: int, value: Column) -> Column:
        return F.max(F.when(F.col("rn") == rank, value))

    total = F.col("total")
    score = F.coalesce(F.col("risk_score"), F.lit(0.0))
    pairs = two.groupBy("patient_id").agg(
        *[
            column
            for rank, side in ((1, "latest"), (2, "previous"))
            for column in (
                at(rank, F.col("visit_id")).alias(f"{side}_visit_id"),
                at(rank, F.col("created_at")).alias(f"{side}_created_at"),
                at(rank, total).alias(f"{side}_total"),
                at(rank, score).alias(f"{side}_score"),
            )
        ]
    )
    enough = F.col("previous_visit_id").isNotNull()
    change = F.col("latest_total") - F.col("previous_total")
    return pairs.select(
        "patient_id",
        enough.alias("has_comparison"),
        "latest_visit_id",
        "previous_visit_id",
        "latest_created_at",
        "previous_created_at",
        "latest_total",
        "previous_total",
        F.when(enough, change).otherwise(0).cast("bigint").alias("phq9_change"),
        F.when(enough, binary_half_even(F.col("latest_score") - F.col("previous_score"), 4))
        .otherwise(0.0)
        .alias("risk_score_change"),
        F.when(enough, change_status(change, words))
        .otherwise(F.lit(words["none"][0]))
        .alias("status"),
        F.when(enough, change_summary(change, words))
        .otherwise(F.lit(words["none"][1]))
        .alias("summary"),
    )


def patient_trend(visits: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every visit with its change since the visit before it."""
    base = visits.where(filled(F.col("patient_id")).isNotNull()).select(
        "patient_id",
        *ORDER,
        visit_day(F.col("visit_date"), F.col("created_at")).alias("visit_day"),
        F.coalesce(F.col("phq9_total"), F.lit(0)).cast("bigint").alias("total"),
        half_up(F.coalesce("risk_score", F.lit(0.0)) * 100).cast("int").alias("risk_percent"),
    )
    numbered = with_previous(base, "patient_id", ORDER, ["total"], hot_rows)
    return numbered.withColumn("change", F.col("total") - F.col("previous_total"))


def trend_arrays(visits: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Visits of each patient as arrays, oldest first, one array for each calendar month.

    ``part`` is the month as YYYYMM. The shape follows the dates alone, so an array never changes
    when later months come, and it holds what a patient can be seen in a month.
    """
    trend = patient_trend(visits, hot_rows)
    part = F.date_format("created_at", "yyyyMM").cast("int")
    point = F.struct("position", "created_at", "visit_id", "total", "risk_percent")
    return trend.groupBy("patient_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(point)).alias("trend")
    )


def latest_report(visits: DataFrame) -> DataFrame:
    """Latest visit of every patient by visit text, then by save time."""
    by_visit = Window.partitionBy("patient_id").orderBy(
        F.desc("visit_value"), *_newest_order()
    )
    return (
        visits.where(filled(F.col("patient_id")).isNotNull())
        .withColumn("visit_value", visit_value(visits))
        .withColumn("rn", F.row_number().over(by_visit))
        .where(F.col("rn") == 1)
        .select(
            "patient_id", "visit_id", "visit_value", "phq9_total", "predicted_severity"
        )
    )


def patient_prefill(records: DataFrame) -> DataFrame:
    """Demographics of each patient's newest visit, from the nested input first."""
    newest_first = Window.partitionBy("patient_id").orderBy(*_newest_order())
    has_input = "input_data" in records.columns
    nested = (
        [f.name for f in records.schema["input_data"].dataType.fields] if has_input else []
    )

    def value(name: str) -> Column:
        top = F.col(name) if name in records.columns else None
        inner = F.col(f"input_data.{name}") if name in nested else None
        found = [c for c in (inner, top) if c is not None]
        return F.coalesce(*found) if found else F.lit(None)

    fields = [AGE, *DEMOGRAPHIC_CODES]
    return (
        records.where(filled(F.col("patient_id")).isNotNull())
        .select(
            "patient_id", *ORDER, "patient_name", *[value(c).alias(c) for c in fields]
        )
        .withColumn("rn", F.row_number().over(newest_first))
        .where(F.col("rn") == 1)
        .select("patient_id", "visit_id", "patient_name", *fields)
    )


def patient_directory(visits: DataFrame) -> DataFrame:
    """One row per patient: name (the oldest one on record), last visit, count, label."""
    name = filled(F.col("patient_name"))
    people = (
        visits.where(filled(F.col("patient_id")).isNotNull())
        .groupBy("patient_id")
        .agg(
            F.coalesce(
                F.min_by(name, F.when(name.isNotNull(), F.struct(*ORDER))), F.lit("")
            ).alias("patient_name"),
            F.max(visit_value(visits)).alias("latest_visit"),
            F.count(F.lit(1)).alias("visit_count"),
        )
    )
    return people.withColumn(
        "label",
        patient_label(F.col("patient_name"), F.col("patient_id"), F.col("visit_count")),
    ).orderBy("patient_name", "patient_id")


def patient_label(name: Column, patient_id: Column, visits: Column) -> Column:
    base = F.when(filled(name).isNotNull(), F.concat(name, F.lit(" - "), patient_id)).otherwise(
        patient_id
    )
    word = F.when(visits == 1, "visit").otherwise("visits")
    counted = F.concat(base, F.lit(" ("), visits.cast("string"), F.lit(" "), word, F.lit(")"))
    return F.when(visits > 0, counted).otherwise(base)


def _score_sum() -> Column:
    # A decimal sum does not depend on row order. Saved scores have four decimals; of others twelve count.
    return F.sum(F.coalesce("risk_score", F.lit(0.0)).cast("decimal(26,12)"))


def _mean_or_zero(total: Column, count: Column, digits: int) -> Column:
    return F.coalesce(binary_half_even(F.try_divide(total, count), digits), F.lit(0.0))


def _level(visits: DataFrame) -> Column:
    """The predicted level, else the saved one (where visits have it), else "Unknown"."""
    also = [F.col("severity")] if "severity" in visits.columns else []
    return first_filled(F.col("predicted_severity"), *also, F.lit("Unknown"))


def _count_map(name: str, always: Sequence[str] = ()) -> Column:
    """Map of rows by value of the column ``name`` from groups that have it and ``n``, in order; ``always`` even at 0."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col("n"))))
    zero = F.array(*[F.struct(F.lit(x).alias("name"), F.lit(0).cast("bigint").alias("n")) for x in always])
    pairs = F.concat(listed, zero) if always else listed
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["name"])))
    sums = F.transform(
        names,
        lambda x: F.aggregate(
            F.filter(pairs, lambda p: p["name"] == x), F.lit(0).cast("bigint"), lambda total, p: total + p["n"]
        ),
    )
    return F.map_from_arrays(names, sums)


def _by_level_and_band(visits: DataFrame, level: Column, band: Column) -> DataFrame:
    """Counts and sums by level and band: few rows, combined before they are shuffled."""
    return visits.groupBy(level.alias("level"), band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"),
        _score_sum().alias("score"),
        F.sum(F.coalesce(F.col("phq9_total"), F.lit(0)).cast("bigint")).alias("phq"),
        F.max(F.struct(*ORDER)).alias("newest"),
    )


def _rows_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")


def dashboard_stats(visits: DataFrame, newest_only: int | None = STATS_WINDOW) -> DataFrame:
    """Dashboard row over the newest 500 visits; ``None`` takes all of them.

    ``severity_counts`` and ``risk_band_counts`` are maps over all values that occur; the three usual
    bands are in the latter even at 0.
    """
    seen = newest(visits, newest_only) if newest_only else visits
    band = F.coalesce(filled(F.col("risk_band")), F.lit("Low"))
    groups = _by_level_and_band(seen, _level(visits), band)
    total = _rows_where(F.lit(True))
    return groups.agg(
        total.alias("total_predictions"),
        *[_rows_where(F.col("band") == b).alias(f"{b.lower()}_risk_count") for b in BANDS],
        _mean_or_zero(F.sum("score").cast("double"), total, 4).alias("average_risk_score"),
        _mean_or_zero(F.sum("phq"), total, 2).alias("average_phq9_total"),
        F.max("newest.created_at").alias("latest_prediction_time"),
        *[
            _rows_where(F.col("level") == name).alias("n_" + name.lower().replace(" ", "_"))
            for name in [*SEVERITIES, "Unknown"]
        ],
        _count_map("level").alias("severity_counts"),
        _count_map("band", BANDS).alias("risk_band_counts"),
    )


def stats_variant(visits: DataFrame) -> DataFrame:
    """Stats over all given visits, with the most common level (ties: seen first) and both count maps."""
    saved = F.col("severity") if "severity" in visits.columns else F.col("predicted_severity")
    band = F.coalesce(filled(F.col("risk_band")), risk_band(saved))
    groups = _by_level_and_band(visits, _level(visits), band)
    total = _rows_where(F.lit(True))
    per_level = Window.partitionBy("level")
    # Rows of a level in all its bands, and its newest visit; the groups are few.
    groups = groups.withColumns(
        {"level_n": F.sum("n").over(per_level), "level_newest": F.max("newest").over(per_level)}
    )
    return groups.agg(
        total.alias("total_predictions"),
        *[_rows_where(F.col("band") == b).alias(f"{b.lower()}_risk_patients") for b in BANDS],
        _mean_or_zero(F.sum("score").cast("double"), total, 4).alias("average_risk_score"),
        F.coalesce(F.max_by("level", F.struct("level_n", "level_newest")), F.lit("N/A")).alias(
            "most_common_severity"
        ),
        F.max("newest.created_at").alias("latest_prediction_time"),
        _count_map("level").alias("severity_counts"),
        _count_map("band", BANDS).alias("risk_band_counts"),
    )


def map_text(counts: str) -> Column:
    """A count map as text, by name."""
    entries = F.array_sort(F.map_entries(counts))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"])), ",")


def daily_activity(visits: DataFrame) -> DataFrame:
    """Visits and mean total per day."""
    day = visit_day(F.col("visit_date"), F.col("created_at"))
    total = F.coalesce(F.col("phq9_total"), F.lit(0)).cast("bigint")
    return (
        visits.groupBy(day.alias("visit_day"))
        .agg(F.count(F.lit(1)).alias("n_visits"), F.sum(total).alias("sum_total"))
        .where(F.col("visit_day") != "")
        .select(
            "visit_day",
            "n_visits",
            binary_half_up(F.col("sum_total") / F.col("n_visits"), 2).alias("mean_total"),
        )
    )


def mean_nonzero_total(visits: DataFrame) -> DataFrame:
    """Mean of the totals that are not zero, 0 when there is none."""
    total = F.nullif(F.col("phq9_total").cast("bigint"), F.lit(0).cast("bigint"))
    return visits.agg(
        F.count(total).alias("n_nonzero"),
        F.coalesce(F.try_divide(F.sum(total), F.count(total)), F.lit(0.0)).alias("mean_total"),
    )


def history_search(
    visits: DataFrame,
    name: str | None = None,
    level: str | None = None,
    band: str | None = None,
    since: str | None = None,
    until: str | None = None,
    patient_id: str | None = None,
) -> DataFrame:
    """Visits meeting all given conditions; days are compared inclusively as text."""
    day = visit_day(F.col("visit_date"), F.col("created_at"))
    shown_band = F.coalesce(
        filled(F.col("risk_band")), risk_band(F.col("predicted_severity"), "Low")
    )
    found = visits
    if patient_id:
        found = found.where(F.col("patient_id") == patient_id)
    if name:
        found = found.where(F.lower(F.coalesce("patient_name", F.lit(""))).contains(name.lower()))
    if level:
        found = found.where(F.col("predicted_severity") == level)
    if band:
        found = found.where(shown_band == band)
    if since:
        found = found.where(day >= since)
    if until:
        found = found.where(day <= until)
    return found
