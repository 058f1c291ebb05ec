"""Saved visits: comparisons, trends, directory, stats, search, storage."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from visitgauge.operators import history, sequence
from visitgauge.sources import visits as store

SCHEMA = (
    "visit_id bigint, patient_id string, patient_name string, created_at timestamp, "
    "visit_date string, phq9_total bigint, predicted_severity string, risk_band string, "
    "risk_score double"
)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def visits(spark):
    rows = [
        (1, "A", "Old Name", at(1), "2024-01-01", 12, "Moderate", "Medium", 0.5),
        (2, "A", "", at(2), None, 7, "Mild", "", 0.25),
        (3, "A", "New Name", at(2), "", 20, "Severe", "High", None),
        (4, "B", "", at(3), "2024-01-09", 0, "Minimal", None, 0.9),
        (5, "", "Nobody", at(4), None, None, "", "High", 0.1),
        (6, "C", "Cy", at(5), "2023-12-31", 3, "Minimal", "Low", 0.2),
        (7, "C", "Cy", at(4), "2024-02-01", 3, "Minimal", "Low", 0.3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_comparison(visits):
    rows = {r["patient_id"]: r for r in history.patient_comparison(visits).collect()}
    assert set(rows) == {"A", "B", "C"}
    a = rows["A"]
    assert (a["latest_visit_id"], a["previous_visit_id"], a["phq9_change"]) == (3, 2, 13)
    assert a["risk_score_change"] == -0.25
    assert (a["status"], a["summary"]) == (
        "worsened", "Patient worsened by 13 PHQ-9 points since last visit.",
    )
    assert rows["B"]["status"] == "insufficient_history" and rows["B"]["phq9_change"] == 0
    assert rows["C"]["status"] == "no_change"
    other = {r["patient_id"]: r for r in
             history.patient_comparison(visits, history.SERVICE_WORDS).collect()}
    assert other["A"]["summary"] == "Patient condition worsened by 13 PHQ-9 points."


def test_comparison_limits_rows_before_the_shuffle(visits, capsys):
    history.patient_comparison(visits).explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1


def random_visits(spark, n=2000):
    # A third of all visits belongs to one patient, all at a handful of times.
    return spark.range(n).select(
        F.col("id").alias("visit_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("p"), (F.col("id") % 97).cast("string"))
        ).alias("patient_id"),
        F.timestamp_seconds((F.col("id") * 7919) % 5 * 86400).alias("created_at"),
        F.lit(None).cast("string").alias("visit_date"),
        (F.col("id") * 31 % 28).alias("phq9_total"),
        (F.col("id") % 100 / 100).alias("risk_score"),
    )


@pytest.mark.parametrize("hot_rows", [20, 100, 10_000])
def test_spread_trend_equals_plain_window(spark, hot_rows):
    visits = random_visits(spark)
    found = {r["visit_id"]: r for r in history.patient_trend(visits, hot_rows=hot_rows).collect()}
    last, place = {}, {}
    rows = visits.collect()
    assert len(found) == len(rows)
    for r in sorted(rows, key=lambda r: (r["created_at"], r["visit_id"])):
        p = r["patient_id"]
        place[p] = place.get(p, 0) + 1
        got = found[r["visit_id"]]
        assert (got["previous_total"], got["position"]) == (last.get(p), place[p])
        last[p] = r["phq9_total"]


def test_hot_rows_leave_no_single_large_group(spark):
    visits = random_visits(spark).select("patient_id", "created_at", "visit_id", "phq9_total")
    hot = visits.where("patient_id = 'hot'")
    runs = hot.repartitionByRange(12, "patient_id", "created_at", "visit_id").groupBy(
        F.spark_partition_id().alias("run")
    ).count().collect()
    assert len(runs) > 6 and max(r["count"] for r in runs) < hot.count() / 3
    spread = sequence._spread(hot, "patient_id", ["created_at", "visit_id"], ["phq9_total"], 12)
    assert spread.count() == hot.count()


def test_trend_arrays_are_whole_and_follow_months(spark):
    visits = random_visits(spark)
    arrays = history.trend_arrays(visits, hot_rows=100).collect()
    assert sum(len(r["trend"]) for r in arrays) == 2000
    assert all(int(f"{p['created_at']:%Y%m}") == r["part"] for r in arrays for p in r["trend"])
    hot = sorted((r["part"], r["trend"]) for r in arrays if r["patient_id"] == "hot")
    points = [p for _, part in hot for p in part]
    assert [p["position"] for p in points] == list(range(1, len(points) + 1))
    assert points == sorted(points, key=lambda p: (p["created_at"], p["visit_id"]))
    # Months that were complete don't change when later ones come.
    first = hot[0][0]
    early = history.trend_arrays(visits.where(F.date_format("created_at", "yyyyMM").cast("int") <= first)).collect()
    assert [r["trend"] for r in early if r["patient_id"] == "hot"] == [hot[0][1]]


def test_stats_count_any_level_and_fall_back_to_the_saved_one(spark):
    rows = [(1, "Mild", "Severe", "High"), (2, None, "Severe", ""), (3, "", None, "Odd"), (4, "New level", "Mild", "Low")]
    visits = spark.createDataFrame(rows, "visit_id bigint, predicted_severity string, severity string, risk_band string")
    visits = visits.withColumns(
        {"created_at": F.make_timestamp(F.lit(2024), F.lit(1), F.col("visit_id"), F.lit(0), F.lit(0), F.lit(0)),
         "phq9_total": F.lit(3), "risk_score": F.lit(0.1234567)}
    )
    row = history.dashboard_stats(visits).first()
    assert row["severity_counts"] == {"Mild": 1, "Severe": 1, "Unknown": 1, "New level": 1}
    assert row["risk_band_counts"] == {"High": 1, "Low": 2, "Medium": 0, "Odd": 1}
    other = history.stats_variant(visits).first()
    assert other["severity_counts"] == row["severity_counts"]
    assert other["risk_band_counts"] == {"High": 2, "Low": 1, "Medium": 0, "Odd": 1}
    empty = history.dashboard_stats(visits.limit(0)).first()
    assert empty["severity_counts"] == {} and empty["risk_band_counts"] == {"High": 0, "Medium": 0, "Low": 0}


def test_service_comparison_falls_back_to_the_nested_total(spark):
    rows = [(1, "A", None, (7,)), (2, "A", 0, (4,)), (3, "B", 5, (9,)), (4, "B", 6, None)]
    visits = spark.createDataFrame(rows, "visit_id bigint, patient_id string, phq9_total int, input_data struct<PHQ9_TOTAL: int>")
    visits = visits.withColumns({"created_at": F.current_timestamp(), "risk_score": F.lit(0.5)})
    changes = {r["patient_id"]: r for r in history.patient_comparison(visits, history.SERVICE_WORDS).collect()}
    assert (changes["A"]["previous_total"], changes["A"]["latest_total"]) == (7, 4) and changes["B"]["phq9_change"] == 1
    assert {r["phq9_change"] for r in history.patient_comparison(visits).collect()} == {0, 1}


def test_directory(visits):
    rows = {r["patient_id"]: r for r in history.patient_directory(visits).collect()}
    assert rows["A"]["patient_name"] == "Old Name" and rows["A"]["visit_count"] == 3
    assert rows["A"]["label"] == "Old Name - A (3 visits)"
    assert rows["B"]["label"] == "B (1 visit)"
    assert rows["C"]["latest_visit"] == "2024-02-01"
    assert "" not in rows


def test_latest_report_goes_by_visit_text(visits):
    rows = {r["patient_id"]: r["visit_id"] for r in history.latest_report(visits).collect()}
    assert rows == {"A": 3, "B": 4, "C": 7}


def test_dashboard(visits):
    row = history.dashboard_stats(visits).first()
    assert row["total_predictions"] == 7
    assert (row["high_risk_count"], row["medium_risk_count"], row["low_risk_count"]) == (2, 1, 4)
    assert row["average_risk_score"] == round(2.25 / 7, 4)
    assert row["average_phq9_total"] == round(45 / 7, 2)
    assert row["n_unknown"] == 1 and row["n_minimal"] == 3
    capped = history.dashboard_stats(visits, newest_only=2).first()
    assert capped["total_predictions"] == 2


def test_empty_history(visits):
    none = visits.limit(0)
    row = history.dashboard_stats(none).first()
    assert row["total_predictions"] == 0 and row["average_risk_score"] == 0.0
    assert row["latest_prediction_time"] is None
    other = history.stats_variant(none).first()
    assert (other["total_predictions"], other["most_common_severity"]) == (0, "N/A")
    assert history.patient_comparison(none).count() == 0
    assert history.newest(none).count() == 0
    assert history.mean_nonzero_total(none).first() == (0, 0.0)


def test_stats_variant_takes_band_from_level_and_first_seen_on_ties(visits):
    row = history.stats_variant(visits.where("visit_id in (1, 2, 4)")).first()
    assert (row["high_risk_patients"], row["medium_risk_patients"], row["low_risk_patients"]) == (0, 1, 2)
    assert row["most_common_severity"] == "Minimal"


def test_days_and_means(visits):
    rows = {r["visit_day"]: tuple(r)[1:] for r in history.daily_activity(visits).collect()}
    assert rows["2024-01-02"] == (2, 13.5) and rows["2023-12-31"] == (1, 3.0)
    assert history.mean_nonzero_total(visits).first() == (5, 9.0)


def test_search(visits):
    def ids(**conditions):
        found = history.history_search(visits, **conditions)
        return sorted(r["visit_id"] for r in found.collect())

    assert ids(name="NAME") == [1, 3]
    assert ids(level="Minimal", band="Low") == [4, 6, 7]
    assert ids(since="2024-01-02", until="2024-01-04") == [2, 3, 5]
    assert ids(patient_id="C", since="2024-01-01") == [7]
    assert ids() == [1, 2, 3, 4, 5, 6, 7]


def test_recent_activity_fills_blanks(visits):
    row = history.recent_activity(visits.where("visit_id = 5")).first()
    assert (row["patient_id"], row["severity"], row["phq9_total"]) == ("No ID", "Unknown", "-")
    assert row["visit_day"] == "2024-01-04" and row["risk_percent"] == 10


def test_store_and_export(spark, visits, tmp_path):
    path = str(tmp_path / "visits")
    with pytest.raises(FileNotFoundError):
        store.read_visits(spark, path)
    fresh = visits.drop("visit_id", "created_at").withColumn("input_data", F.struct("phq9_total"))
    store.append_visits(fresh, path)
    store.append_visits(fresh, path)
    saved = store.read_visits(spark, path)
    assert saved.count() == 14 and saved.select("visit_id").distinct().count() == 14
    assert saved.where("created_at is null or timestamp is null").count() == 0
    document = json.loads(store.as_json(visits.where("visit_id = 1")).first()[0])
    assert document["visit_id"] == "1" and document["created_at"].startswith("2024-01-01T00:00:00")
