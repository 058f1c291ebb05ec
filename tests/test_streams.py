"""Streams: state across batches, late visits, replays."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from visitgauge.operators import history
from visitgauge.plans.scoring import boundary_requests, score_rules
from visitgauge.streaming import visits as streams
from workload import views

SCHEMA = (
    "visit_id bigint, patient_id string, created_at timestamp, phq9_total bigint, "
    "predicted_severity string, risk_band string"
)


def add(spark, folder, rows):
    full = [(*r, "Mild", None) for r in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def day(n):
    return dt.datetime(2024, 3, n)


BATCHES = [
    [(1, "A", day(1), 10), (3, "A", day(3), 7), (2, "B", day(2), 5)],
    # One visit of A is older than stored ones, two are newer.
    [(5, "A", day(6), 9), (4, "A", day(5), 8), (6, "A", day(2), 1), (7, "C", day(1), 2)],
]
CHANGES = {
    1: (None, "insufficient_history"), 6: (10, "improved"), 3: (1, "worsened"),
    4: (7, "worsened"), 5: (8, "worsened"), 2: (None, "insufficient_history"),
    7: (None, "insufficient_history"),
}


def changes(spark, out):
    rows = streams.read_visit_changes(spark, out).collect()
    assert len({r["visit_id"] for r in rows}) == len(rows)
    return {r["visit_id"]: (r["previous_total"], r["status"]) for r in rows}


def test_late_visits_correct_the_visit_behind_them(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in BATCHES:
        add(spark, source, rows)
        schema = spark.read.parquet(source).schema
        streams.visit_changes(streams.read_stream(spark, source, schema), out, state)
    assert changes(spark, out) == CHANGES


def test_replayed_batches_change_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for turn in range(2):
        for rows in BATCHES if turn == 0 else []:
            add(spark, source, rows)
        schema = spark.read.parquet(source).schema
        for name, follow in (("changes", streams.visit_changes), ("days", streams.daily_activity)):
            # A new checkpoint gives all files again, under the same batch numbers.
            stream = streams.read_stream(spark, source, schema, files_per_batch=1)
            follow(stream, f"{out}/{name}", str(tmp_path / f"state-{name}-{turn}"))
    assert changes(spark, f"{out}/changes") == CHANGES
    days = {r["visit_day"]: r["n_visits"] for r in streams.read_daily_activity(spark, f"{out}/days").collect()}
    assert days == {"2024-03-01": 2, "2024-03-02": 2, "2024-03-03": 1, "2024-03-05": 1, "2024-03-06": 1}


@pytest.mark.parametrize("files_per_batch", [3, 64])
def test_many_files_give_what_one_file_gives(spark, tmp_path, files_per_batch):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    source = str(tmp_path / "in")
    # Rows of a patient and of a day are spread over the files in an order of their own.
    orders.repartition(12, F.hash("o_orderkey")).write.parquet(source)
    read = streams.read_stream(spark, source, orders.schema, files_per_batch)
    visits = views.as_history(views.with_answers(read, views.VISIT_HEAD))
    days, moves = str(tmp_path / "days"), str(tmp_path / "moves")
    streams.daily_activity(visits, days, f"{days}-state")
    streams.visit_changes(visits, moves, f"{moves}-state")
    whole = views.history(spark, "/root/testdata/sf0.001")
    trend = history.patient_trend(whole).select("patient_id", "visit_id", "total", "previous_total")
    found = streams.read_visit_changes(spark, moves).select("patient_id", "visit_id", "total", "previous_total")
    assert sorted(map(str, found.collect())) == sorted(map(str, trend.collect()))
    daily = whole.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("d")).count()
    assert {(r["visit_day"], r["n_visits"]) for r in streams.read_daily_activity(spark, days).collect()} == {
        tuple(r) for r in daily.collect()
    }


def test_days_stay_in_state_only_around_the_watermark(spark, tmp_path):
    """150 files give what one gives; the state holds a few days; visits behind the watermark count on the side."""
    rows = [(k, "A", dt.datetime(2024, 1, 1) + dt.timedelta(hours=10 * k), k % 28) for k in range(150)]
    late = [(900 + k, "B", dt.datetime(2024, 1, 1 + k), 5) for k in range(3)]
    found = []
    for name, files in (("many", 150), ("one", 1)):
        source, out, state = (str(tmp_path / f"{name}-{n}") for n in ("in", "out", "state"))
        frame = spark.createDataFrame([(*r, "Mild", None) for r in rows], SCHEMA)
        frame.repartitionByRange(files, "created_at").write.parquet(source)
        stream = streams.read_stream(spark, source, frame.schema, files_per_batch=25)
        query = streams.daily_activity(stream, out, state)
        if name == "many":
            held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
            assert len(held) >= 6 and held[-1] <= 15
        add(spark, source, late)
        query = streams.daily_activity(streams.read_stream(spark, source, frame.schema, files_per_batch=25), out, state)
        assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress) >= 3
        found.append(sorted(map(tuple, streams.read_daily_activity(spark, out).collect())))
    assert found[0] == found[1]
    days = {}
    for _, _, at, total in rows + late:
        days.setdefault(f"{at:%Y-%m-%d}", []).append(total)
    assert {(d, n) for d, n, _ in found[0]} == {(d, len(t)) for d, t in days.items()}


def test_batches_read_the_buckets_of_their_patients(spark, tmp_path, monkeypatch):
    """Files read follow the batch's patients, compacted or not, and results don't change with compaction."""
    monkeypatch.setattr(streams, "COMPACT_AFTER", 3)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    everyone = [(k, f"P{k}", day(1), k % 27) for k in range(400)]
    last = [(1000 + k, "P7", day(2 + k), k) for k in range(7)]
    for rows in [everyone, *[[r] for r in last]]:
        add(spark, source, rows)
        schema = spark.read.parquet(source).schema
        streams.visit_changes(streams.read_stream(spark, source, schema), out, state)
    found = {r["visit_id"]: r["previous_total"] for r in streams.read_visit_changes(spark, out).collect()}
    assert found == {k: None for k in range(400)} | {1000: 7} | {1000 + k: k - 1 for k in range(1, 7)}
    assert sorted(p.name for p in (tmp_path / "out" / "base").iterdir()) == ["version=2", "version=5"]
    assert sorted(p.name for p in (tmp_path / "out" / "visits").iterdir()) == [f"batch={n}" for n in (3, 4, 5, 6, 7)]
    bucket = spark.createDataFrame([("P7",)], "patient_id string").select(streams._bucket()).first()[0]
    some = streams.stored_visits(spark, out, 7, [bucket])
    assert len(some.inputFiles()) > len([f for f in some.inputFiles() if f"bucket={bucket}/" in f])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan
    assert {r["patient_id"] for r in some.collect()} >= {"P7"} and some.count() < 60


def test_running_counts_grow_and_old_versions_go(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([(1, "A", day(1), 5)], [(2, "A", day(2), 5), (3, "B", day(2), 5)], [(4, "C", day(3), 5)]):
        add(spark, source, rows)
        schema = spark.read.parquet(source).schema
        counts = streams.running_counts(streams.read_stream(spark, source, schema))
        streams.publish_counts(counts, out, state)
    assert [tuple(r) for r in streams.published(spark, out).collect()] == [("Low", "Mild", 4)]
    assert len(list((tmp_path / "out").iterdir())) == 2


def test_scored_requests_are_appended_and_duplicates_kept(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    requests = boundary_requests(spark, (5,)).withColumn("patient_name", F.lit("Robin Vale"))
    for _ in range(2):
        requests.write.mode("append").parquet(source)
        schema = spark.read.parquet(source).schema
        streams.score_and_append(
            streams.read_stream(spark, source, schema), score_rules, out, state
        )
    saved = spark.read.parquet(out).collect()
    assert len(saved) == 2 and len({r["visit_id"] for r in saved}) == 2
    assert {r["patient_id"] for r in saved} == {saved[0]["patient_id"]}
    assert {r["batch"] for r in saved} == {0, 1}
