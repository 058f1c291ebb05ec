"""Classification metrics and fairness against published numbers and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from visitgauge.operators import agreement, fairness
from visitgauge.schema import CLASS_LABELS, FAIRNESS_GROUPS

# Published results of the chosen model, classes in alphabetical order.
MATRIX = [[253, 0, 1, 0, 0], [0, 1205, 0, 0, 0], [3, 0, 89, 3, 0], [0, 0, 3, 36, 2], [0, 0, 0, 2, 15]]
RISK = {
    "RIAGENDR": {"1": 19.3631, "2": 30.8343},
    "AGE_GROUP": {"18-29": 23.0769, "30-44": 22.5888, "45-59": 28.9894, "60+": 25.9921},
    "RIDRETH1": {"1": 27.3973, "2": 28.6765, "3": 25.0678, "4": 26.9231, "5": 18.8406},
    "INDHHIN2": {
        "1": 36.6667, "2": 33.871, "3": 38.2979, "4": 34.0, "5": 27.4809, "6": 30.9211,
        "7": 31.2102, "8": 22.0472, "9": 18.0723, "10": 21.875, "12": 31.5789, "13": 31.5789,
        "14": 17.3611, "15": 15.047,
    },
}


@pytest.fixture(scope="module")
def published(spark):
    cells = [
        (a, b, MATRIX[i][j])
        for i, a in enumerate(CLASS_LABELS)
        for j, b in enumerate(CLASS_LABELS)
        if MATRIX[i][j]
    ]
    df = spark.createDataFrame(cells, "y_true string, y_pred string, n int")
    return df.select("y_true", "y_pred", F.explode(F.sequence(F.lit(1), "n")).alias("i"))


def test_published_metrics(published):
    row = agreement.model_metrics(published).first()
    assert row["accuracy"] == 0.9913151364764268
    assert row["precision"] == pytest.approx(0.9912763126517516, abs=1e-15)
    assert row["recall"] == pytest.approx(0.9913151364764268, abs=1e-15)
    assert row["f1"] == pytest.approx(0.9912870047443506, abs=1e-15)
    assert row["test_size"] == 1612


def test_published_class_report(published):
    rows = {r["label"]: r for r in agreement.classification_report(published).collect()}
    expected = {"Mild": (0.9922, 254), "Minimal": (1.0, 1205), "Moderate": (0.9468, 95),
                "Moderately Severe": (0.8780, 41), "Severe": (0.8824, 17)}
    for label, (f1, support) in expected.items():
        assert round(rows[label]["f1"], 4) == f1 and rows[label]["support"] == support
    macro = rows["macro avg"]
    assert [round(macro[c], 5) for c in ("f1", "precision", "recall")] == [0.93987, 0.94113, 0.93866]


def test_confusion_matrix_keeps_empty_cells(published):
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in agreement.confusion_matrix(published).collect()}
    assert [[cells[a, b] for b in CLASS_LABELS] for a in CLASS_LABELS] == MATRIX


def test_no_rows_give_zero_metrics(published):
    assert list(agreement.model_metrics(published.limit(0)).first())[1:] == [0.0] * 4


def test_best_model_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame(
        [(0, "a", 0.5), (1, "b", 0.9), (2, "c", 0.9)], "ordinal int, candidate string, f1 double"
    )
    assert agreement.select_best(df).first()["candidate"] == "b"


def brute_group(rows):
    n, k = len(rows), len(CLASS_LABELS)
    tp = sum(a == b for a, b in rows)
    fp = sum(sum(b == c and a != c for a, b in rows) for c in CLASS_LABELS)
    tn = sum(sum(b != c and a != c for a, b in rows) for c in CLASS_LABELS)
    f1 = 0.0
    for c in CLASS_LABELS:
        hits = sum(a == b == c for a, b in rows)
        s, p = sum(a == c for a, _ in rows), sum(b == c for _, b in rows)
        f1 += s * (2 * hits / (s + p) if s + p else 0.0)
    return {"accuracy": tp / n, "false_positive_rate": fp / (fp + tn),
            "false_negative_rate": 1 - tp / n, "f1": f1 / n, "sample_size": n}


@pytest.fixture(scope="module")
def random_scores(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        true = rng.choice(CLASS_LABELS)
        # One gender holds most rows; the small ones fall below the sample limit.
        gender = rng.choice([1] * 30 + [2] * 10 + [9, None])
        wrong = 0.4 if gender == 2 else 0.05
        rows.append((gender, rng.choice(["18-29", None, "60+"]), rng.choice([3, 99]),
                     rng.choice([1.0, 123.0]), true,
                     rng.choice(CLASS_LABELS) if rng.random() < wrong else true))
    return spark.createDataFrame(
        rows, "RIAGENDR int, AGE_GROUP string, RIDRETH1 int, INDHHIN2 double, y_true string, y_pred string"
    )


def test_fairness_report_equals_brute_force(random_scores):
    rows = random_scores.collect()
    report = fairness.fairness_report(random_scores).collect()
    overall = brute_group([(r["y_true"], r["y_pred"]) for r in rows])
    seen = set()
    for line in report:
        def text(v):
            return v if isinstance(v, str) or v is None else str(int(v))

        part = [(r["y_true"], r["y_pred"]) for r in rows
                if text(r[line["group_column"]]) == line["group_value"]]
        expected = brute_group(part)
        for name, value in expected.items():
            assert line[name] == pytest.approx(value, abs=5.1e-5), name
        assert line["f1_gap"] == pytest.approx(expected["f1"] - overall["f1"], abs=5.1e-5)
        flag = "OK"
        if len(part) < 20:
            flag = "Low Sample Size"
        elif expected["false_negative_rate"] - overall["false_negative_rate"] > 0.10:
            flag = "Warning"
        assert line["fairness_flag"] == flag
        seen.add((line["group_column"], line["group_value"]))
    assert ("RIAGENDR", "9") in seen and ("INDHHIN2", "123") in seen
    assert not any(v is None for _, v in seen)
    labels = {(r["group_column"], r["group_value"]): r["group_label"] for r in report}
    assert labels["RIDRETH1", "99"] == "Unknown / Other (99)"
    assert labels["RIAGENDR", "1"] == "Male"
    assert [r["group_column"] for r in report] == sorted(
        [r["group_column"] for r in report], key=FAIRNESS_GROUPS.index
    )


def published_report(spark):
    rows = [(g, v, v, p, p / 100) for g, values in RISK.items() for v, p in values.items()]
    return spark.createDataFrame(
        rows, "group_column string, group_value string, group_label string, "
        "risk_percentage double, selection_rate double"
    )


def test_summary_of_the_published_report(spark):
    report = published_report(spark)
    row = fairness.fairness_summary(report).first()
    ages = row["groups"]["AGE_GROUP"]
    assert set(ages[0].asDict()) == set(report.columns)
    assert [a["risk_percentage"] for a in ages] == sorted((a["risk_percentage"] for a in ages), reverse=True)
    assert fairness.summary_records(fairness.fairness_summary(report)).drop("place").exceptAll(report).count() == 0
    assert row["bias_detected"] and round(row["max_disparity"], 4) == 23.2509
    assert (row["highest_risk_age_group"], row["lowest_risk_age_group"]) == ("45-59", "30-44")
    assert (row["highest_risk_gender"], row["lowest_risk_gender"]) == ("2", "1")
    assert row["highest_risk_race"] == "2"
    assert [g["group_value"] for g in row["groups"]["AGE_GROUP"]] == ["45-59", "60+", "18-29", "30-44"]


def test_summary_without_report(spark):
    row = fairness.fairness_summary(published_report(spark).limit(0)).first()
    assert not row["bias_detected"] and row["highest_risk_age_group"] is None
    assert row["fairness_warning"] == "Fairness report is not available yet."
    assert row["groups"] == {}


def test_single_groups_have_no_disparity(spark):
    report = published_report(spark).where("group_value = '1'").withColumns(
        {c: F.lit(0.5) for c in ("accuracy", "false_positive_rate", "false_negative_rate")}
    )
    assert fairness.fairness_disparities(report).count() == 0
    assert fairness.fairness_summary(report).first()["max_disparity"] == 0.0


def test_patient_flag_with_and_without_report(spark):
    visits = spark.createDataFrame(
        [("Low", "45-59"), ("Low", "18-29"), ("High", "18-29"), ("Low", None)],
        "risk_band string, AGE_GROUP string",
    )
    summary = fairness.fairness_summary(published_report(spark))
    flags = [r["fairness_flag"] for r in fairness.with_fairness_flag(visits, summary).collect()]
    assert flags == [True, False, True, False]
    flags = [r["fairness_flag"] for r in fairness.with_fairness_flag(visits, None).collect()]
    assert flags == [False, False, True, False]
