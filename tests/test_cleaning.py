"""Reading, checks, cleaning and scoring of single rows."""

from __future__ import annotations

import decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import COMPLETE, NO_ANSWERS
from visitgauge.functions import cleaning, identity, scoring
from visitgauge.operators import merging, quality
from visitgauge.schema import DEMOGRAPHIC_COLUMNS, ITEMS, KEY, QUESTIONNAIRE_COLUMNS, TOTAL
from visitgauge.sources.survey import load_raw, read_survey, read_surveys


def column(df, name):
    return [row[name] for row in df.collect()]


def test_totals_need_nine_valid_answers(spark):
    rows = [
        [0] * 9, [1] * 9, [2] * 9, [3] * 9, [1, 2, 3, 1, 2, 3, 1, 0, 0],
        [7] + [0] * 8, [0] * 8 + [9],
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in ITEMS))
    assert column(cleaning.add_phq9_total(df), TOTAL) == [0, 9, 18, 27, 13, None, None]


def test_text_answers_are_coerced(spark):
    df = spark.createDataFrame(
        [(" 2 ", "3d", "", "x", "1e0", "+3", "nan", None)],
        "a string, b string, c string, d string, e string, f string, g string, h string",
    )
    row = cleaning.coerce_numeric(df, df.columns).first()
    assert list(row) == [2.0, None, None, None, 1.0, 3.0, None, None]


@pytest.mark.parametrize(
    ("total", "level"),
    [(0, "Minimal"), (4, "Minimal"), (5, "Mild"), (9, "Mild"), (10, "Moderate"), (14, "Moderate"),
     (15, "Moderately Severe"), (19, "Moderately Severe"), (20, "Severe"), (27, "Severe")],
)
def test_severity_boundaries(spark, total, level):
    row = spark.range(1).select(
        *[scoring.severity(F.lit(total), p).alias(p) for p in ("null", "clamp", "raise")]
    ).first()
    assert list(row) == [level] * 3


def test_totals_out_of_range_by_policy(spark):
    df = spark.createDataFrame([(-1,), (28,), (None,)], "t int")
    assert column(df.select(scoring.severity(F.col("t"), "null").alias("s")), "s") == [None] * 3
    assert column(df.select(scoring.severity(F.col("t"), "clamp").alias("s")), "s") == [
        "Minimal", "Severe", None,
    ]
    with pytest.raises(Exception, match="must be between 0 and 27"):
        df.select(scoring.severity(F.col("t"), "raise")).collect()


def test_age_groups_closed_and_open(spark):
    ages = [17, 18, 29, 30, 44, 45, 59, 60]
    names = ["Under 18", "18-29", "18-29", "30-44", "30-44", "45-59", "45-59", "60+"]
    df = spark.createDataFrame([(float(a),) for a in ages], "a double")
    for closed in (True, False):
        assert column(df.select(scoring.age_group(F.col("a"), closed).alias("g")), "g") == names
    half = spark.createDataFrame([(29.5,), (None,)], "a double")
    assert column(half.select(scoring.age_group(F.col("a"), True).alias("g")), "g") == [None, None]
    assert column(half.select(scoring.age_group(F.col("a"), False).alias("g")), "g") == [
        "30-44", None,
    ]


def test_missing_codes_and_impossible_age_become_null(spark):
    df = spark.createDataFrame(
        [(1, 130, 9, 7, 99, 9, 77)], ", ".join(f"{c} int" for c in DEMOGRAPHIC_COLUMNS)
    )
    assert list(cleaning.clean_demographics(df).first())[1:] == [None] * 6


def test_unknown_level_bands(spark):
    df = spark.createDataFrame([("Other",), (None,)], "s string")
    assert column(df.select(scoring.risk_band(F.col("s")).alias("b")), "b") == ["High", "High"]
    assert column(df.select(scoring.risk_band(F.col("s"), "Low").alias("b")), "b") == ["Low", "Low"]


def brute_hash(text: str) -> str:
    value = 0
    for c in text:
        value = (value * 31 + ord(c)) % 2**32
    digits = ""
    while value:
        value, rest = divmod(value, 36)
        digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[rest] + digits
    return digits.rjust(6, "0")[-6:]


def test_patient_ids(spark):
    names = ["Noor Winter", "  ", None, "José  O'Neil-Smith the Third", "a"]
    df = spark.createDataFrame([(n, 35, 2) for n in names], "n string, a int, g int")
    found = column(
        df.select(identity.generated_patient_id(F.col("n"), F.col("a"), F.col("g")).alias("i")), "i"
    )
    slugs = ["NOOR-WINTER", "PATIENT", "PATIENT", "JOS-O-NEIL-SMITH-T", "A"]
    assert found == [f"MHQ-{s}-{brute_hash(f'{s}|35|2')}" for s in slugs]


def test_given_identity_wins(spark):
    df = spark.createDataFrame([(" P-1 ", " Bo "), ("", ""), (None, None)], "i string, n string")
    parts = identity.patient_identity(F.col("i"), F.col("n"), F.lit(1), F.lit(1))
    rows = df.select(*[c.alias(k) for k, c in parts.items()]).collect()
    assert rows[0] == ("P-1", "Bo")
    assert {r["patient_name"] for r in rows[1:]} == {"Unnamed patient"}
    assert all(r["patient_id"].startswith("MHQ-PATIENT-") for r in rows[1:])


def test_reading_and_merging(spark, survey_files):
    merged = load_raw(spark, survey_files["demographic"], survey_files["questionnaire"])
    assert merged.count() == COMPLETE + len(NO_ANSWERS)
    assert merged.schema[KEY].dataType.simpleString() == "bigint"


def test_missing_file_and_columns(spark, survey_files):
    with pytest.raises(FileNotFoundError, match="Please place demographic.csv"):
        read_surveys(spark, "/nowhere/a.csv", "/nowhere/b.csv")
    with pytest.raises(ValueError, match="missing required columns: .*DPQ010"):
        read_survey(spark, survey_files["demographic"], QUESTIONNAIRE_COLUMNS)


def test_duplicate_keys_are_refused_and_null_keys_ignored(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], f"{KEY} int")
    with pytest.raises(ValueError, match=r"has duplicate SEQN values: \[1\]"):
        quality.require_unique_key(df, KEY, "table")
    quality.require_unique_key(df.where("SEQN = 2 or SEQN is null"), KEY, "table")


def test_unmatched_counts_with_repeats_and_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (None,)], f"{KEY} int")
    right = spark.createDataFrame([(2,), (2,), (2,), (3,)], f"{KEY} int")
    assert merging.merge_unmatched(left, right).first() == (6, 1, 1, 1, 0)


def test_item_quality(spark):
    rows = [[0] * 9, [9, None] + [1] * 7, [7, 9] + [2] * 7]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in ITEMS))
    assert quality.item_quality(df).first() == (4, 1, "7.0,9.0")
    assert quality.item_quality(df.limit(0)).first() == (0, 0, "")
    assert quality.item_quality(df, most_listed=1).first() == (4, 1, "7.0")
    assert {r["value"] for r in quality.invalid_values(df).collect()} == {7.0, 9.0}


def test_contract_splits_requests(spark):
    from visitgauge.plans.scoring import boundary_requests, split_requests

    good = boundary_requests(spark)
    bad = good.limit(1).withColumns(
        {"RIDAGEYR": F.lit(121), "DPQ090": F.lit(None).cast("int"), "RIAGENDR": F.lit(-1)}
    )
    accepted, rejected = split_requests(good.unionByName(bad))
    assert accepted.count() == 6
    assert rejected.first()["violations"] == [
        "RIDAGEYR must be between 0 and 120", "RIAGENDR must be 0 or more",
        "DPQ090 must be between 0 and 3",
    ]
    half = good.limit(1).withColumn("DPQ010", F.lit(1.5))
    assert quality.input_violations(half).first()["violations"] == ["DPQ010 must be a whole number"]


def test_leakage(spark):
    a = spark.createDataFrame([(i,) for i in [1, 2, 2, 10, None]], "k int")
    b = spark.createDataFrame([(i,) for i in [2, 10, 10, 3, None]], "k int")
    assert quality.split_leakage(a, b, "k").first() == (2, "10,2")
    assert quality.split_leakage(a, b.where("k = 3"), "k").first()[0] == 0


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_service_numbers_round_their_exact_binary_value(spark, digits):
    values = [107 / 40, 0.12345, 2.5, 3.5, 0.125, 0.375, 1.005, 26.75, 0.0, -0.125, 1 / 3, 12.3456789]
    values += [a / b for a in range(0, 28) for b in range(1, 90)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    even, up = df.select(
        scoring.binary_half_even(F.col("v"), digits), scoring.binary_half_up(F.col("v"), digits)
    ).toPandas().T.values.tolist()
    assert even == [round(v, digits) for v in values]
    exact = decimal.Decimal(1).scaleb(-digits)
    for value, found in zip(values, up):
        if value >= 0:
            assert found == float(decimal.Decimal(value).quantize(exact, decimal.ROUND_HALF_UP))
