"""Stratified split: quotas, order and feasibility."""

from __future__ import annotations

import hashlib
import math

import pytest

from visitgauge.operators import split

PUBLISHED = {"Minimal": 4016, "Mild": 845, "Moderate": 316, "Moderately Severe": 138, "Severe": 57}
PUBLISHED_TEST = {"Minimal": 1205, "Mild": 254, "Moderate": 95, "Moderately Severe": 41, "Severe": 17}


def labelled(spark, counts):
    rows, number = [], 0
    for label, n in counts.items():
        for _ in range(n):
            rows.append((number, label))
            number += 1
    return spark.createDataFrame(rows, "SEQN bigint, SEVERITY string")


def test_published_quotas(spark):
    counts = spark.createDataFrame(list(PUBLISHED.items()), "SEVERITY string, n bigint")
    found = {r["SEVERITY"]: r["n_test"] for r in split.test_quotas(counts, 0.3).collect()}
    assert found == PUBLISHED_TEST


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_split_equals_sorting_each_class(spark, digits):
    counts = {"a": 700, "b": 30, "c": 2, "d": 1}
    df = labelled(spark, counts)
    quotas = split.test_quotas(split.class_counts(df, "SEVERITY"), 0.3)
    flagged = split.first_in_hash_order(df, quotas, 42, "SEQN", "SEVERITY", "is_test", digits)
    rows = flagged.collect()
    assert len(rows) == 733
    quota = {r["SEVERITY"]: r["n_test"] for r in quotas.collect()}
    assert sum(quota.values()) == math.ceil(733 * 0.3)
    for label in counts:
        keys = [r["SEQN"] for r in rows if r["SEVERITY"] == label]
        keys.sort(key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
        chosen = {r["SEQN"] for r in rows if r["SEVERITY"] == label and r["is_test"]}
        assert chosen == set(keys[: quota[label]])


def test_split_does_not_depend_on_partitioning(spark):
    df = labelled(spark, {"a": 300, "b": 20})
    one = split.stratified_split(df.coalesce(1)).where("is_test").select("SEQN")
    many = split.stratified_split(df.repartition(13)).where("is_test").select("SEQN")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


@pytest.mark.parametrize(
    ("counts", "size", "reason"),
    [({"a": 3, "b": 1}, 0.3, "at least two rows"), ({"a": 2, "b": 2, "c": 2}, 0.9, "too large"),
     ({"a": 2, "b": 2, "c": 2}, 0.1, "too small"), ({"a": 2}, 1.0, "between 0 and 1")],
)
def test_infeasible_splits(spark, counts, size, reason):
    with pytest.raises(ValueError, match=reason):
        split.require_feasible_split(labelled(spark, counts), size)


def test_distribution_counts_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    assert [tuple(r) for r in split.value_distribution(df, "v").collect()] == [
        ("a", 1), ("b", 2), ("nan", 1),
    ]
