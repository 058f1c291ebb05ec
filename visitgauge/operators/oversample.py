"""Oversampling of minority classes by interpolation between neighbours (SMOTE).

Chawla, Bowyer, Hall and Kegelmeyer, JAIR 2002. Choices depend on row keys and a
seed only, so the result does not change with partitioning or retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitgauge.operators.neighbours import BLOCK_ROWS, LEAF_ROWS, nearest_in_class
from visitgauge.operators.split import class_counts, first_in_hash_order
from visitgauge.schema import KEY, TARGET
from visitgauge.session import materialise


# Copies that one task makes of one vector at a time.
COPIES_PER_ROW = 10_000


def distinct_points(
    train: DataFrame, features: Sequence[str], label: str = TARGET, key: str = KEY, extra: Column | None = None
) -> DataFrame:
    """Distinct vectors of each class: label, ``vid`` (their lowest key), ``x``, ``same`` (rows) and ``extra``."""
    chosen = F.lit(False) if extra is None else extra
    vector = F.array(*[F.col(c).cast("double") for c in features])
    return train.groupBy(label, vector.alias("x")).agg(
        F.min(key).alias("vid"), F.count(F.lit(1)).alias("same"), F.count_if(chosen).alias("extra")
    )


def _uniform(seed: int, *keys: Column) -> Column:
    """Number in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def oversample(
    train: DataFrame,
    features: Sequence[str],
    seed: int = 42,
    key: str = KEY,
    label: str = TARGET,
    neighbours: int = 5,
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
    copies_per_row: int = COPIES_PER_ROW,
) -> DataFrame:
    """Training rows plus synthetic ones, so every class reaches the largest class.

    Returns the label, the features and ``synthetic``. With fewer than two rows in
    some class nothing is added. Equal vectors are searched once, with their number.
    Copies of a vector are made in parts of ``copies_per_row``, spread over tasks, so a
    vector that many rows share is no task of its own.
    """
    original = train.select(label, *features, F.lit(False).alias("synthetic"))
    # One row per class.
    counts = {row[label]: row["n"] for row in class_counts(train, label).collect()}
    if not counts or min(counts.values()) < 2:
        return original
    largest = max(counts.values())
    k = min(neighbours, min(counts.values()) - 1)
    wanted = [
        (name, (largest - n) // n, (largest - n) % n) for name, n in counts.items() if n < largest
    ]
    if not wanted:
        return original
    spark = train.sparkSession
    plan = spark.createDataFrame(wanted, f"`{label}` string, each bigint, n_test bigint")
    minority = train.where(F.col(label).isin(*[w[0] for w in wanted]))
    chosen = first_in_hash_order(minority, plan, seed, key, label, "_extra")
    points = materialise(
        distinct_points(chosen, features, label, key, F.col("_extra"))
        .join(F.broadcast(plan), label)
        .select(
            label, "vid", "x", "same",
            (F.col("same") * F.col("each") + F.col("extra")).alias("copies"),
        )
    )
    found = nearest_in_class(points.select(label, "vid", "x"), k, label, leaf_rows, block_rows)
    # A vector held by several rows is its own neighbour that many times less one.
    others = found.join(points.select(F.col("vid").alias("neighbour"), "same"), "neighbour")
    listed = others.groupBy("vid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbour", "same"))).alias("near")
    )
    own = F.array_repeat("vid", (F.col("same") - 1).cast("int"))
    rest = F.flatten(
        F.transform("near", lambda n: F.array_repeat(n["neighbour"], F.least(n["same"], F.lit(k)).cast("int")))
    )
    picks = (
        points.join(listed, "vid", "left")
        .withColumn(
            "near_ids",
            F.slice(
                F.concat(
                    F.when(F.col("same") > k, F.array_repeat("vid", F.lit(k))).otherwise(own),
                    F.coalesce(rest, F.array().cast("array<bigint>")),
                ),
                1,
                k,
            ),
        )
        .where("copies > 0")
    )
    size = F.lit(copies_per_row)
    parts = picks.select(
        label, "vid", "x", "near_ids", "copies",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / size))).alias("part"),
    )
    # Dealt by vector and part, so that the parts of one vector are made in many tasks.
    parts = parts.repartition(label, "vid", "part")
    last = F.least(F.col("copies"), (F.col("part") + 1) * size)
    picks = parts.select(
        label, "vid", "x", "near_ids", F.explode(F.sequence(F.col("part") * size + 1, last)).alias("copy")
    )
    place = F.floor(_uniform(seed, F.col("vid"), F.col("copy")) * F.size("near_ids")).cast("int")
    chosen_pairs = picks.select(
        label, "x", F.element_at("near_ids", place + 1).alias("neighbour"),
        _uniform(seed + 1, F.col("vid"), F.col("copy")).alias("u"),
    )
    step = chosen_pairs.join(
        points.select(F.col("vid").alias("neighbour"), F.col("x").alias("y")), "neighbour"
    ).withColumn(
        "z", F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a))
    )
    synthetic = step.select(
        label,
        *[F.col("z")[i].alias(name) for i, name in enumerate(features)],
        F.lit(True).alias("synthetic"),
    )
    return original.unionByName(synthetic)
