"""Stratified train / test split with exact class counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgauge.schema import KEY, TARGET


def split_feasibility(
    df: DataFrame, test_size: float, label: str = TARGET
) -> DataFrame:
    """One row saying whether a stratified split is possible, and if not, why."""
    per_class = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = per_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_classes"),
        F.coalesce(F.min("n"), F.lit(0)).alias("smallest_class"),
    ).withColumn("test_rows", F.ceil(F.col("n_rows") * F.lit(float(test_size))))
    totals = totals.withColumn("train_rows", F.col("n_rows") - F.col("test_rows"))
    n_classes = F.col("n_classes")
    reason = (
        F.when(~F.lit(0 < test_size < 1), "test_size must be between 0 and 1")
        .when(n_classes == 0, "No target labels available for splitting")
        .when(
            F.col("smallest_class") < 2,
            "Each severity class needs at least two rows for stratified splitting",
        )
        .when(F.col("test_rows") < n_classes, "test_size is too small for stratification")
        .when(F.col("train_rows") < n_classes, "test_size is too large for stratification")
        .otherwise("")
    )
    return totals.withColumn("reason", reason).withColumn("feasible", F.col("reason") == "")


def require_feasible_split(df: DataFrame, test_size: float, label: str = TARGET) -> DataFrame:
    """The same table, or an error with the reason a split is not possible."""
    if not 0 < test_size < 1:
        raise ValueError(f"test_size must be between 0 and 1. Received: {test_size}")
    checked = split_feasibility(df, test_size, label).first()
    if not checked["feasible"]:
        raise ValueError(
            f"{checked['reason']}. Rows: {checked['n_rows']}, "
            f"classes: {checked['n_classes']}, smallest class: {checked['smallest_class']}"
        )
    return df


def test_quotas(per_class: DataFrame, test_size: float, label: str = TARGET) -> DataFrame:
    """Test rows per class by largest remainder; ``per_class`` has one row per class.

    Windows here run over as many rows as there are classes.
    """
    every = Window.partitionBy(F.lit(0))
    share = per_class.withColumn("n_all", F.sum("n").over(every)).withColumn(
        "exact", F.col("n") / F.col("n_all") * F.ceil(F.col("n_all") * F.lit(float(test_size)))
    )
    share = share.withColumns(
        {
            "base": F.floor("exact"),
            "left": F.ceil(F.col("n_all") * F.lit(float(test_size)))
            - F.sum(F.floor("exact")).over(every),
        }
    )
    by_remainder = Window.partitionBy(F.lit(0)).orderBy(
        F.desc(F.col("exact") - F.col("base")), F.col(label)
    )
    return share.select(
        label,
        "n",
        (F.col("base") + F.when(F.row_number().over(by_remainder) <= F.col("left"), 1).otherwise(0))
        .cast("bigint")
        .alias("n_test"),
    )


def split_order(key: Column, seed: int) -> Column:
    """Pseudo-random sort key of a row: the same in every run and on any partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def first_in_hash_order(
    df: DataFrame,
    quotas: DataFrame,
    seed: int,
    key: str,
    label: str,
    flag: str,
    digits: int = 4,
) -> DataFrame:
    """Add ``flag``: in each class, exactly ``n_test`` rows of ``quotas``, first in hash order.

    Sorting a whole class would put most rows in one task, since classes are few
    and uneven. Instead rows are counted per class and hash prefix, the prefix in
    which the quota is reached is found from these counts, and only the rows
    carrying that prefix are ordered to find the last hash that still counts.
    The table is read three times, so hand in a stored one when it is costly.
    """
    hashed = df.withColumn("_h", split_order(F.col(key), seed)).withColumn(
        "_p", F.substring("_h", 1, digits)
    )
    prefixes = hashed.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(label).orderBy("_p")
    # At most classes x 16**digits rows; one row per class is left after the filter.
    crossing = (
        prefixes.withColumn("before", F.sum("n").over(running) - F.col("n"))
        .join(F.broadcast(quotas.select(label, "n_test")), label)
        .where(
            (F.col("before") < F.col("n_test"))
            & (F.col("n_test") <= F.col("before") + F.col("n"))
        )
        .select(label, "_p", (F.col("n_test") - F.col("before")).alias("needed"))
    )
    within = Window.partitionBy(label).orderBy("_h", key)
    last = (
        hashed.select(label, "_p", "_h", key)
        .join(F.broadcast(crossing), [label, "_p"])
        .withColumn("rn", F.row_number().over(within))
        .where(F.col("rn") == F.col("needed"))
        .select(F.col(label).alias("_label"), F.struct("_h", F.col(key).alias("k")).alias("_last"))
    )
    own = F.struct(F.col("_h"), F.col(key).alias("k"))
    return (
        hashed.join(F.broadcast(last), F.col(label) == F.col("_label"), "left")
        .withColumn(flag, F.coalesce(own <= F.col("_last"), F.lit(False)))
        .drop("_h", "_p", "_label", "_last")
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def stratified_split(
    df: DataFrame,
    test_size: float = 0.3,
    seed: int = 42,
    key: str = KEY,
    label: str = TARGET,
) -> DataFrame:
    """Add ``is_test``, with exactly the quota of every class on the test side."""
    quotas = test_quotas(class_counts(df, label), test_size, label)
    return first_in_hash_order(df, quotas, seed, key, label, "is_test")


def split_distribution(split: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows per split and class."""
    side = F.when(F.col("is_test"), "test").otherwise("train")
    return split.groupBy(side.alias("split"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts per value as text, nulls included as ``nan``."""
    return (
        df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("value")
    )
