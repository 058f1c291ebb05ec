"""Checks on tables and rows. Row checks list problems; table checks aggregate once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitgauge.functions.cleaning import coerce_numeric, item_sum
from visitgauge.functions.identity import trimmed
from visitgauge.schema import (
    AGE, DEMOGRAPHIC_CODES, ITEM_VALUES, ITEMS, MAX_AGE, SUSPICIOUS_ACCURACY, TOTAL,
)


def require_columns(df: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    """The same table, or an error naming the columns it lacks."""
    missing = [column for column in required if column not in df.columns]
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Non-null keys held by more than one row, with their row count."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def require_unique_key(df: DataFrame, key: str, name: str, shown: int = 5) -> DataFrame:
    """The same table, or an error showing up to five repeated keys."""
    repeated = [row[0] for row in duplicate_keys(df, key).select(key).limit(shown).collect()]
    if repeated:
        raise ValueError(f"{name} has duplicate {key} values: {repeated}")
    return df


def _violations(checks: Sequence[tuple[Column, str]]) -> Column:
    """Array of the messages whose condition does not hold (null counts as broken)."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in checks])
    )


def input_violations(df: DataFrame) -> DataFrame:
    """Add ``violations``: broken rules of the scoring input contract."""
    checks = [(F.col(AGE).between(0, MAX_AGE), f"{AGE} must be between 0 and {MAX_AGE}")]
    checks += [(F.col(c) >= 0, f"{c} must be 0 or more") for c in DEMOGRAPHIC_CODES]
    checks += [(F.col(c).between(0, 3), f"{c} must be between 0 and 3") for c in ITEMS]
    # A missing value is named above.
    checks += [
        (F.coalesce(F.col(c) % 1 == 0, F.lit(True)), f"{c} must be a whole number")
        for c in (AGE, *DEMOGRAPHIC_CODES, *ITEMS)
    ]
    return df.withColumn("violations", _violations(checks))


def form_violations(df: DataFrame) -> DataFrame:
    """Add ``violations``: messages of the entry form."""
    checks = [
        (trimmed(F.col("patient_name")).isNotNull(), "Patient name is required."),
        (
            F.col(AGE).cast("double").between(0, MAX_AGE),
            "Age must be between 0 and 120.",
        ),
        (trimmed(F.col("visit_date")).isNotNull(), "Visit date is required."),
        (trimmed(F.col("visit_time")).isNotNull(), "Visit time is required."),
    ]
    checks += [
        (F.col(c).isin(*ITEM_VALUES), f"{c} must be answered from 0 to 3.") for c in ITEMS
    ]
    return df.withColumn("violations", _violations(checks))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") == 0)


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") > 0)


def item_cell_counts(df: DataFrame) -> DataFrame:
    """Counts by kind: complete rows, missing cells, and invalid cells per value.

    Each row turns into its faulty cells only, so a clean row costs one record,
    and the counts are combined before the shuffle.
    """
    numeric = coerce_numeric(df.select(*ITEMS), ITEMS)
    cells = F.array(*[F.col(c) for c in ITEMS])
    faulty = F.filter(cells, lambda v: v.isNull() | ~v.isin(*ITEM_VALUES))
    tagged = F.transform(
        faulty,
        lambda v: F.struct(
            F.when(v.isNull(), "missing_cell").otherwise("invalid_cell").alias("kind"),
            v.alias("value"),
        ),
    )
    complete = F.array(
        F.struct(
            F.lit("complete_row").alias("kind"), F.lit(None).cast("double").alias("value")
        )
    )
    return (
        numeric.select(
            F.explode(F.when(F.size(faulty) == 0, complete).otherwise(tagged)).alias("cell")
        )
        .groupBy(F.col("cell.kind").alias("kind"), F.col("cell.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


#: Invalid values that the one-row report lists; ``invalid_values`` has them all.
MOST_LISTED = 1_000


def invalid_values(df: DataFrame) -> DataFrame:
    """Every invalid answer value with the number of its cells, a row each."""
    counts = item_cell_counts(df).where(F.col("kind") == "invalid_cell")
    return counts.select("value", F.col("n").alias("n_cells"))


def item_quality(df: DataFrame, most_listed: int = MOST_LISTED) -> DataFrame:
    """One row: faulty cells, complete rows and the distinct invalid values seen.

    The values are listed as text up to ``most_listed``; free numbers in a column don't fill one row.
    """
    counts = item_cell_counts(df)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    kind = F.col("kind")
    # Ordered rather than filtered first, so that both parts share one exchange of the counts.
    text = F.when(kind == "invalid_cell", F.col("value").cast("string")).alias("text")
    first = counts.select(text).orderBy(F.col("text").asc_nulls_last()).limit(most_listed)
    listed = first.agg(F.array_join(F.array_sort(F.collect_list("text")), ",")).scalar()
    return counts.agg(
        total(kind != "complete_row").alias("invalid_or_missing_cell_count"),
        total(kind == "complete_row").alias("complete_valid_rows"),
    ).withColumn("observed_invalid_values", listed)


def total_consistency(df: DataFrame) -> DataFrame:
    """Whether every stored total equals its item sum (missing answers count 0)."""
    same = F.col(TOTAL) == item_sum(missing_as_zero=True)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.bool_and(F.coalesce(same, F.lit(False))), F.lit(True)).alias(
            "totals_match"
        ),
    )


def keys_in_both(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys present on both sides; one shuffle, keys combined before it."""
    tagged = train.select(key, F.lit(True).alias("train")).unionByName(
        test.select(key, F.lit(False).alias("train"))
    )
    return (
        tagged.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.bool_or("train").alias("in_train"), F.bool_or(~F.col("train")).alias("in_test"))
        .where("in_train and in_test")
        .select(key)
    )


def split_leakage(train: DataFrame, test: DataFrame, key: str, shown: int = 20) -> DataFrame:
    """One row: number of shared keys and the first ones in text order."""
    shared = keys_in_both(train, test, key).select(F.col(key).cast("string").alias("k"))
    first = shared.orderBy("k").limit(shown).agg(
        F.array_join(F.array_sort(F.collect_list("k")), ",")
    )
    return shared.agg(
        F.count(F.lit(1)).alias("duplicate_key_count"), first.scalar().alias("first_keys")
    )


def row_completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Add ``completeness``: whole percent of the fields that carry a value."""
    answered = sum(
        (F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
         for c in fields),
        F.lit(0),
    )
    return df.withColumn(
        "completeness", F.floor(answered * 100.0 / len(fields) + 0.5).cast("int")
    )


def accuracy_flag(metrics: DataFrame) -> DataFrame:
    """Mark metrics rows whose accuracy is too good to be taken at face value."""
    return metrics.withColumn(
        "accuracy_suspiciously_high",
        F.coalesce(F.col("accuracy"), F.lit(0.0)) >= SUSPICIOUS_ACCURACY,
    )
