"""Column expressions and row filters that clean survey codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitgauge.schema import (
    AGE, DEMOGRAPHIC_COLUMNS, FEATURES, ITEM_VALUES, ITEMS, KEY, MAX_AGE, MISSING_CODES, TARGET,
    TOTAL,
)

# A Java double literal also accepts suffixes such as "3d"; the pattern keeps them out.
_PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def text_to_number(value: Column) -> Column:
    """Double for text holding one plain number, else null."""
    return F.when(value.rlike(_PLAIN_NUMBER), value.try_cast("double"))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn the named columns into doubles; bad text and NaN become null."""
    converted = {}
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            converted[name] = text_to_number(F.col(name))
        elif isinstance(kind, T.FractionalType):
            converted[name] = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        else:
            converted[name] = F.col(name).cast("double")
    return df.withColumns(converted)


def respondent_key(value: Column) -> Column:
    """Whole respondent number from text; anything else is no key."""
    number = text_to_number(value)
    return F.when(number == F.floor(number), number.cast("bigint"))


def without_missing_codes(name: str) -> Column:
    """The column, with the survey's refused / unknown codes as null."""
    value = F.col(name)
    codes = MISSING_CODES.get(name)
    return F.when(~value.isin(*codes), value) if codes else value


def clean_demographics(df: DataFrame) -> DataFrame:
    """Numeric demographic columns, missing codes and impossible ages nulled."""
    numeric = coerce_numeric(df, [c for c in DEMOGRAPHIC_COLUMNS if c != KEY])
    cleaned = {name: without_missing_codes(name) for name in MISSING_CODES}
    cleaned[AGE] = F.when(F.col(AGE).between(0, MAX_AGE), F.col(AGE))
    return numeric.withColumns(cleaned)


def valid_item(name: str) -> Column:
    value = F.col(name)
    return F.when(value.isin(*ITEM_VALUES), value)


def add_phq9_total(df: DataFrame) -> DataFrame:
    """Keep item answers 0..3 only and add their sum (null unless all nine are there)."""
    numeric = coerce_numeric(df, ITEMS)
    return numeric.withColumns({name: valid_item(name) for name in ITEMS}).withColumn(
        TOTAL, item_sum()
    )


def item_sum(missing_as_zero: bool = False) -> Column:
    """Sum of the nine items; null spreads unless ``missing_as_zero``."""
    parts = [F.coalesce(F.col(c), F.lit(0)) if missing_as_zero else F.col(c) for c in ITEMS]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def answered_fully(df: DataFrame) -> DataFrame:
    """Rows whose nine answers are all valid. On stored numeric items this is a scan filter."""
    numeric = coerce_numeric(df, [c for c in ITEMS if df.schema[c].dataType.typeName() == "string"])
    valid = F.lit(True)
    for name in ITEMS:
        valid = valid & F.col(name).isin(*ITEM_VALUES)
    return numeric.where(valid)


def complete_cases(df: DataFrame) -> DataFrame:
    """Rows with all items, a total and a label."""
    return df.dropna(subset=[*ITEMS, TOTAL, TARGET])


def select_features(df: DataFrame) -> DataFrame:
    """Model features and the target as text."""
    return df.select(*FEATURES, F.col(TARGET).cast("string").alias(TARGET))
