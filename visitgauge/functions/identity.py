"""Patient identity: text fallbacks, name slugs and derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitgauge.schema import PATIENT_ID_PREFIX, SLUG_LENGTH


def filled(value: Column) -> Column:
    """Null for empty text: what a truthiness test would skip."""
    return F.nullif(value, F.lit(""))


def trimmed(value: Column) -> Column:
    """Trimmed text, null when nothing is left."""
    return filled(F.regexp_replace(value, r"^\s+|\s+$", ""))


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[filled(v) for v in values])


def name_slug(name: Column) -> Column:
    """Upper-case ASCII slug of a name, at most 18 characters."""
    dashed = F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9]+", "-")
    bare = F.upper(F.regexp_replace(dashed, "^-+|-+$", ""))
    return F.substring(F.coalesce(filled(bare), F.lit("PATIENT")), 1, SLUG_LENGTH)


def rolling_hash(text: Column) -> Column:
    """Six base-36 digits of the 31-multiplier hash modulo 2**32 (ASCII input)."""
    value = F.aggregate(
        F.split(text, ""),
        F.lit(0).cast("bigint"),
        lambda acc, c: (acc * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    digits = F.conv(value.cast("string"), 10, 36)
    return F.substring(F.lpad(digits, 7, "0"), -6, 6)


def generated_patient_id(name: Column, age: Column, gender: Column) -> Column:
    slug = name_slug(name)
    seed = F.concat_ws("|", slug, age.cast("bigint"), gender.cast("bigint"))
    return F.concat_ws("-", F.lit(PATIENT_ID_PREFIX), slug, rolling_hash(seed))


def patient_identity(
    patient_id: Column, patient_name: Column, age: Column, gender: Column
) -> dict[str, Column]:
    """Given id or a generated one, and a display name."""
    return {
        "patient_id": F.coalesce(
            trimmed(patient_id), generated_patient_id(patient_name, age, gender)
        ),
        "patient_name": F.coalesce(trimmed(patient_name), F.lit("Unnamed patient")),
    }


def visit_day(visit_date: Column, created_at: Column) -> Column:
    """Visit date, else the day part of the save time; empty when neither exists."""
    return F.coalesce(filled(visit_date), F.date_format(created_at, "yyyy-MM-dd"), F.lit(""))
