"""Scores, levels, bands and the sentences that go with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitgauge.schema import (
    AGE_GROUP_TOPS, AGREES_NOTE, DIFFERS_NOTE, GROUP_LABELS, ITEM_MEANINGS, ITEM_QUESTIONS, ITEMS,
    MAX_TOTAL, RECOMMENDATIONS, SEVERITY_TOPS, WARNINGS,
)


def severity(total: Column, out_of_range: str = "null") -> Column:
    """Level of a total. ``out_of_range``: "null", "clamp" or "raise"."""
    level = F.when(total <= SEVERITY_TOPS[0][1], SEVERITY_TOPS[0][0])
    for name, top in SEVERITY_TOPS[1:-1]:
        level = level.when(total <= top, name)
    level = level.when(total.isNotNull(), SEVERITY_TOPS[-1][0])
    if out_of_range == "clamp":
        return level
    if out_of_range == "raise":
        problem = F.concat(
            F.lit("PHQ-9 total must be between 0 and 27. Received: "), total.cast("string")
        )
        return F.when(total.between(0, MAX_TOTAL) | total.isNull(), level).otherwise(
            F.raise_error(problem)
        )
    if out_of_range == "null":
        return F.when((total > -1) & (total <= MAX_TOTAL), level)
    raise ValueError(f"unknown out_of_range policy: {out_of_range}")


def age_group(age: Column, closed: bool = True) -> Column:
    """Age bucket. ``closed`` ranges leave 29.5 without a group; the open chain does not."""
    first, first_top = AGE_GROUP_TOPS[0]
    group = F.when(age < first_top + 1, first)
    lower = first_top + 1
    for name, top in AGE_GROUP_TOPS[1:-1]:
        group = group.when(age.between(lower, top) if closed else age <= top, name)
        lower = top + 1
    last = AGE_GROUP_TOPS[-1][0]
    return group.when(age >= lower if closed else age.isNotNull(), last)


def risk_band(level: Column, unknown: str = "High") -> Column:
    """Low / Medium / High; ``unknown`` is the band of any other (or no) level."""
    return (
        F.when(level.isin("Minimal", "Mild"), "Low")
        .when(level == "Moderate", "Medium")
        .when(level.isin("Moderately Severe", "Severe"), "High")
        .otherwise(unknown)
    )


def warning_text(level: Column) -> Column:
    return (
        F.when(level.isin("Minimal", "Mild"), WARNINGS["low"])
        .when(level == "Moderate", WARNINGS["moderate"])
        .otherwise(WARNINGS["other"])
    )


def recommendation_text(level: Column) -> Column:
    text = F.when(level == "Minimal", RECOMMENDATIONS["Minimal"])
    for name in ("Mild", "Moderate"):
        text = text.when(level == name, RECOMMENDATIONS[name])
    return text.otherwise(RECOMMENDATIONS["other"])


def explanation_text(
    level: Column, total: Column, band: Column, model_level: Column | None = None
) -> Column:
    """Sentence for clinic staff; the model part only where an estimate exists."""
    head = F.concat(
        F.lit("The PHQ-9 score is "), total.cast("string"),
        F.lit(", which falls in the "), level, F.lit(" range. "),
        F.lit("The primary screening result follows PHQ-9 scoring boundaries."),
    )
    tail = F.concat(F.lit(" The screening risk band is "), F.lower(band), F.lit("."))
    if model_level is None:
        return F.concat(head, tail)
    estimate = F.when(
        F.coalesce(model_level, F.lit("")) != "",
        F.concat(F.lit(" The trained model estimate is "), model_level, F.lit(".")),
    ).otherwise("")
    return F.concat(head, estimate, tail)


def explanation_text_form(level: Column, total: Column, band: Column) -> Column:
    """Wording used by the form when the scorer sent no sentence."""
    return F.concat(
        F.lit("The PHQ-9 score is "), total.cast("string"),
        F.lit(", which is in the "), level, F.lit(" range. The model estimates "),
        F.lower(band), F.lit(" risk from PHQ-9 answers and demographic fields."),
    )


def model_note(agreement: Column) -> Column:
    return F.when(agreement, AGREES_NOTE).otherwise(DIFFERS_NOTE)


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def group_label(group_column: Column, group_value: Column) -> Column:
    """Readable label of a demographic code given as text; fallbacks for unknown and null."""
    labels = {
        f"{column}|{code}": label
        for column, codes in GROUP_LABELS.items()
        for code, label in codes.items()
    }
    known = F.try_element_at(_literal_map(labels), F.concat_ws("|", group_column, group_value))
    return (
        F.when(group_value.isNull(), "Missing")
        .when(group_column == "AGE_GROUP", group_value)
        .otherwise(
            F.coalesce(known, F.concat(F.lit("Unknown / Other ("), group_value, F.lit(")")))
        )
    )


def item_question(code: Column) -> Column:
    return F.try_element_at(_literal_map(ITEM_QUESTIONS), code)


def item_meaning(score: Column) -> Column:
    return F.coalesce(
        F.try_element_at(_literal_map(ITEM_MEANINGS), score.cast("int")), F.lit("Unknown")
    )


def risk_percent(risk_percentage: Column, selection_rate: Column) -> Column:
    """Percentage of a report row, from the selection rate where it is absent."""
    return F.coalesce(risk_percentage, F.coalesce(selection_rate, F.lit(0.0)) * 100)


def report_band(percentage: Column) -> Column:
    """Band of a report row by its whole-number percentage."""
    whole = F.floor(percentage + 0.5)
    return F.when(whole >= 30, "High").when(whole >= 20, "Medium").otherwise("Low")


def pattern_for_total(total: Column) -> dict[str, Column]:
    """Answers that reach a total by filling the first items up first."""
    return {
        name: F.greatest(F.lit(0), F.least(F.lit(3), total - 3 * i)).cast("int")
        for i, name in enumerate(ITEMS)
    }


def half_even(value: Column, digits: int) -> Column:
    """Round to ``digits`` the way array libraries do: scale, half-even, unscale."""
    scale = float(10**digits)
    return F.rint(value * scale) / F.lit(scale)


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half upwards, the browser's way."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def _binary_rounded(value: Column, digits: int, tie_up: bool) -> Column:
    """Round the exact binary value, of which ``value * scale`` is only the nearest double.

    The error of that product is computed exactly (Dekker's product; the scale has few bits), so a
    value just below a tie, such as 107 / 40, goes down.
    """
    scale = F.lit(float(10**digits))
    spread = value * F.lit(134217729.0)  # 2^27 + 1 splits a double into two halves
    high = spread - (spread - value)
    product = value * scale
    error = (high * scale - product) + (value - high) * scale
    whole = F.floor(product).cast("double")
    beyond = ((product - whole) - 0.5) + error
    tie = (beyond == 0) & (F.lit(tie_up) | (whole % 2 != 0))
    return (whole + F.when((beyond > 0) | tie, 1.0).otherwise(0.0)) / scale


def binary_half_even(value: Column, digits: int) -> Column:
    """Round to the nearest decimal of the exact binary value, true ties to even."""
    return _binary_rounded(value, digits, False)


def binary_half_up(value: Column, digits: int) -> Column:
    """Round to the nearest decimal of the exact binary value, true ties up."""
    return _binary_rounded(value, digits, True)
