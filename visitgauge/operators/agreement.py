"""Classification quality from counts of (true, predicted) pairs.

Sums over classes are written out in class order, so results do not depend on
the order in which partial sums arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitgauge.schema import CLASS_LABELS


def pair_counts(
    df: DataFrame, true: str = "y_true", predicted: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*by, F.col(true).alias("y_true"), F.col(predicted).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(
    df: DataFrame,
    labels: Sequence[str] = CLASS_LABELS,
    true: str = "y_true",
    predicted: str = "y_pred",
) -> DataFrame:
    """All label pairs with their counts, zero cells kept."""
    names = F.array(*[F.lit(x) for x in labels])
    grid = (
        df.sparkSession.range(1)
        .select(F.explode(names).alias("y_true"))
        .select("y_true", F.explode(names).alias("y_pred"))
    )
    counts = pair_counts(df, true, predicted)
    return grid.join(counts, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def sum_where(condition: str) -> str:
    """SQL sum of pair counts under a condition, 0 when there are none."""
    return f"coalesce(sum(CASE WHEN {condition} THEN n END), 0)"


def class_totals(labels: Sequence[str]) -> list[Column]:
    """Aggregates over pair counts: hits, true rows and predicted rows of each class."""
    found = []
    for i, label in enumerate(labels):
        quoted = "'" + label.replace("\\", "\\\\").replace("'", "\\'") + "'"
        true, predicted = f"y_true = {quoted}", f"y_pred = {quoted}"
        found += [
            F.expr(sum_where(f"{true} AND {predicted}")).alias(f"tp{i}"),
            F.expr(sum_where(true)).alias(f"s{i}"),
            F.expr(sum_where(predicted)).alias(f"p{i}"),
        ]
    return found


# Metrics as SQL text over the class totals: one expression each instead of hundreds of
# small column objects.


def ratio(part: str, whole: str) -> str:
    """Quotient, 0 where there is nothing to divide by."""
    return f"coalesce(try_divide(double({part}), double({whole})), 0D)"


def class_precision(i: int) -> str:
    return ratio(f"tp{i}", f"p{i}")


def class_recall(i: int) -> str:
    return ratio(f"tp{i}", f"s{i}")


def class_f1(i: int) -> str:
    return ratio(f"2 * tp{i}", f"s{i} + p{i}")


def hits(labels: Sequence[str]) -> str:
    return "(" + " + ".join(f"tp{i}" for i in range(len(labels))) + ")"


def weighted(metric: Callable[[int], str], labels: Sequence[str]) -> str:
    """Mean of a per-class metric weighted by true rows."""
    total = " + ".join(f"s{i} * {metric(i)}" for i in range(len(labels)))
    return ratio(f"({total})", "n_rows")


def macro(metric: Callable[[int], str], labels: Sequence[str]) -> str:
    return f"(({' + '.join(metric(i) for i in range(len(labels)))}) / {len(labels)})"


def wide_counts(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Class totals on one row (per ``by``), from pair counts combined before the shuffle."""
    counts = pair_counts(df, by=by)
    aggregates = [F.expr("coalesce(sum(n), 0)").alias("n_rows"), *class_totals(labels)]
    return counts.groupBy(*by).agg(*aggregates) if by else counts.agg(*aggregates)


def model_metrics(
    df: DataFrame, labels: Sequence[str] = CLASS_LABELS, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; 0 where undefined."""
    return wide_counts(df, labels, by).selectExpr(
        *by,
        "n_rows AS test_size",
        f"{ratio(hits(labels), 'n_rows')} AS accuracy",
        f"{weighted(class_precision, labels)} AS precision",
        f"{weighted(class_recall, labels)} AS recall",
        f"{weighted(class_f1, labels)} AS f1",
    )


def classification_report(
    df: DataFrame, labels: Sequence[str] = CLASS_LABELS
) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted averages."""

    def line(name: str, precision: str, recall: str, f1: str, support: str) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            F.expr(precision).alias("precision"),
            F.expr(recall).alias("recall"),
            F.expr(f1).alias("f1"),
            F.expr(support).alias("support"),
        )

    metrics = (class_precision, class_recall, class_f1)
    lines = [line(label, *[m(i) for m in metrics], f"s{i}") for i, label in enumerate(labels)]
    accuracy = ratio(hits(labels), "n_rows")
    lines.append(line("accuracy", accuracy, accuracy, accuracy, "n_rows"))
    lines.append(line("macro avg", *[macro(m, labels) for m in metrics], "n_rows"))
    lines.append(line("weighted avg", *[weighted(m, labels) for m in metrics], "n_rows"))
    return wide_counts(df, labels).select(F.inline(F.array(*lines)))


def select_best(metrics: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The candidate with the highest weighted F1; the first one wins ties."""
    return metrics.orderBy(F.desc("f1"), ordinal).limit(1)


def agreement_summary(df: DataFrame, rule: str, model: str) -> DataFrame:
    """How often two labels agree."""
    same = F.col(rule).eqNullSafe(F.col(model))
    return df.agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(same).alias("agreement_count"),
        F.count_if(~same).alias("mismatch_count"),
    )
