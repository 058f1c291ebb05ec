"""Quality rules whose cutoffs keep a promise: limited false rejection of good documents.

Fixed base rules fail short and repetitive texts. The others compare a measure with a cutoff from a
grid. A cutoff may be used in a stratum (a language) only if the labelled good documents there prove
it harmless: with X of n good documents rejected, the exact binomial (Clopper-Pearson) upper bound
on the rejection rate has to be at most the rule's share of ``false_rejection``. The error
probability of the bounds is divided by the number of all stratum, rule and cutoff combinations
(Bonferroni), so all promises hold together with probability ``1 - error``. The strictest proven
cutoff is used; where nothing can be proven, the rule rejects nothing.

Only DataFrame functions are used. Repeated word windows are found by sorting their hashes inside a
row, so no text is spread over rows, and measures are written once and read twice.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.stages import written

FALSE_REJECTION = 0.06
ERROR = 0.05
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
BLANKS = r"[\x20\x09-\x0D]+"


class Rule(NamedTuple):
    """Rejects rows whose bin of ``value`` is above the cutoff's number."""

    name: str
    value: str
    low: float
    step: float
    cutoffs: int


RULES = [
    Rule("symbols", "n_symbols / n_words", 0.0, 0.02, 50),
    Rule("duplicate_lines", "n_dup_lines / n_lines", 0.0, 0.02, 50),
    Rule("repeated_words", "n_repeat_words / n_words", 0.0, 0.02, 50),
    Rule("upper_case", "n_upper / word_chars", 0.0, 0.02, 50),
    Rule("long_words", "word_chars / n_words", 5.0, 0.5, 40),
    Rule("short_words", "-word_chars / n_words", -5.0, 0.1, 50),
]


def measures(df: DataFrame, text_col: str, keep_text: bool) -> DataFrame:
    """``row`` (a struct of the columns of ``df``) with the measures of its text."""
    carried = [df[c] for c in df.columns if keep_text or c != text_col]
    rows = df.select(
        F.struct(*carried).alias("row"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text")
    ).select(
        "row",
        "text",
        F.array_remove(F.split("text", BLANKS), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    rows = rows.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "if(size(words) < 3, array(), transform(sequence(0, size(words) - 3),"
            " i -> xxhash64(words[i], words[i + 1], words[i + 2])))"
        ).cast("array<long>").alias("windows"),
    )
    # Only texts with a repeated window have their windows sorted, with their places.
    rows = rows.withColumn(
        "sorted",
        F.expr(
            "if(size(windows) = size(array_distinct(windows)), array(),"
            " array_sort(transform(windows, (h, i) -> struct(h, i))))"
        ),
    )
    rows = rows.withColumn(
        "places",
        F.expr(
            "sort_array(transform(filter(sorted, (x, i) -> get(sorted, i - 1).h = x.h or get(sorted, i + 1).h = x.h), x -> x.i))"
        ),
    )
    return rows.withColumn(
        "n_repeat_words",
        F.expr(
            "aggregate(places, struct(-3 as last, 0L as words),"
            " (a, p) -> struct(p as last, a.words + least(3, p - a.last) as words)).words"
        ),
    ).drop("windows", "sorted", "places")


def binned(rule: Rule):
    """How many of the rule's cutoffs the measure exceeds; an undefined measure exceeds none."""
    over = f"try_divide({rule.value.replace(' / ', ', ')}) - ({rule.low}D)"
    return F.expr(f"cast(coalesce(least({rule.cutoffs}, greatest(0, ceil(({over}) / {rule.step}D))), 0) as int)")


def log_factorial(x: str) -> str:
    """SQL for ln(x!), by Stirling's series ten places further up."""
    y = f"({x} + 11D)"
    product = " + ".join(f"ln({x} + {k}D)" for k in range(1, 11))
    return (
        f"(({y} - 0.5D) * ln({y}) - {y} + 0.5D * ln(2D * pi()) + 1D / (12D * {y}) - 1D / (360D * pow({y}, 3))"
        f" + 1D / (1260D * pow({y}, 5)) - ({product}))"
    )


def tail(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k) of a binomial X, for k below the mean; 1 from the mean on.

    The terms are summed from the largest down until they no longer count in a double.
    """
    largest = (
        f"exp({log_factorial(n)} - {log_factorial(k)} - {log_factorial(f'({n} - {k})')}"
        f" + {k} * ln({p}D) + ({n} - {k}) * ln(1D - {p}D))"
    )
    many = f"least({k}, cast(12 * sqrt({n} * {p}D) + 100 as long))"
    ratio = f"({k} - i + 1) / ({n} - {k} + i) * (1D - {p}D) / {p}D"
    total = (
        f"if({k} = 0, 1D, aggregate(sequence(1L, {many}), struct(1D as term, 1D as total),"
        f" (a, i) -> struct(a.term * {ratio} as term, a.total + a.term * {ratio} as total)).total)"
    )
    return f"if({k} >= {n} * {p}D, 1D, {largest} * {total})"


def proven_cutoffs(good: DataFrame, rules: list[Rule], false_rejection: float, error: float) -> DataFrame:
    """The strictest proven cutoff number of each rule, a column for each, by ``stratum``.

    ``good`` has a stratum and, by rule name, the bins of good documents.
    """
    share = false_rejection / len(rules)
    strata = good.select("stratum").distinct().count()
    allowed = error / max(1, strata * sum(rule.cutoffs for rule in rules))
    stacked = ", ".join(f"'{r.name}', `{r.name}`, {r.cutoffs}" for r in rules)
    counts = good.selectExpr("stratum", f"stack({len(rules)}, {stacked}) as (rule, bin, cutoffs)").groupBy(
        "stratum", "rule", "cutoffs", "bin"
    ).agg(F.count("*").alias("rows"))
    # One row for each stratum and rule; the counts by bin are at most as many as the rule's cutoffs.
    grouped = counts.groupBy("stratum", "rule", "cutoffs").agg(
        F.sum("rows").alias("n"), F.collect_list(F.struct("bin", "rows")).alias("bins")
    )
    cells = grouped.select(
        "stratum", "rule", "n", "bins", F.explode(F.expr("sequence(0, cutoffs - 1)")).alias("cutoff")
    ).withColumn("k", F.expr("aggregate(bins, 0L, (a, b) -> a + if(b.bin > cutoff, b.rows, 0L))"))
    proven = cells.where(F.expr(tail("k", "n", share)) <= allowed)
    return proven.groupBy("stratum").pivot("rule", [r.name for r in rules]).agg(F.min("cutoff"))


def judged(
    df: DataFrame,
    labels: DataFrame,
    rules: list[Rule] = RULES,
    false_rejection: float = FALSE_REJECTION,
    error: float = ERROR,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    keep_text: bool = True,
) -> DataFrame:
    """``row`` (a struct of the input's columns, without the text on demand) with the measures, ``base_failed`` and ``kept``.

    ``labels`` has doc_id and quality; a document is good if all its labels are 1. Null texts have no
    words and fail; rows without an id are unlabelled; a null stratum is a stratum of its own, and so
    is every other value. Repeated rows are judged alike, and each counts as an example. With empty
    labels only the base rules reject. An empty table gives an empty result. Input columns can have
    any names, since they stay in the struct. Texts are measured whole.
    """
    rows = measures(df, text_col, keep_text)
    rows = rows.select("*", *[binned(rule).alias(rule.name) for rule in rules]).withColumn(
        "base_failed",
        F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words"),
    )
    stratum = F.col("row")[stratum_col].cast("string")
    rows = written(rows.withColumn("stratum", F.coalesce(F.concat(F.lit("="), stratum), F.lit(""))), "measures")
    good_ids = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(
        F.col("doc_id").alias("good_id")
    )
    bins = rows.where("not base_failed").select("stratum", F.col("row")[id_col].alias("id"), *[r.name for r in rules])
    good = bins.join(good_ids, F.col("id") == F.col("good_id"), "left_semi")
    cutoffs = proven_cutoffs(good, rules, false_rejection, error).select(
        F.col("stratum").alias("of"), *[F.col(r.name).alias(f"most_{r.name}") for r in rules]
    )
    passed = [f"coalesce({r.name} <= most_{r.name}, true)" for r in rules]
    decided = rows.join(written(cutoffs, "cutoffs"), F.col("stratum") == F.col("of"), "left")
    return decided.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.expr(f"not base_failed and {' and '.join(passed)}").alias("kept"),
    )
