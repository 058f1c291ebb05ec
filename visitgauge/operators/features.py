"""Fitting and applying the feature preparation.

All fit statistics come from one table of counts per column and value, so the
rows are read and shuffled once, already combined. Answers and codes have few
distinct values, which keeps that table small; free numbers and texts work too:

* Medians are found by counting passes over ranges of values, never by ordering a column in one task.
* Categories are numbered by a range partitioning. Their index is a stored table, and rows are
  encoded into one sparse vector by joins with it, whatever the number of categories.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitgauge.operators.quality import require_columns
from visitgauge.schema import CATEGORICAL_FEATURES, FEATURES, KEY, NUMERIC_FEATURES, TARGET
from visitgauge.session import materialise

#: Ranges that a counting pass divides an interval into.
MEDIAN_BINS = 1024
#: Up to so many categories of a column, counted first, are broadcast to the rows; more are joined by a shuffle.
BROADCAST_CATEGORIES = 100_000


def as_number(name: str) -> Column:
    """The value as a number; null for texts that are none."""
    return F.col(name).try_cast("double")


def as_category(name: str) -> Column:
    """Category text of a column: whole codes print without a decimal point, other texts stay."""
    value = as_number(name)
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(F.col(name).cast("string"))


def value_counts(df: DataFrame) -> DataFrame:
    """Rows per (column, value) over all feature columns; null values included."""
    pairs = [
        F.struct(
            F.lit(name).alias("column"),
            F.col(name).cast("double").alias("number"),
            F.lit(None).cast("string").alias("category"),
        )
        for name in NUMERIC_FEATURES
    ] + [
        F.struct(
            F.lit(name).alias("column"),
            as_number(name).alias("number"),
            as_category(name).alias("category"),
        )
        for name in CATEGORICAL_FEATURES
    ]
    return (
        df.select(F.explode(F.array(*pairs)).alias("cell"))
        .groupBy("cell.column", "cell.number", "cell.category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def medians(counts: DataFrame, bins: int = MEDIAN_BINS) -> dict[str, float]:
    """Median of every column of ``counts`` (column, number, n), exact, without ordering any column.

    Each pass counts the rows of an interval by equal ranges and keeps the range with the wanted rank,
    narrowed to the lowest and highest value in it, until that is one value. Codes take one pass; free
    numbers a few more. A pass returns at most ``bins`` rows for each of the two middle ranks of a column.
    """
    spark = counts.sparkSession
    present = counts.where(F.col("number").isNotNull())
    whole = present.groupBy("column").agg(
        F.sum("n").alias("n"), F.min("number").alias("low"), F.max("number").alias("high")
    ).collect()
    # Both middle ranks of a column, from 1, inside an interval of values.
    middle = {(r["column"], k): [(r["n"] + 1 + k) // 2, r["low"], r["high"]] for r in whole for k in (0, 1)}
    while wanted := [(c, k, low, high) for (c, k), (_, low, high) in middle.items() if low < high]:
        ranges = F.broadcast(spark.createDataFrame(wanted, "column string, side int, low double, high double"))
        inside = present.join(ranges, "column").where(F.col("number").between(F.col("low"), F.col("high")))
        # Halves, so that the width of an interval has no overflow; of the smallest numbers they are 0.
        share = F.try_divide(F.col("number") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        ends = F.when(F.col("number") > F.col("low"), F.lit(bins - 1)).otherwise(F.lit(0))
        place = F.when(share.isNull(), ends).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))
        counted = inside.groupBy("column", "side", place.alias("bin")).agg(
            F.sum("n").alias("n"), F.min("number").alias("low"), F.max("number").alias("high")
        )
        for row in sorted(counted.collect(), key=lambda r: (r["column"], r["side"], r["bin"])):
            state = middle[row["column"], row["side"]]
            if state[0] > 0:
                state[0] -= row["n"]
                if state[0] <= 0:
                    # The rank inside this range, which becomes the interval.
                    state[:] = [-(state[0] + row["n"]), row["low"], row["high"]]
        for state in middle.values():
            state[0] = abs(state[0])
    return {r["column"]: (middle[r["column"], 0][1] + middle[r["column"], 1][1]) / 2 for r in whole}


def numeric_statistics(counts: DataFrame) -> DataFrame:
    """Median, and mean and population deviation after filling nulls with the median.

    Deviations are summed around the median: exact for whole answers, in any order. ``counts`` is read
    several times, so hand in a stored table.
    """
    numeric = counts.where(F.col("column").isin(*NUMERIC_FEATURES))
    found = [(c, m) for c, m in medians(numeric).items()]
    middle = counts.sparkSession.createDataFrame(found, "column string, median double")
    shift = F.coalesce(F.col("number") - F.col("median"), F.lit(0.0))
    # One row per numeric column.
    return (
        numeric.join(F.broadcast(middle), "column")
        .groupBy("column", "median")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("number").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
            F.sum(shift * F.col("n")).alias("s1"),
            F.sum(shift * shift * F.col("n")).alias("s2"),
        )
        .select(
            "column",
            "n_rows",
            "n_missing",
            "median",
            (F.col("median") + F.col("s1") / F.col("n_rows")).alias("mean"),
            F.sqrt(
                F.greatest(
                    F.lit(0.0),
                    F.col("s2") / F.col("n_rows")
                    - (F.col("s1") / F.col("n_rows")) * (F.col("s1") / F.col("n_rows")),
                )
            ).alias("std"),
        )
    )


def _categories_seen(counts: DataFrame) -> DataFrame:
    return counts.where(
        F.col("column").isin(*CATEGORICAL_FEATURES) & F.col("category").isNotNull()
    )


def categorical_statistics(counts: DataFrame) -> DataFrame:
    """Most frequent value of each categorical column (ties: the lowest)."""
    first = F.min(F.struct((-F.col("n")).alias("less"), "number", "category")).alias("first")
    return _categories_seen(counts).groupBy("column").agg(first).select(
        "column", F.col("first.category").alias("most_frequent"), (-F.col("first.less")).alias("n")
    )


def category_domains(counts: DataFrame) -> DataFrame:
    """Categories of each categorical column with their place in the encoding.

    Rows are numbered inside ranges of the order, and each range begins where the ones before it
    end, so no task holds a whole column.
    """
    order = ["column", "number", "category"]
    ranged = _categories_seen(counts).repartitionByRange(*order).sortWithinPartitions(*order)
    # Stored, since the numbers hold for this partitioning alone.
    rows = materialise(ranged.withColumn("id", F.monotonically_increasing_id()))
    runs = rows.groupBy("column", F.shiftright("id", 33).alias("run")).agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("k")
    )
    # One row for each range and column.
    before = F.sum("k").over(Window.partitionBy("column").orderBy("run")) - F.col("k")
    starts = runs.select("column", "run", (F.col("first") - before).alias("origin"))
    return (
        rows.withColumn("run", F.shiftright("id", 33))
        .join(F.broadcast(starts), ["column", "run"])
        .select("column", (F.col("id") - F.col("origin") + 1).cast("int").alias("place"), "category", "n")
    )


def fit_statistics(counts: DataFrame) -> DataFrame:
    """All fitted values in one table: numeric columns and categorical fills."""
    numeric = numeric_statistics(counts).select(
        "column", F.lit("numeric").alias("kind"), "median", "mean", "std",
        F.lit(None).cast("string").alias("most_frequent"),
    )
    nothing = F.lit(None).cast("double")
    categorical = categorical_statistics(counts).select(
        "column", F.lit("categorical").alias("kind"), nothing.alias("median"),
        nothing.alias("mean"), nothing.alias("std"), "most_frequent",
    )
    return numeric.unionByName(categorical)


@dataclass(frozen=True, eq=False)
class FeatureModel:
    """Fitted feature preparation: scaling values, fills, and the stored index of categories (column, place, category)."""

    numeric: dict[str, tuple[float, float, float]]
    fills: dict[str, str]
    sizes: dict[str, int]
    index: DataFrame

    def __eq__(self, other: object) -> bool:
        return (
            isinstance(other, FeatureModel)
            and (self.numeric, self.fills, self.sizes) == (other.numeric, other.fills, other.sizes)
            and self.index.exceptAll(other.index).isEmpty()
        )

    @cached_property
    def categories(self) -> dict[str, list[str]]:
        """Categories by column, for one plan column each; ``encode`` needs them nowhere but in the index."""
        rows = self.index.orderBy("column", "place").collect()
        return {c: [r["category"] for r in rows if r["column"] == c] for c in CATEGORICAL_FEATURES}

    @property
    def feature_names(self) -> list[str]:
        names = [f"num__{c}" for c in NUMERIC_FEATURES]
        return names + [
            f"cat__{c}_{v}" for c in CATEGORICAL_FEATURES for v in self.categories[c]
        ]

    @property
    def width(self) -> int:
        return len(NUMERIC_FEATURES) + sum(self.sizes.values())

    def columns(self) -> dict[str, Column]:
        """Feature expressions by name, in order."""
        return {**self.scaled(), **self.one_hot()}

    def scaled(self) -> dict[str, Column]:
        found = {}
        for name in NUMERIC_FEATURES:
            median, mean, std = self.numeric[name]
            filled = F.coalesce(F.col(name).cast("double"), F.lit(median))
            found[f"num__{name}"] = (filled - F.lit(mean)) / F.lit(std if std else 1.0)
        return found

    def one_hot(self) -> dict[str, Column]:
        """Dense indicator columns; an unknown category leaves all of them at 0."""
        found = {}
        for name in CATEGORICAL_FEATURES:
            filled = F.coalesce(as_category(name), F.lit(self.fills[name]))
            for value in self.categories[name]:
                found[f"cat__{name}_{value}"] = F.when(filled == value, 1.0).otherwise(0.0)
        return found

    def transform(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Kept columns followed by the feature columns."""
        require_columns(df, FEATURES, "feature table")
        return df.select(*keep, *[c.alias(n) for n, c in self.columns().items()])

    def encode(self, df: DataFrame, keep: list[str], output: str = "features") -> DataFrame:
        """Kept columns and one sparse vector with the values of ``feature_names``, in their order.

        Each categorical column is joined with its part of the index: broadcast if it is short, else
        shuffled. An unknown category leaves its part of the vector at 0.
        """
        require_columns(df, FEATURES, "feature table")
        rows = df.select(
            *keep,
            *[c.alias(f"_{n}") for n, c in self.scaled().items()],
            *[F.coalesce(as_category(c), F.lit(self.fills[c])).alias(f"_{c}") for c in CATEGORICAL_FEATURES],
        )
        for name in CATEGORICAL_FEATURES:
            own = self.index.where(F.col("column") == name).select(
                F.col("category").alias(f"_{name}"), (F.col("place") - 1).cast("double").alias(f"_{name}_place")
            )
            if self.sizes[name] <= BROADCAST_CATEGORIES:
                own = F.broadcast(own)
            # The place behind the last category stands for unknown ones; the encoder drops it.
            known = {"ml_attr": {"type": "nominal", "num_vals": self.sizes[name]}}
            place = F.coalesce(f"_{name}_place", F.lit(float(self.sizes[name])))
            rows = rows.join(own, f"_{name}", "left").withColumn(f"_{name}_place", place.alias(f"_{name}_place", metadata=known))
        places, parts = ([f"_{c}_{x}" for c in CATEGORICAL_FEATURES] for x in ("place", "part"))
        encoder = OneHotEncoder(inputCols=places, outputCols=parts, handleInvalid="keep", dropLast=True).fit(rows)
        assembler = VectorAssembler(inputCols=[*[f"_{n}" for n in self.scaled()], *parts], outputCol=output)
        return assembler.transform(encoder.transform(rows)).select(*keep, output)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, "numeric", 0, None, *self.numeric[c]) for c in NUMERIC_FEATURES]
        rows += [(c, "fill", self.sizes[c], self.fills[c], None, None, None) for c in CATEGORICAL_FEATURES]
        fitted = spark.createDataFrame(
            rows,
            "column string, kind string, place int, category string, "
            "median double, mean double, std double",
        )
        nothing = {c: F.lit(None).cast("double") for c in ("median", "mean", "std")}
        listed = self.index.select("column", F.lit("category").alias("kind"), "place", "category").withColumns(nothing)
        return fitted.unionByName(listed)

    @staticmethod
    def from_table(table: DataFrame) -> FeatureModel:
        # One row for each column; the categories stay in the table.
        rows = table.where("kind != 'category'").collect()
        return FeatureModel(
            numeric={
                r["column"]: (r["median"], r["mean"], r["std"])
                for r in rows
                if r["kind"] == "numeric"
            },
            fills={r["column"]: r["category"] for r in rows if r["kind"] == "fill"},
            sizes={r["column"]: r["place"] for r in rows if r["kind"] == "fill"},
            index=table.where("kind = 'category'").select("column", "place", "category"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_table(spark).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FeatureModel:
        return FeatureModel.from_table(spark.read.parquet(path))


def fit_features(train: DataFrame) -> FeatureModel:
    """Fit on training rows. A row for each column comes to the driver; the categories stay in a stored table."""
    require_columns(train, FEATURES, "feature table")
    counts = materialise(value_counts(train))
    numeric = {
        r["column"]: (r["median"], r["mean"], r["std"])
        for r in numeric_statistics(counts).collect()
    }
    fills = {
        r["column"]: r["most_frequent"] for r in categorical_statistics(counts).collect()
    }
    empty = [c for c in NUMERIC_FEATURES if c not in numeric]
    empty += [c for c in CATEGORICAL_FEATURES if c not in fills]
    if empty:
        raise ValueError(f"no values to fit in columns: {empty}")
    index = materialise(category_domains(counts).select("column", "place", "category"))
    sizes = {r["column"]: r["n"] for r in index.groupBy("column").agg(F.count(F.lit(1)).cast("int").alias("n")).collect()}
    return FeatureModel(numeric=numeric, fills=fills, sizes=sizes, index=index)


def transformed_table(model: FeatureModel, df: DataFrame) -> DataFrame:
    """Feature columns, the target and the respondent key if there is one, checked to have the fitted width."""
    columns = model.columns()
    if len(columns) != len(model.feature_names):
        raise ValueError(
            "Transformed feature width does not match feature names: "
            f"{len(columns)} != {len(model.feature_names)}"
        )
    return df.select(
        *[c.alias(n) for n, c in columns.items()], F.col(TARGET).cast("string").alias(TARGET),
        *[c for c in [KEY] if c in df.columns],
    )
