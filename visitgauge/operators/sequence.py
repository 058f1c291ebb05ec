"""Order-dependent columns per key that stay balanced when one key is huge.

A plain window sends every row of a key to one task. That is the best plan while
keys are small. Keys above ``hot_rows`` take another path: their rows are
range-partitioned by (key, order), so a key spreads over many tasks, each run is
numbered on its own, and the few run summaries carry the state across runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitgauge.session import materialise

HOT_ROWS = 1_000_000


def _plain(df: DataFrame, key: str, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    window = Window.partitionBy(key).orderBy(*order)
    columns = {f"previous_{c}": F.lag(c).over(window) for c in carry}
    columns["position"] = F.row_number().over(window).cast("bigint")
    return df.withColumns(columns)


def _spread(
    df: DataFrame, key: str, order: Sequence[str], carry: Sequence[str], runs: int
) -> DataFrame:
    # The run number comes from the range shuffle, whose bounds are sampled; the
    # checkpoint makes both uses below see the same runs.
    tagged = materialise(
        df.repartitionByRange(runs, key, *order).withColumn("_run", F.spark_partition_id())
    )
    in_run = Window.partitionBy(key, "_run").orderBy(*order)
    across = Window.partitionBy(key).orderBy("_run")
    ends = (
        tagged.groupBy(key, "_run")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.max_by(F.struct(*carry), F.struct(*order)).alias("_last"),
        )
        .select(
            key,
            "_run",
            F.lag("_last").over(across).alias("_carried"),
            (F.sum("_rows").over(across) - F.col("_rows")).alias("_before"),
        )
    )
    numbered = tagged.withColumns(
        {f"previous_{c}": F.lag(c).over(in_run) for c in carry}
        | {"_n": F.row_number().over(in_run)}
    )
    # At most one summary row per run plus one per hot key, so it is safe to broadcast.
    joined = numbered.join(F.broadcast(ends), [key, "_run"])
    first = F.col("_n") == 1
    filled: dict[str, Column] = {
        f"previous_{c}": F.when(first, F.col(f"_carried.{c}")).otherwise(
            F.col(f"previous_{c}")
        )
        for c in carry
    }
    filled["position"] = (F.col("_before") + F.col("_n")).cast("bigint")
    return joined.withColumns(filled).drop("_run", "_n", "_carried", "_before")


def with_previous(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    carry: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``previous_<c>`` for each carried column and the ``position`` within the key.

    ``order`` must be unique within a key. One counting job decides whether any
    key is hot; without one the result is a plain window.
    """
    hot = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
    )
    size = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    hot_keys, hot_total = size[0], size[1]
    if not hot_keys:
        return _plain(df, key, order, carry)
    # Each hot key has more than hot_rows rows, so there are at most rows / hot_rows of them.
    names = F.broadcast(hot.select(key))
    runs = max(2, -(-hot_total // hot_rows) * 2)
    is_hot = df.join(names, key, "left_semi")
    rest = df.join(names, key, "left_anti")
    parts = [_plain(rest, key, order, carry), _spread(is_hot, key, order, carry, runs)]
    return reduce(DataFrame.unionByName, parts)
