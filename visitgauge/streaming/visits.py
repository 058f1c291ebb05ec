"""Streams over visits: scoring, daily activity, changes and running counts.

Results don't depend on how rows are spread over files and micro-batches, nor on
their order of arrival: late visits correct what was written before. Every batch
writes folders of its own number and replaces them when it is replayed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from visitgauge.functions.identity import filled, first_filled
from visitgauge.functions.scoring import binary_half_up, risk_band
from visitgauge.operators.history import change_status
from visitgauge.operators.sequence import with_previous
from visitgauge.sources.visits import visit_documents, write_visits


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64
) -> DataFrame:
    """Parquet file stream with a bounded micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def for_each_batch(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Give everything available now to ``write``, batch by batch, and stop."""
    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _numbers(spark: SparkSession, path: str, name: str = "version") -> list[int]:
    """Numbers of the completely written folders ``name=N`` below ``path``, ascending."""
    system, folder = _files(spark, path)
    if not system.exists(folder):
        return []
    names = [str(status.getPath().getName()) for status in system.listStatus(folder)]
    done = [n for n in names if n.startswith(f"{name}=") and system.exists(_files(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n.removeprefix(f"{name}=")) for n in done)


def publish(table: DataFrame, path: str, number: int) -> None:
    """Write a new version of a small table; readers keep the one they read.

    The version before it stays for them, older ones go.
    """
    spark = table.sparkSession
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")
    for old in _numbers(spark, path):
        if old < number - 1:
            system, folder = _files(spark, f"{path}/version={old}")
            system.delete(folder, True)


def published(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Newest complete version of a table, or the newest one before a number; None if there is none."""
    found = [v for v in _numbers(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={found[-1]}") if found else None


def score_and_append(
    requests: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
) -> StreamingQuery:
    """Score each micro-batch and append it to the visit table.

    A batch writes its own folder and replaces it when replayed, so a restart
    neither loses nor repeats visits. Two equal requests stay two visits.
    """

    def write(batch: DataFrame, number: int) -> None:
        write_visits(visit_documents(score(batch)), f"{path}/batch={number}", "overwrite")

    return for_each_batch(requests, write, checkpoint)


DAY_KEY = ["start", "visit_day"]


def daily_activity(visits: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Keep visits and sum of totals per day at ``path``; ``read_daily_activity`` reads it.

    Days are event-time windows under a watermark of ``delay``: their running sums stay in the state store
    until the watermark has passed them, so the state holds the days around the newest visit, whatever
    the history. Visits behind the watermark never reach the state. They are recognised by the same
    watermark: a day whose rows came in a batch, but which the state didn't update, was late. Such rows are
    summed on the side, and reading adds them, so late visits count as well.

    The published table has a row for each day. A batch adds its days to the version before it, and a
    replayed batch counts once. A visit without a time counts for a day without a name.
    """
    at = F.col("created_at").cast("timestamp")
    rows = visits.select(
        at.alias("at"),
        F.date_format(at, "yyyy-MM-dd").alias("visit_day"),
        F.coalesce(F.col("phq9_total"), F.lit(0)).cast("bigint").alias("total"),
    )
    one = F.lit(1).cast("bigint")
    # A day of the session's time zone lies in two windows at most; its name keeps the parts apart.
    state = rows.withWatermark("at", delay).groupBy(F.window("at", "1 day"), "visit_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total").alias("sum")
    ).select(F.col("window.start").alias("start"), "visit_day", F.lit(True).alias("in_state"), "n", "sum")
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("at") / 86_400) * 86_400)
    given = rows.select(start.alias("start"), "visit_day", F.lit(False).alias("in_state"), one.alias("n"), F.col("total").alias("sum"))

    def write(batch: DataFrame, number: int) -> None:
        # One pass over the batch, so that the state is updated once.
        kept, came = F.col("in_state"), ~F.col("in_state")
        days = batch.groupBy(*DAY_KEY).agg(
            F.max(F.when(kept, F.struct("n", "sum"))).alias("running"),
            F.sum(F.when(came, F.col("n"))).alias("n"),
            F.sum(F.when(came, F.col("sum"))).alias("sum"),
        )
        late = F.col("running").isNull()
        days = days.select(
            *DAY_KEY, "running",
            F.when(late, F.col("n")).otherwise(F.lit(0)).alias("late_visits"),
            F.when(late, F.col("sum")).otherwise(F.lit(0)).alias("late_total"),
        )
        so_far = published(batch.sparkSession, path, before=number)
        every = days if so_far is None else so_far.unionByName(days)
        publish(
            every.groupBy(*DAY_KEY).agg(
                # Running sums only grow, so the largest count is the newest.
                F.max("running").alias("running"),
                F.sum("late_visits").alias("late_visits"),
                F.sum("late_total").alias("late_total"),
            ),
            path, number,
        )

    return for_each_batch(state.unionByName(given), write, checkpoint, "update")


def read_daily_activity(spark: SparkSession, path: str) -> DataFrame:
    """Visits and mean total of every day so far, late ones included."""
    days = published(spark, path)
    if days is None:
        fields = "visit_day string, running struct<n: bigint, sum: bigint>, late_visits bigint, late_total bigint"
        days = spark.createDataFrame([], fields)
    sums = days.groupBy("visit_day").agg(
        F.sum(F.coalesce("running.n", F.lit(0)) + F.col("late_visits")).alias("n_visits"),
        F.sum(F.coalesce("running.sum", F.lit(0)) + F.col("late_total")).alias("sum_total"),
    )
    return sums.select(
        "visit_day",
        "n_visits",
        binary_half_up(F.col("sum_total") / F.col("n_visits"), 2).alias("mean_total"),
    )


def running_counts(visits: DataFrame) -> DataFrame:
    """Visits by band and level so far; a few rows whatever the history."""
    level = first_filled(F.col("predicted_severity"), F.lit("Unknown"))
    band = F.coalesce(filled(F.col("risk_band")), risk_band(level, "Low"))
    return visits.groupBy(band.alias("risk_band"), level.alias("severity")).agg(
        F.count(F.lit(1)).alias("n_visits")
    )


def publish_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the newest complete table of running counts at ``path``, for ``published``."""

    def write(batch: DataFrame, number: int) -> None:
        publish(batch, path, number)

    return for_each_batch(counts, write, checkpoint, "complete")


CHANGE_KEY = ["patient_id", "visit_id", "created_at"]
#: Stored visits lie in so many parts by patient; a batch reads the parts of its patients.
BUCKETS = 512
#: So many batches are stored one by one before they are joined with all earlier ones.
COMPACT_AFTER = 32
STORED_VISITS = "patient_id string, visit_id bigint, created_at timestamp, total bigint, batch bigint, bucket int"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("patient_id"), F.lit(BUCKETS)).cast("int")


def stored_visits(spark: SparkSession, path: str, number: int, buckets: list[int] | None = None) -> DataFrame:
    """Visits of all batches up to ``number``, of some buckets or all.

    The newest compacted version holds all batches up to its own number, and the folders of later
    batches the rest. Buckets are folders, so others are never listed as input of the scan.
    """
    def part(folder: str) -> DataFrame:
        rows = spark.read.schema(STORED_VISITS).option("basePath", folder).parquet(folder)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    base = max((v for v in _numbers(spark, f"{path}/base") if v < number), default=-1)
    parts = [part(f"{path}/base/version={base}")] if base >= 0 else []
    parts += [part(f"{path}/visits/batch={n}") for n in _numbers(spark, f"{path}/visits", "batch") if base < n <= number]
    return reduce(DataFrame.unionByName, parts)


def _write_buckets(rows: DataFrame, folder: str) -> None:
    """Rows by bucket, each bucket written by one task and sorted by patient, so that a bucket is one file."""
    dealt = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "patient_id", "created_at")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)


def _compact(spark: SparkSession, path: str, number: int) -> None:
    """A new version of all stored visits up to ``number``; what the version before it held goes.

    A replayed batch finds all it needs: the version before stays, with the folders of the batches behind it.
    """
    _write_buckets(stored_visits(spark, path, number), f"{path}/base/version={number}")
    versions = _numbers(spark, f"{path}/base")
    old = [v for v in versions if v < number][-1:]
    gone = [f"{path}/base/version={v}" for v in versions if v < number and v not in old]
    gone += [f"{path}/visits/batch={n}" for n in _numbers(spark, f"{path}/visits", "batch") if old and n <= old[0]]
    for folder in gone:
        system, place = _files(spark, folder)
        system.delete(place, True)


def visit_changes(visits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Follow every visit's change since the patient's visit before it; ``read_visit_changes`` reads it.

    A batch is stored by bucket of the patient, then ordered with the stored visits of its patients, read
    from their buckets alone. It writes its own visits and those whose predecessor it brought, so a late
    visit also corrects the visit behind it. Batches are compacted from time to time.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = batch.where(filled(F.col("patient_id")).isNotNull()).select(
            "patient_id",
            "visit_id",
            F.col("created_at").cast("timestamp").alias("created_at"),
            F.coalesce(F.col("phq9_total"), F.lit(0)).cast("bigint").alias("total"),
            F.lit(number).cast("bigint").alias("batch"),
            _bucket().alias("bucket"),
        )
        own_folder = f"{path}/visits/batch={number}"
        _write_buckets(keyed, own_folder)
        own = spark.read.schema(STORED_VISITS).parquet(own_folder)
        # At most BUCKETS numbers.
        buckets = [r["bucket"] for r in own.select("bucket").distinct().collect()]
        stored = stored_visits(spark, path, number, buckets)
        ordered = with_previous(
            stored.join(own.select("patient_id").distinct(), "patient_id", "left_semi"),
            "patient_id",
            ["created_at", "visit_id"],
            ["total", "batch"],
        )
        changed = ordered.where((F.col("batch") == number) | (F.col("previous_batch") == number))
        changed.select(*CHANGE_KEY, "total", "previous_total").write.mode("overwrite").parquet(
            f"{path}/changes/batch={number}"
        )
        if number % COMPACT_AFTER == COMPACT_AFTER - 1:
            _compact(spark, path, number)

    return for_each_batch(visits, write, checkpoint)


def read_visit_changes(spark: SparkSession, path: str) -> DataFrame:
    """Every visit so far with its change, from the last batch that wrote it."""
    fields = T.StructType.fromDDL(
        "patient_id string, visit_id bigint, created_at timestamp, total bigint,"
        " previous_total bigint, batch bigint"
    )
    rows = spark.read.schema(fields).parquet(f"{path}/changes")
    newest = rows.groupBy(*CHANGE_KEY).agg(
        F.max(F.struct("batch", "total", "previous_total")).alias("newest")
    )
    change = F.col("total") - F.col("previous_total")
    return newest.select(*CHANGE_KEY, "newest.total", "newest.previous_total").withColumns(
        {
            "change": change,
            "status": F.when(change.isNull(), "insufficient_history").otherwise(
                change_status(change)
            ),
        }
    )
