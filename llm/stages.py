"""Helpers shared by the operators: tables, written stages and text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitgauge.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/llm-stages-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Later steps and retried tasks read the files, so a lost executor costs only
    its own unfinished tasks. The folder belongs to the application; see
    ``clear_stages``.
    """
    spark = df.sparkSession
    folder = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def clear_stages(spark: SparkSession) -> None:
    """Delete all written stages of this application. Frames built on them can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator needs, under fixed names; other columns can't clash."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``most_bytes`` of text, so that the memory of a
    Python worker doesn't follow the number of rows in an Arrow batch. A longer text is a run alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        first = held = 0
        for row, length in enumerate(lengths.tolist()):
            if held and held + length > most_bytes:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += length + 64
        if first < batch.num_rows:
            yield batch.slice(first)


def remainder(id_col: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor
