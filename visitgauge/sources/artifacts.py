"""Written stages and reports, and a manifest of what exists."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitgauge.operators.fairness import REPORT_COLUMNS
from visitgauge.schema import KEY, TARGET
from visitgauge.sources.survey import read_or_fail

TEXT_COLUMNS = {"group_column", "group_value", "group_label", "fairness_flag", "notes"}
COUNT_COLUMNS = {"sample_size", "min_group_size"}
REPORT_SCHEMA = ", ".join(
    f"`{c}` {'string' if c in TEXT_COLUMNS else 'bigint' if c in COUNT_COLUMNS else 'double'}"
    for c in REPORT_COLUMNS
)


def store(df: DataFrame, path: str, *partitions: str, file_format: str = "parquet") -> DataFrame:
    """Write a stage and read it back, so later steps start from the stored table."""
    writer = df.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.save(path)
    reader = df.sparkSession.read.format(file_format)
    if file_format == "csv":
        reader = reader.option("header", True).schema(df.schema)
    return reader.load(path)


def read_split(
    spark: SparkSession, train_path: str, test_path: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Transformed train and test tables and the feature columns (all but the target and the key)."""
    problem = "Processed train/test files are missing. Run the preprocessing first."
    tables = []
    for path in (train_path, test_path):
        table = read_or_fail(lambda path=path: spark.read.parquet(path), problem)
        if TARGET not in table.columns:
            raise ValueError(f"{path} is missing {TARGET}.")
        tables.append(table)
    return tables[0], tables[1], [c for c in tables[0].columns if c not in (TARGET, KEY)]


def write_fairness_report(report: DataFrame, path: str) -> None:
    """One sorted CSV; a report has one row per demographic group."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_fairness_report(spark: SparkSession, path: str) -> DataFrame:
    return read_or_fail(
        lambda: spark.read.option("header", True).schema(REPORT_SCHEMA).csv(path),
        f"Fairness report not found: {path}",
    )


def write_json_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


#: Files up to this size are hashed by the JVM as one value; larger ones are streamed in parts of CHUNK_BYTES.
WHOLE_BYTES, CHUNK_BYTES = 64 << 20, 8 << 20
#: File digests that are joined at a time for the digest of a folder.
DIGEST_GROUP = 10_000


def _files(spark: SparkSession, name: str, path: str) -> DataFrame | None:
    """Listing of a file or folder; contents are read only where ``content`` is used."""
    try:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .load(path)
            .select(F.lit(name).alias("artifact"), "length", "modificationTime", "content", "path")
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def chunked_digests(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``files`` (path and others) with ``sha``, SHA-256 of each file, read in parts of bounded size.

    One file is the work of one task, since a digest follows the bytes in order; files are dealt to
    tasks by path. The path must be one that Arrow's file systems can open.
    """
    rest = [c for c in files.columns if c != "path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                # Spark writes file:/x where others expect file:///x.
                system, place = FileSystem.from_uri(re.sub("^file:/+", "file:///", quote(path, safe=":/")))
                digest = hashlib.sha256()
                with system.open_input_stream(place) as stream:
                    while part := stream.read(chunk_bytes):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), batch["path"], pa.array(found, pa.string())], [*rest, "path", "sha"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "path")
    dealt = files.select(*rest, "path").repartition("path")
    return dealt.mapInArrow(run, f"{fields}, path string, sha string")


def artifact_manifest(
    spark: SparkSession, paths: dict[str, str], whole_bytes: int = WHOLE_BYTES, group: int = DIGEST_GROUP
) -> DataFrame:
    """Existence, size, newest change and SHA-256 of each named file or folder.

    A folder's hash is taken over the hashes of its files in path order; beyond ``group`` files it is taken
    over the hashes of such groups. Files of more than ``whole_bytes`` are hashed in parts, so no size is too large.
    """
    found = [f for f in (_files(spark, n, p) for n, p in paths.items()) if f is not None]
    expected = spark.createDataFrame(list(paths.items()), "artifact string, path string")
    if not found:
        return expected.select("artifact", "path", F.lit(False).alias("exists"))
    files = reduce(DataFrame.unionByName, found)
    listed = ["artifact", "length", "modificationTime", "path"]
    # The source skips files by their length before it opens them.
    small = files.where(F.col("length") <= whole_bytes).select(*listed, F.sha2("content", 256).alias("sha"))
    large = chunked_digests(files.where(F.col("length") > whole_bytes).select(*listed))
    place = F.row_number().over(Window.partitionBy("artifact").orderBy("path"))
    hashed = small.unionByName(large).withColumn("part", F.floor((place - 1) / group))

    def joined(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        """One hash for each key: of the only row, or over all in their order."""
        grouped = rows.groupBy(*keys).agg(
            F.sum("length").alias("length"),
            F.max("modificationTime").alias("modificationTime"),
            F.array_sort(F.collect_list(F.struct(order, "sha"))).alias("parts"),
        )
        digest = F.when(F.size("parts") == 1, F.col("parts")[0]["sha"]).otherwise(
            F.sha2(F.array_join(F.col("parts.sha"), ""), 256)
        )
        return grouped.select(*keys, "length", "modificationTime", digest.alias("sha"))

    summary = joined(joined(hashed, ["artifact", "part"], "path"), ["artifact"], "part")
    return expected.join(summary, "artifact", "left").select(
        "artifact",
        "path",
        F.col("sha").isNotNull().alias("exists"),
        F.col("length").alias("size_bytes"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("modified_at"),
        F.col("sha").alias("sha256"),
    )
