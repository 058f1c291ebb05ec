"""Whitening of embeddings by exact principal components.

* Components are quantised to integers, and equal integer vectors count once: their distinct list is
  written and read again by all later steps.
* Sums of products are exact integers. Tasks add them up for their rows and send a fixed number of
  values; Spark adds those up by place, so nothing that follows the rows reaches the driver.
* The integer scatter n * sum(x x') - S S' is n * n times the covariance. Its spectrum is computed by
  ``llm.spectrum``: one Spark row for each prime of the characteristic polynomial, and one for each
  root whose vectors are wanted. Only values of the size of the matrix pass through the driver.
* One more pass over the distinct list measures how far the covariance of the whitened vectors is
  from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import spectrum
from llm.stages import written

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Larger entries have no place in a 64-bit integer after scaling; such rows take no part.
LARGEST_ENTRY = 2.0**50
BLOCK_ROWS = 4096
#: Products of entries below this, summed over a block, are exact in doubles.
EXACT_ENTRY = 2**20
LIMB_BITS, LIMBS = 40, 5


class Whitening(NamedTuple):
    """``n`` distinct vectors, their sums by dimension, and by component: vector, eigenvalue of the
    scatter, share of the trace; the largest deviation from the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    scatter_values: np.ndarray
    explained: list[float]
    identity_error: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they fit, else Python's."""
        largest = max([abs(s) for s in self.sums] + [int(np.abs(x).max(initial=0)) * self.n])
        if largest < 2**62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return deviations.astype(float) @ self.vectors.T / np.sqrt(self.scatter_values)


def usable(df: DataFrame, vector_col: str, scale: int, offset: int) -> DataFrame:
    """``row`` (a struct of the columns) and ``x`` (array of longs) of rows that take part."""
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[vector_col].cast("array<double>").alias("vector"))
    # NaN is larger than every number in Spark's order.
    fine = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < F.lit(LARGEST_ENTRY)))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)
    return rows.select("row", F.transform("vector", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset)).alias("x"))


def common_size(rows: DataFrame) -> int:
    """Length of most vectors; of equally common lengths the least."""
    first = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    return first["size"] if first else 0


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def products(z: np.ndarray) -> np.ndarray:
    """z' z as Python integers, exact."""
    total = np.zeros((z.shape[1],) * 2, object)
    for first in range(0, len(z), BLOCK_ROWS):
        block = z[first : first + BLOCK_ROWS]
        if np.abs(block).max(initial=0) < EXACT_ENTRY:
            wide = block.astype(float)
            total += (wide.T @ wide).astype(np.int64).astype(object)
        else:
            wide = block.astype(object)
            total += wide.T @ wide
    return total


def scatter(fit: DataFrame, size: int, offset: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and sums of products of the distinct vectors less the offset, exact."""
    upper = np.triu_indices(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1), object)
        for batch in batches:
            x = matrix(batch["x"], size) - offset
            total += products(np.hstack([x, np.ones((len(x), 1), np.int64)]))
        flat, parts = total[upper], []
        for limb in range(LIMBS):
            last = limb == LIMBS - 1
            digit = flat >> LIMB_BITS * limb
            parts.append(np.array(digit if last else digit & (1 << LIMB_BITS) - 1, np.int64))
        places = np.arange(len(flat), dtype=np.int32)
        for limb, values in enumerate(parts):
            some = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places[some]), pa.array(np.full(len(some), limb, np.int32)), pa.array(values[some])],
                ["place", "limb", "value"],
            )

    summed = fit.mapInArrow(run, "place int, limb int, value long").groupBy("place", "limb").agg(F.sum("value").alias("value"))
    total = np.zeros((size + 1, size + 1), object)
    # At most LIMBS rows for each place of the matrix.
    for place, limb, value in summed.collect():
        total[upper[0][place], upper[1][place]] += value << LIMB_BITS * limb
    total = total + np.triu(total, 1).T
    return total[size, size], total[size, :size].tolist(), total[:size, :size].tolist()


def characteristic(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Coefficients of the characteristic polynomial, constant first; a row of residues for each prime."""
    primes = spectrum.primes_for(spectrum.coefficient_bound(a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.array(a, object)
        for batch in batches:
            own = [primes[k] for k in batch["id"].to_pylist()]
            found = [spectrum.characteristic_residues((entries % p).astype(np.int64), p).tolist() for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found, pa.list_(pa.int64()))], ["prime", "residues"])

    parts = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.range(0, len(primes), 1, parts).mapInArrow(run, "prime long, residues array<bigint>").collect()
    return spectrum.joined([r["prime"] for r in rows], [r["residues"] for r in rows])


def components_of(spark: SparkSession, a: list[list[int]], roots: list[tuple[int, int, int]]) -> np.ndarray:
    """Unit vectors of all roots, in their order; a Spark row for each root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch["id"].to_pylist()
            found = [spectrum.null_vectors(a, *roots[k]).reshape(-1).tolist() for k in places]
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(found, pa.list_(pa.float64()))], ["place", "flat"])

    rows = spark.range(0, len(roots), 1, len(roots)).mapInArrow(run, "place long, flat array<double>").collect()
    return np.vstack([np.array(r["flat"]).reshape(-1, len(a)) for r in sorted(rows)])


def identity_error(fit: DataFrame, model: Whitening, offset: int) -> float:
    """Largest entry of the whitened distinct vectors' covariance less the identity."""
    size, many = len(model.sums), len(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((many + 1, many + 1))
        for batch in batches:
            white = model.whitened(model.deviations(matrix(batch["x"], size) - offset))
            wide = np.hstack([white, np.ones((len(white), 1))])
            total += wide.T @ wide
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

    total = np.zeros((many + 1) ** 2)
    for place, value in fit.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value")).collect():
        total[place] = value
    total = total.reshape(many + 1, many + 1) / model.n
    # Deviations are centred exactly, so the means left here are rounding alone.
    means = total[-1, :-1]
    return float(np.abs(total[:-1, :-1] - np.outer(means, means) - np.eye(many)).max(initial=0))


def fitted(rows: DataFrame, size: int, components: int, offset: int) -> Whitening:
    """The whitening of ``rows`` (x), whose vectors have ``size`` components."""
    spark = rows.sparkSession
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    n, sums, inner = scatter(fit, size, offset)
    a = [[n * inner[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    trace = sum(a[k][k] for k in range(size))
    empty = Whitening(n, sums, np.zeros((0, size)), np.zeros(0), [], 0.0)
    if not trace:
        return empty
    roots = spectrum.largest_roots(characteristic(spark, a), components)
    vectors = components_of(spark, a, roots)[:components]
    values = [Fraction(root, 1 << bits) for root, bits, many in roots for _ in range(many)][:components]
    model = Whitening(n, sums, vectors, np.array([float(v) for v in values]), [float(v / trace) for v in values], 0.0)
    return model._replace(identity_error=identity_error(fit, model, offset))


def squared_lengths(deviations: np.ndarray) -> pa.Array:
    """Sums of squares of every row, exact."""
    if deviations.dtype != object and np.abs(deviations).max(initial=0) < 2**52:
        high, low = deviations >> 26, deviations & (1 << 26) - 1
        parts = [(high * high).sum(1), (high * low).sum(1), (low * low).sum(1)]
        sums = [(int(a) << 52) + (int(b) << 27) + int(c) for a, b, c in zip(*parts)]
    else:
        sums = [int((row * row).sum()) for row in deviations.astype(object)]
    # Beyond 38 digits there is no Spark number to hold it.
    return pa.array([s if s < 10**38 else None for s in sums], pa.decimal128(38, 0))


def whiten(
    df: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
    vector_col: str = "embedding",
) -> DataFrame:
    """``row`` (a struct of the input's columns), ``n``, ``deviation`` (decimal), ``whitened`` and
    ``explained`` (arrays by component, the largest eigenvalue first) and ``identity_error``.

    x is floor(scale * entry) + offset; statistics are those of the distinct x. Rows with a null or
    empty vector, or with null, non-finite or huge entries (2**50 and more) take no part, nor do
    vectors of another length than most. Zero vectors, null ids and repeated rows take part; equal
    vectors get equal results. Components without variance are left out, so the arrays can be
    shorter than asked for, and are empty if all vectors are equal. Equal eigenvalues have one of
    their many bases. An empty table gives an empty result. Other columns are kept, whatever their names.
    """
    rows = usable(df, vector_col, scale, offset)
    size = common_size(rows)
    rows = rows.where(F.size("x") == size)
    model = fitted(rows, size, components, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            deviations = own.deviations(matrix(batch["x"], size) - offset)
            white = own.whitened(deviations)
            ends = pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32)) if white.size else None
            lists = pa.ListArray.from_arrays(ends, pa.array(white.reshape(-1))) if white.size else pa.array(
                [[]] * len(white), pa.list_(pa.float64())
            )
            yield pa.RecordBatch.from_arrays([batch["row"], squared_lengths(deviations), lists], ["row", "deviation", "whitened"])

    sent = rows.sparkSession.sparkContext.broadcast(model)  # components x dimensions
    kind = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(run, f"row {kind}, deviation decimal(38,0), whitened array<double>")
    return done.select(
        "row",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, model.explained)).cast("array<double>").alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
