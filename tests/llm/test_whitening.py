"""Embedding whitening against plain exact sums and LAPACK."""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pytest
from llm import spectrum, whitening
from llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(vectors, scale=64, offset=1_000_000):
    """Distinct integer vectors, their number and sums, and the scatter, with Python's integers."""
    x = sorted({tuple(floor(scale * float(c)) + offset for c in v) for v in vectors})
    n, size = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(size)]
    deviations = [[n * c - s for c, s in zip(r, sums)] for r in x]
    scatter = [[sum(d[i] * d[j] for d in deviations) // n for j in range(size)] for i in range(size)]
    return x, n, sums, scatter


def test_query(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    _, n, sums, scatter = plain(rows.values())
    found = QUERIES["op12_whitening"](spark, FOLDER).collect()
    assert len(found) == 16 * len(rows)
    values, vectors = np.linalg.eigh(np.array(scatter, float))
    values, vectors = values[::-1], vectors[:, ::-1]
    white = np.zeros((len(rows), 16))
    places = {k: i for i, k in enumerate(sorted(rows))}
    for r in found:
        x = [floor(64 * float(c)) + 1_000_000 for c in rows[r["vec_id"]]]
        assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x, sums))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
        white[places[r["vec_id"]], r["component"] - 1] = r["whitened"]
    deviations = np.array([[n * (floor(64 * float(c)) + 1_000_000) - s for c, s in zip(rows[k], sums)] for k in sorted(rows)], float)
    own = deviations @ vectors[:, :16] / np.sqrt(values[:16])
    assert np.abs(np.abs((own * white).sum(0)) - (own**2).sum(0)).max() < 1e-6 * len(rows)
    assert np.abs(np.abs(own) - np.abs(white)).max() < 1e-7


def test_characteristic_polynomial_is_exact():
    generator = np.random.default_rng(3)
    for size in (1, 2, 5, 9):
        x = generator.integers(-50, 50, (size + 3, size)).astype(object)
        a = (x.T @ x).tolist()
        primes = spectrum.primes_for(spectrum.coefficient_bound(a))
        residues = [spectrum.characteristic_residues((np.array(a, object) % p).astype(np.int64).reshape(size, size), p).tolist() for p in primes]
        polynomial = spectrum.joined(primes, residues)
        # Leverrier's traces of powers give the same coefficients in rationals.
        power, plain_coefficients, m = np.array(a, object), [Fraction(1)], np.zeros((size, size), object)
        for k in range(1, size + 1):
            m = power @ m + plain_coefficients[-1] * np.eye(size, dtype=int).astype(object)
            plain_coefficients.append(-Fraction(sum((power @ m)[i, i] for i in range(size)), k))
        assert polynomial == [int(c) for c in reversed(plain_coefficients)]


def test_equal_and_close_roots():
    # (t - 3)^2 (t - 7) (t - 1) t
    polynomial = [1]
    for root in (0, 1, 3, 3, 7):
        polynomial = [b - root * a for a, b in zip([*polynomial, 0], [0, *polynomial])]
    roots = spectrum.largest_roots(polynomial, 5)
    assert [(round(r / 2**b, 12), m) for r, b, m in roots] == [(7, 1), (3, 2), (1, 1)]
    assert [m for *_, m in spectrum.largest_roots(polynomial, 2)] == [1, 2]
    near = [1]
    for root in (10**30, 10**30 + 1, 5):
        near = [b - root * a for a, b in zip([*near, 0], [0, *near])]
    assert [m for *_, m in spectrum.largest_roots(near, 3)] == [1, 1, 1]


def test_repeated_eigenvalues_have_a_basis(spark):
    rows = [(k, [float(5 * (k % 4 == j)) * (1 if k < 4 else -1) for j in range(4)]) for k in range(8)] * 2
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = whitening.whiten(frame, components=4).collect()
    white = np.array([r["whitened"] for r in found])
    assert len(found) == 16 and {r["n"] for r in found} == {8}
    assert np.abs(white.T @ white / 16 - np.eye(4)).max() < 1e-12
    assert all(r["explained"] == pytest.approx([0.25] * 4) for r in found)


def test_odd_vectors(spark):
    rows = [(k, [k % 3 + 0.25, 1.0, float(k)], "x") for k in range(6)] + [
        (20, None, "x"), (21, [0.0, 0.0, 0.0], "x"), (22, [float("nan"), 1.0, 1.0], "x"), (23, [None, 1.0, 1.0], "x"),
        (24, [1.0], "x"), (None, [1.0, 1.0, 2.0], "x"), (25, [float("inf"), 0.0, 0.0], "x"), (26, [], "x"), (5, [2.25, 1.0, 5.0], "x"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string")
    found = whitening.whiten(frame).collect()
    assert sorted(str(r["row"]["vec_id"]) for r in found) == sorted(map(str, [0, 1, 2, 3, 4, 5, 5, 21, None]))
    kept = [r for r in rows if r[0] in (None, 0, 1, 2, 3, 4, 5, 21)]
    _, n, sums, scatter = plain([r[1] for r in kept])
    assert {r["n"] for r in found} == {n}
    assert {len(r["whitened"]) for r in found} == {np.linalg.matrix_rank(np.array(scatter, float))}
    same = [r["whitened"] for r in found if r["row"]["vec_id"] == 5]
    assert same[0] == same[1]
    assert whitening.whiten(frame.limit(0)).count() == 0
    alone = whitening.whiten(frame.where("vec_id = 1")).collect()
    assert [(r["n"], r["whitened"], int(r["deviation"])) for r in alone] == [(1, [], 0)]


def test_sums_of_large_entries_are_exact(spark):
    rows = [(k, [float(2**49 - 3**k), float(-(2**40) * k), 1.0 / (k + 1)]) for k in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    _, n, sums, _ = plain([r[1] for r in rows])
    for r in whitening.whiten(frame).collect():
        x = [floor(64 * c) + 1_000_000 for c in r["row"]["embedding"]]
        assert int(r["deviation"]) == sum((n * c - s) ** 2 for c, s in zip(x, sums))
        assert r["identity_error"] < 1e-4
