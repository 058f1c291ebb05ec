"""Eigenvalues and eigenvectors of an integer symmetric matrix without negative eigenvalues, by exact arithmetic.

1. The characteristic polynomial modulo many primes: the matrix is brought to Hessenberg form by
   similarity in the field of each prime, where no rounding exists.
2. Chinese remaindering joins the residues to the integer coefficients; their bound is known from the trace.
3. Roots are isolated by counting sign changes of the polynomial moved to a point, which is exact when
   all roots are real, and refined by bisection on integers. Equal roots stay together.
4. Eigenvectors are null-space vectors: the matrix less the root is factored in fixed-point integers
   of some hundred bits, and a block of vectors is iterated and orthonormalised.

The work depends on the size of the matrix and of its entries, not on the rows they were summed from.
"""

from __future__ import annotations

from math import comb, isqrt

import numpy as np

#: Relative width to which a root is refined; roots nearer to each other count as equal.
ROOT_BITS = 160
#: Fractional bits of the inverse iteration, and how far from the root (relative) the matrix is moved.
WORK_BITS, SHIFT_BITS = 640, 200


def is_prime(n: int) -> bool:
    """Miller-Rabin; these bases are certain below 3 * 10**24."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)):
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2**31 whose product is more than ``bound``."""
    found, product, n = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(matrix: list[list[int]]) -> int:
    """More than twice every coefficient: for eigenvalues without sign, the mean bounds their symmetric functions."""
    size = len(matrix)
    mean = sum(matrix[k][k] for k in range(size)) // max(size, 1) + 1
    return 2 * max(comb(size, k) * mean**k for k in range(size + 1)) + 1


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """The matrix (residues) brought to upper Hessenberg form by similarity modulo ``p``."""
    a, size = a.copy(), len(a)
    for k in range(size - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            a[[k + 1, pivot]] = a[[pivot, k + 1]]
            a[:, [k + 1, pivot]] = a[:, [pivot, k + 1]]
        factors = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factors[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factors % p).sum(1)) % p
    return a


def characteristic_residues(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of the characteristic polynomial modulo ``p``, constant first, from the recurrence of leading blocks."""
    h, size = hessenberg(a, p), len(a)
    polynomials = np.zeros((size + 1, size + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(size):
        new = np.zeros(size + 1, np.int64)
        new[1:] = polynomials[k, :-1]
        new = (new - h[k, k] * polynomials[k]) % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(h[i + 1, i]) % p
            if not product:
                break
            new = (new - int(h[i, k]) * product % p * polynomials[i]) % p
        polynomials[k + 1] = new
    return polynomials[size]


def joined(primes: list[int], residues: list[list[int]]) -> list[int]:
    """Integers of least magnitude with the given residues (a row for each prime)."""
    product = 1
    for p in primes:
        product *= p
    weights = [(rest := product // p) * pow(rest % p, -1, p) for p in primes]
    values = [sum(w * r[k] for w, r in zip(weights, residues)) % product for k in range(len(residues[0]))]
    return [v - product if 2 * v > product else v for v in values]


def scaled(polynomial: list[int], bits: int) -> list[int]:
    """Coefficients of the polynomial with roots 2**bits times as large."""
    top = len(polynomial) - 1
    return [c << bits * (top - k) for k, c in enumerate(polynomial)]


def moved(polynomial: list[int], at: int) -> list[int]:
    """Coefficients around ``at``, by repeated synthetic division."""
    p, size = list(polynomial), len(polynomial)
    for first in range(size - 1):
        for k in range(size - 2, first - 1, -1):
            p[k] += at * p[k + 1]
    return p


def roots_above(polynomial: list[int], at: int) -> int:
    """Roots larger than ``at``, with their multiplicity; exact since all roots are real (Descartes)."""
    signs = [c > 0 for c in moved(polynomial, at) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def value(polynomial: list[int], at: int) -> int:
    total = 0
    for c in reversed(polynomial):
        total = total * at + c
    return total


def largest_roots(polynomial: list[int], many: int) -> list[tuple[int, int, int]]:
    """The largest positive roots as (root, bits, multiplicity), falling, until ``many`` are counted.

    The root is root / 2**bits, to a relative 2**-ROOT_BITS. Zero roots are left out.
    """
    while len(polynomial) > 1 and polynomial[0] == 0:
        polynomial = polynomial[1:]
    many = min(many, len(polynomial) - 1)
    if many <= 0:
        return []
    # The sum of the roots bounds the largest one. All roots of an integer polynomial without the
    # root 0 have the product |constant| >= 1, so none is below 1 / bound**(degree - 1).
    bound = -polynomial[-2] + 1
    found: list[tuple[int, int, int]] = []
    stack = [(0, bound, 0, len(polynomial) - 1)]
    # Open intervals (low, high] at a scale of 2**bits, with the roots in them; the highest first.
    while stack and sum(m for _, _, m in found) < many:
        low, high, bits, inside = stack.pop()
        if high - low <= 1:
            low, high, bits = low << 8, high << 8, bits + 8
        p = scaled(polynomial, bits)
        if inside > 1 and (high - low) << ROOT_BITS > high or low == 0:
            middle = (low + high) // 2
            above = roots_above(p, middle) - roots_above(p, high)
            if inside - above:
                stack.append((low, middle, bits, inside - above))
            if above:
                stack.append((middle, high, bits, above))
            continue
        if inside == 1:
            low, high, bits = refined(polynomial, low, high, bits)
        found.append((low + high, bits + 1, inside))
    return found


def refined(polynomial: list[int], low: int, high: int, bits: int) -> tuple[int, int, int]:
    """A shorter interval (low, high] around the only root in it, by the sign of the polynomial."""
    extra = max(0, ROOT_BITS - max(0, low.bit_length() - (high - low).bit_length()) + 2)
    low, high, bits = low << extra, high << extra, bits + extra
    p = scaled(polynomial, bits)
    above = value(p, high)
    if above == 0:
        return high, high, bits
    positive = above > 0
    while high - low > 1 and (high - low) << ROOT_BITS > high:
        middle = (low + high) // 2
        at = value(p, middle)
        if at == 0:
            return middle, middle, bits
        if (at > 0) == positive:
            high = middle
        else:
            low = middle
    return low, high, bits


def null_vectors(matrix: list[list[int]], root: int, bits: int, many: int) -> np.ndarray:
    """``many`` orthonormal vectors (rows, doubles) of the eigenvalue root / 2**bits, which has that multiplicity."""
    size = len(matrix)
    unit = 1 << WORK_BITS
    # Fixed-point entries relative to the largest diagonal entry, moved a little beside the root.
    scale = max(matrix[k][k] for k in range(size))
    a = np.array([[(v << WORK_BITS) // scale for v in row] for row in matrix], object).reshape(size, size)
    beside = ((root << WORK_BITS) >> bits) // scale + (root << WORK_BITS >> bits + SHIFT_BITS) // scale + 1
    for k in range(size):
        a[k, k] -= beside
    order = np.arange(size)
    for k in range(size):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < size:
            a[k + 1 :, k] = (a[k + 1 :, k] << WORK_BITS) // a[k, k]
            a[k + 1 :, k + 1 :] -= (a[k + 1 :, k : k + 1] * a[k, k + 1 :]) >> WORK_BITS
    # A start with every component and no pattern.
    vectors = [[pow(3, 1 + r * size + c, 2**31 - 1) * (unit >> 31) for c in range(size)] for r in range(many)]
    for _ in range(3):
        solved = []
        for vector in vectors:
            x = np.array(vector, object)[order]
            for k in range(size - 1):
                x[k + 1 :] -= (a[k + 1 :, k] * x[k]) >> WORK_BITS
            for k in range(size - 1, -1, -1):
                x[k] = (int(x[k]) << WORK_BITS) // a[k, k]
                x[:k] -= (a[:k, k] * x[k]) >> WORK_BITS
            for other in solved:
                x = x - ((int(x @ other) >> WORK_BITS) * other >> WORK_BITS)
            length = isqrt(int(x @ x))
            solved.append(np.array([(int(v) << WORK_BITS) // max(length, 1) for v in x], object))
        vectors = solved
    return np.array([[int(v) / unit for v in x] for x in vectors], float).reshape(many, size)
