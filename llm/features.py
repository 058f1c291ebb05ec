"""Hashed indicator features of texts, and labelled rows of a table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.hashing import BLANK, MIX, hashes, mixed, word_spans

BROADCAST_ROWS = 500_000
#: Upper-case letters as A, digits as 0, other letters and all bytes of longer characters as a.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[0x80:] = ord("a")


def shape_hashes(texts: Sequence[str | None]) -> np.ndarray:
    """Hash of the shape of every word: runs of one kind of character count as one (``THE!!`` is ``A!``)."""
    whole = b"\n".join([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    kinds = SHAPE[np.frombuffer(whole, np.uint8)]
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | BLANK[kinds[1:]]
    short = np.concatenate([kinds[keep], np.zeros(8, np.uint8)])
    inside = np.concatenate([[False], ~BLANK[short[:-8]], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return hashes(short, edges[::2], edges[1::2] - edges[::2])


def runs(tokens: np.ndarray, bounds: np.ndarray, length: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``length`` tokens inside a text, and the text's number."""
    many = max(0, len(tokens) - length + 1)
    value = np.full(many, salt, np.uint64)
    for k in range(length):
        value = mixed(value * MIX[0] + tokens[k : k + many])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = text[:many] == text[length - 1 : length - 1 + many]
    return value[inside], text[:many][inside]


def indicators(texts: Sequence[str | None], bits: int, word_runs: Sequence[int], shape_runs: Sequence[int]):
    """Distinct features of every text, sorted, as one array, and where each text's features begin.

    Features are runs of words, runs of word shapes, and runs of equal words, hashed to ``bits`` bits.
    """
    raw, starts, lengths, bounds = word_spans(texts)
    words = hashes(raw, starts, lengths)
    found = [runs(words, bounds, length, length) for length in word_runs]
    if shape_runs:
        shapes = shape_hashes(texts)
        again = np.zeros(len(words), np.uint64)
        again[1:] = words[1:] == words[:-1]
        shapes = mixed(shapes + again)
        found += [runs(shapes, bounds, length, 16 + length) for length in shape_runs]
    values = np.concatenate([v for v, _ in found]) >> np.uint64(64 - bits)
    numbers = np.concatenate([t for _, t in found]).astype(np.uint64)
    keys = np.unique((numbers << np.uint64(bits)) | values)
    ends = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(bits))
    return (keys & np.uint64((1 << bits) - 1)).astype(np.int32), ends


def with_label(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows of ``docs`` (with doc_id) that have one label 0 or 1, with it; contradicting labels count as none.

    Labels are broadcast up to ``BROADCAST_ROWS`` ids, which saves a shuffle of the texts; beyond
    that both sides are shuffled.
    """
    known = labels.where(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id").agg(
        F.min(label).alias("label"), F.max(label).alias("other")
    ).where("label = other").select(F.col("doc_id").alias("labelled"), "label")
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.join(known, docs["doc_id"] == known["labelled"]).drop("labelled")


def smallest_keys(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of ``rows`` (doc_id and other narrow columns), by the hash of the id; one for each id."""
    return rows.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def texts_of_keys(docs: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with the bounded ``keys`` and their columns; at most ``most`` rows.

    The keys were found without texts, so only the chosen texts move.
    """
    return docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrated(margins: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits the target best (Newton's method, slightly damped)."""
    slope, offset = 1.0, 0.0
    weight = weight / weight.mean()
    for _ in range(50):
        p = sigmoid(slope * margins + offset)
        error, curve = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([error @ margins + 1e-3 * (slope - 1), error.sum() + 1e-3 * offset])
        hessian = np.array([[curve @ margins**2 + 1e-3, curve @ margins], [curve @ margins, curve.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - np.clip(step[0], -2, 2), offset - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(slope, 0.0)), float(offset)
