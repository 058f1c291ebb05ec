"""Quality classifier: naive Bayes support vectors.

Texts are sets of hashed n-grams of words and of word shapes. Every indicator is scaled by the log
ratio of its frequencies in good and bad texts, counted over all labelled training rows. A linear
hinge-loss model is then fitted by dual coordinate descent on a bounded sample: at most
``SAMPLE_ROWS`` rows of each class, those with the smallest hash of their id. A fifth of the sample
is held back to turn margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.features import calibrated, indicators, sigmoid, smallest_keys, texts_of_keys, with_label
from llm.stages import remainder, slices

BITS = 18
WORD_RUNS = (1, 2)
SHAPE_RUNS = (1, 2, 3)
SAMPLE_ROWS = 3_000
SMOOTHING = 1.0
PENALTY = 0.1
ROUNDS = 20
HELD_BACK = 5
FOLDS = 5


class Model(NamedTuple):
    weights: np.ndarray
    slope: float
    offset: float


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return indicators(texts, BITS, WORD_RUNS, SHAPE_RUNS)


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class with each feature, and rows of each class, over all of ``rows`` (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in slices(batches):
            found, ends = features(batch["text"].to_pylist())
            labels = batch["label"].to_numpy()
            each = np.repeat(labels, np.diff(ends))
            for label in (0, 1):
                counts[label, :-1] += np.bincount(found[each == label], minlength=1 << BITS)
                counts[label, -1] += int((labels == label).sum())
        used = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["feature", "bad", "good"]
        )

    sums = rows.select("text", "label").mapInArrow(run, "feature long, bad long, good long").groupBy("feature").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    table = sums.toPandas()  # at most 2^18 + 1 rows
    counts = np.zeros((2, (1 << BITS) + 1))
    counts[0, table["feature"]] = table["bad"]
    counts[1, table["feature"]] = table["good"]
    return counts[:, :-1], counts[:, -1]


def sample(rows: DataFrame, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most ``most`` rows of each class, smallest hash of the id first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, ends = features(batch["text"].to_pylist())
            sets = pa.array([found[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["label"], sets], ["label", "features"])

    ids = rows.select("doc_id", "label")
    chosen = [texts_of_keys(rows, smallest_keys(ids.where(f"label = {label}"), most), most) for label in (0, 1)]
    rows = chosen[0].unionByName(chosen[1]).select("text", "label").mapInArrow(run, "label int, features binary").collect()
    found = [np.frombuffer(row["features"], np.int32) for row in rows]
    # An order that doesn't depend on partitions: the classes alternate by a sum over their features.
    order = np.argsort([int(x.sum(dtype=np.int64)) % 10_007 for x in found], kind="stable")
    return [found[k] for k in order], np.array([rows[k]["label"] for k in order], np.int64)


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of the squared-hinge model min 1/2 |w|^2 + sum cost max(0, 1 - y w.x)^2, one dual variable at a time.

    The last weight belongs to a feature that every row has.
    """
    weights = np.zeros(len(scale) + 1)
    dual = np.zeros(len(rows))
    values = [scale[r] for r in rows]
    diagonal = 1 / (2 * cost)
    squares = np.array([v @ v + 1 for v in values]) + diagonal
    generator = np.random.default_rng(7)
    for _ in range(ROUNDS):
        moved = 0.0
        for k in generator.permutation(len(rows)):
            at, value, sign = rows[k], values[k], signs[k]
            slack = sign * (weights[at] @ value + weights[-1]) - 1 + diagonal[k] * dual[k]
            new = max(0.0, dual[k] - slack / squares[k])
            if step := new - dual[k]:
                weights[at] += step * sign * value
                weights[-1] += step * sign
                dual[k] = new
                moved = max(moved, abs(step * squares[k]))
        if moved < 1e-2:
            break
    return weights


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_ROWS) -> Model:
    """Model of the labelled rows of ``docs`` (doc_id, text). Without both classes all scores are the share of label 1."""
    rows = with_label(docs, labels, label)
    counts, totals = class_counts(rows)
    if not totals.all():
        share = (totals[1] + 1) / (totals.sum() + 2)
        return Model(np.zeros((1 << BITS) + 1), 0.0, float(np.log(share / (1 - share))))
    # A feature of three rows or fewer says little about others.
    smooth = counts + SMOOTHING
    ratio = np.log(smooth[1] / smooth[1].sum() / (smooth[0] / smooth[0].sum()))
    scale = np.where(counts.sum(0) > 3, ratio, 0.0)
    found, given = sample(rows, most)
    found = [r[scale[r] != 0] for r in found]
    length = np.array([np.sqrt((scale[r] ** 2).sum()) for r in found]).mean() or 1.0
    scale = scale / length
    held = np.arange(len(given)) % HELD_BACK == 0
    signs = 2.0 * given - 1
    shares = np.array([(given[~held] == k).mean() for k in (0, 1)])
    cost = PENALTY * 0.5 / np.maximum(shares, 1e-3)[given]
    inner = [r for r, h in zip(found, held) if not h]
    weights = dual_descent(inner, signs[~held], scale, cost[~held])
    margins = np.array([weights[r] @ scale[r] + weights[-1] for r, h in zip(found, held) if h])
    # In the sample the classes have other shares than in the corpus.
    target = given[held]
    in_sample = np.array([(target == k).mean() for k in (0, 1)])
    weight = (totals / totals.sum() / np.maximum(in_sample, 1e-3))[target]
    slope, offset = calibrated(margins, target, weight)
    return Model(np.append(weights[:-1] * scale, weights[-1]).astype(np.float64), slope, offset)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of ``docs`` (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, slope, offset = sent.value
        for batch in slices(batches):
            found, ends = features(batch["text"].to_pylist())
            sums = np.concatenate([[0.0], np.cumsum(weights[found])])
            margins = sums[ends[1:]] - sums[ends[:-1]] + weights[-1]
            scores = pa.array(sigmoid(slope * margins + offset))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], scores], names)

    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 2 MB
    names = ["doc_id", "held_out", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def classify(
    df: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = SAMPLE_ROWS,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row.

    Only rows whose crc32 of the id as text leaves a remainder by 5 teach; the others are held out.
    A null id counts as the empty text and has no label. Null and empty texts get the score of a
    text without features. Repeated rows are scored alike. Labels other than 0 and 1, and ids with
    contradicting labels, are not used; without labels of both classes all rows get the smoothed
    share of label 1. Other columns are ignored, whatever their names. Texts are scored whole.
    """
    docs = df.select(
        df[id_col].alias("doc_id"), (remainder(id_col, FOLDS) == 0).alias("held_out"), df[text_col].cast("string").alias("text")
    )
    model = fit(docs.where("not held_out").select("doc_id", "text"), labels, most=most)
    return score(docs, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
