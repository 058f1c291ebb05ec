"""Log-likelihood of whole documents under a recurrent language model trained on the corpus.

Words are counted over all training documents by their 64-bit hash. Those that occur twice, up to the
``FREQUENT`` most frequent, are the vocabulary of the recurrent model (``llm.gru``), whose classes grow
with it and have few frequent words or many rare ones; every other word is its rare-word token, times the smoothed share of the word among rare
words, so the model gives every possible text a probability. Words met once train the rare-word token.

The model first learns from a bounded number of documents in one task (``WARM_DOCUMENTS``, smallest
hash of the id first). From there every task goes over all its training documents once, about
``REPLICA_TOKENS`` or more, and the weights are averaged by their tokens. Counts, training and scores cover all documents.

Counts of the ``FREQUENT`` most frequent words travel to all tasks (a fixed size). The words beyond
are looked up in a join on the hash; none of them is frequent enough to be a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.features import smallest_keys, texts_of_keys
from llm.gru import END, Network, Trainer, packed, start_weights, unpacked
from llm.hashing import word_hashes
from llm.stages import remainder, slices, written

FOLDS, HELD_OUT = 7, 2
LEAST_COUNT = 2
RARE = 0
FREQUENT = 65_536
WARM_DOCUMENTS = 1_500
WARM_PASSES = 6
WARM_RATE, RATE = 8e-3, 1e-3
GATHER = 32
REPLICA_TOKENS = 4_000_000
TRAIN_BYTES = 4 << 20
SCORE_BYTES = 24 << 20
BLOCKS, TOGETHER = 64, 32
END_KEY = 0


class Words(NamedTuple):
    """Frequent words: sorted hashes, their counts and their numbers in the model (RARE beyond it)."""

    keys: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of every word, and whether it is there at all."""
        if not len(self.keys):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return at, self.keys[at] == words

    def codes(self, words: np.ndarray) -> np.ndarray:
        at, met = self.find(words)
        return np.where(met, self.numbers[at] if len(self.keys) else RARE, RARE).astype(np.int32)


def counted(docs: DataFrame) -> DataFrame:
    """word (hash) and n over all texts; END_KEY counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=TRAIN_BYTES):
            words, _ = word_hashes(batch["text"].to_pylist())
            keys, counts = np.unique(words, return_counts=True)
            keys, counts = np.append(keys, np.uint64(END_KEY)), np.append(counts, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> Words:
    top = counts.where(f"word != {END_KEY}").orderBy(F.desc("n"), "word").limit(FREQUENT).toPandas()
    keys = top["word"].to_numpy(np.int64).view(np.uint64)
    numbers = np.arange(len(keys)) + END + 1
    numbers[top["n"].to_numpy(np.int64) < LEAST_COUNT] = RARE
    order = np.argsort(keys, kind="stable")
    return Words(keys[order], top["n"].to_numpy(np.int64)[order], numbers[order])


def class_bounds(words: Words) -> np.ndarray:
    """First number of each class of the model, and how many numbers there are in all.

    The rare-word token and the end have a class each. The others are runs of ranks whose roots of
    shares have equal sums of about 1: so a token needs the fewest scores, of all classes and of the
    words in its own. The last class is filled up to a multiple of the number of classes.
    """
    counts = -np.sort(-words.counts[words.numbers != RARE])
    roots = np.sqrt(counts / counts.sum())
    inner = int(np.ceil(roots.sum()))
    of_class = np.minimum((np.cumsum(roots) - roots / 2) / roots.sum() * inner, inner - 1).astype(np.int64)
    first = np.flatnonzero(np.diff(of_class, prepend=-1)) + END + 1
    classes = len(first) + END + 1
    many = len(counts) + END + 1
    return np.concatenate([np.arange(END + 1), first, [classes * int(np.ceil(many / classes))]]).astype(np.int64)


def shape(words: Words) -> tuple[int, int]:
    """Numbers and classes of the model."""
    bounds = class_bounds(words)
    return int(bounds[-1]), len(bounds) - 1


def documents(words: Words, texts: list[str | None]) -> list[np.ndarray]:
    found, bounds = word_hashes(texts)
    codes = words.codes(found)
    return [codes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def warm_weights(docs: DataFrame, words: Words, start: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights after some passes over a bounded number of documents, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in batches for t in batch["text"].to_pylist()]
        read = documents(words, texts)
        # Made here as in the driver, so that they need not be sent.
        trainer = Trainer(start_weights(*shape(words)), WARM_RATE, class_bounds(words), GATHER)
        for turn in range(WARM_PASSES):
            trainer.rate = WARM_RATE * (1 - 0.8 * turn / WARM_PASSES)
            trainer.learn(read)
        yield pa.RecordBatch.from_arrays([pa.array([packed(trainer.network.w).tobytes()], pa.binary())], ["weights"])

    keys = smallest_keys(docs.select("doc_id"), WARM_DOCUMENTS)
    chosen = texts_of_keys(docs, keys, WARM_DOCUMENTS).orderBy("doc_id", "text").select("text").coalesce(1)
    found = [row[0] for row in chosen.mapInArrow(run, "weights binary").collect()]
    return unpacked(np.frombuffer(found[0], np.float32), start) if found else start


def run_of(task: int) -> int:
    """Tasks whose weights are summed first: ``TOGETHER`` neighbours, so that few weights are shuffled again."""
    return task // TOGETHER


def summed(parts: DataFrame, *keys: str) -> DataFrame:
    """Tokens and parts of weights (block, run, tokens, part) summed by ``keys``, one row for each."""

    def added(group):
        total = np.sum([np.frombuffer(p, np.float32) for p in group["part"]], axis=0, dtype=np.float64)
        return group.head(1).assign(tokens=group["tokens"].sum(), part=[total.astype(np.float32).tobytes()])

    return parts.groupBy(*keys).applyInPandas(added, "block int, run int, tokens long, part binary")


def replicas(tokens: int) -> int:
    """At most so many tasks train, as each sends all weights, however few its documents."""
    return max(1, -(-tokens // REPLICA_TOKENS))


def averaged_weights(docs: DataFrame, words: Words, start: dict[str, np.ndarray], tokens: int) -> dict[str, np.ndarray]:
    """Weights after one pass over all documents (of ``tokens``) in every task, averaged by tokens, block by block."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer = Trainer(start, RATE, class_bounds(words), GATHER)
        for batch in slices(batches, most_bytes=TRAIN_BYTES):
            trainer.learn(documents(words, batch["text"].to_pylist()))
        if trainer.tokens:
            parts = np.array_split(packed(trainer.network.w) * np.float32(trainer.tokens), BLOCKS)
            run = run_of(TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(BLOCKS), pa.int32()),
                    pa.array([run] * BLOCKS, pa.int32()),
                    pa.array([trainer.tokens] * BLOCKS, pa.int64()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                ],
                ["block", "run", "tokens", "part"],
            )

    parts = docs.select("text").coalesce(replicas(tokens)).mapInArrow(train, "block int, run int, tokens long, part binary")
    rows = sorted(summed(summed(parts, "block", "run"), "block").collect(), key=lambda row: row["block"])
    if not rows:
        return start
    flat = np.concatenate([np.frombuffer(row["part"], np.float32) / row["tokens"] for row in rows])
    return unpacked(flat, start)


def scored(docs: DataFrame, words: Words, weights: dict[str, np.ndarray]) -> DataFrame:
    """Per row: number, doc_id, held_out, n_tokens, n_known and log sums over frequent words, the
    recurrent model's log10, and the hashes of the words to be looked up."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((words, weights))  # 26 MB at most
    rest = ["doc_id", "held_out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        own, net = sent.value[0], Network(sent.value[1], class_bounds(sent.value[0]))
        for batch in slices(batches, most_bytes=SCORE_BYTES):
            found, bounds = word_hashes(batch["text"].to_pylist())
            at, met = own.find(found)
            codes = np.where(met, own.numbers[at] if len(own.keys) else RARE, RARE).astype(np.int32)
            logs = np.where(met, np.log10((own.counts[at] if len(own.keys) else at) + 1.0), 0.0)
            text_of = np.repeat(np.arange(batch.num_rows), np.diff(bounds))

            def summed(values: np.ndarray) -> pa.Array:
                return pa.array(np.bincount(text_of, values, minlength=batch.num_rows).astype(values.dtype))

            model = net.score([codes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
            tail = ~met
            ends = np.concatenate([[0], np.cumsum(tail)])[bounds].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number, number + batch.num_rows)),
                    *(batch[c] for c in rest),
                    pa.array(np.diff(bounds) + 1),
                    summed(met.astype(np.int64)),
                    summed(logs),
                    summed(np.where(codes == RARE, logs, 0.0)),
                    summed((codes == RARE).astype(np.int64)),
                    pa.array(model),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(found[tail].view(np.int64))),
                ],
                ["number", *rest, "n_tokens", "known", "logs", "rare_logs", "n_rare", "model", "tail"],
            )
            number += batch.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*rest, "text").mapInArrow(
        run,
        f"number long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, rare_logs double,"
        " n_rare long, model double, tail array<bigint>",
    )


def log_likelihood(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32 of the id as text leaves 2 by 7 are held out; a null id counts as the empty
    text. A null or empty text is its end token alone. Repeated rows all count and are scored alike.
    An empty table gives an empty result; with no training rows counts are 0 and the recurrent model
    keeps its first weights. Other columns are ignored, whatever their names. Texts are taken whole.
    """
    held = remainder(id_col, FOLDS) == HELD_OUT
    docs = df.select(df[id_col].alias("doc_id"), held.alias("held_out"), df[text_col].cast("string").alias("text"))
    learned = docs.where("not held_out").select("doc_id", "text")
    counts = written(counted(learned), "counts")
    totals = counts.agg(
        F.sum("n").alias("tokens"), F.count("*").alias("words"), F.sum(F.when(F.col("word") == END_KEY, F.col("n"))).alias("ends")
    ).first()
    tokens, distinct, ends = (int(x or 0) for x in totals)
    words = frequent_words(counts)
    named = words.numbers != RARE
    rare_tokens = tokens - ends - int(words.counts[named].sum())
    rare_words = distinct - (ends > 0) - int(named.sum())
    start = start_weights(*shape(words))
    weights = averaged_weights(learned, words, warm_weights(learned, words, start), tokens)
    rows = written(scored(docs, words, weights), "scored")
    looked_up = (
        rows.select("number", F.explode("tail").alias("word"))
        .join(counts, "word")
        .groupBy("number")
        .agg(F.count("*").alias("also_known"), F.sum(F.log10(F.col("n") + 1)).alias("also_logs"))
    )
    all_rows = rows.drop("tail").join(looked_up, "number", "left").na.fill(0, ["also_known"]).na.fill(0.0, ["also_logs"])
    end_known, end_log = int(ends > 0), float(np.log10(ends + 1))
    base_unit, rare_unit = float(np.log10(tokens + distinct + 1)), float(np.log10(rare_tokens + rare_words + 1))
    return all_rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("also_known") + end_known).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("also_logs") + end_log - F.col("n_tokens") * base_unit).alias("base_score"),
        (F.col("model") + F.col("rare_logs") + F.col("also_logs") - F.col("n_rare") * rare_unit).alias("score"),
    )
