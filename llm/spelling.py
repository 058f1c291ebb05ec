"""Spelling variants: words of a corpus that differ by one code point, found with PartEnum signatures.

1. Words are counted over all texts, in parts before anything is shuffled.
2. The letters of a word are a multiset, read as a binary vector: dimension (letter, k) is set if the
   word has the letter at least k times. One replaced code point changes two dimensions, an inserted
   or deleted one changes one. Words with equal vectors are one class, and classes are joined.
3. PartEnum for a Hamming distance of at most two: the dimensions are dealt into eight parts of about equal
   weight, each part of a vector is hashed to one byte, and a signature leaves two parts out. Two
   vectors at distance two or less agree on all parts but two, so they share one of the 28
   signatures: an equi-join finds every such pair. Of the signatures that a pair shares only the
   first counts, which its bytes tell, so no pair is made twice.
4. Pairs of classes whose vectors differ in more than two dimensions are ruled out by two 64-bit
   parities. Words of the others are verified by their edit distance.
5. The form of a word is its most frequent near word, if that is far more frequent. Chains of forms
   are followed by pointer doubling; a chain rises by a factor each step, so a few rounds suffice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.hashing import mixed
from llm.stages import written
from llm.text import lower_ascii

LETTERS = r"[^A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
PARTS, DISTANCE = 8, 2
#: Letters with their count up to this are dealt to parts by weight; the rest by hash.
BALANCED_TIMES = 8
LEFT_OUT = list(combinations(range(PARTS), DISTANCE))


def word_counts(
    df: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, spoil: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """word and n of all runs of letters, with A-Z in lower case, that are long and frequent enough.

    With ``spoil``, a run whose crc32 of ``<id>:<run>`` is divisible by it loses the code point at that
    number modulo its length: misspellings with a known origin. A null id counts as the empty text.
    """
    words = df.select(
        F.coalesce(df[id_col].cast("string"), F.lit("")).alias("id"),
        F.explode(F.split(lower_ascii(df[text_col].cast("string")), LETTERS)).alias("word"),
    ).where(F.char_length("word") >= least_length)
    if spoil:
        code = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        place = F.pmod("code", F.char_length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 2, F.char_length("word")))
        words = words.withColumn("code", code).withColumn("place", place)
        words = words.withColumn("word", F.when(F.col("code") % spoil == 0, cut).otherwise(F.col("word")))
        words = words.where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def elements(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word's letters in order, as word number, code point and how often it has come so far, and the words' ends."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    number = np.repeat(np.arange(len(words)), lengths)
    order = np.lexsort((points, number))
    points, number = points[order], number[order]
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (number[1:] != number[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(points)), 0))
    return number, points, np.arange(len(points)) - first + 1, ends


def dealt_parts(words: DataFrame) -> dict[tuple[int, int], int]:
    """Part of every frequent dimension, heaviest first to the lightest part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, points, times, _ = elements(batch["word"].to_pylist())
            keys, rows = np.unique(points[times <= BALANCED_TIMES] * 16 + times[times <= BALANCED_TIMES], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(rows.astype(np.int64))], ["key", "n"])

    # Letters are few (117) and times bounded, so this is a short table whatever the words.
    weights = words.select("word").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    loads, parts = [0] * PARTS, {}
    for row in sorted(weights, key=lambda r: (-r["n"], r["key"])):
        part = loads.index(min(loads))
        loads[part] += row["n"]
        parts[divmod(row["key"], 16)] = part
    return parts


def vectors(words: DataFrame, parts: dict[tuple[int, int], int]) -> DataFrame:
    """word, n, class (its sorted letters), the bytes of its parts as one number, and two parities of its dimensions."""
    known = np.array(sorted(p * 16 + k for p, k in parts), np.int64)
    place = np.array([parts[divmod(int(k), 16)] for k in known], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["word"].to_pylist()
            number, points, times, ends = elements(own)
            hashes = mixed((points * (1 << 24) + times).astype(np.uint64) + np.uint64(zlib.crc32(b"dimension")))
            keys = points * 16 + times
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            dealt = (times <= BALANCED_TIMES) & (known[at] == keys) if len(known) else np.zeros(len(keys), bool)
            part = np.where(dealt, place[at] if len(known) else 0, (hashes % np.uint64(PARTS)).astype(np.int64))
            # The sum of its dimensions' hashes stands for a part; the top byte of a mix of it is kept.
            sums = np.zeros((len(own), PARTS), np.uint64)
            np.add.at(sums, (number, part), mixed(hashes))
            whole = np.zeros(len(own), np.uint64)
            for k in range(PARTS):
                whole |= (mixed(sums[:, k]) >> np.uint64(56)) << np.uint64(8 * k)
            parities = [np.zeros(len(own), np.uint64) for _ in range(2)]
            for k, parity in enumerate(parities):
                np.bitwise_xor.at(parity, number, np.uint64(1) << ((hashes >> np.uint64(8 + 16 * k)) & np.uint64(63)))
            letters = points.astype(np.uint32).tobytes().decode("utf-32-le")
            sets = [letters[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["word"], batch["n"], pa.array(sets, pa.string()), pa.array(whole.view(np.int64)),
                 *(pa.array(p.view(np.int64)) for p in parities)],
                ["word", "n", "class", "bytes", "odd1", "odd2"],
            )

    return words.select("word", "n").mapInArrow(run, "word string, n long, class string, bytes long, odd1 long, odd2 long")


def first_shared() -> str:
    """SQL: the place in LEFT_OUT of the first signature that vectors with bytes x and y share.

    The parts that differ are the bytes of x ^ y that aren't zero; both must be among the parts left out.
    """
    cases = " ".join(
        f"when ((x.bytes ^ y.bytes) & {signed(~mask_of(pair) & (1 << 64) - 1)}L) = 0 then {k}" for k, pair in enumerate(LEFT_OUT)
    )
    return f"case {cases} end"


def mask_of(pair: tuple[int, int]) -> int:
    return sum(0xFF << 8 * k for k in pair)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def class_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes, a before b, whose vectors differ in two dimensions or less, as far as their parities tell."""
    masks = F.array(*[F.lit(signed(~mask_of(pair) & (1 << 64) - 1)) for pair in LEFT_OUT])
    rows = classes.select("*", F.posexplode(masks).alias("left_out", "mask"))
    rows = rows.withColumn("signature", F.col("bytes").bitwiseAND(F.col("mask"))).drop("mask")
    x, y = rows.alias("x"), rows.alias("y")
    near = (
        "x.left_out = y.left_out and x.signature = y.signature and x.class < y.class"
        f" and bit_count(x.odd1 ^ y.odd1) <= {DISTANCE} and bit_count(x.odd2 ^ y.odd2) <= {DISTANCE}"
        f" and x.left_out = {first_shared()}"
    )
    return x.join(y, F.expr(near)).select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))


def near_words(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, near and the near word's n, both ways, of all words at edit distance one in pairs of classes."""
    left = words.select(F.col("class").alias("a"), F.col("word").alias("v"), F.col("n").alias("v_n"))
    right = words.select(F.col("class").alias("b"), F.col("word").alias("w"), F.col("n").alias("w_n"))
    found = pairs.join(left, "a").join(right, "b").where("levenshtein(v, w, 1) = 1")
    ways = F.array(
        F.struct(F.col("v").alias("word"), F.col("w").alias("near"), F.col("w_n").alias("near_n")),
        F.struct(F.col("w").alias("word"), F.col("v").alias("near"), F.col("v_n").alias("near_n")),
    )
    return found.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of all words with a form: the last word that forms lead to."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = written(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def variant_groups(counts: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``counts`` (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. The
    form is the near word of largest n (the first in code-point order among equals), if its n is at
    least ``ratio`` (over one) times the word's; else null, as is form_n. The root is the word itself without a
    form. Null words take no part, and a word that comes repeatedly counts once, with its n added up. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("forms need a ratio of at least 2, else their chains may have no end")
    words = written(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    each = written(vectors(words, dealt_parts(words)), "vectors")
    classes = each.select("class", "bytes", "odd1", "odd2").distinct()
    pairs = written(class_pairs(classes), "class-pairs")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best")
    near = written(near_words(each, pairs).groupBy("word").agg(F.count("*").alias("n_near"), best), "near")
    joined = written(words.join(near, "word", "left"), "forms")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    formed = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    ends = roots(formed.where("form is not null")).withColumnRenamed("word", "of")
    return formed.join(ends, F.col("word") == F.col("of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
