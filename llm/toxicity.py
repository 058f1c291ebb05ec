"""Toxicity by weak supervision.

Many voters look at a text: lexicons of insults by theme and language, patterns, and word stems that
were mined from the labelled training rows for languages and words that no list has. A generative
model explains when voters fire together: given the hidden class they fire independently, except
for pairs with a correlation of their own.

Mined stems are beginnings of words with a number of different words: one insult may be an accident
where three forms of it in one text are not, so each beginning is tested for one, two and three.

* Means and covariances of all voters are summed over the whole training table.
* The hidden class makes the covariance of two voters the product of their strengths times the
  variance of the class; strengths come from fitting that product off the diagonal. Pairs that stay
  far from it are correlated for other reasons: they leave the fit, and share their weight later.
* Given labels are one more voter on their rows, with a strength to be estimated like the others.
* With the share of toxic rows among the labelled training rows, strengths become the probabilities
  to fire in either class, and votes become posterior labels.

A linear classifier over voters and hashed words is trained on the posterior labels of a bounded
sample (``SAMPLE_ROWS`` rows on either side of one half, smallest hash of the id first). Labelled
training rows, at most as many, turn its margins into probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.features import calibrated, indicators, sigmoid, smallest_keys, texts_of_keys, with_label
from llm.hashing import MASKS, hashes, word_spans
from llm.stages import remainder, slices, written

# Lexicons by theme. A word also matches with a usual ending. Words that are harmless
# in one of the languages (such as "die") are left out.
LEXICONS: dict[str, list[str]] = {
    "intellect": ["idiot", "idiotic", "moron", "moronic", "imbecile", "cretin", "halfwit"],
    "dullness": ["stupid", "dumb", "dumbass", "brainless", "mindless", "dimwit"],
    "worth": ["worthless", "useless", "hopeless"],
    "failure": ["loser", "weakling"],
    "contempt": ["pathetic", "laughable", "pitiful"],
    "mockery": ["clown", "buffoon", "fool", "foolish"],
    "refuse": ["trash", "garbage", "rubbish", "filth", "filthy"],
    "vermin": ["scum", "scumbag", "vermin", "parasite", "swine"],
    "disgust": ["disgusting", "revolting", "repulsive", "vile", "nasty"],
    "hate": ["despise", "loathe", "hateful"],
    "profanity": ["fuck", "fucking", "shit", "shitty", "bitch", "bastard", "asshole", "crap"],
    "german": ["idiotisch", "dummkopf", "arschloch", "abschaum", "wertlos", "erbärmlich", "ekelhaft", "versager", "trottel"],
    "french": ["imbécile", "crétin", "connard", "salaud", "ordure", "minable", "pathétique", "débile"],
    "spanish": ["idiota", "imbécil", "estúpido", "basura", "escoria", "patético", "asqueroso", "inútil", "payaso"],
}
WORD_ENDINGS = ["", "s", "e", "en", "es", "n"]
ADDRESSES = ["you", "du", "tu", "usted", "vous", "ihr"]
WISHES = ["shut up", "go away", "drop dead", "get lost", "go to hell"]
CENSORED = re.compile(r"\b\w{1,3}[*@#$]{2,}\w{0,3}\b")
PATTERNS = ["two_hits", "two_themes", "dense", "address", "censored", "wish"]
NEAR_WORDS = 4
STEM_LENGTHS = range(4, 9)
#: So many different words with one beginning, or more, are a voter of their own.
STEM_WORDS = (1, 2, 3)
#: Labelled toxic rows that a mined voter fires on: so many, and one in so many of all of them.
LEAST_STEM_ROWS, STEM_SHARE = 4, 200
LEAST_STEM_ODDS = 20.0
#: A clean row counts as much against a beginning as so many toxic rows count for it.
CLEAN_WEIGHT = 5
LEAST_WORD_ROWS = 5
BITS = 18
SAMPLE_ROWS = 5_000
FOLDS, HELD_OUT = 3, 1
DEFAULT_SHARE = 0.1
LEAST_RATE = 1e-4
PASSES = 120
RIDGE = 2e-5
#: Bytes between words made of letters only; bytes of longer characters count as letters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[ord("a") : ord("z") + 1] = False
NO_LETTER[0x80:] = False


def keys_of(words: list[str]) -> np.ndarray:
    """Hashes of single lower-case words."""
    raw, starts, lengths, _ = word_spans([" ".join(words)], NO_LETTER)
    return hashes(raw, starts, lengths)


def lexicon() -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all lexicon words with their endings, and the theme of each."""
    themes: dict[int, int] = {}
    for place, words in enumerate(LEXICONS.values()):
        for key in keys_of([w + end for w in words for end in WORD_ENDINGS]).tolist():
            themes.setdefault(key, place)
    keys = np.array(sorted(themes), np.uint64)
    return keys, np.array([themes[k] for k in keys.tolist()], np.int64)


LEXICON_KEYS, LEXICON_THEMES = lexicon()
ADDRESS_KEYS = keys_of(ADDRESSES)
WISH_KEYS = [keys_of(w.split()) for w in WISHES]


def found_in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` occur in ``sorted_keys``, and the places of those that do."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    hit = np.flatnonzero(sorted_keys[at] == keys)
    return hit, at[hit]


def letters(texts: list[str | None]):
    return word_spans([(t or "").lower() for t in texts], NO_LETTER)


def beginnings(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``size`` bytes of every word that has them, as one number, and the words' places."""
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    rows = np.flatnonzero(lengths >= size)
    return eight[starts[rows]] & MASKS[size], rows


def different_words(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, text_of: np.ndarray):
    """Starts, lengths and texts of the words, each once for each text."""
    keys = hashes(raw, starts, lengths)
    order = np.lexsort((keys, text_of))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (text_of[order[1:]] != text_of[order[:-1]])
    rows = order[new]
    return starts[rows], lengths[rows], text_of[rows]


class Voters:
    """The voters: lexicons, patterns, and mined stems (numbers whose bytes are the stem, with a least number of different words)."""

    def __init__(self, stems: list[tuple[int, int]]):
        texts = [f"stem {s.to_bytes(8, 'little').rstrip(bytes(1))!r} x {least}" for s, least in stems]
        self.names = [*LEXICONS, *PATTERNS, *texts]
        # Several words with a beginning follow from one, and from two.
        first = len(LEXICONS) + len(PATTERNS)
        self.derived = np.array([n in ("two_hits", "two_themes", "dense", "address") for n in self.names])
        self.derived[first:] = [least > 1 for _, least in stems]
        self.stems = []
        for size in STEM_LENGTHS:
            for least in STEM_WORDS:
                own = sorted(
                    (s, first + k) for k, (s, n) in enumerate(stems) if n == least and (s.bit_length() + 7) // 8 == size
                )
                if own:
                    self.stems.append((size, least, np.array([s for s, _ in own], np.uint64), np.array([k for _, k in own])))

    def votes(self, texts: list[str | None]) -> np.ndarray:
        """A row of 0 and 1 for every text."""
        raw, starts, lengths, bounds = letters(texts)
        keys = hashes(raw, starts, lengths)
        text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        fired = np.zeros((len(texts), len(self.names)), np.int8)
        hit, place = found_in(LEXICON_KEYS, keys)
        fired[text_of[hit], LEXICON_THEMES[place]] = 1
        many = len(LEXICONS)
        count = np.bincount(text_of[hit], minlength=len(texts))
        fired[:, many] = count >= 2
        fired[:, many + 1] = fired[:, :many].sum(1) >= 2
        fired[:, many + 2] = count * 100 > np.maximum(np.diff(bounds), 1)
        if len(hit):
            near = np.isin(keys, ADDRESS_KEYS)
            for step in range(1, NEAR_WORDS + 1):
                ok = hit[(hit >= step)]
                ok = ok[near[ok - step] & (text_of[ok - step] == text_of[ok])]
                fired[text_of[ok], many + 3] = 1
        for place, text in enumerate(texts):
            if text and ("**" in text or "@@" in text or "##" in text or "$$" in text or "*@" in text):
                fired[place, many + 4] = CENSORED.search(text) is not None
        for wish in WISH_KEYS:
            at = np.flatnonzero(keys[: len(keys) - len(wish) + 1] == wish[0])
            for k, key in enumerate(wish[1:], 1):
                at = at[(keys[at + k] == key) & (text_of[at + k] == text_of[at])]
            fired[text_of[at], many + 5] = 1
        if self.stems:
            starts, lengths, text_of = different_words(raw, starts, lengths, text_of)
        for size, least, stems, columns in self.stems:
            values, rows = beginnings(raw, starts, lengths, size)
            hit, place = found_in(stems, values)
            cells = text_of[rows[hit]] * len(self.names) + columns[place]
            met, count = np.unique(cells, return_counts=True)
            fired.reshape(-1)[met[count >= least]] = 1
        return fired


def mined_stems(rows: DataFrame) -> list[tuple[int, int]]:
    """Beginnings of words, with a number of different words, common in toxic rows and rare in others, of ``rows`` (text, label).

    Rows with each beginning and number are counted by class over all rows. Of beginnings that contain each
    other, the one that parts the classes best is taken for each number. What passes has its share of the toxic
    rows, so the result is bounded by the different words of a row, not by the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=4 << 20):
            labels = batch["label"].to_numpy()
            raw, starts, lengths, bounds = letters(batch["text"].to_pylist())
            starts, lengths, text_of = different_words(raw, starts, lengths, np.repeat(np.arange(len(labels)), np.diff(bounds)))
            for size in STEM_LENGTHS:
                values, words = beginnings(raw, starts, lengths, size)
                order = np.lexsort((text_of[words], values))
                values, texts = values[order], text_of[words][order]
                new = np.ones(len(values), bool)
                new[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
                at = np.flatnonzero(new)
                count, values, toxic = np.diff(np.append(at, len(values))), values[at], labels[texts[at]]
                for least in STEM_WORDS:
                    many = count >= least
                    stems, first = np.unique(values[many], return_index=True)
                    ends = np.append(first[1:], int(many.sum()))
                    sums = np.concatenate([[0], np.cumsum(toxic[many])]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(stems.view(np.int64)), pa.array(np.full(len(stems), least, np.int32)), pa.array(ends - first),
                         pa.array(sums[ends] - sums[first])],
                        ["stem", "least", "rows", "toxic"],
                    )

    totals = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    toxic, clean = int(totals[1]), int(totals[0] - totals[1])
    if not toxic or not clean:
        return []
    counts = rows.select("text", "label").mapInArrow(run, "stem long, least int, rows long, toxic long").groupBy("stem", "least").agg(
        F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic")
    )
    enough = max(LEAST_STEM_ROWS, toxic // STEM_SHARE)
    odds = (F.col("toxic") / toxic) / ((F.col("rows") - F.col("toxic") + 1) / clean)
    passed = counts.where((F.col("toxic") >= enough) & (odds >= LEAST_STEM_ODDS)).collect()
    found = [(int(r["stem"]).to_bytes(8, "little", signed=True).rstrip(b"\0"), r["least"], r["toxic"], r["rows"]) for r in passed]
    taken: set[tuple[bytes, int]] = set()
    # Beginnings of what is taken, so that a longer or shorter one is seen at once.
    inside: set[tuple[bytes, int]] = set()
    for stem, least, toxic_rows, all_rows in sorted(found, key=lambda f: ((CLEAN_WEIGHT + 1) * -f[2] + CLEAN_WEIGHT * f[3], len(f[0]), f)):
        starts = {(stem[:k], least) for k in range(STEM_LENGTHS[0], len(stem) + 1)}
        if (stem, least) not in inside and taken.isdisjoint(starts):
            taken.add((stem, least))
            inside |= starts
    return sorted((int.from_bytes(stem, "little"), least) for stem, least in taken)


class LabelModel(NamedTuple):
    """Log-odds of a toxic row: ``start`` plus, for each voter, ``fired`` or ``silent``."""

    start: float
    fired: np.ndarray
    silent: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return sigmoid(self.start + votes @ self.fired + (1 - votes) @ self.silent)


def moments(votes: DataFrame, many: int) -> np.ndarray:
    """Sums of products of the voters, and of the constant 1 behind them, over all rows of ``votes``.

    A label, if the rows have one, is the last voter. Tasks send a fixed number of values.
    """
    labelled = "label" in votes.columns
    size = many + labelled + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                parts = [batch["votes"].flatten().to_numpy().reshape(-1, many).astype(float)]
                if labelled:
                    parts.append(batch["label"].to_numpy().astype(float)[:, None])
                fired = np.hstack([*parts, np.ones((batch.num_rows, 1))])
                total += fired.T @ fired
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "value"])

    columns = ["votes", "label"] if labelled else ["votes"]
    parts = votes.select(columns).mapInArrow(run, "place long, value double")
    total = np.zeros(size * size)
    for place, value in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():  # one row for each pair
        total[place] = value
    return total.reshape(size, size)


def correlations(total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, standard deviations and correlations of voters from their sums of products."""
    rows = max(total[-1, -1], 1)
    means = total[-1, :-1] / rows
    covariance = total[:-1, :-1] / rows - np.outer(means, means)
    spread = np.sqrt(np.clip(np.diag(covariance), 1e-12, None))
    return means, spread, covariance / np.outer(spread, spread)


def label_model(every: np.ndarray, labelled: np.ndarray, derived: np.ndarray, share: float) -> LabelModel:
    """Fit strengths, correlations and firing rates to the moments of all rows and of the labelled ones."""
    means, spread, correlation = correlations(every)
    many = len(means)
    with_labels = correlations(labelled)[2]
    joint = np.zeros((many + 1, many + 1))
    joint[:many, :many] = correlation
    joint[many, :] = joint[:, many] = with_labels[many]
    active = np.append(every[-1, :-1] >= 5, 0 < labelled[-1, -2] < labelled[-1, -1])
    usable = np.outer(active, active) & ~np.eye(many + 1, dtype=bool)
    # Voters that follow from others are correlated with them and with each other.
    also = np.append(derived, False)
    fitted = usable & ~np.outer(also, also)
    weight = np.ones_like(joint)
    weight[many, :] = weight[:, many] = many  # a label counts as much as all voters together
    strength = np.where(active, 0.5, 0.0)
    own = np.zeros_like(joint)
    for turn in range(3):
        for _ in range(500):
            below = (fitted * weight * strength**2).sum(1)
            above = (fitted * weight * joint * strength).sum(1)
            new = np.where(below > 0, np.clip(above / np.maximum(below, 1e-9), 0, 0.999), 0)
            if np.abs(new - strength).max() < 1e-7:
                break
            strength = (strength + new) / 2
        own = np.where(usable, joint - np.outer(strength, strength), 0)
        rest = own[:many, :many][fitted[:many, :many]]
        if turn < 2 and len(rest):
            # Pairs far from the common cause have another one and leave the fit.
            fitted[:many, :many] &= np.abs(own[:many, :many]) <= max(0.1, 3 * np.sqrt(np.mean(rest**2)))
    # Correlation with the class times the spreads gives the difference of the two rates.
    difference = strength[:many] * spread / np.sqrt(share * (1 - share))
    toxic = np.clip(means + (1 - share) * difference, LEAST_RATE, 1 - LEAST_RATE)
    clean = np.clip(means - share * difference, LEAST_RATE, 1 - LEAST_RATE)
    discount = active[:many] / (1 + np.clip(own[:many, :many], 0, None).max(1, initial=0))
    fired = discount * np.log(np.maximum(toxic / clean, 1))
    silent = discount * np.log(np.minimum((1 - toxic) / (1 - clean), 1))
    return LabelModel(float(np.log(share / (1 - share))), fired, silent)


class Model(NamedTuple):
    voters: np.ndarray
    words: np.ndarray
    start: float
    slope: float
    offset: float

    def margins(self, votes: np.ndarray, found: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.words[found])])
        scale = 1 / np.sqrt(np.maximum(np.diff(ends), 1))
        return self.start + votes @ self.voters + scale * (sums[ends[1:]] - sums[ends[:-1]])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return indicators(texts, BITS, (1,), ())


def voted(docs: DataFrame, voters: Voters) -> DataFrame:
    """Votes (array) of every row of ``docs`` with a text; the other columns stay."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            votes = voters.votes(batch["text"].to_pylist())
            ends = np.arange(0, votes.size + 1, votes.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(votes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), lists], [*rest, "votes"])

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(run, f"{fields}, votes array<tinyint>")


def examples(rows: DataFrame, voters: Voters) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Votes, features, their ends and targets of bounded rows (text, target), in an order of their own."""
    many = len(voters.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            found, ends = features(texts)
            sets = pa.array([found[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
            packed = pa.array([v.tobytes() for v in voters.votes(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["target"], packed, sets], ["target", "votes", "features"])

    sent = rows.mapInArrow(run, "target double, votes binary, features binary").collect()
    found = [np.frombuffer(row["features"], np.int32) for row in sent]
    order = np.argsort([int(x.sum(dtype=np.int64)) % 10_007 for x in found], kind="stable")
    votes = np.array([np.frombuffer(sent[k]["votes"], np.int8) for k in order]).reshape(-1, many)
    ends = np.concatenate([[0], np.cumsum([len(found[k]) for k in order])]).astype(np.int64)
    flat = np.concatenate([*(found[k] for k in order), np.zeros(0, np.int32)]).astype(np.int64)
    return votes, flat, ends, np.array([sent[k]["target"] for k in order], float)


def linear(votes: np.ndarray, found: np.ndarray, ends: np.ndarray, target: np.ndarray) -> Model:
    """Logistic regression on posterior labels, by adaptive gradient steps over the whole sample."""
    many = votes.shape[1]
    model = [np.zeros(many), np.zeros(1 << BITS), np.zeros(1)]
    squares = [np.full(many, 1e-6), np.full(1 << BITS, 1e-6), np.full(1, 1e-6)]
    # Words of very few sample rows stay out, whatever the sample: they tell more about those rows than about others.
    often = np.bincount(found, minlength=1 << BITS) >= LEAST_WORD_ROWS
    scale = 1 / np.sqrt(np.maximum(np.diff(ends), 1))
    row_of = np.repeat(np.arange(len(target)), np.diff(ends))
    for _ in range(PASSES):
        now = Model(model[0], model[1], float(model[2][0]), 1.0, 0.0)
        error = (sigmoid(now.margins(votes, found, ends)) - target) / max(1, len(target))
        by_word = np.bincount(found, weights=(error * scale)[row_of], minlength=1 << BITS)
        steps = [votes.T @ error + 1e-5 * model[0], np.where(often, by_word, 0) + RIDGE * model[1], error.sum(keepdims=True)]
        for part, square, step in zip(model, squares, steps):
            square += step**2
            part -= 0.5 * step / np.sqrt(square)
    return Model(model[0], model[1], float(model[2][0]), 1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[Voters, Model]:
    """Voters and model of the rows of ``docs`` (doc_id, text)."""
    known = with_label(docs, labels, label)
    voters = Voters(mined_stems(known))
    votes = written(voted(docs, voters), "votes")
    many = len(voters.names)
    every = moments(votes, many)
    labelled = moments(with_label(votes, labels, label), many)
    share = (labelled[-1, -2] + 1) / (labelled[-1, -1] + 1 / DEFAULT_SHARE)
    generative = label_model(every, labelled, voters.derived, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fired = batch["votes"].flatten().to_numpy().reshape(-1, many)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(generative.posterior(fired))], ["doc_id", "target"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    targets = votes.mapInArrow(run, f"doc_id {kind}, target double")
    sides = [
        texts_of_keys(docs, smallest_keys(targets.where(side), most), most).select("text", "target")
        for side in ("target >= 0.5", "target < 0.5")
    ]
    model = linear(*examples(sides[0].union(sides[1]), voters))
    keys = smallest_keys(known.select("doc_id", F.col("label").cast("double").alias("target")), 2 * most)
    checked = texts_of_keys(docs, keys, 2 * most).select("text", "target")
    votes_, found, ends, given = examples(checked, voters)
    if len(set(given.tolist())) == 2:
        # Both classes weigh the same, so a score above one half is likelier toxic than not before the
        # share of toxic rows is known; that share differs between languages, which no score may read.
        toxic_share = given.mean()
        weight = np.where(given == 1, 0.5 / toxic_share, 0.5 / (1 - toxic_share))
        slope, offset = calibrated(model.margins(votes_, found, ends), given, weight)
        model = model._replace(slope=slope, offset=offset)
    return voters, model


def score(docs: DataFrame, voters: Voters, model: Model) -> DataFrame:
    """``docs`` with score in place of the text."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            margins = own.margins(voters.votes(texts), *features(texts))
            scores = pa.array(sigmoid(own.slope * margins + own.offset))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), scores], [*rest, "score"])

    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 2 MB
    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(run, f"{fields}, score double")


def classify(
    df: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int = SAMPLE_ROWS,
    keep_row: bool = False,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row; on demand the input's columns too, in the struct ``row``.

    Rows whose crc32 of the id as text leaves 1 by 3 are held out: neither their texts nor their
    labels teach. A null id counts as the empty text and has no label. Null and empty texts get the
    score of a text on which no voter fires. Repeated rows are scored alike. Labels other than 0 and
    1, and ids with contradicting labels, are not used; without labels a toxic share of 10 % is
    assumed and margins stay uncalibrated. Other columns are ignored, whatever their names. An
    empty table gives an empty result. Texts are scored whole.
    """
    held = remainder(id_col, FOLDS) == HELD_OUT
    docs = df.select(
        df[id_col].alias("doc_id"), held.alias("held_out"), df[text_col].cast("string").alias("text"),
        *([F.struct("*").alias("row")] if keep_row else []),
    )
    voters, model = fit(docs.where("not held_out").select("doc_id", "text"), labels, "toxic", most)
    scored = score(docs, voters, model)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
