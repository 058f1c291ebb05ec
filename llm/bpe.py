"""Byte-level BPE encoding and decoding with a contiguous rank array.

A text is cut into words by character class. The parts of every new word lie side by side in a
row of an array, next to the ranks of adjacent pairs. Each round finds the smallest rank of a row
(the leftmost of equals), deletes the boundary there, and refreshes the two neighbouring ranks.
Words of similar length share one NumPy array, so a round serves thousands of words. Words longer
than ``SHORT`` bytes use a heap, as scanning them would take quadratic time.

A task keeps the ids of the words it has met in a table that grows to a bounded size, keyed by a 64-bit
hash of the word's bytes and length (two of 2,000,000 words share one with a probability below 1e-6).
The table goes at the end of the task, as idle workers outlive it and would hold it in later stages.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from llm.hashing import hashes
from llm.stages import slices, texts_of

SHORT = 48
FIRST_BITS, TABLE_BITS = 16, 22
NO_RANK = np.int32(2**31 - 1)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# Unicode White_Space, as first and last code points.
WHITE_SPACE = [
    (0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
# Endings that the pre-tokenizer splits off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    classes = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            classes[code] = LETTER
        elif major == "N":
            classes[code] = NUMBER
    for first, last in WHITE_SPACE:
        classes[first : last + 1] = SPACE
    return classes


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable bytes stand for
    themselves, the others take the code points from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def word_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Mask of the code points that begin a word; ``text_starts`` begin one in any case."""
    n = len(codes)
    kind = character_classes()[codes]
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    fresh = np.zeros(n + 1, bool)
    fresh[text_starts] = True
    fresh[n] = True
    space = kind == SPACE
    # The last character of a run of white space before something else begins a word: a blank
    # takes the following run along, another character stands alone.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:n])
    starts[last] = True
    starts[last[codes[last] == 0x20] + 1] = False
    starts |= fresh[:n]
    # An apostrophe that begins a word takes a following ending along.
    for at in np.flatnonzero((codes == 0x27) & starts).tolist():
        if at + 1 < n and kind[at + 1] == LETTER and not fresh[at + 1] and starts[at]:
            follow = codes[at + 1 : at + 3].tolist()
            for ending in ENDINGS:
                size = len(ending)
                if follow[:size] == [*map(ord, ending)] and not fresh[at + 2 : at + 1 + size].any():
                    starts[at + 1] = False
                    if at + 1 + size < n:
                        starts[at + 1 + size] = True
                    break
    return starts


class WordTable:
    """Ids of words by hash: open addressing with linear steps. Half full, it doubles up to ``most`` bits;
    there it is emptied."""

    def __init__(self, most: int = TABLE_BITS):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.bits = min(FIRST_BITS, self.most)
        self.resize()
        self.pool = np.zeros(1 << 16, "<u4")
        self.filled = self.words = 0

    def resize(self) -> None:
        size = 1 << self.bits
        self.keys = np.zeros(size, np.uint64)
        self.first = np.zeros(size, np.int32)
        self.count = np.zeros(size, np.int32)

    def full(self, more: int) -> bool:
        """Whether so many more words don't fit at the present size."""
        return 2 * (self.words + more) > 1 << self.bits

    def reserve(self, more: int) -> None:
        """Grow as far as so many more words need, at most to ``most`` bits."""
        bits = self.bits
        while self.full(more) and self.bits < self.most:
            self.bits += 1
        if self.bits > bits:
            held = np.flatnonzero(self.keys)
            keys, first, count = self.keys[held], self.first[held], self.count[held]
            self.resize()
            self.put(keys, first, count)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key, -1 where it is absent."""
        place = self.home(keys)
        held = self.keys[place]
        rows = np.flatnonzero(held != keys)
        while len(rows):
            seen = held[rows]
            place[rows[seen == 0]] = -1
            rows = rows[seen != 0]
            place[rows] = (place[rows] + 1) & (len(self.keys) - 1)
            held[rows] = self.keys[place[rows]]
            rows = rows[held[rows] != keys[rows]]
        return place

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Add distinct absent keys, whose ids follow each other in ``ids``."""
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.filled : self.filled + len(ids)] = ids
        first = self.filled + np.cumsum(counts) - counts
        self.filled += len(ids)
        self.words += len(keys)
        self.put(keys, first, counts)

    def put(self, keys: np.ndarray, first: np.ndarray, counts: np.ndarray) -> None:
        place, rows = self.home(keys), np.arange(len(keys))
        while len(rows):
            at = place[rows]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[rows[free]]
            own = self.keys[at] == keys[rows]
            self.first[at[own]], self.count[at[own]] = first[rows[own]], counts[rows[own]]
            rows = rows[~own]
            place[rows] = (place[rows] + 1) & (len(self.keys) - 1)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        vocabulary = model["vocab"]
        self.size = max([*vocabulary.values(), *(t["id"] for t in content["added_tokens"])]) + 1
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        spelled = [b""] * self.size
        for token, number in vocabulary.items():
            spelled[number] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, number in self.special.items():
            spelled[number] = token.encode()
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_ids = np.array([vocabulary[letter] for letter in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.key_ranks = np.append(order.astype(np.int32), NO_RANK)
        grid = self.ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.byte_ranks = grid.reshape(256, 256)
        self.table = WordTable()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours, NO_RANK where there is none."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where((self.keys[at] == wanted) & (right >= 0), self.key_ranks[at], NO_RANK)

    def encode_short(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Ids of words of at most SHORT bytes: a row each, -1 behind the last.

        ``raw`` has the bytes of a word in each row, padded to a common width.
        """
        width = raw.shape[1]
        columns = np.arange(width, dtype=np.int32)
        inside = columns < lengths[:, None]
        now = self.byte_ids[raw]
        now[~inside] = -1
        ranks = np.full(raw.shape, NO_RANK, np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self.byte_ranks[raw[:, :-1], raw[:, 1:]], NO_RANK)
        done = np.empty(raw.shape, np.int32)
        rows = np.arange(len(raw))
        while len(rows):
            at = ranks.argmin(1).astype(np.int32)
            least = ranks[np.arange(len(rows)), at]
            going = least != NO_RANK
            if not going.all():
                done[rows[~going]] = now[~going]
                rows, at, least, now, ranks = rows[going], at[going], least[going], now[going], ranks[going]
            line = np.arange(len(rows))
            now[line, at] = self.merged[least]
            # Delete the boundary behind ``at``: all that follows moves one place to the left.
            after = columns[:-1] > at[:, None]
            np.copyto(now[:, :-1], now[:, 1:].copy(), where=after)
            now[:, -1] = -1
            after[line, np.minimum(at, width - 2)] = True
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=after)
            ranks[:, -1] = NO_RANK
            follow = np.minimum(at + 1, width - 1)
            ranks[line, at] = self.ranks(now[line, at], now[line, follow])
            i = np.flatnonzero(at > 0)
            ranks[i, at[i] - 1] = self.ranks(now[i, at[i] - 1], now[i, at[i]])
        return done

    def encode_long(self, word: np.ndarray) -> np.ndarray:
        """Ids of the bytes of one word, by a heap of candidate merges over a linked list."""
        ids = self.byte_ids[word].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank_of = self.pair_ranks()
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    pair = ids[k], ids[after[k]]
                    if (rank := rank_of.get(pair)) is not None:
                        heapq.heappush(heap, (rank, k, *pair))
        return np.array([x for x in ids if x >= 0], "<u4")

    @lru_cache(maxsize=1)  # noqa: B019  one codec per worker and file
    def pair_ranks(self) -> dict[tuple[int, int], int]:
        left, right = np.divmod(self.keys[:-1], self.size)
        return dict(zip(zip(left.tolist(), right.tolist()), self.key_ranks[:-1].tolist()))

    def learn(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Encode new, distinct words and keep their ids."""
        order = np.argsort(lengths, kind="stable")
        sizes = lengths[order]
        start, short = 0, int(np.searchsorted(sizes, SHORT, "right"))
        while start < short:
            # Words of nearly equal length share an array, of bounded size.
            width = max(8, int(sizes[start]) * 5 // 4)
            end = min(start + 20_000, int(np.searchsorted(sizes, width, "right")), short)
            rows = order[start:end]
            width = max(2, int(sizes[end - 1]))
            at = np.minimum(starts[rows, None] + np.arange(width), len(raw) - 1)
            ids = self.encode_short(raw[at], lengths[rows])
            kept = ids >= 0
            self.table.add(keys[rows], kept.sum(1), ids[kept])
            start = end
        for row in order[short:].tolist():
            ids = self.encode_long(raw[starts[row] : starts[row] + lengths[row]])
            self.table.add(keys[row : row + 1], np.array([len(ids)]), ids)

    def encode_batch(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of every text as 32-bit integers; a null text counts as empty."""
        texts = [t or "" for t in texts]
        special = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if special:
            found = self.encode_plain(["" if k in {*special} else t for k, t in enumerate(texts)])
            for k in special:
                found[k] = self.encode_special(texts[k])
            return found
        return self.encode_plain(texts)

    def encode_special(self, text: str) -> np.ndarray:
        """Ids of a text with special strings, which stand for themselves."""
        for name, number in self.special.items():
            if name in text:
                between = np.array([number], "<u4")
                found = [x for piece in text.split(name) for x in (between, self.encode_special(piece))]
                return np.concatenate(found[1:])
        return self.encode_plain([text])[0]

    def encode_plain(self, texts: list[str]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts], np.int64)
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, "<u4")] * len(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        encoded = whole.encode("utf-8", "surrogatepass")
        raw = np.frombuffer(encoded + bytes(8), np.uint8)
        text_starts = np.cumsum(sizes) - sizes
        starts = np.flatnonzero(word_starts(codes, text_starts[sizes > 0]))
        first_words = np.searchsorted(starts, text_starts)
        if len(encoded) != len(codes):
            wide = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
            starts = (np.cumsum(wide, dtype=np.int64) - wide)[starts]
        lengths = np.diff(starts, append=len(encoded))
        keys = hashes(raw, starts, lengths)
        table = self.table
        places = table.find(keys)
        missing = np.flatnonzero(places < 0)
        if len(missing):
            new, at = np.unique(keys[missing], return_index=True)
            bits = table.bits
            table.reserve(len(new))
            if table.full(len(new)):
                table.clear()
                missing = np.arange(len(keys))
                new, at = np.unique(keys, return_index=True)
                table.reserve(len(new))
                while table.full(len(new)):  # one very long text may have more words
                    table.bits += 1
                    table.resize()
            at = missing[at]
            self.learn(raw, new, starts[at], lengths[at])
            if table.bits == bits:
                places[missing] = table.find(keys[missing])
            else:  # all words have moved
                places = table.find(keys)
        counts = table.count[places]
        ends = np.cumsum(counts, dtype=np.int64)
        take = np.arange(int(ends[-1])) + np.repeat(table.first[places] - (ends - counts), counts)
        ids = table.pool[take]
        bounds = np.concatenate([[0], ends])[np.append(first_words, len(starts))].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, packed: bytes | None) -> str:
        """Text of little-endian 32-bit ids, special strings included; bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed or b"", "<u4").astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        take = np.arange(total) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.flat[take].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker and file."""
    return Codec(path)


@contextmanager
def task_codec(path: str) -> Iterator[Codec]:
    """The worker's codec, whose words are forgotten at the end of the task."""
    own = codec(path)
    try:
        yield own
    finally:
        own.table.clear()


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit).

    One row per input row, in any order. A null text counts as empty and gives no ids; a null id is
    kept. Repeated rows give repeated results; an empty table gives an empty one. Other columns are
    ignored, whatever their names. Texts of any length are encoded whole.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path) as own:
            for batch in slices(batches):
                ids = own.encode_batch(batch["text"].to_pylist())
                counts = pa.array([len(x) for x in ids], pa.int64())
                packed = pa.array([x.tobytes() for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], counts, packed], names)

    source = texts_of(df, id_col, text_col)
    names = ["doc_id", "n_tokens", "ids"]
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """Texts of the ``ids`` column that ``encode`` gives: the input's columns, and text.

    Null ids give an empty text. Any column of the input may be null; repeated rows stay.
    """
    path = path or default_vocabulary()
    source = df.drop("text")
    names = [*source.columns, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, "ids"):
            texts = pa.array([own.decode(p) for p in batch["ids"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{fields}, text string")
