"""Words of texts as 64-bit hashes, computed over whole batches with NumPy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * MIX[1]
    values = (values ^ (values >> np.uint64(27))) * MIX[2]
    return values ^ (values >> np.uint64(31))


def hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of every word; never zero. ``raw`` has 8 spare bytes at its end."""
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))

    def chunk(rows, place):
        held = np.minimum(lengths[rows] - place, 8)
        return eight[starts[rows] + place] & MASKS[held]

    value = lengths.astype(np.uint64) * MIX[0]
    rows, place = np.arange(len(starts)), 0
    while len(rows):
        mixed = (value[rows] ^ chunk(rows, place)) * MIX[1]
        value[rows] = (mixed ^ (mixed >> np.uint64(29))) * MIX[2]
        place += 8
        rows = rows[lengths[rows] > place]
    return (value ^ (value >> np.uint64(32))) | np.uint64(1)


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more entry at the end).

    A-Z are lower-cased; words are runs of bytes other than blank and 9 to 13. Null texts have none.
    """
    raw, starts, lengths, bounds = word_spans(texts)
    return hashes(raw, starts, lengths), bounds


def word_spans(
    texts: Iterable[str | None], between: np.ndarray = BLANK
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, start and length of every word in them, first word of every text.

    ``between`` marks the bytes that part words; a line end must be one of them.
    """
    encoded = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    sizes = np.array([len(e) + 1 for e in encoded], np.int64)
    raw = np.frombuffer(b"\n".join([*encoded, bytes(8)]), np.uint8)
    length = len(raw) - 8
    inside = np.empty(length + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(between[raw[:length]], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return raw, starts, ends - starts, bounds
