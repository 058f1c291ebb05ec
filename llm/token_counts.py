"""Token counts of whole texts with a SentencePiece model.

A blank between two other characters begins a new piece, as no piece of the vocabulary has a blank
behind another character. A text can therefore be split there, the blank being the mark that the
library puts before every text anyway. Workers look up the counts of segments that they have met
and encode the others in batches of bounded size. Where a segment has no such blank for long, line
ends part it: they are single bytes for the model and join with nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.stages import slices, texts_of

MARK = "▁"
SAFE_BLANK = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
LONG_SEGMENT = 50_000
KNOWN_SEGMENTS = 1_000_000
CALL_BYTES = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Counter:
    """Counts tokens with one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        ordinary = [p for k, p in enumerate(pieces) if not self.model.is_byte(k)]
        plain = self.lengths(["a b"]) == [2 * self.lengths(["a"])[0]] and self.lengths(["  a"]) != self.lengths(["a"])
        self.blank_is_safe = plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p in ordinary)
        self.line_end_is_safe = not any("\n" in p for p in ordinary)
        self.known: dict[str, int] = {"": 0}

    def lengths(self, segments: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(segments, num_threads=1)]

    def segments(self, text: str) -> list[str]:
        """Parts of a text whose counts add up to the count of the text."""
        if not self.blank_is_safe:
            return [text]
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return SAFE_BLANK.split(text)
        return text.split(" ")

    def long_count(self, segment: str) -> int:
        """Count of a segment without safe blanks, by parts that begin with a line end."""
        if not self.line_end_is_safe:
            return self.lengths([segment])[0]
        total, start = 0, 0
        while start < len(segment):
            end = segment.find("\n", start + LONG_SEGMENT)
            end = len(segment) if end < 0 else end
            # The mark before a part that begins with a line end is a token of its own.
            total += self.lengths([segment[start:end]])[0] - (start > 0)
            start = end
        return total

    def learn(self, segments: list[str]) -> None:
        held, size = [], 0
        for segment in segments:
            if len(segment) > LONG_SEGMENT:
                self.known[segment] = self.long_count(segment)
                continue
            held.append(segment)
            size += len(segment)
            if size > CALL_BYTES:
                self.known.update(zip(held, self.lengths(held)))
                held, size = [], 0
        self.known.update(zip(held, self.lengths(held)))

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of every text; null counts as empty."""
        if len(self.known) > KNOWN_SEGMENTS:
            self.known = {"": 0}
        split = [self.segments(t) if t else [] for t in texts]
        known = self.known
        self.learn([s for s in {s for segments in split for s in segments} if s not in known])
        counts = [sum(map(known.__getitem__, segments)) for segments in split]
        for segments in split:
            if len(segments) == 1 and len(segments[0]) > LONG_SEGMENT:
                known.pop(segments[0], None)
        return counts


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter per worker and file."""
    return Counter(path)


def count_tokens(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text, one row per input row.

    Null and empty texts have no bytes and no tokens; null ids are kept; repeated rows give repeated
    results; an empty table gives an empty one. Other columns are ignored, whatever their names.
    Texts are counted whole, without begin or end tokens.
    """
    path = path or default_model()
    source = texts_of(df, id_col, text_col).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches):
            counts = pa.array(own.count(batch["text"].to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], counts], names)

    names = ["doc_id", "n_bytes", "n_tokens"]
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
