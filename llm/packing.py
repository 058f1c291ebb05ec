"""Best-fit packing of token pieces into fixed-length sequences, with a bounded number of open bins.

Documents longer than a sequence are cut; the other pieces are packed online: a piece goes to the
open bin with the least free space that still holds it. Free spaces are the bits of one integer, so
that bin is one bit scan away. When no open bin fits and all places are taken, the fullest closes.
The pieces of an Arrow batch are placed longest first, which leaves hardly any gap: on the documents
measured, 0.01 % more sequences than full ones alone would be, against 0.8 % in random order.

Pieces are dealt out at random (by a hash) to tasks of about ``pieces_per_task`` pieces; every task
packs its own. A task holds its open bins only, and its result depends on its rows alone, so a lost
task is repeated with the same outcome.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.bpe import default_vocabulary, task_codec
from llm.stages import slices, texts_of, written

SEQUENCE = 2048
OPEN_BINS = 8192
PIECES_PER_TASK = 250_000


class OpenBins:
    """At most ``most`` bins that still have room, found by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.made = capacity, most, 0, 0
        self.free = 0  # bit f is set if an open bin has f places left
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset for a piece of 1 to ``capacity`` tokens."""
        fitting = self.free >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = self.take(room)
        else:
            if self.open >= self.most:
                self.take((self.free & -self.free).bit_length() - 1)
            room, number = self.capacity, self.made
            self.made += 1
        if left := room - length:
            self.by_free[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - room

    def take(self, room: int) -> int:
        """Remove an open bin with just this room."""
        bins = self.by_free[room]
        number = bins.pop()
        self.open -= 1
        if not bins:
            self.free &= ~(1 << room)
        return number


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; only the first may be shorter than ``capacity``."""
    first = (tokens - 1) % capacity + 1
    return [(0, first), *((start, capacity) for start in range(first, tokens, capacity))]


def pieces(
    df: DataFrame,
    path: str | None = None,
    capacity: int = SEQUENCE,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of tokenised documents: doc_id, piece, start, length, ids_crc32 and, on demand, ids.

    A document is its token ids and then ``end_id``, so a null or empty text is one piece of one
    token. Null ids are kept. Repeated rows give repeated pieces.
    """
    path = path or default_vocabulary()
    source = texts_of(df, id_col, text_col)
    kind = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path) as own:
            end = np.array([end_id], "<u4")
            for batch in slices(batches):
                rows, found = [], []
                for row, ids in enumerate(own.encode_batch(batch["text"].to_pylist())):
                    ids = np.concatenate([ids, end])
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        raw = ids[start : start + length].tobytes()
                        rows.append(row)
                        found.append((piece, start, length, zlib.crc32(raw), raw if with_ids else None))
                columns = list(zip(*found))[: 5 if with_ids else 4]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), *arrays], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    fields = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return source.mapInArrow(run, fields + ", ids binary" * with_ids)


def pack(
    df: DataFrame,
    capacity: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
    pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """Add sequence_id and offset to rows with ``doc_id``, ``piece``, ``length`` and ``ids_crc32``.

    ``df`` should be a written table: it is counted first, to size the tasks. Every row gets a
    place, repeated rows too; lengths have to be 1 to ``capacity``. Offsets in a sequence run from
    0 without a gap. Sequence numbers are unique, not dense.
    """
    parts = max(1, -(-df.count() // pieces_per_task))
    key = F.xxhash64("doc_id", "piece", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        for batch in batches:
            lengths = batch["length"].to_numpy()
            places = np.empty((len(lengths), 2), np.int64)
            order = np.argsort(-lengths, kind="stable")
            places[order] = [bins.place(n) for n in lengths[order].tolist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places[:, 0] + base), pa.array(places[:, 1])],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    dealt = df.drop("sequence_id", "offset").repartition(parts, key)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    ordered = dealt.sortWithinPartitions(key, "doc_id", "piece")
    return ordered.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(
    df: DataFrame,
    path: str | None = None,
    capacity: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Tokenise, cut and pack documents; the columns of ``pieces`` with sequence_id and offset.

    Null or empty texts are one end token. Columns of other names are ignored. An empty table gives
    an empty result. Full pieces fill a sequence each.
    """
    cut_up = pieces(df, path, capacity, with_ids=with_ids, id_col=id_col, text_col=text_col)
    return pack(written(cut_up, "pieces"), capacity, open_bins)
