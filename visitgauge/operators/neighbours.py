"""Exact nearest neighbours within a class, without forming all pairs as rows.

Answers and codes have few values, so most columns leave gaps between them. Each class is cut
along its gaps into boxes, and the boxes give lower bounds of distances:

1. A tree of cuts is drawn for each class on a sample of bounded size; all rows are sent down that tree.
   A cut is worth the square of the gap it runs through, times the share of rows on its smaller
   side, so codes and answers that tell many rows apart come first.
2. Leaves that lie next to each other form blocks of bounded size. Every row searches its own block, nearest
   leaves first, and passes over leaves whose box is farther than the k-th neighbour found so far.
3. Only then it visits the other blocks that have a leaf not farther than that bound. What was not
   visited can't hold a nearer row, so the result is exact whatever the sample.

A row travels once to each block it asks, not to each leaf. A task has a block and part of the rows that
ask it; rows of one leaf go together, so boxes are compared once for all of them. Distances are matrix
products, and only pairs within the bound are computed again one by one. On more rows the bounds are
tighter, and a smaller share of the leaves is visited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitgauge.session import materialise

LEAF_ROWS = 256
# Rows of a block, of which a task has one, and rows that ask it there.
BLOCK_ROWS, PART_ROWS = 65_536, 32_768
# Rows of each class that shape its tree, and those that a single cut is chosen by.
SAMPLE_ROWS, CUT_ROWS = 50_000, 1_000
# Relative slack for rounding in the distance bounds; it only lets more candidates through.
SLACK = 1e-9
# Rows that go through the leaves together, and leaves of which boxes are compared with each row at a time.
GROUP_ROWS, STEP_LEAVES = 256, 64
# Leaves of a group that tighten the bound before boxes are compared.
FIRST_LEAVES = 4


@dataclass(frozen=True)
class Cuts:
    """A tree: inner nodes have a dimension, a cut and two children; negative children are leaves (~number)."""

    dimension: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64) if len(self.cut) else np.full(len(x), -1)
        inside = np.flatnonzero(node >= 0)
        while len(inside):
            at = node[inside]
            low = x[inside, self.dimension[at]] <= self.cut[at]
            node[inside] = np.where(low, self.below[at], self.above[at])
            inside = inside[node[inside] >= 0]
        return ~node


def _best_cut(x: np.ndarray) -> tuple[int, float] | None:
    """Dimension and place of the cut of most worth; None if all rows are equal."""
    ordered = np.sort(x[:CUT_ROWS], axis=0)
    m = len(ordered)
    gaps = np.diff(ordered, axis=0)
    side = np.minimum(np.arange(1, m), np.arange(m - 1, 0, -1)) / m
    worth = gaps**2 * side[:, None]
    if not worth.size or worth.max() <= 0:
        return None
    row, column = divmod(int(worth.argmax()), x.shape[1])
    return column, float(ordered[row, column] + ordered[row + 1, column]) / 2


def _tree(x: np.ndarray, leaf_rows: int) -> Cuts:
    nodes: list[list] = []
    leaves = 0
    stack = [(np.arange(len(x)), None, 0)]
    while stack:
        rows, parent, side = stack.pop()
        found = _best_cut(x[rows]) if len(rows) > leaf_rows else None
        if found is None:
            number, leaves = ~leaves, leaves + 1
        else:
            number = len(nodes)
            nodes.append([found[0], found[1], 0, 0])
            low = x[rows, found[0]] <= found[1]
            stack += [(rows[low], number, 2), (rows[~low], number, 3)]
        if parent is not None:
            nodes[parent][side] = number
    columns = list(zip(*nodes)) if nodes else [(), (), (), ()]
    return Cuts(*(np.array(c, float if k == 1 else np.int64) for k, c in enumerate(columns)))


def _trees(points: DataFrame, label: str, leaf_rows: int, sample_rows: int) -> dict[str, Cuts]:
    """One tree for each class, from up to ``sample_rows`` of its rows in hash order."""
    order = Window.partitionBy(label).orderBy(F.xxhash64("vid"), "vid")
    sizes = {row[label]: row["n"] for row in points.groupBy(label).agg(F.count("*").alias("n")).collect()}
    rows = points.select(label, "vid", "x").withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= sample_rows)
    found: dict[str, list] = {name: [] for name in sizes}
    for row in rows.orderBy(label, "_turn").select(label, "x").toLocalIterator():
        found[row[label]].append(row["x"])
    # A sampled row stands for several.
    return {
        name: _tree(np.array(x, float), max(8, leaf_rows * len(x) // sizes[name])) for name, x in found.items()
    }


def _packed(x: np.ndarray) -> pa.Array:
    """Each row as the bytes of its numbers."""
    data = np.ascontiguousarray(x, np.float64)
    ends = np.arange(0, (len(x) + 1) * 8 * x.shape[1], 8 * x.shape[1] or 1, dtype=np.int32)[: len(x) + 1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _matrix(packed: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    chunks = packed.chunks if isinstance(packed, pa.ChunkedArray) else [packed]
    parts = [np.empty((0, size))]
    for chunk in chunks:
        if len(chunk):
            first = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset]
            parts.append(np.frombuffer(chunk.buffers()[2], np.float64, len(chunk) * size, first).reshape(-1, size))
    return parts[1] if len(parts) == 2 else np.concatenate(parts)


def _classes(batch: pa.RecordBatch, label: str) -> Iterator[tuple[object, np.ndarray]]:
    """The classes in a batch with their rows."""
    names = batch[label].dictionary_encode()
    codes = names.indices.fill_null(-1).to_numpy()
    for code, name in enumerate(names.dictionary.to_pylist()):
        yield name, np.flatnonzero(codes == code)


def _in_leaves(points: DataFrame, label: str, size: int, trees: dict[str, Cuts]) -> DataFrame:
    """The class, ``vid``, leaf and packed vector of every row."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            leaf = np.zeros(len(x), np.int32)
            for name, at in _classes(batch, label):
                leaf[at] = trees[name].leaves(x[at])
            yield pa.RecordBatch.from_arrays(
                [batch[label], batch["vid"], pa.array(leaf), _packed(x)], [label, "vid", "leaf", "packed"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = f"`{label}` {kinds[label]}, vid {kinds['vid']}, leaf int, packed binary"
    return points.select(label, "vid", "x").mapInArrow(assign, schema)


@dataclass(frozen=True)
class Boxes:
    """Rows, lowest and highest values of the leaves of a class."""

    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def squared_bounds(self, x: np.ndarray) -> np.ndarray:
        """Least squared distance of every row of ``x`` to every box."""
        found = np.zeros((len(x), len(self.rows)))
        # Only where some box leaves out a row.
        for k in np.flatnonzero((self.low.max(0) > x.min(0)) | (self.high.min(0) < x.max(0))).tolist():
            out = np.maximum(self.low[:, k] - x[:, k : k + 1], x[:, k : k + 1] - self.high[:, k])
            found += np.square(np.maximum(out, 0, out=out), out=out)
        return found

    def group_bounds(self, x: np.ndarray) -> np.ndarray:
        """Least squared distance of the box of all rows of ``x`` to every box."""
        out = np.maximum(np.maximum(self.low - x.max(0), x.min(0) - self.high), 0)
        return (out**2).sum(1)

    def some(self, at: np.ndarray) -> Boxes:
        return Boxes(self.rows[at], self.low[at], self.high[at])


def _boxes(leaved: DataFrame, label: str, size: int) -> dict[str, Boxes]:
    """Boxes of the leaves that have rows; their number is bounded by the sample's."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[object, int], list] = {}
        for batch in batches:
            x, leaf = _matrix(batch["packed"], size), batch["leaf"].to_numpy()
            for name, at in _classes(batch, label):
                at = at[np.argsort(leaf[at], kind="stable")]
                own, first, many = np.unique(leaf[at], return_index=True, return_counts=True)
                lows, highs = np.minimum.reduceat(x[at], first), np.maximum.reduceat(x[at], first)
                for number, n, low, high in zip(own.tolist(), many.tolist(), lows, highs):
                    seen = found.setdefault((name, number), [0, low, high])
                    seen[:] = [seen[0] + n, np.minimum(seen[1], low), np.maximum(seen[2], high)]
        for (name, number), (n, low, high) in found.items():
            yield pa.RecordBatch.from_pydict(
                {label: [name] * size, "leaf": np.full(size, number, np.int32), "place": np.arange(size, dtype=np.int32),
                 "n": np.full(size, n), "low": low, "high": high}
            )

    kind = leaved.schema[label].dataType.simpleString()
    parts = leaved.mapInArrow(reduce, f"`{label}` {kind}, leaf int, place int, n long, low double, high double")
    found = parts.groupBy(label, "leaf", "place").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = found.toArrow().combine_chunks()
    boxes = {}
    for batch in rows.to_batches():
        leaf, place, n, low, high = (batch[c].to_numpy() for c in ("leaf", "place", "n", "low", "high"))
        for name, at in _classes(batch, label):
            many = int(leaf[at].max()) + 1
            box = Boxes(np.zeros(many, np.int64), np.full((many, size), np.inf), np.full((many, size), -np.inf))
            box.rows[leaf[at]] = n[at]
            box.low[leaf[at], place[at]], box.high[leaf[at], place[at]] = low[at], high[at]
            boxes[name] = box
    return boxes


def _blocks(rows: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of every leaf, and the number of blocks that it alone is dealt into.

    Neighbouring leaves share a block of up to ``block_rows``; a larger leaf is dealt into several by a hash.
    """
    first, many = np.zeros(len(rows), np.int32), np.ones(len(rows), np.int32)
    block, held = 0, 0
    for leaf, n in enumerate(rows.tolist()):
        if held and held + n > block_rows:
            block, held = block + 1, 0
        first[leaf] = block
        held += n
        if n > block_rows:
            many[leaf] = -(-n // block_rows)
            block, held = block + int(many[leaf]), 0
    return first, many


class Nearest:
    """The rows of a block by leaves, searched by rows that come with the bound they have reached."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: np.ndarray, k: int):
        order = np.argsort(leaf, kind="stable")
        self.ids, self.k = ids[order], k
        self.x = x = x[order]
        _, self.first, many = np.unique(leaf[order], return_index=True, return_counts=True)
        self.last = self.first + many
        self.boxes = Boxes(many, np.minimum.reduceat(x, self.first), np.maximum.reduceat(x, self.first))
        self.middle = (self.boxes.low.min(0) + self.boxes.high.max(0)) / 2
        own = x - self.middle
        squares = (own * own).sum(1)
        self.largest = squares.max()
        # Single precision, unless its rounding is large beside the leaves.
        across = np.median(((self.boxes.high - self.boxes.low) ** 2).sum(1))
        self.kind = np.float32 if self._loss(np.float32, self.largest) <= 1e-3 * across else np.float64
        # With a last component of 1, the product gives the squares less those of the asking row.
        self.wide = np.empty((x.shape[1] + 1, len(x)), self.kind)
        self.wide[:-1] = -2 * own.T
        self.wide[-1] = squares

    def _loss(self, kind: type, largest: float) -> float:
        """What the short form of the squares loses to rounding, at most."""
        return float(np.finfo(kind).eps) * 8 * (len(self.middle) + 2) * (self.largest + largest)

    def search(self, x: np.ndarray, names: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, id and distance of up to ``k`` rows not farther than ``reach`` for some rows, nearest first.

        ``reach`` has squares of distances and is narrowed to the k-th found.
        """
        moved = x - self.middle
        own = (moved * moved).sum(1)
        wide = np.ones((len(x), x.shape[1] + 1), self.kind)
        wide[:, :-1] = moved
        loss = self._loss(self.kind, own.max())
        held = [(np.empty(0, np.int64), self.ids[:0], np.empty(0))]
        waiting = 0

        def settle() -> None:
            line, ids, apart = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((ids, apart, line))
            line, ids, apart = line[order], ids[order], apart[order]
            place = np.arange(len(line)) - np.searchsorted(line, line)
            last, few = place == self.k - 1, place < self.k
            reach[line[last]] = np.minimum(reach[line[last]], apart[last] ** 2 * (1 + SLACK))
            held[:] = [(line[few], ids[few], apart[few])]

        bounds = self.boxes.group_bounds(x)
        order = np.argsort(bounds, kind="stable")
        start, step = 0, FIRST_LEAVES
        while start < len(order):
            leaves = order[start : start + step]
            leaves = leaves[bounds[leaves] <= reach.max() * (1 + SLACK) + SLACK]
            if not len(leaves):
                break
            near = self.boxes.some(leaves).squared_bounds(x) if start else None
            for k, leaf in enumerate(leaves.tolist()):
                rows = np.arange(len(x)) if near is None else np.flatnonzero(near[:, k] <= reach * (1 + SLACK) + SLACK)
                if not len(rows):
                    continue
                first, last = self.first[leaf], self.last[leaf]
                apart = (wide if len(rows) == len(wide) else wide[rows]) @ self.wide[:, first:last]
                if near is None and last - first > self.k:
                    # One more than k, as a row itself may be among them.
                    limit = np.partition(apart, self.k, axis=1)[:, self.k] + own[rows] + loss
                    reach[rows] = np.minimum(reach[rows], np.maximum(limit, 0))
                most = (reach[rows] + loss - own[rows]).astype(self.kind)
                line, column = np.divmod(np.flatnonzero(apart <= np.nextafter(most, self.kind(np.inf))[:, None]), last - first)
                line, column = rows[line], column + first
                other = self.ids[column] != names[line]
                line, column = line[other], column[other]
                held.append((line, self.ids[column], np.sqrt(((x[line] - self.x[column]) ** 2).sum(1))))
                waiting += len(line)
                if waiting > 8 * self.k * len(x):
                    settle()
                    waiting = 0
            settle()
            start, step = start + step, STEP_LEAVES
        return held[0]


def _searched(
    asking: DataFrame, blocked: DataFrame, label: str, size: int, k: int, boxes: dict[str, Boxes], block_rows: int, first: bool
) -> DataFrame:
    """The best ``k`` of each row of ``asking`` in the block it asks, as arrays.

    The ``first`` time rows ask their own block; they then come with the other blocks that may have nearer rows,
    and with their vectors if there are any.
    """
    keys = [label, "block"]
    # One row for each block.
    parts = asking.groupBy(*keys).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    here = asking.join(F.broadcast(parts), keys).withColumn("part", F.pmod(F.xxhash64("leaf"), "parts").cast("int"))
    there = blocked.join(F.broadcast(parts), keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kind, key_kind = (asking.schema[c].dataType.simpleString() for c in (label, "vid"))
    lists = f"`{label}` {kind}, vid {key_kind}, neighbours array<{key_kind}>, distances array<double>"
    schema = lists + (", leaf int, packed binary, reach double, blocks array<int>" if first else "")

    def best(key: tuple, queries: pa.Table, others: pa.Table) -> pa.Table:
        lines, ids, apart = [np.empty(0, np.int64)], [], [np.empty(0)]
        names, at = queries["vid"].to_numpy(), queries["leaf"].to_numpy()
        order = np.argsort(at, kind="stable")
        queries = queries.take(pa.array(order))
        names, at = names[order], at[order]
        x, reach = _matrix(queries["packed"], size), queries["reach"].to_numpy().copy()
        rows = others["vid"].to_numpy()
        ids.append(rows[:0])
        blocks: list[list[int]] = []
        if len(rows) and len(x):
            held = Nearest(_matrix(others["packed"], size), rows, others["leaf"].to_numpy(), k)
            del others
            if first:
                every = boxes[key[0].as_py()]
                starts, many = _blocks(every.rows, block_rows)
                homes = np.repeat(np.arange(len(starts)), many)
                # Every block of a leaf dealt into several has its box.
                number = starts[homes] + np.concatenate([np.arange(m) for m in many])
                turns = np.flatnonzero(np.diff(number, prepend=-1))
                own_block = key[1].as_py()
            for start in range(0, len(x), GROUP_ROWS):
                some = slice(start, start + GROUP_ROWS)
                line, near, distance = held.search(x[some], names[some], reach[some])
                lines.append(line + start)
                ids.append(near)
                apart.append(distance)
                if first:
                    bounds = np.minimum.reduceat(every.group_bounds(x[some])[homes], turns)
                    bounds[own_block] = np.inf
                    wanted = bounds <= (reach[some] * (1 + SLACK) + SLACK)[:, None]
                    wanted &= np.isfinite(bounds)
                    blocks += [np.flatnonzero(w).astype(np.int32) for w in wanted]
        line = np.concatenate(lines)
        ends = pa.array(np.searchsorted(line, np.arange(len(x) + 1)).astype(np.int32))
        found = pa.array(np.concatenate(ids), from_pandas=True).cast(queries["vid"].type)
        columns = [
            queries[label], queries["vid"], pa.ListArray.from_arrays(ends, found),
            pa.ListArray.from_arrays(ends, pa.array(np.concatenate(apart))),
        ]
        if first:
            asked = pa.array([len(b) > 0 for b in blocks], pa.bool_())
            packed = queries["packed"].combine_chunks()
            packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
            some = pc.if_else(asked, packed, pa.scalar(None, pa.binary()))
            columns += [pa.array(at), some, pa.array(reach), pa.array(blocks, pa.list_(pa.int32()))]
        return pa.Table.from_arrays(columns, [c.split(" ")[0].strip("`") for c in schema.split(", ")])

    group = [*keys, "part"]
    # Both sides come from the same table; with columns of their own they can be told apart.
    here, there = (
        side.select(*[F.col(c).alias(c) for c in [*group, "vid", "leaf", "packed", *more]]) for side, more in ((here, ["reach"]), (there, []))
    )
    # Work is much for few bytes: partitions by bytes would be too few.
    spark = asking.sparkSession
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    here, there = (side.repartition(dealt, *group) for side in (here, there))
    return here.groupBy(*group).cogroup(there.groupBy(*group)).applyInArrow(best, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vid").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_in_class(
    points: DataFrame,
    k: int,
    label: str = "label",
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The ``k`` nearest other points of the same class: (label, vid, neighbour, distance, rank).

    ``points`` has a class, a unique ``vid`` and distinct vectors ``x``; hand in a
    stored table, it is read several times. Ties go to the lower ``vid``. A class with fewer
    than ``k`` other points gives all of them.
    """
    first = points.select(F.size("x").alias("size")).first()
    if first is None:
        names = points.select(label, "vid", F.col("vid").alias("neighbour"))
        return names.withColumns({"distance": F.lit(0.0), "rank": F.lit(1)})
    size = first["size"]
    trees = _trees(points, label, leaf_rows, sample_rows)
    leaved = materialise(_in_leaves(points, label, size, trees))
    boxes = _boxes(leaved, label, size)
    plan = []
    for name, own in boxes.items():
        starts, many = _blocks(own.rows, block_rows)
        plan += zip([name] * len(starts), range(len(starts)), starts.tolist(), many.tolist())
    kind = leaved.schema[label].dataType.simpleString()
    # One row for each leaf.
    leaves = points.sparkSession.createDataFrame(plan, f"`{label}` {kind}, leaf int, start int, many int")
    block = F.col("start") + F.pmod(F.xxhash64("vid"), F.col("many")).cast("int")
    blocked = leaved.join(F.broadcast(leaves), [label, "leaf"]).select(label, "vid", "leaf", "packed", block.alias("block"))
    asking = blocked.withColumn("reach", F.lit(float("inf")))
    found = materialise(_searched(asking, blocked, label, size, k, boxes, block_rows, True))
    asking = found.where(F.size("blocks") > 0).select(label, "vid", "leaf", "packed", "reach", F.explode("blocks").alias("block"))
    more = _searched(asking, blocked, label, size, k, boxes, block_rows, False)
    lists = found.select(label, "vid", "neighbours", "distances").union(more)
    pairs = lists.select(label, "vid", F.inline(F.arrays_zip("neighbours", "distances")))
    pairs = pairs.withColumnsRenamed({"neighbours": "neighbour", "distances": "distance"})
    return _ranked(pairs, k).select(label, "vid", "neighbour", "distance", "rank")
