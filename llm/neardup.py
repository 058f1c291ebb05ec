"""Near-duplicate groups of documents by one-permutation hashing.

1. A document's set of five-word shingles is hashed once. Each of 128 bins keeps its smallest hash;
   an empty bin takes the value of the first filled bin in its own fixed order of bins (optimal
   densification). Bands of four bins name buckets: a pair of similarity 0.75 misses all 32 of them
   with a probability of 5e-6.
2. Documents with equal sets are one class, of which a single row goes on, so exact copies cost one
   row in every later step, whatever their number.
   All that follows reads the texts of classes that share a bucket, which are few in most corpora.
3. Every bucket links its classes to one head, in the form of a star: the class with most company in
   all its buckets, which in a group of copies is the text they were made from. Edges are confirmed
   on the full sets, and components are formed.
4. Where a bucket still holds several components, they are joined in rounds, as in Boruvka's spanning
   trees: first each component offers its most promising pair to another one, then each class its next
   most promising ones, more of them every round, until no class has any left. Inside a component more
   links change nothing, so a pair whose components have met is never tried. No link between different
   texts is lost, and only refused pairs cost more than a spanning tree.
5. Components come from alternating large-star and small-star steps over the confirmed links.

Hashes have 64 bits; a set with a false member is less likely than a hardware fault.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.hashing import MIX, mixed, word_hashes
from llm.stages import slices, written

WORDS = 5
BAND_BINS, BAND_ROWS = 128, 4
BANDS = BAND_BINS // BAND_ROWS
SIMILARITY_PERCENT = 75
# Sketches keep two bits of each of 512 bins. At similarity 0.75, 96 differ on average; more than 142
# do so about once in 10^6 pairs.
SKETCH_BINS = 512
SKETCH_LONGS = SKETCH_BINS // 32
MOST_DIFFERENT = 142
LEAST_SKETCHED = 64
BROADCAST_KEYS = 500_000
BLOCK_ROWS, LOT_ROWS = 2_048, 8_192
PAIRS_AT_ONCE = 1 << 18
#: Sets of so many shingles, or fewer, go along with their sketches.
MARKED = 256
#: Partners that a class may offer in the first round, and how many times as many in each later one.
FIRST_OFFERS, GROWTH = 8, 8


@lru_cache
def bin_order(bins: int) -> np.ndarray:
    """For every bin, the order in which it looks for a filled one; the bin itself comes first."""
    keys = mixed(np.arange(bins * bins, dtype=np.uint64) * MIX[0] + MIX[1]).reshape(bins, bins)
    return np.argsort(keys * (1 - np.eye(bins, dtype=np.uint64)), axis=1, kind="stable")


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; fewer than five words are one shingle together."""
    words, bounds = word_hashes(texts)
    shingles = np.zeros(len(words), np.uint64)
    whole = max(0, len(words) - WORDS + 1)
    for k in range(WORDS):
        shingles[:whole] = mixed(shingles[:whole] + words[k : k + whole] + MIX[0])
    sets = []
    for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = end - first
        if n >= WORDS:
            sets.append(np.unique(shingles[first : end - WORDS + 1]))
        elif n:
            value = np.array([n], np.uint64)
            for word in words[first:end]:
                value = mixed(value + word + MIX[2])
            sets.append(value)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def densified(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Bin values of every non-empty sorted set, one row each."""
    values = np.zeros((len(sets), bins), np.uint64)
    edges = np.arange(bins, dtype=np.uint64) * np.uint64(2**64 // bins)
    order = bin_order(bins)
    for row, hashes in enumerate(sets):
        first = np.searchsorted(hashes, edges)
        filled = first < np.append(first[1:], len(hashes))
        source = np.arange(bins)
        empty, turn = np.flatnonzero(~filled), 1
        while len(empty):
            tried = order[empty, turn]
            met = filled[tried]
            source[empty[met]] = tried[met]
            empty, turn = empty[~met], turn + 1
        values[row] = hashes[first[source]]
    return values


def buckets_of(sets: list[np.ndarray]) -> np.ndarray:
    """Bucket names of non-empty sets, a column for each band."""
    rows = densified(sets, BAND_BINS).reshape(len(sets), BANDS, BAND_ROWS)
    names = np.arange(BANDS, dtype=np.uint64) * MIX[0] + np.zeros((len(sets), 1), np.uint64)
    for k in range(BAND_ROWS):
        names = mixed(names + rows[:, :, k] + MIX[1])
    return names.view(np.int64)


def sketches_of(sets: list[np.ndarray]) -> np.ndarray:
    """Sketches of non-empty sets, as rows of 64-bit numbers."""
    values = densified(sets, SKETCH_BINS) + np.arange(SKETCH_BINS, dtype=np.uint64) * MIX[2]
    twos = (mixed(values) >> np.uint64(62)).astype(np.uint8)
    bytes_ = twos[:, ::4] << 6 | twos[:, 1::4] << 4 | twos[:, 2::4] << 2 | twos[:, 3::4]
    return np.ascontiguousarray(bytes_).view("<i8")


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each row in a struct, with row number, id, text, set size, class and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            sets = shingle_sets(batch["text"].to_pylist())
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            names = buckets_of([sets[k] for k in full.tolist()])
            classes = np.array([np.add.reduce(mixed(s ^ MIX[1])) for s in sets], np.uint64).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["row"],
                    pa.array(np.arange(number, number + len(sets))),
                    batch["id"],
                    batch["text"],
                    pa.array(sizes),
                    pa.array(classes, mask=sizes == 0),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(names.reshape(-1))),
                ],
                ["row", "number", "id", "text", "n", "class", "buckets"],
            )
            number += len(sets)

    source = df.select(
        F.struct(*[df[c] for c in df.columns if c != text_col]).alias("row"),
        df[id_col].alias("id"),
        df[text_col].cast("string").alias("text"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(
        run,
        f"row {kinds['row']}, number long, id {kinds['id']}, text string, n long, class long, "
        "buckets array<bigint>",
    )


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for all nodes of ``edges`` (columns a and b, longs).

    Large-star and small-star steps alternate until the edges no longer change.
    """

    def stars(links: DataFrame, larger: bool) -> DataFrame:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not larger:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        moved = both.join(least, "a")
        if larger:
            moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
                least.select("a", F.col("least").alias("b"))
            )
        return moved.where("a != b").distinct()

    def settled(links: DataFrame) -> bool:
        """Whether every node either is a component's smallest node or points to one, once."""
        roles = links.select(F.col("a").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("is_root")).union(
            links.select(F.col("b").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("is_root"))
        )
        sums = roles.groupBy("node").agg(F.sum("points").alias("points"), F.max("is_root").alias("is_root"))
        return sums.where("points > 1 or points = 1 and is_root = 1").isEmpty()

    links = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = written(links.distinct(), "links")
    while not settled(links):
        links = written(stars(stars(links, True), False), "links")
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def only(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among the keys (one column of distinct values).

    Keys are broadcast up to ``BROADCAST_KEYS``, which saves a shuffle of wide rows; beyond that
    both sides are shuffled.
    """
    keys = keys.toDF("wanted")
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return rows.join(keys, F.col(column) == F.col("wanted"), "left_semi")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough.

    The pairs are few and narrow, the sets wide: up to ``BROADCAST_KEYS`` pairs go to the sets of
    their first class, and only these move to the second one.
    """
    pairs = pairs.select("a", "b")
    narrow = F.broadcast(pairs) if pairs.count() <= BROADCAST_KEYS else pairs
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = only(sets, pairs.select("b").distinct(), "class").select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = left.join(narrow, "a").join(right, "b")
    common = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"),
                         F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))
    return common.where(f"100 * common >= {SIMILARITY_PERCENT} * (na + nb - common)").select("a", "b")


def promising(x: str, y: str) -> str:
    """SQL condition on set sizes (exact) and sketches that similar pairs meet."""
    sizes = f"100 * least({x}.n, {y}.n) >= {SIMILARITY_PERCENT} * greatest({x}.n, {y}.n)"
    terms = []
    for k in range(SKETCH_LONGS):
        z = f"({x}.sketch[{k}] ^ {y}.sketch[{k}])"
        terms.append(f"bit_count(({z} | shiftrightunsigned({z}, 1)) & {0x5555555555555555}L)")
    # In small sets one element can fill many bins, so they are all tested in full.
    return f"{sizes} and (least({x}.n, {y}.n) < {LEAST_SKETCHED} or {' + '.join(terms)} <= {MOST_DIFFERENT})"


def sketch_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bins in which sketches differ, row by row."""
    z = x ^ y
    return np.bitwise_count((z | (z >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64)


def marks_in_common(row: np.ndarray, column: np.ndarray, marks: pd.Series) -> np.ndarray:
    """How many marks of one row another one has, pair by pair; pairs are sorted by ``row``."""
    counts = np.array([len(x) // 2 for x in marks], np.int64)
    flat, ends = np.frombuffer(b"".join(marks), np.uint16), np.cumsum(counts)
    common = np.zeros(len(row), np.int64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
    for start, end in zip(first, [*first[1:], len(row)]):
        own = np.frombuffer(marks.iat[row[start]], np.uint16)
        theirs = column[start:end]
        many = counts[theirs]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends[theirs] - many, many)
        values = flat[place]
        met = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        common[start:end] = np.add.reduceat(met, np.cumsum(many) - many)
    return common


def best_offers(rows: pd.DataFrame, take: int) -> pd.DataFrame:
    """The nearest ``take`` promising partners of each row that asks behind its cursor, among those of its bucket that are offered."""
    rows = rows.sort_values("bucket", kind="stable")
    asks, offered = np.flatnonzero(rows["asks"]), np.flatnonzero(rows["offered"])
    found = [np.zeros((0, 3), np.int64)]
    if len(asks) and len(offered):
        bucket, names, now, origin, size, n, after, after_name = (
            rows[c].fillna(0).to_numpy().astype(np.int64)
            for c in ("bucket", "class", "component", "first", "size", "n", "after", "after_class")
        )
        sketches = np.frombuffer(b"".join(rows["packed"]), np.uint64).reshape(-1, SKETCH_LONGS)
        low = np.searchsorted(bucket[offered], bucket[asks])
        ends = np.cumsum(np.searchsorted(bucket[offered], bucket[asks], "right") - low)
        start = 0
        while start < len(asks):
            # Rows with about PAIRS_AT_ONCE pairs together.
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, "right")))
            many = np.diff(ends[start:end], prepend=before)
            row = np.repeat(np.arange(start, end), many)
            column = offered[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + low[row]]
            row, start = asks[row], end
            # A pair is offered by the class whose first component was smaller, and by it alone.
            fits = (now[row] != now[column]) & (
                (size[row] < size[column]) | (size[row] == size[column]) & (origin[row] < origin[column])
            )
            row, column = row[fits], column[fits]
            least, most = np.minimum(n[row], n[column]), np.maximum(n[row], n[column])
            fits = 100 * least >= SIMILARITY_PERCENT * most
            row, column, least = row[fits], column[fits], least[fits]
            apart = sketch_distances(sketches[row], sketches[column])
            fits = (apart <= MOST_DIFFERENT) | (least < LEAST_SKETCHED)
            fits &= (apart > after[row]) | (apart == after[row]) & (names[column] > after_name[row])
            row, column, apart = row[fits], column[fits], apart[fits]
            # Small sets are here as a whole, so what the sketches let through is settled before it is offered.
            small = np.flatnonzero((n[row] <= MARKED) & (n[column] <= MARKED))
            common = marks_in_common(row[small], column[small], rows["marks"])
            refused = 100 * common < SIMILARITY_PERCENT * (n[row[small]] + n[column[small]] - common)
            row, column, apart = (np.delete(v, small[refused]) for v in (row, column, apart))
            order = np.lexsort((names[column], apart, row))
            row, column, apart = row[order], column[order], apart[order]
            few = np.arange(len(row)) - np.searchsorted(row, row) < take
            found.append(np.stack([names[row[few]], names[column[few]], apart[few]], 1))
    return pd.DataFrame(np.concatenate(found), columns=["class", "other", "apart"])


def narrow(rows: DataFrame) -> DataFrame:
    """Written rows of a few numbers, to be broadcast up to ``BROADCAST_KEYS`` of them; beyond that both sides are shuffled."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows


def offers(members: DataFrame, state: DataFrame, sets: DataFrame, take: int) -> DataFrame:
    """class, other and apart: up to ``take`` partners of each asking class (with a cursor), the most promising first.

    ``members`` (bucket, class) of buckets without a class that asks, or with one component, are left out. Members of
    a large bucket are dealt into numbered blocks, which meet pair by pair, so that no bucket is one task; small
    buckets share lots, each with one row for each member. At most ``take`` rows leave a group for each of its rows.
    """
    rows = members.join(narrow(state), "class")
    blocks = rows.groupBy("bucket").agg(
        F.count("*").alias("k"), F.count("after").alias("asking"),
        F.min("component").alias("low"), F.max("component").alias("high"),
    ).where("asking > 0 and low != high").select("bucket", "k", F.ceil(F.col("k") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = written(blocks, "blocks")
    lots = int(blocks.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]) // LOT_ROWS + 1
    sized = rows.join(narrow(blocks), "bucket").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # In a large bucket a row asks in all pairs with its own block first, and is offered in all with it second.
    asks, yes = F.col("after").isNotNull(), F.lit(True)
    lot = F.when(F.col("blocks") > 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(lots)))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    roles = F.when(
        F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), asks.alias("asks"), yes.alias("offered")))
    ).otherwise(
        F.concat(
            F.transform(F.filter(every, lambda _: asks), lambda y: F.struct(F.col("block").alias("x"), y.alias("y"), yes.alias("asks"), (~yes).alias("offered"))),
            F.transform(every, lambda x: F.struct(x.alias("x"), F.col("block").alias("y"), (~yes).alias("asks"), yes.alias("offered"))),
        )
    )
    dealt = sized.withColumns({"lot": lot, "large": F.col("blocks") > 1}).select("*", F.inline(roles))
    wide = dealt.join(sets.select("class", "n", "packed", "marks"), "class")
    found = wide.groupBy("large", "lot", "x", "y").applyInPandas(
        lambda group: best_offers(group, take), "class long, other long, apart long"
    )
    # A pair can come from several buckets; equal rows have one rank.
    turn = F.dense_rank().over(Window.partitionBy("class").orderBy("apart", "other"))
    return found.withColumn("turn", turn).where(F.col("turn") <= take).dropDuplicates(["class", "other"]).drop("turn")


def bridged(members: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """first and component: what the components in shared buckets are called after all links across them.

    The state has a row for each class in a bucket with several components: its first component and the
    number of classes in it, its present component, and behind which partner it goes on asking (null: none left).
    """
    rows = labelled(members.select("bucket", "class"), groups)
    split = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    rows = written(rows.join(split.select("bucket"), "bucket").withColumnRenamed("component", "first"), "open")
    sizes = labelled(sets.select("class"), groups).groupBy("component").agg(F.count("*").alias("size"))
    state = written(
        rows.select("class", "first").distinct().join(sizes.withColumnRenamed("component", "first"), "first").select(
            "class", "first", "size", F.col("first").alias("component"),
            F.lit(-1).cast("long").alias("after"), F.lit(0).cast("long").alias("after_class"),
        ),
        "state",
    )
    members = rows.select("bucket", "class")

    def across(found: DataFrame, state: DataFrame) -> DataFrame:
        """Offers whose classes are in different components now."""
        origin = narrow(state.select("class", "component"))
        ends = found.join(origin, "class").join(origin.toDF("other", "component2"), "other")
        return ends.where("component != component2")

    def joined(pairs: DataFrame, state: DataFrame) -> DataFrame:
        """The state after the pairs (class, other, component, component2) were confirmed or refused."""
        tried = written(
            pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"), "component", "component2")
            .dropDuplicates(["a", "b"]), "tried",
        )
        if tried.isEmpty():
            return state
        links = similar(tried, sets).join(narrow(tried), ["a", "b"])
        links = written(links.select(F.col("component").alias("a"), F.col("component2").alias("b")).distinct(), "bridges")
        if links.isEmpty():
            return state
        names = narrow(written(components(links).toDF("component", "becomes"), "joined"))
        new = state.join(names, "component", "left").withColumn("component", F.coalesce("becomes", "component"))
        return written(new.select("class", "first", "size", "component", "after", "after_class"), "state")

    take = FIRST_OFFERS
    while not state.where("after is not null").isEmpty():
        found = written(offers(members, state, sets, take), "offers")
        ends = across(found, state)
        # First the best pair of each component alone; what still leads to another component comes after.
        best = ends.groupBy("component").agg(F.min(F.struct("apart", "class", "other", "component2")).alias("best"))
        state = joined(best.select("component", "best.*"), state)
        state = joined(across(found, state), state)
        # A class goes on behind its last partner, if it had as many as it was allowed.
        last = found.groupBy("class").agg(F.count("*").alias("k"), F.max(F.struct("apart", "other")).alias("last"))
        last = last.where(F.col("k") == take).select(
            "class", F.col("last.apart").alias("after"), F.col("last.other").alias("after_class")
        )
        new = state.drop("after", "after_class").join(narrow(written(last, "asking")), "class", "left")
        state = written(new.select("class", "first", "size", "component", "after", "after_class"), "state")
        take *= GROWTH
    return state.select("first", "component").distinct()


def full_sets(rows: DataFrame) -> DataFrame:
    """class, n, sketch (also as bytes) and shingles (array of hashes) of rows with class and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch["text"].to_pylist())
            sizes = np.array([len(s) for s in sets], np.int64)
            sketches = sketches_of(sets)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            each = np.arange(0, sketches.size + 1, SKETCH_LONGS, dtype=np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["class"],
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(each), pa.array(sketches.reshape(-1))),
                    pa.array([row.tobytes() for row in sketches], pa.binary()),
                    # Beginnings of hashes, in order: what sets have in common, their marks have in common.
                    pa.array([(s >> np.uint64(48)).astype(np.uint16).tobytes() if len(s) <= MARKED else b"" for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["class", "n", "sketch", "packed", "marks", "shingles"],
            )

    return rows.select("class", "text").mapInArrow(run, "class long, n long, sketch array<bigint>, packed binary, marks binary, shingles array<bigint>")


def labelled(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows with ``class`` and their component; a class without links is its own."""
    if groups is None:
        return rows.withColumn("component", F.col("class"))
    named = groups.withColumnRenamed("node", "class")
    return rows.join(named, "class", "left").withColumn("component", F.coalesce("component", "class"))


def links_between(rows: DataFrame, firsts: DataFrame) -> DataFrame | None:
    """Component of every class that has a confirmed link; None if there is no shared bucket.

    ``rows`` are written signatures, ``firsts`` has the number of one row for each class.
    """
    classes = only(rows, firsts, "number")
    spread = classes.select("class", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")
    members = written(spread.join(shared, "bucket"), "members")
    if members.isEmpty():
        return None
    company = written(members.groupBy("class").agg(F.sum(F.col("k") - 1).alias("company")), "company")
    met = only(classes, company.select("class"), "class")
    sets = written(full_sets(met), "sets")

    # Stars around the class with most company.
    heads = members.join(company, "class").groupBy("bucket").agg(F.max(F.struct("company", "class")).alias("head"))
    stars = members.join(heads, "bucket").where("class != head.class").select(
        F.col("class").alias("p"), F.col("head.class").alias("q")
    ).distinct()
    x = sets.select(F.col("class").alias("p"), "n", "sketch").alias("x")
    y = sets.select(F.col("class").alias("q"), "n", "sketch").alias("y")
    stars = stars.join(x, "p").join(y, "q").where(promising("x", "y"))
    stars = written(stars.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "stars")
    groups = written(components(written(similar(stars, sets), "confirmed")), "components")

    # Pairs across components in buckets that still have several.
    names = bridged(members, sets, groups).withColumnRenamed("component", "becomes")
    # Components that were bridged take the name of the joined one.
    nodes = labelled(sets.select("class"), groups).join(names, F.col("component") == F.col("first"), "left")
    return nodes.select(F.col("class").alias("node"), F.coalesce("becomes", "component").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups: ``row`` (a struct of the input's columns but the text), ``text``,
    ``n_shingles``, ``component_id``, ``kept`` and ``chosen``.

    ``component_id`` is the smallest id reachable over links, ``kept`` tells whether the row has that
    id, and ``chosen`` is true for exactly one row of every group (the first with that id), so that
    repeated rows leave one. Null and empty texts, and texts without words, have no shingles, are
    linked with nothing, and are kept and chosen. A null id is larger than all others; a group of
    null ids has a null ``component_id`` and keeps its rows. An empty table gives an empty result.
    Input columns can have any names, since they stay in the struct. Texts are taken whole.
    """
    rows = written(signatures(df, id_col, text_col), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "number")).alias("first")
    classes = written(rows.where("class is not null").groupBy("class").agg(first), "classes")
    groups = links_between(rows, classes.select("first.number"))
    named = labelled(classes, groups)
    heads = named.groupBy("component").agg(F.min("first").alias("head"))
    verdicts = named.join(heads, "component").select("class", "head")
    return rows.join(verdicts, "class", "left").select(
        "row",
        "text",
        F.col("n").alias("n_shingles"),
        F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("component_id"),
        F.when(F.col("head").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("head.id"))).alias("kept"),
        F.coalesce(F.col("number") == F.col("head.number"), F.lit(True)).alias("chosen"),
    )
