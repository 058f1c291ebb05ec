"""Benchmark decontamination with DataFrame functions only.

1. Items become windows of ten consecutive normalised words; an item of fewer words is one window.
   Every distinct window is kept once, with the ids of its items.
2. The windows are broadcast as a hash set, keyed by a 64-bit hash. Every document is scanned once:
   its words are exploded into positions, and the hash of the words from there on is looked up in
   the same generated code. A hit is verified on the words themselves.
3. Hits of one document meet in the task that scanned it, before anything is shuffled: places and
   item sets are combined there, so that a passage shared by a third of all documents, or a document
   full of hits, moves as one row for each document. Each document adds one row of its own, so
   documents without a hit need no join to come back.

The set is broadcast up to ``BROADCAST_WINDOWS`` windows, counted first. More windows are dealt by their hash into
blocks of about that size, and the documents, numbered and written once, are scanned once for each block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.stages import written
from llm.text import lower_ascii

WINDOW = 10
BROADCAST_WINDOWS = 400_000
#: Everything but digits, lower-case letters and characters beyond ASCII parts words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def words_of(text: Column) -> Column:
    """Normalised words of a text; none for null."""
    parted = F.split(lower_ascii(text), f"{BETWEEN}+")
    return F.coalesce(F.array_remove(parted, ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """hash, length, words and the sorted distinct item ids (as strings) of every distinct window."""
    rows = items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("item"), words_of(items[text_col]).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    rows = rows.select("item", "length", "words", F.explode(F.expr("sequence(1, size(words) - length + 1)")).alias("first"))
    rows = rows.select("item", "length", F.slice("words", F.col("first"), F.col("length")).alias("words")).distinct()
    each = rows.groupBy("length", "words").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return each.select(F.xxhash64("words").alias("hash"), "length", "words", "items")


def scanned(docs: DataFrame, windows: DataFrame, lengths: list[int], own_rows: bool) -> DataFrame:
    """number, first word (from 0), length and items of every hit in ``docs`` (number, words and others).

    With ``own_rows`` each document also has a row at -1, with its other columns.
    """
    others = [c for c in docs.columns if c not in ("number", "words")]
    spots = docs.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("size"))
    # The words from each place on which a window fits.
    places = F.when(F.size("words") >= F.col("size"), F.expr("sequence(0, size(words) - size)"))
    places = F.coalesce(places, F.array().cast("array<int>"))
    if own_rows:
        places = F.concat(F.when(F.col("size") == lengths[0], F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")), places)
    spots = spots.select("*", F.explode(places).alias("first"))
    part = F.when(F.col("first") >= 0, F.slice("words", F.col("first") + 1, F.col("size")))
    spots = spots.withColumn("part", part).withColumn("key", F.when(F.col("first") >= 0, F.xxhash64("part")))
    found = windows.select(F.col("hash").alias("w_hash"), F.col("words").alias("w_words"), "items")
    # Looked up by the hash alone, which is a plain number; words are compared only where one is found.
    hits = spots.join(F.broadcast(found), F.col("key") == F.col("w_hash"), "left").where(
        (F.col("first") == -1) | F.col("items").isNotNull() & (F.col("part") == F.col("w_words"))
    )
    own = [F.when(F.col("first") == -1, F.col(c)).alias(c) for c in others]
    return hits.select("number", "first", F.col("size").alias("length"), "items", *own)


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    most_windows: int = BROADCAST_WINDOWS,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    keep_text: bool = True,
) -> DataFrame:
    """One row for each row of ``df``: ``row`` (a struct of its columns, without the text on demand), ``n_words``,
    ``spans`` (array of first and last word, from 0, merged, in order), ``n_hit`` (words in spans),
    ``items`` (ids with an occurring window, as sorted strings) and ``contaminated``.

    Null and empty texts, and texts without words, have no hits; items without words have no windows;
    a null item id counts as the empty text; equal ids are one item. Repeated rows each have their
    own result. With an empty benchmark nothing is hit; an empty table gives an empty result. Input
    columns can have any names, since they stay in the struct. Texts are scanned whole.
    """
    kept = [df[c] for c in df.columns if keep_text or c != text_col]
    docs = df.select(
        F.monotonically_increasing_id().alias("number"),
        F.struct(*kept).alias("row"),
        words_of(df[text_col]).alias("words"),
    ).withColumn("n_words", F.size("words").cast("long"))
    windows = written(item_windows(benchmark, window, item_id_col, item_text_col), "windows")
    # At most one row for each length up to the window's.
    lengths = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    blocks = -(-sum(lengths.values()) // most_windows)
    if blocks > 1:
        docs = written(docs, "numbered")
    sizes = sorted(lengths, reverse=True) or [window]
    parts = [
        scanned(docs, windows.where(F.pmod("hash", F.lit(blocks)) == block) if blocks > 1 else windows, sizes, block == 0)
        for block in range(max(1, blocks))
    ]
    rows = reduce(DataFrame.union, [p.select("number", "first", "length", "items", "row", "n_words") for p in parts])
    hit = F.col("first") >= 0
    each = rows.groupBy("number").agg(
        F.first("row", ignorenulls=True).alias("row"),
        F.max("n_words").alias("n_words"),
        F.collect_list(F.when(hit, F.struct("first", (F.col("first") + F.col("length") - 1).alias("last")))).alias("hits"),
        F.collect_set(F.when(hit, F.col("items"))).alias("sets"),
    )
    covered = F.flatten(F.transform("hits", lambda h: F.sequence(h["first"], h["last"])))
    each = each.select(
        "row", "n_words", "sets", (F.size("hits") > 0).alias("contaminated"),
        F.sort_array(F.array_distinct(covered)).alias("covered"),
    )
    # Runs of covered words. The array is bound once (c), so that no rewriting evaluates it for each element.
    runs = F.expr(
        "transform(array(covered), c -> arrays_zip("
        "filter(c, (p, i) -> i = 0 or get(c, i - 1) < p - 1), filter(c, (p, i) -> i = size(c) - 1 or get(c, i + 1) > p + 1)))[0]"
    )
    each = each.withColumn("spans", F.transform(runs, lambda r: F.struct(r["0"].alias("first"), r["1"].alias("last"))))
    n_hit = F.size("covered").cast("long")
    items = F.array_sort(F.array_distinct(F.flatten("sets")))
    return each.select("row", "n_words", "spans", n_hit.alias("n_hit"), items.alias("items"), "contaminated")


def without_documents(df: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``df`` that hold no window of the benchmark; see ``find_leaks`` for odd rows."""
    return find_leaks(df, benchmark, **parameters).where("not contaminated").select("row.*")


def without_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **parameters) -> DataFrame:
    """All rows of ``df``, with the hit words of each text removed, and what follows each of them up to the next word.

    Texts without a hit stay as they are, null included.
    """
    found = find_leaks(df, benchmark, text_col=text_col, **parameters)
    # Pieces of a word and what follows it; what stands before the first word is a piece of its own.
    inside = BETWEEN.replace(r"\x60", r"\x40\x5B-\x60")
    outside = inside.replace("[", "[^", 1)
    text = F.col("row")[text_col].cast("string")
    lead = F.regexp_extract(text, f"^{inside}*", 0)
    pieces = F.regexp_extract_all(text, F.lit(f"{outside}+{inside}*"), F.lit(0))
    stays = F.expr(
        "transform(sequence(0, size(spans)), k -> slice(pieces, if(k = 0, 0, spans[k - 1].last + 1) + 1,"
        " if(k = size(spans), size(pieces), spans[k].first) - if(k = 0, 0, spans[k - 1].last + 1)))"
    )
    cut = found.withColumn("pieces", F.when(F.col("contaminated"), pieces)).withColumn(
        "clean", F.when(F.col("contaminated"), F.concat(lead, F.array_join(F.flatten(stays), ""))).otherwise(text)
    )
    columns = [F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns]
    return cut.select(*columns)
