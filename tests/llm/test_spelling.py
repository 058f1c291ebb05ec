"""Spelling variants against plain counts and all pairs."""

from __future__ import annotations

import collections
import re
import zlib

import pytest
from llm import spelling
from llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_counts(rows, spoil=199, least_length=6, least_count=5):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            code = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if spoil and code % spoil == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_groups(counts, ratio=5):
    found = {w: [v for v in counts if near(w, v)] for w in counts}
    forms = {}
    for word, others in found.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[word] = best if best is not None and counts[best] >= ratio * counts[word] else None
    rows = set()
    for word, n in counts.items():
        root = word
        while forms[root]:
            root = forms[root]
        rows.add((word, forms[word], root, n, len(found[word]), counts.get(forms[word])))
    return rows


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op13_spelling"](spark, FOLDER).collect()} == plain_groups(plain_counts(rows))


def test_spoiled_counts_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for spoil in (None, 2):
        found = spelling.word_counts(odd, least_length=3, least_count=1, spoil=spoil).collect()
        assert {r["word"]: r["n"] for r in found} == plain_counts(rows, spoil, 3, 1)
    assert spelling.word_counts(empty).count() == 0


def test_anagrams_chains_and_ties(spark):
    """Many words of one multiset, chains of forms, letters beyond ASCII, long and repeated rows."""
    counts = {"letters": 10_000, "lettars": 1_500, "lettaro": 200, "ettaro": 20, "settaro": 20, "ttaro": 1, "retsel": 7}
    counts |= {f"{'ab' * k}c{'ab' * (12 - k)}": 5 + k for k in range(13)}
    counts |= {f"{'ab' * k}d{'ab' * (12 - k)}": 400 for k in range(13)}
    counts |= {"été" * 3: 50, "éte" * 3: 9, "étéétéét": 5, "ÿ" * 3000: 8, "ÿ" * 2999: 50, "ÿ" * 2998 + "z": 50}
    rows = [(w, n) for w, n in counts.items()] + [(None, 5)]
    rows = [(w, n - 1) for w, n in rows] + [(w, 1) for w, _ in rows]
    frame = spark.createDataFrame(rows, "word string, n long").repartition(5)
    assert {tuple(r) for r in spelling.variant_groups(frame).collect()} == plain_groups(counts)
    assert spelling.variant_groups(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.variant_groups(frame, ratio=1)


def test_signatures_lose_no_pair(spark):
    """All words at distance one of random words over a small alphabet."""
    import numpy as np

    generator = np.random.default_rng(7)
    words = {"".join(generator.choice(list("abcdeé"), int(generator.integers(6, 9)))) for _ in range(700)}
    counts = {w: int(generator.integers(5, 200)) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.variant_groups(frame).collect()} == plain_groups(counts)
