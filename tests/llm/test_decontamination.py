"""Benchmark decontamination against a plain version."""

from __future__ import annotations

import re

import pytest
from llm import decontamination

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = re.compile(f"[^{SEPARATORS}]+")
RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_leaks(text, items, window=10):
    """Hit places and items of one text."""
    words, hit, met = plain_words(text), set(), set()
    for item, content in items:
        own = plain_words(content)
        size = min(window, len(own))
        parts = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k : k + size]) in parts:
                hit.update(range(k, k + size))
                met.add(item or "")
    return len(words), hit, sorted(met)


ITEMS = [
    ("b", "Alpha beta, gamma delta epsilon zeta; alpha"),
    ("a", "one two three four five six seven eight nine ten eleven"),
    ("a", "naïve 日本語"),
    ("c", "ONE-two three four five six seven eight nine TEN"),
    (None, "word"),
    ("d", None),
    ("e", " .,; "),
]


@pytest.fixture(scope="module")
def benchmark_rows(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id string, text string, number int")


def expected(rows):
    out = []
    for row in rows:
        n, hit, items = plain_leaks(row["text"], ITEMS)
        out.append((row["doc_id"], n, len(hit), items, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [decontamination.BROADCAST_WINDOWS, 2])
def test_odd_rows_and_blocks(odd, benchmark_rows, most):
    """Small blocks give the same result as one broadcast."""
    found = decontamination.find_leaks(odd, benchmark_rows, most_windows=most).collect()
    assert sorted(((r["row"]["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found), key=str) == expected(odd.collect())
    for r in found:
        assert [k for s in r["spans"] for k in range(s["first"], s["last"] + 1)] == sorted(plain_leaks(r["row"]["text"], ITEMS)[1])


def test_empty_tables(odd, empty, benchmark_rows):
    assert decontamination.find_leaks(empty, benchmark_rows).count() == 0
    assert decontamination.find_leaks(odd, benchmark_rows.limit(0)).where("contaminated or n_hit > 0 or size(items) > 0").count() == 0
    assert decontamination.without_spans(odd, benchmark_rows.limit(0)).exceptAll(odd).count() == 0


def test_removal(spark, odd, benchmark_rows):
    kept = decontamination.without_documents(odd, benchmark_rows)
    assert kept.columns == odd.columns
    assert sorted(map(str, kept.select("doc_id").collect())) == sorted(str(r.__class__(doc_id=r["doc_id"])) for r in odd.collect() if not plain_leaks(r["text"], ITEMS)[1])
    cut = decontamination.without_spans(odd, benchmark_rows)
    assert cut.columns == odd.columns
    wanted = []
    for row in odd.collect():
        _, hit, _ = plain_leaks(row["text"], ITEMS)
        text = row["text"]
        if hit:
            places = list(RAW_WORD.finditer(text))
            ends = [m.start() for m in places[1:]] + [len(text)]
            text = text[: places[0].start()] + "".join(text[m.start() : e] for k, (m, e) in enumerate(zip(places, ends)) if k not in hit)
        wanted.append((row["doc_id"], text))
    same = sorted(((r["doc_id"], r["text"]) for r in cut.collect()), key=str) == sorted(wanted, key=str)
    assert same  # no list of long texts in a failure


def test_many_hits_in_many_copies(spark):
    passage = " ".join(f"w{k}" for k in range(40))
    rows = [(k, f"x{k} {passage} y{k}") for k in range(500)] + [(1000, f"{passage} z " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = spark.createDataFrame([(k, f"q{k} {passage}") for k in range(50)], "item_id int, text string")
    found = {r["row"]["doc_id"]: r for r in decontamination.find_leaks(docs, items, keep_text=False).collect()}
    assert all(found[k]["n_hit"] == 40 and len(found[k]["items"]) == 50 for k in range(500))
    assert found[1000]["n_hit"] == 12000 and len(found[1000]["spans"]) == 300
