"""Token counts, BPE round trips and packing against the libraries."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import bpe, packing, token_counts
from llm.queries import QUERIES
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"


@lru_cache
def loaded():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    return loaded()


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_encoded_as_the_library_does(text):
    codec = bpe.codec(bpe.default_vocabulary())
    library = loaded()
    (ids,) = codec.encode_batch([text])
    assert ids.tolist() == ids_of(library, text)
    assert codec.decode(ids.tobytes()) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_mixed_pieces_in_one_batch(library):
    parts = [" ", "  ", "\n", "\t", "'s", "'ll", "'", "a", "Éc", "³", "7", "!?", "<|endoftext|>", "日", "s", "　", "word"]
    generator = random.Random(3)
    texts = ["".join(generator.choices(parts, k=generator.randint(0, 25))) for _ in range(3000)]
    for text, ids in zip(texts, bpe.codec(bpe.default_vocabulary()).encode_batch(texts)):
        assert ids.tolist() == ids_of(library, text), text


def test_full_table_is_emptied(library):
    codec = bpe.Codec(bpe.default_vocabulary())
    codec.table = bpe.WordTable(6)
    texts = [" ".join(f"w{k}x{j}" for k in range(20)) for j in range(40)]
    for text in texts:
        assert codec.encode_batch([text])[0].tolist() == ids_of(library, text)
    assert codec.encode_batch([" ".join(texts)])[0].tolist() == ids_of(library, " ".join(texts))


def test_table_grows_with_its_words_and_ends_with_the_task(library):
    def held(table):
        return sum(x.nbytes for x in (table.keys, table.first, table.count, table.pool))

    generator = random.Random(4)
    texts = [" ".join("".join(generator.choices("abcdefghij", k=7)) for _ in range(6000)) for _ in range(12)]
    with bpe.task_codec(bpe.default_vocabulary()) as codec:
        codec.table.clear()
        for text in texts + texts:
            assert codec.encode_batch([text])[0].tolist() == ids_of(library, text)
        assert codec.table.words > 60_000 and 2 * codec.table.words <= len(codec.table.keys) < 1 << bpe.TABLE_BITS
    assert codec.table.words == 0 and held(codec.table) < 2 << 20


def test_encode_and_decode_odd_rows(spark, odd, empty, library):
    encoded = bpe.encode(odd)
    for row in bpe.decode(encoded.join(odd.select("doc_id", "text").dropDuplicates(["doc_id"]).withColumnRenamed("text", "given"), "doc_id")).collect():
        ids = np.frombuffer(row["ids"], "<u4").tolist()
        assert ids == ids_of(library, row["given"]) and len(ids) == row["n_tokens"]
        assert row["text"] == (row["given"] or "")
    assert encoded.count() == odd.count()
    assert bpe.encode(empty).count() == 0


def test_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op3_bpe"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = ids_of(library, texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_counts_of_random_texts(monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_SEGMENT", 40)
    counter = token_counts.Counter(token_counts.default_model())
    assert counter.blank_is_safe and counter.line_end_is_safe
    parts = [*"ab \n\t▁É日", "  ", "<s>", "<0x0A>", "word", "\n\n", " ▁"]
    generator = random.Random(5)
    texts = ["".join(generator.choices(parts, k=generator.randint(0, 90))) for _ in range(3000)] + [None, "", " ", "  ", "▁"]
    assert counter.count(texts) == [len(counter.model.encode(t or "")) for t in texts]


def test_token_count_query(spark, odd, empty):
    model = token_counts.Counter(token_counts.default_model()).model
    for row in QUERIES["op1_token_counts"](spark, FOLDER).join(
        spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text"), "doc_id"
    ).collect():
        assert row["n_tokens"] == len(model.encode(row["text"] or ""))
        assert row["n_bytes"] == len((row["text"] or "").encode())
        assert row["over_limit"] == (row["n_tokens"] > 4096)
    assert token_counts.count_tokens(odd).count() == odd.count()
    assert token_counts.count_tokens(empty).count() == 0


def check_packing(rows, expected):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    sequences = {}
    for row in rows:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    return len(sequences)


def expected_pieces(library, documents):
    for doc_id, text in documents:
        ids = np.array([*ids_of(library, text), 0], "<u4")
        start = 0
        for piece, (at, length) in enumerate(packing.cut(len(ids), packing.SEQUENCE)):
            assert at == start and 0 < length <= packing.SEQUENCE and (piece == 0 or length == packing.SEQUENCE)
            start += length
            yield doc_id is None, doc_id or 0, piece, at, length, zlib.crc32(ids[at : at + length].tobytes())
        assert start == len(ids)


def test_packing_odd_rows(odd, empty, library):
    rows = packing.pack_documents(odd).collect()
    check_packing(rows, expected_pieces(library, [(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert packing.pack_documents(empty).count() == 0


def test_packing_query_leaves_little_room(spark, library):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = QUERIES["op2_packing"](spark, FOLDER).collect()
    made = check_packing(rows, expected_pieces(library, documents))
    assert made <= 1.02 * sum(r["length"] for r in rows) / packing.SEQUENCE + 1


def test_few_open_bins():
    bins = packing.OpenBins(100, 3)
    generator = random.Random(1)
    used = {}
    for _ in range(2000):
        length = generator.randint(1, 100)
        number, offset = bins.place(length)
        assert used.get(number, 0) == offset
        used[number] = offset + length
        assert used[number] <= 100 and bins.open <= 3
    assert bins.made == len(used)
