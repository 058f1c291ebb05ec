"""Nearest neighbours and the pipeline."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from llm import ann, packing
from llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_nearest(vectors, query, k):
    own = vectors[query]
    scored = sorted((-float(np.dot(v, own)), i) for i, v in vectors.items() if i != query)
    return [i for _, i in scored[:k]]


def test_nearest_query_recall(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
    found = {}
    for row in QUERIES["op6_nearest"](spark, FOLDER).collect():
        found.setdefault(row["query_id"], {})[row["rank"]] = row["vec_id"]
        assert row["score"] == pytest.approx(float(vectors[row["query_id"]] @ vectors[row["vec_id"]]), rel=1e-12)
    assert set(found) == {i for i in vectors if i % 20 == 0}
    right = 0
    for query, ranks in found.items():
        assert sorted(ranks) == list(range(1, 21))
        right += len(set(ranks.values()) & set(plain_nearest(vectors, query, 20)))
    assert right / (20 * len(found)) >= 0.95


def test_nearest_recall_in_a_forest_of_many_more_leaves(spark):
    points = np.random.default_rng(5).normal(size=(4000, 32))
    frame = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<double>")
    found = ann.search(frame, frame.where("vec_id % 40 = 0"), k=10, leaf_rows=16, leaves=24).collect()
    assert len(found) == 1000
    scores = points[::40] @ points.T
    scores[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
    true = {(40 * q, int(i)) for q, best in enumerate(np.argsort(-scores, axis=1)[:, :10]) for i in best}
    # 24 of more than 3,000 leaves hold less than half of the neighbours.
    assert len(true & {(r["query_id"], r["vec_id"]) for r in found}) >= 950


def test_nearest_with_odd_vectors(spark):
    rows = [(k, [float(k % 3), 1.0]) for k in range(12)] + [
        (20, None), (21, [0.0, 0.0]), (22, [float("nan"), 1.0]), (23, [None, 1.0]), (24, [1.0]), (None, [1.0, 1.0]), (5, [2.0, 1.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(frame, frame.where("vec_id in (0, 20, 21)"), k=4).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0), (0, 4, 1.0)]
    assert ann.search(frame, frame.where("vec_id = 2"), k=50).count() == 11
    assert ann.search(frame.limit(0), frame.limit(0)).count() == 0


def test_forest_puts_every_row_in_one_leaf():
    generator = np.random.default_rng(1)
    forest = ann.Forest(5, 1)
    forest.splits[0] = {1: 0.0, 2: 0.1, 3: -0.2, 6: 0.0}
    points = generator.normal(size=(500, 5))
    leaves = forest.leaves(points, 0)
    assert set(leaves.tolist()) <= {4, 5, 7, 12, 13}
    assert all(forest.visited(p, 1) == [(0, leaf)] for p, leaf in zip(points, leaves.tolist()))
    assert len(forest.visited(points[0], 99)) == 5


def test_pipeline_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "test")
        if place < 4:
            assert docs.columns == columns
            assert docs.count() <= before
            before = docs.count()
        if place == 3:
            kept = {r["doc_id"] for r in docs.collect()}
            assert docs.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == kept
    assert docs.agg({"length": "max"}).first()[0] <= packing.SEQUENCE


def test_pipeline_on_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        docs.count()


def test_registered():
    names = registry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert names["pipeline"] is corpus_pipeline.run


def test_memory_of_a_forest_does_not_follow_the_rows_it_has_met():
    generator = np.random.default_rng(2)
    forest = ann.Forest(17, 2)
    for tree in range(2):
        forest.splits[tree] = dict(zip(range(1, 1 << 12), generator.normal(scale=0.02, size=(1 << 12) - 1).tolist()))
    points = generator.normal(size=(20_000, 17))
    forest.leaves(points[:1], 0), forest.leaves(points[:1], 1)
    before = len(pickle.dumps(forest))
    for tree in range(2):
        forest.leaves(points, tree)
    forest.visited(points[0], 500)
    assert len(pickle.dumps(forest)) == before < 200_000


def test_batches_of_visits_are_bounded(monkeypatch):
    generator = np.random.default_rng(3)
    forest = ann.Forest(5, 1)
    forest.splits[0] = dict(zip(range(1, 64), generator.normal(scale=0.1, size=63).tolist()))
    columns = {"node": range(50), "vector": generator.normal(size=(50, 4)).tolist(), "square": [1.0] * 50}
    rows = pa.RecordBatch.from_pydict({name: list(values) for name, values in columns.items()})
    whole = [tuple(r.values()) for b in ann.locate(forest, [rows], 4, 9.0, 40) for r in b.to_pylist()]
    for most in (30, 90):
        monkeypatch.setattr(ann, "BATCH_VISITS", most)
        batches = list(ann.locate(forest, [rows], 4, 9.0, 40))
        assert max(b.num_rows for b in batches) <= most
        assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == whole
    assert len(whole) == 2000


def test_recall_of_a_forest_whose_visited_leaves_are_few(spark):
    generator = np.random.default_rng(8)
    middles = generator.normal(size=(40, 16))
    points = middles[np.arange(4000) % 40] + generator.normal(scale=0.3, size=(4000, 16))
    frame = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<double>")
    found = ann.search(frame, frame.where("vec_id % 41 = 0"), k=10, leaf_rows=16, leaves=8, matrix_gain=1).collect()
    scores = points[::41] @ points.T
    scores[np.arange(98), np.arange(0, 4000, 41)] = -np.inf
    true = {(41 * q, int(i)) for q, best in enumerate(np.argsort(-scores, axis=1)[:, :10]) for i in best}
    assert len(found) == 980
    assert len(true & {(r["query_id"], r["vec_id"]) for r in found}) >= 930


def test_search_of_all_rows_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    points = np.random.default_rng(6).normal(size=(300, 8))
    frame = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<double>")
    found = ann.search(frame, frame.where("vec_id % 10 = 0"), k=5, leaf_rows=16, leaves=1000).collect()
    plain = dict(enumerate(points))
    for query in range(0, 300, 10):
        own = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == query)
        assert [i for _, i in own] == plain_nearest(plain, query, 5)
