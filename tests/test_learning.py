"""Features, neighbours, oversampling, training and the whole bootstrap run."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tests.conftest import COMPLETE
from visitgauge.operators import features, neighbours
from visitgauge.operators.features import FeatureModel, fit_features, numeric_statistics, value_counts
from visitgauge.operators.neighbours import nearest_in_class
from visitgauge.operators.oversample import oversample
from visitgauge.plans import audit as audit_plan
from visitgauge.plans import fairness as fairness_plan
from visitgauge.plans import scoring, training
from visitgauge.schema import CATEGORICAL_FEATURES, FEATURES, NUMERIC_FEATURES, SEVERITIES
from visitgauge.sources import artifacts


def feature_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(200):
        age = None if i % 9 == 0 else float(rng.integers(0, 100))
        codes = [None if i % 11 == c else float(rng.integers(1, 5)) for c in range(5)]
        group = [None, "18-29", "60+"][i % 3]
        items = [float(rng.integers(0, 4)) for _ in range(9)]
        rows.append([age, *codes, group, *items])
    kinds = ", ".join(f"{c} {'string' if c == 'AGE_GROUP' else 'double'}" for c in FEATURES)
    return spark.createDataFrame(rows, kinds)


def test_statistics_equal_numpy(spark):
    df = feature_rows(spark)
    stats = {r["column"]: r for r in numeric_statistics(value_counts(df)).collect()}
    for name in NUMERIC_FEATURES:
        x = np.array([r[name] if r[name] is not None else np.nan for r in df.select(name).collect()])
        median = np.nanmedian(x)
        full = np.where(np.isnan(x), median, x)
        assert stats[name]["median"] == median
        assert stats[name]["mean"] == pytest.approx(full.mean(), rel=1e-12)
        assert stats[name]["std"] == pytest.approx(full.std(), rel=1e-12)


def test_medians_of_free_numbers(spark):
    rng = np.random.default_rng(11)
    columns = {
        "even": rng.normal(0, 1e6, 1000), "odd": rng.lognormal(0, 3, 1001), "hot": np.r_[np.full(700, 3.25), rng.normal(0, 1, 300)],
        "two": np.array([1.5, -7.5]), "one": np.array([4.0]), "wide": np.array([-1.7e308, 1.7e308, 5e-324, 0.0]),
    }
    rows = [(name, float(x), 1) for name, values in columns.items() for x in values] + [("odd", None, 5)]
    counts = spark.createDataFrame(rows, "column string, number double, n bigint").repartition(6)
    for bins in (1024, 32):
        assert features.medians(counts, bins) == {name: np.median(values) for name, values in columns.items()}


def test_very_many_categories_encode_and_train(spark):
    """100,000 categories, and one unknown, in sparse vectors; the dense columns are never made."""
    many = 100_000
    rows = spark.range(many + 4_000).select(
        *[((F.col("id") % 90) if c == "RIDAGEYR" else (F.col("id") % 4)).cast("double").alias(c) for c in NUMERIC_FEATURES],
        *[(F.concat(F.lit("code "), (F.col("id") % many).cast("string")) if c == "RIDRETH1" else (F.col("id") % 3).cast("string")).alias(c)
          for c in CATEGORICAL_FEATURES],
        F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("label"),
    )
    model = fit_features(rows)
    assert model.sizes["RIDRETH1"] == many and "categories" not in model.__dict__
    places = model.index.where("column = 'RIDRETH1'")
    assert places.select("place").distinct().count() == many
    assert places.orderBy("place").first()["category"] == "code 0"
    encoded = model.encode(rows, ["label", "RIDRETH1"])
    row = encoded.where("RIDRETH1 = 'code 77'").first()["features"]
    assert row.size == model.width == len(NUMERIC_FEATURES) + many + 3 * (len(CATEGORICAL_FEATURES) - 1)
    at = len(NUMERIC_FEATURES) + sum(model.sizes[c] for c in CATEGORICAL_FEATURES[: CATEGORICAL_FEATURES.index("RIDRETH1")])
    place = places.where("category = 'code 77'").first()["place"]
    assert row[at + place - 1] == 1.0 and sum(row.toArray()[at : at + many]) == 1.0
    unknown = model.encode(rows.limit(1).withColumn("RIDRETH1", F.lit("nothing known")), []).first()["features"]
    assert sum(unknown.toArray()[at : at + many]) == 0.0
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    indexed = StringIndexer(inputCol="label", outputCol="y").fit(encoded).transform(encoded)
    assert LogisticRegression(labelCol="y", maxIter=3).fit(indexed).numFeatures == model.width


def test_encoding(spark, tmp_path):
    df = feature_rows(spark)
    model = fit_features(df)
    model.save(spark, str(tmp_path / "features"))
    assert FeatureModel.load(spark, str(tmp_path / "features")) == model
    assert model.feature_names[:2] == ["num__RIDAGEYR", "num__DPQ010"]
    assert "cat__RIAGENDR_1" in model.feature_names and "cat__AGE_GROUP_60+" in model.feature_names
    odd = df.limit(1).withColumns({"RIAGENDR": F.lit(77.0), "RIDRETH1": F.lit(None).cast("double")})
    row = model.transform(odd, []).first().asDict()
    assert sum(v for k, v in row.items() if k.startswith("cat__RIAGENDR_")) == 0.0
    assert row[f"cat__RIDRETH1_{model.fills['RIDRETH1']}"] == 1.0
    vectors = model.encode(df, ["RIDAGEYR"]).select("features").collect()
    dense = model.transform(df, []).collect()
    assert sorted(tuple(r["features"].toArray()) for r in vectors) == sorted(map(tuple, dense))
    with pytest.raises(ValueError, match="missing required columns"):
        model.transform(df.drop("DPQ010"), [])


def coded_points(n: int, seed: int = 1) -> np.ndarray:
    """Distinct vectors of nine answers, an age and indicator columns of six codes."""
    rng = np.random.default_rng(seed)
    answers = rng.choice(4, (n, 9), p=[0.5, 0.25, 0.15, 0.1])
    codes = [np.eye(m)[rng.integers(0, m, n)] for m in (2, 5, 12, 5, 6, 6)]
    return np.unique(np.hstack([answers, rng.integers(12, 80, (n, 1)) / 10, *codes]), axis=0)


def plain_neighbours(x: np.ndarray, label: list[str], k: int) -> dict[int, list[int]]:
    found = {}
    for i in range(len(x)):
        others = [j for j in range(len(x)) if j != i and label[j] == label[i]]
        found[i] = sorted(others, key=lambda j: (np.sqrt(((x[i] - x[j]) ** 2).sum()), j))[:k]
    return found


def point_frame(spark, x, label):
    rows = [(label[i], i, [float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, "label string, vid bigint, x array<double>").repartition(4)


@pytest.mark.parametrize(("leaf", "block", "sample"), [(4096, 4096, 4096), (6, 5, 30), (16, 4096, 4096)])
def test_neighbours_equal_brute_force(spark, leaf, block, sample):
    """One leaf for each class, many small leaves of a small sample, and code-like gaps with ties."""
    x = coded_points(300)
    label = ["a" if i % 3 else "b" for i in range(len(x))]
    label[0] = "alone"
    found = {}
    for r in nearest_in_class(point_frame(spark, x, label), 4, "label", leaf, block, sample).collect():
        found.setdefault(r["vid"], {})[r["rank"]] = r["neighbour"]
    for i, others in plain_neighbours(x, label, 4).items():
        assert [found.get(i, {}).get(rank) for rank in range(1, 5)] == (others or [None] * 4)


def test_leaves_farther_than_the_bound_are_not_visited(spark):
    """Boxes rule out most of the pairs on coded answers, more of them on more rows."""
    shares = []
    for n in (1_000, 8_000):
        x = coded_points(n)
        tree = neighbours._tree(x, 64)
        leaf = tree.leaves(x)
        many = leaf.max() + 1
        low = np.stack([x[leaf == k].min(0) for k in range(many)])
        high = np.stack([x[leaf == k].max(0) for k in range(many)])
        boxes = neighbours.Boxes(np.bincount(leaf), low, high)
        asked = x[:: max(1, n // 200)]
        apart = np.sort(((asked[:, None, :] - x) ** 2).sum(2), axis=1)[:, 5]
        visited = boxes.squared_bounds(asked) <= apart[:, None]
        shares.append(float((visited * boxes.rows).sum() / (len(asked) * n)))
    # Independent codes are the hardest case: 0.98 and 0.75 of the rows here.
    assert shares[1] < shares[0] / 1.2 and shares[1] < 0.85


def test_oversampling_reaches_the_largest_class(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "big", float(rng.normal()), float(rng.normal())) for i in range(90)]
    rows += [(100 + i, "small", float(5 + i % 3), 1.0) for i in range(7)]
    # All rows of one class equal: its synthetic rows equal them too.
    rows += [(200 + i, "same", 9.0, 9.0) for i in range(8)]
    df = spark.createDataFrame(rows, "SEQN bigint, SEVERITY string, a double, b double")
    full = oversample(df, ["a", "b"]).collect()
    counts = {name: sum(r["SEVERITY"] == name for r in full) for name in ("big", "small", "same")}
    assert counts == {"big": 90, "small": 90, "same": 90}
    made = [r for r in full if r["synthetic"]]
    assert all((r["a"], r["b"]) == (9.0, 9.0) for r in made if r["SEVERITY"] == "same")
    assert all(5.0 <= r["a"] <= 7.0 and r["b"] == 1.0 for r in made if r["SEVERITY"] == "small")
    again = oversample(df.repartition(5), ["a", "b"], copies_per_row=3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, full))


def test_oversampling_is_skipped_for_single_rows(spark):
    df = spark.createDataFrame(
        [(1, "a", 0.0), (2, "a", 1.0), (3, "b", 2.0)], "SEQN bigint, SEVERITY string, x double"
    )
    assert oversample(df, ["x"]).count() == 3


@pytest.fixture(scope="module")
def built(spark, survey_files, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("built"))
    paths = fairness_plan.bootstrap(
        spark, survey_files["demographic"], survey_files["questionnaire"], folder,
        test_size=0.25, trees=10,
    )
    return paths


def test_bootstrap_writes_everything(spark, built):
    train, test = spark.read.parquet(built["train_raw"]), spark.read.parquet(built["test_raw"])
    assert (train.count(), test.count()) == (45, 15)
    both = train.unionByName(test)
    assert {r[0] for r in both.select("SEVERITY").distinct().collect()} == set(SEVERITIES)
    a, b, names = artifacts.read_split(spark, built["train"], built["test"])
    assert set(a.columns) == {*names, "SEVERITY", "SEQN"} and b.count() == 15
    with pytest.raises(FileNotFoundError, match="Processed train/test files are missing"):
        artifacts.read_split(spark, "/nowhere/train", built["test"])


def test_training_oversamples_every_class_unless_told_otherwise(spark, built):
    train, test, names = artifacts.read_split(spark, built["train"], built["test"])
    counts = {r["SEVERITY"]: r["count"] for r in train.groupBy("SEVERITY").count().collect()}
    largest = max(counts.values()) * len(counts)
    assert training.TrainedModel.load(spark, built["model"]).metrics["train_size"] == largest
    _, compared = training.train_models(train, test, names, trees=2, oversampled=False)
    assert {r["train_size"] for r in compared.collect()} == {sum(counts.values())}
    uneven = train.where("SEVERITY != 'Severe'").unionByName(train.where("SEVERITY = 'Severe'").limit(2))
    _, size = training.fit_candidates(uneven, names, trees=2)
    assert size == largest


def test_fairness_of_the_trained_model(spark, built):
    report = artifacts.read_fairness_report(spark, built["fairness_report"])
    rows = report.collect()
    assert {r["group_column"] for r in rows} == {"RIAGENDR", "AGE_GROUP", "RIDRETH1", "INDHHIN2"}
    assert {r["fairness_flag"] for r in rows} == {"Low Sample Size"}
    assert len(report.columns) == 25


def test_model_round_trip(spark, built, tmp_path):
    model = training.TrainedModel.load(spark, built["model"])
    assert model.labels == sorted(SEVERITIES) and model.metrics["train_size"] == 45
    assert len(model.metrics["confusion_matrix"]) == 5
    test = spark.read.parquet(built["test"])
    for r in model.predict_proba(test).collect():
        assert r["y_pred"] in model.labels
        assert sum(r["class_probabilities"]) == pytest.approx(1.0)
    with pytest.raises(FileNotFoundError, match="Model file not found"):
        training.TrainedModel.load(spark, str(tmp_path / "none"))
    spark.createDataFrame([('{"labels": []}',)], "value string").write.text(
        str(tmp_path / "half/description")
    )
    with pytest.raises(ValueError, match="does not contain a classifier"):
        training.TrainedModel.load(spark, str(tmp_path / "half"))


def test_unseen_test_label_is_an_error(spark, built):
    test = spark.read.parquet(built["test"])
    odd = test.withColumn("SEVERITY", F.lit("Unheard"))
    with pytest.raises(Exception, match="previously unseen labels"):
        training.fit_labels_check(odd, sorted(SEVERITIES)).collect()


def test_boundary_checks_follow_the_rule(spark, built):
    model = training.TrainedModel.load(spark, built["model"])
    fitted = FeatureModel.load(spark, built["preprocessor"])
    rows = scoring.boundary_checks(spark, model, fitted).collect()
    assert [(r["phq9_total"], r["predicted_severity"]) for r in rows] == [
        (0, "Minimal"), (5, "Mild"), (10, "Moderate"), (15, "Moderately Severe"),
        (20, "Severe"), (27, "Severe"),
    ]
    assert all(r["matches_expected"] and 0 <= r["risk_percentage"] <= 100 for r in rows)


def test_batch_scoring(spark, built):
    model = training.TrainedModel.load(spark, built["model"])
    fitted = FeatureModel.load(spark, built["preprocessor"])
    summary = fairness_plan.stored_summary(spark, built["fairness_report"])
    asked = scoring.boundary_requests(spark).withColumn("patient_name", F.lit("Noor Winter"))
    rows = scoring.score_batch(asked, model, fitted, summary).collect()
    assert len(rows) == 6
    for r in rows:
        assert r["patient_id"].startswith("MHQ-NOOR-WINTER-")
        assert r["input_data"]["patient_id"] == r["patient_id"]
        assert r["risk_score"] == max(r["probabilities"].values())
        assert r["risk_percentage"] == pytest.approx(r["risk_score"] * 100, abs=0.05)
        assert r["model_agreement"] == (r["model_predicted_severity"] == r["predicted_severity"])
        assert r["input_data"]["AGE_GROUP"] == "30-44"
    assert len({r["patient_id"] for r in rows}) == 1
    assert fairness_plan.stored_summary(spark, "/nowhere/report") is None


def test_refused_codes_in_scoring(spark, built):
    model = training.TrainedModel.load(spark, built["model"])
    fitted = FeatureModel.load(spark, built["preprocessor"])
    asked = scoring.with_identity(
        scoring.boundary_requests(spark, (27,)).withColumn("INDHHIN2", F.lit(77))
    )
    kept = scoring.with_model_estimate(asked, model, fitted)
    cleaned = scoring.with_model_estimate(asked, model, fitted, clean=True)
    assert kept.count() == cleaned.count() == 1
    wide = fitted.transform(asked, []).first().asDict()
    assert sum(v for k, v in wide.items() if k.startswith("cat__INDHHIN2_")) == 0.0


def test_audit(spark, survey_files, built, tmp_path):
    out = str(tmp_path / "audit")
    row = audit_plan.audit(
        spark, survey_files["demographic"], survey_files["questionnaire"], built, out
    ).first()
    usage = row["raw_csv_usage"]
    assert (usage["demographic_rows"], usage["questionnaire_rows"], usage["merged_valid_rows"]) == (
        COMPLETE + 4, COMPLETE + 4, COMPLETE
    )
    assert row["phq_cleaning"]["cells"]["observed_invalid_values"] == "7.0,9.0"
    assert row["train_test_split"]["leakage"]["duplicate_key_count"] == 0
    assert row["sample_prediction_summary"]["sample_count"] == 6
    assert [c["phq9_total"] for c in row["sample_prediction_checks"]] == [0, 5, 10, 15, 20, 27]
    assert all(a["exists"] and len(a["sha256"]) == 64 for a in row["artifacts"])
    text = "".join(p.read_text() for p in Path(out).glob("part-*"))
    assert json.loads(text)["features"]["leakage_caveat"]


def test_manifest_of_missing_and_single_files(spark, survey_files):
    import hashlib

    paths = {"there": survey_files["demographic"], "gone": "/nowhere/x"}
    rows = {r["artifact"]: r for r in artifacts.artifact_manifest(spark, paths).collect()}
    content = Path(survey_files["demographic"]).read_bytes()
    assert rows["there"]["sha256"] == hashlib.sha256(content).hexdigest()
    assert rows["there"]["size_bytes"] == len(content) and not rows["gone"]["exists"]


def test_manifest_of_large_files_and_many_files(spark, tmp_path):
    """A file above 2 GB (sparse) is hashed in parts; groups of files give a hash of hashes."""
    import hashlib

    large = tmp_path / "large file%.bin"
    with large.open("wb") as file:
        file.write(b"begin")
        file.truncate((2 << 30) + 4096)
    folder = tmp_path / "folder"
    folder.mkdir()
    for k in range(7):
        (folder / f"part-{k}").write_bytes(bytes([k]) * (k * 700 + 1))
    paths = {"large": str(large), "folder": str(folder)}
    rows = {r["artifact"]: r for r in artifacts.artifact_manifest(spark, paths, whole_bytes=2000, group=3).collect()}
    with large.open("rb") as file:
        assert rows["large"]["sha256"] == hashlib.file_digest(file, "sha256").hexdigest()
    assert rows["large"]["size_bytes"] == (2 << 30) + 4096
    each = [hashlib.sha256(bytes([k]) * (k * 700 + 1)).hexdigest() for k in range(7)]
    groups = [hashlib.sha256("".join(each[k : k + 3]).encode()).hexdigest() for k in (0, 3)] + [each[6]]
    assert rows["folder"]["sha256"] == hashlib.sha256("".join(groups).encode()).hexdigest()
    assert rows["folder"]["size_bytes"] == sum(k * 700 + 1 for k in range(7))
    whole = artifacts.artifact_manifest(spark, {"folder": str(folder)}).first()
    assert whole["sha256"] == hashlib.sha256("".join(each).encode()).hexdigest()


def test_boosted_trees_compete_with_probabilities(spark, built, tmp_path):
    """Through the real path: fitted as a candidate, stored, read back, and used in batch scoring."""
    train, test, names = artifacts.read_split(spark, built["train"], built["test"])
    models, _ = training.fit_candidates(train, names, trees=2, boosted=True, rounds=3)
    assert [m.model_type for m in models] == [training.LOGISTIC, training.FOREST, training.BOOSTED]
    model = models[-1]
    assert model.gives_probabilities and len(model.curves) == len(model.labels)
    model.save(spark, str(tmp_path / "boosted"))
    again = training.TrainedModel.load(spark, str(tmp_path / "boosted"))
    rows = again.predict_proba(test).select("y_pred", "class_probabilities").collect()
    assert len(rows) == 15
    for row in rows:
        assert sum(row["class_probabilities"]) == pytest.approx(1)
        assert row["y_pred"] == model.labels[int(np.argmax(row["class_probabilities"]))]
    compared = training.compare_models(models, test).collect()
    assert {r["candidate"] for r in compared} == {m.model_type for m in models}
    fitted = FeatureModel.load(spark, built["preprocessor"])
    scored = scoring.score_batch(scoring.boundary_requests(spark), again, fitted).collect()
    assert all(sum(r["probabilities"].values()) == pytest.approx(1, abs=1e-3) and r["risk_score"] > 0 for r in scored)


def test_boosted_members_write_columns_of_their_own(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense(float(k % 7), float(k)), float(k % 2)) for k in range(40)]
    fit = training.BoostedTrees(rounds=1, depth=1).fit(spark.createDataFrame(rows, ["features", "label"]))
    assert len(fit.curves) == 2
    names = [(m.getPredictionCol(), m.getRawPredictionCol(), m.getProbabilityCol()) for m in fit.members]
    assert names == [(f"prediction_{k}", f"raw_{k}", f"probability_{k}") for k in range(2)]


def test_boosted_trees_give_labels_but_no_probabilities(spark, built):
    train, test, names = artifacts.read_split(spark, built["train"], built["test"])
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=names, outputCol="features")
    prepared = assembler.transform(training.label_index(train))
    fitted = OneVsRest(classifier=GBTClassifier(maxIter=1, maxDepth=2)).fit(prepared)
    model = training.TrainedModel(
        PipelineModel([assembler, fitted]), sorted(SEVERITIES), names, training.BOOSTED
    )
    assert model.predict(test).where(F.col("y_pred").isin(*SEVERITIES)).count() == 15
    with pytest.raises(NotImplementedError, match="does not support predict_proba"):
        model.predict_proba(test)


def test_forest_rows_keep_the_share_of_a_common_answer_pattern(spark):
    assembler = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 1.0, id * 1.0) as a", "if(id % 3 = 0, 2.0, id % 7 * 1.0) as b", "if(id % 3 = 0, 0, int(id % 2)) as label"
    )
    prepared = assembler.transform(rows).select("features", "label")
    few = [(tuple(r["features"].toArray()), r["label"]) for r in training.bounded_rows(prepared, 1000).collect()]
    assert len(few) == 1000
    assert few.count(((1.0, 2.0), 0)) == pytest.approx(333, abs=1)
    assert sum(label for _, label in few) == pytest.approx(333, abs=1)
    assert training.bounded_rows(prepared, 40_000).count() == 30_000


def test_rows_travel_to_blocks_and_not_to_leaves(spark, monkeypatch):
    """A row is sent to each block that may have a nearer one, whatever the number of its leaves."""
    asked = []
    searched = neighbours._searched

    def counted(asking, *rest):
        asked.append(asking.count())
        return searched(asking, *rest)

    monkeypatch.setattr(neighbours, "_searched", counted)
    x = coded_points(2_000)
    found = nearest_in_class(point_frame(spark, x, ["a"] * len(x)), 5, "label", 16, 700).collect()
    assert len(found) == 5 * len(x)
    # Three or four blocks of up to 700 rows; most of more than 100 leaves can't be passed over.
    assert asked[0] == len(x) and asked[1] <= 3 * len(x)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_block_search_equals_all_pairs(scale):
    """Equal distances, a far offset that single precision would not bear, and bounds that are handed in."""
    rng = np.random.default_rng(4)
    x = np.unique(rng.integers(0, 4, (900, 6)).astype(float), axis=0) * scale + (scale - 1) * 1e3
    ids, leaf = rng.permutation(len(x)) * 10, rng.integers(0, 9, len(x))
    apart = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    order = np.lexsort((np.broadcast_to(ids, apart.shape), apart), axis=1)[:, :4]
    held = neighbours.Nearest(x, ids, leaf, 4)
    reach = np.full(len(x), np.inf)
    line, near, distance = held.search(x, ids, reach)
    assert line.tolist() == np.repeat(np.arange(len(x)), 4).tolist()
    assert near.tolist() == ids[order].ravel().tolist()
    assert distance.tolist() == np.take_along_axis(apart, order, 1).ravel().tolist()
    again = held.search(x, ids, reach.copy())
    assert again[1].tolist() == near.tolist()


def test_leaves_larger_than_a_block_are_dealt_into_several():
    first, many = neighbours._blocks(np.array([3, 3, 25, 0, 4, 7]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5] and many.tolist() == [1, 1, 3, 1, 1, 1]


def test_regression_of_many_rows_starts_from_a_part(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6_000, 5))
    label = np.digitize(x.sum(1) + rng.normal(scale=0.5, size=len(x)), [-1.5, 1.5])
    rows = spark.createDataFrame([(Vectors.dense(v), float(k)) for v, k in zip(x.tolist(), label.tolist())], ["features", "label"])
    estimator = training.candidates(6_000)[0][1]
    plain = training.fit_logistic(estimator, rows, 6_000, 3)
    started = training.fit_logistic(estimator, rows, 6_000, 3, start_rows=1_000)
    assert np.abs(started.coefficientMatrix.toArray() - plain.coefficientMatrix.toArray()).max() < 0.05
    assert len(started.summary.objectiveHistory) < len(plain.summary.objectiveHistory)
    assert started.summary.objectiveHistory[-1] == pytest.approx(plain.summary.objectiveHistory[-1], abs=2e-5)
