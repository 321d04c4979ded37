"""The isolation forest against plain Python on its own trees, the choice among classifiers, and stored models."""

import math
import random

import numpy as np
import pytest

from mailstrata.operators import classifier, forest, learning, registry


def _tampered(path):
    """Other bytes in a file, without the checksum that the local file system keeps beside it."""
    path.write_bytes(path.read_bytes() + b"x")
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


def _walk(f, row):
    """The mean path length of one row, node by node."""
    total = 0.0
    for root in f.roots.tolist():
        at = root
        while f.feature[at] >= 0:
            at = int(f.left[at] if row[f.feature[at]] < f.threshold[at] else f.right[at])
        total += f.length[at]
    return total / len(f.roots)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.RandomState(4)
    x = rng.randn(600, 3)
    x[:6] += 9  # these lie apart
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    rows[50] = (50, None, 0.1, 0.2)
    return spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)


def test_forest_scores_are_those_of_its_trees(points):
    f = forest.fit(points, ["id"], ["a", "b", "c"], seed=11, trees=60)
    got = {r["id"]: r["s"] for r in points.select("id", forest.score(f).alias("s")).collect()}
    c = 2 * (math.log(255) + 0.5772156649015329) - 2 * 255 / 256
    for r in points.collect():
        row = [-1.0 if v is None else v for v in (r["a"], r["b"], r["c"])]
        assert abs(got[r["id"]] - 2 ** (-_walk(f, row) / c)) < 1e-12
    top = sorted(got, key=got.get, reverse=True)[:6]
    assert set(top) == set(range(6)) and min(got[i] for i in top) > 0.6
    again = forest.fit(points.repartition(2), ["id"], ["a", "b", "c"], seed=11, trees=60)
    assert all((getattr(f, k) == getattr(again, k)).all() for k in ("roots", "feature", "threshold", "left", "right", "length"))
    assert (forest.fit(points, ["id"], ["a", "b", "c"], seed=12, trees=60).threshold[:50] != f.threshold[:50]).any()


def test_forest_edges(spark, points):
    empty = forest.fit(points.limit(0), ["id"], ["a", "b"], seed=1)
    assert {r[0] for r in points.select(forest.score(empty)).collect()} == {0.0}
    same = forest.grow(np.ones((40, 2)), ["a", "b"], 1, trees=5)
    assert (same.feature == -1).all() and np.allclose(same.scores(np.ones((3, 2))), 2 ** -1.0)
    assert forest.mean_path(1) == 0 and forest.mean_path(2) == 1


def test_a_forest_is_stored_and_its_digests_are_checked(spark, points, tmp_path):
    f = forest.fit(points, ["id"], ["a", "b"], seed=2, trees=10)
    path = str(tmp_path / "forest")
    registry.save(forest.as_table(spark, f), spark, path, "isolation", ["a", "b"])
    registry.manifest(spark, path, "isolation", ["a", "b"])
    back = forest.from_table(spark.read.parquet(f"{path}/model"))
    x = np.random.RandomState(1).randn(50, 2)
    assert back.features == ("a", "b") and (back.scores(x) == f.scores(x)).all()
    assert registry.status(spark, path, "isolation", ["a", "b"]) == ("COMPLETED", None)
    assert registry.status(spark, path, "isolation", ["b", "a"])[0] == "MODEL_REJECTED"
    assert registry.status(spark, path, "other", ["a", "b"])[0] == "MODEL_REJECTED"
    assert registry.status(spark, str(tmp_path / "none"), "isolation", ["a"])[0] == "MODEL_UNAVAILABLE"
    assert registry.status(spark, None, "isolation", [])[0] == "MODEL_UNAVAILABLE" and registry.status(spark, path, "isolation", [], enabled=False)[0] == "DISABLED"
    _tampered(next((tmp_path / "forest" / "model").glob("*.parquet")))
    assert registry.status(spark, path, "isolation", ["a", "b"]) == ("MODEL_REJECTED", "a file was changed, added or lost")


def _samples(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        version, bits, rsa = rng.choice([0x0301, 0x0303, 0x0304]), rng.choice([1024, 2048, 4096]), rng.random() < 0.3
        label = "HIGH" if version < 0x0303 or bits < 2048 else "MODERATE" if rsa else "LOW"
        rows.append((f"s{i % 120}", float(version - 0x0300), float(bits) / 1024, float(rsa), label))
    return learning.split(spark.createDataFrame(rows, "server string, version double, bits double, rsa double, label string"), "server", "seed").cache()


def test_the_best_candidate_is_chosen_stored_and_verified(spark, tmp_path):
    rows, features = _samples(spark), ["version", "bits", "rsa"]
    assert rows.groupBy("server").agg(learning.F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    best, figures = classifier.choose(rows, features, "label")
    by = {f["model"]: f for f in figures}
    assert [f["model"] for f in figures] == classifier.CANDIDATES and sum(f["chosen"] for f in figures) == 1
    assert best.name != "dummy" and by["dummy"]["validation_f1"] < 0.4 and by[best.name]["validation_f1"] == max(f["validation_f1"] for f in figures) > 0.9
    path = str(tmp_path / "posture")
    classifier.save(spark, best, path)
    back = classifier.load(spark, path, features)
    a, b = (classifier.predict(rows, c).select("server", "version", "bits", "rsa", "predicted", "validation").collect() for c in (best, back))
    assert sorted(a) == sorted(b) and {r["validation"] for r in a} == {"NOT_VALIDATED"}
    with pytest.raises(registry.ModelRejected):
        classifier.load(spark, path, ["version"])
    _tampered(next((tmp_path / "posture" / "model" / "data").glob("*.parquet")))
    with pytest.raises(registry.ModelRejected):
        classifier.load(spark, path, features)


def test_ties_go_to_the_simplest_and_the_dummy_is_stored(spark, tmp_path):
    rows = spark.createDataFrame([(i, 1.0, "LOW", p) for i, p in enumerate(["TRAIN", "VALIDATION", "TEST"] * 6)], "i int, x double, label string, part string")
    best, figures = classifier.choose(rows, ["x"], "label")
    assert best.name == "dummy" and figures[0]["validation_f1"] == 1.0
    classifier.save(spark, best, str(tmp_path / "d"))
    assert {r["predicted"] for r in classifier.predict(rows, classifier.load(spark, str(tmp_path / "d"), ["x"])).collect()} == {"LOW"}
    with pytest.raises(ValueError):
        classifier.fit_candidates(rows.withColumn("label", learning.F.lit("OTHER")), ["x"], "label")
