"""Boosted trees on samples with a known answer: folds, importances, artifacts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ml


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        d = datetime.date(2020, 1, 1) + datetime.timedelta(days=i // 6)
        rows.append((f"T{i % 6}", d, x, z if i % 9 else None, 1.0, (0.1 if x > 0 else -0.1)))
    return spark.createDataFrame(rows, "ticker string, d date, signal double, noise double, same double, rel double").persist()


def test_folds_are_trained_on_earlier_days_only(spark, samples):
    got = {r["fold"]: r for r in ml.validate(samples, ["signal", "noise"], most_trees=8).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert [got[k]["n_test"] for k in range(1, 6)] == [204, 198, 198, 198, 198] and all(got[k]["n_train"] < got[k + 1]["n_train"] for k in range(1, 5))
    assert got[0]["accuracy"] > 0.95 and got[0]["auc"] > 0.95
    assert got[0]["accuracy"] == pytest.approx(sum(got[k]["accuracy"] for k in range(1, 6)) / 5)


def test_without_a_signal_there_is_no_skill(spark, samples):
    mean = ml.validate(samples, ["noise"], most_trees=8).where("fold = 0").first()
    assert abs(mean["auc"] - 0.5) < 0.1
    one_label = samples.withColumn("rel", F.lit(0.1))
    assert ml.validate(one_label, ["signal"], most_trees=2).where("fold = 0").first()["auc"] is None


def test_importances_and_usable_features(samples):
    assert ml.usable(samples, ["signal", "noise", "same"]) == ["signal", "noise"]
    found = ml.importances(samples, ["signal", "noise"], most_trees=8)
    assert found["signal"] > 0.3 and abs(found["noise"]) < 0.1


def test_a_saved_model_predicts_the_same(spark, samples, tmp_path):
    artifact = ml.train(samples, ["signal", "noise", "same"], label="up", most_trees=8)
    assert artifact.features == ["signal", "noise"] and artifact.metrics["accuracy"] > 0.95 and artifact.importances["signal"] > 0.3
    ml.save(artifact, str(tmp_path / "a"))
    again = ml.load(spark, str(tmp_path / "a"), ["signal", "noise", "more"])
    assert (again.features, again.metrics, again.importances, again.label) == (artifact.features, artifact.metrics, artifact.importances, "up")
    rows = samples.drop("rel")
    told = ml.predict(again, rows)
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, ml.predict(artifact, rows).collect()))
    right = told.join(samples, ["ticker", "d"]).agg(F.avg(((F.col("prediction") == "outperform") == (F.col("signal") > 0)).cast("double"))).first()[0]
    assert right > 0.95
    assert ml.load(spark, str(tmp_path / "a"), ["signal"]) is None and ml.load(spark, str(tmp_path / "none"), ["signal"]) is None
