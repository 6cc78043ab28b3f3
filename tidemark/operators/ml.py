"""Boosted trees over samples in the order of time: validation, importances, artifacts and predictions."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.sources.shared import checkpointed

MOST_TREES, SET_ASIDE = boosting.MOST_TREES, 0.15
#: Rows of a bucket within which a feature is shuffled.
SHUFFLED = 20_000


def flagged(samples: DataFrame) -> DataFrame:
    """Adds the label, and by a hash of ticker and day the rows set aside."""
    aside = F.pmod(F.xxhash64("ticker", "d"), F.lit(1000)) < int(SET_ASIDE * 1000)
    return samples.withColumns({"label": (F.col("rel") > 0).cast("double"), "aside": aside})


def role(trained_on):
    """What a row is to a model that is trained on the rows for which the condition holds."""
    return F.when(~F.coalesce(trained_on, F.lit(False)), boosting.UNUSED).when(F.col("aside"), boosting.ASIDE).otherwise(boosting.TRAIN)


def by_time(samples: DataFrame, parts: int = 6) -> DataFrame:
    """Adds part, from 1 for the oldest days."""
    days = samples.select("d").distinct().withColumn("one", F.lit(1)).withColumn("part", F.ntile(parts).over(Window.partitionBy("one").orderBy("d"))).select("d", "part")
    return samples.join(F.broadcast(days), "d")  # one row per day


def usable(samples: DataFrame, features: Iterable[str], folds: int = 5) -> list[str]:
    """The features that have two different values at least in the oldest part already, which every fold trains on."""
    counts = by_time(samples, folds + 1).where("part = 1").agg(*[F.countDistinct(f).alias(f) for f in features]).first()
    return [f for f in features if counts[f] >= 2]


def auc(scored: DataFrame, by: str) -> DataFrame:
    """(by, auc): the area under the curve of p for the label, ties counted by half; null where only one label is there.

    Rows of equal p are one line; the lines of a fold are summed up in order of p.
    """
    lines = scored.groupBy(by, "p").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
    below = F.sum("zeros").over(Window.partitionBy(by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    won = F.col("ones") * (F.coalesce(below, F.lit(0.0)) + F.col("zeros") / 2)
    return lines.withColumn("won", won).groupBy(by).agg(F.try_divide(F.sum("won"), F.sum("ones") * F.sum("zeros")).alias("auc"))


def fold_predictions(samples: DataFrame, features: list[str], folds: int = 5, most_trees: int = MOST_TREES) -> DataFrame:
    """(fold, ticker, d, label, p, n_train) of the rows of each fold's part, by a model of the days before it. All folds grow
    in the same passes over the rows."""
    rows = checkpointed(by_time(flagged(samples), folds + 1))
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    models = boosting.fit(rows, features, "label", [role(F.col("part") < k) for k in range(2, folds + 2)], most_trees)
    out = None
    for k, model in zip(range(2, folds + 2), models, strict=True):
        said = boosting.probability(model, rows.where(F.col("part") == k)).select(F.lit(k - 1).alias("fold"), "ticker", "d", "label", "p", F.lit(sum(n for part, n in sizes.items() if part < k)).cast("long").alias("n_train"))
        out = said if out is None else out.unionByName(said)
    return checkpointed(out)


def metrics(predictions: DataFrame) -> DataFrame:
    """(fold, n_train, n_test, accuracy, auc) of predictions; fold 0 has the means."""
    right = F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double"))
    each = predictions.groupBy("fold").agg(F.max("n_train").alias("n_train"), F.count("*").alias("n_test"), right.alias("accuracy"))
    each = each.join(auc(predictions, "fold"), "fold")
    mean = each.agg(F.lit(0).alias("fold"), F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"), F.avg("accuracy").alias("accuracy"), F.avg("auc").alias("auc"))
    return each.unionByName(mean)


def validate(samples: DataFrame, features: list[str], folds: int = 5, most_trees: int = MOST_TREES) -> DataFrame:
    """(fold, n_train, n_test, accuracy, auc): each fold is trained on the days before its part; fold 0 has the means.

    The area under the curve is null where only one label is there.
    """
    return metrics(fold_predictions(samples, features, folds, most_trees))


def importances(samples: DataFrame, features: list[str], most_trees: int = MOST_TREES) -> dict[str, float]:
    """How much accuracy the newest fifth of days loses when a feature is shuffled, for a model of the days before.

    Values are shuffled within buckets of rows, so no task holds a whole column.
    """
    rows = checkpointed(by_time(flagged(samples), 5))
    (model,) = boosting.fit(rows, features, "label", [role(F.col("part") < 5)], most_trees)
    test = rows.where("part = 5").select("ticker", "d", "label", *features).persist()
    buckets = max(1, test.count() // SHUFFLED)

    def accuracy(frame: DataFrame) -> float:
        return boosting.probability(model, frame).agg(F.avg(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("double"))).first()[0] or 0.0

    def shuffled(feature: str):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["ticker", "d"]).reset_index(drop=True)
            order = np.random.default_rng(len(frame)).permutation(len(frame))
            return frame.assign(**{feature: frame[feature].to_numpy()[order]})

        return run

    base, found = accuracy(test), {}
    for f in features:
        mixed = test.groupBy(F.pmod(F.xxhash64("ticker", "d"), F.lit(buckets))).applyInPandas(shuffled(f), test.schema)
        found[f] = round(base - accuracy(mixed), 5)
    test.unpersist()
    return found


@dataclass
class Artifact:
    """A fitted model with what belongs to it."""

    model: boosting.Forest
    features: list[str]
    metrics: dict[str, float | None] = field(default_factory=dict)
    importances: dict[str, float] = field(default_factory=dict)
    label: str = ""


def train(samples: DataFrame, features: list[str], *, label: str = "", report: bool = True, most_trees: int = MOST_TREES) -> Artifact:
    """A model of all samples, with the means of its folds and its importances if they are asked for."""
    features = usable(samples, features)
    said, weights = {}, {}
    if report:
        mean = validate(samples, features, most_trees=most_trees).where("fold = 0").first()
        said, weights = {"accuracy": mean["accuracy"], "auc": mean["auc"]}, importances(samples, features, most_trees)
    (model,) = boosting.fit(checkpointed(flagged(samples)), features, "label", [role(F.lit(True))], most_trees)
    return Artifact(model, features, said, weights, label)


def save(artifact: Artifact, folder: str) -> None:
    """The model, and one line of JSON with the rest."""
    spark = SparkSession.active()
    spark.createDataFrame([(artifact.model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model")
    line = json.dumps({"features": artifact.features, "metrics": artifact.metrics, "importances": artifact.importances, "label": artifact.label})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def load(spark: SparkSession, folder: str, known: Iterable[str]) -> Artifact | None:
    """What ``save`` wrote; None where there is none, or where it wants a feature that is not known."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/about")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    if not about["features"] or not set(about["features"]) <= set(known):
        return None
    return Artifact(boosting.Forest.from_json(spark.read.text(f"{folder}/model").first()[0]), about["features"], about["metrics"], about["importances"], about["label"])


def predict(artifact: Artifact, rows: DataFrame) -> DataFrame:
    """(ticker, d, prediction, probability) of each row: outperform from a half on."""
    scored = boosting.probability(artifact.model, rows)
    return scored.select("ticker", "d", F.when(F.col("p") >= 0.5, "outperform").otherwise("underperform").alias("prediction"), F.round("p", 4).alias("probability"))
