"""Models over tables: splits, custom metrics, and predictions of trusted models in tasks."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.ordered import running
from quillmark.operators.resampling import draw


class Task(Protocol):
    """A plug-in task: a run's settings to a table of evidence."""

    def __call__(self, spark, settings: Mapping) -> DataFrame: ...


class DatasetAdapter(Protocol):
    """Where a task's rows come from."""

    def load(self, spark, settings: Mapping) -> DataFrame: ...


class ModelAdapter(Protocol):
    """A model as bytes that tasks load and ask."""

    def load(self, content: bytes): ...

    def predict(self, model, features): ...


class Metric(Protocol):
    """An aggregate expression over a target and a prediction."""

    def __call__(self, y: Column, p: Column) -> Column: ...


class PrivacyAudit(Protocol):
    """Rows of members and others to a row of risk."""

    def __call__(self, df: DataFrame, member: str, loss: str) -> DataFrame: ...


class ArtifactWriter(Protocol):
    """Where a document goes."""

    def write(self, document: Mapping, path: str) -> None: ...


def split(df: DataFrame, key: str, test: float, seed: int, stratum: str | None = None, mode: str = "xxhash64") -> DataFrame:
    """``df`` with part, train or test: of each stratum the rounded share ``test`` of the rows, those of the smallest hashes of seed and key, is the test part."""
    by = [stratum] if stratum else []
    hashed = df.withColumn("__hash", draw(F.lit(1 << 60), seed, F.col(key), mode=mode)).withColumn("__one", F.lit(1).cast("long"))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    placed = running(hashed, by, "__hash", ["__one"])
    joined = placed.join(sizes, by) if by else placed.crossJoin(sizes)
    part = F.when(F.col("before___one") < F.round(F.col("__size") * test), "test").otherwise("train")
    return joined.select(*(F.col(c) for c in df.columns), part.alias("part"))


def custom(df: DataFrame, metrics: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, metrics): metrics given as aggregate expressions, all in one pass; a grouped pandas UDF is such an expression too."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(v.alias(k) for k, v in metrics.items()))


def scored(df: DataFrame, key: str, features: Sequence[str], content: bytes, load: Callable, predict: Callable, most: int = 64 << 20) -> DataFrame:
    """(key, score) of a trusted model, loaded once in each task from ``content`` (at most ``most`` bytes), asked for a batch of rows at a time. This isolates nothing: the model's code is run as it is."""
    if len(content) > most:
        raise ValueError(f"the model is larger than {most} bytes")
    shared, names = df.sparkSession.sparkContext.broadcast(content), list(features)

    def run(batches):
        model = load(shared.value)
        for batch in batches:
            yield batch[[key]].assign(score=predict(model, batch[names]))

    return df.select(key, *names).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, score double")


def _linear(model, features):
    total = model["intercept"]
    for name, (weight, centre, scale) in zip(features.columns, model["weights"]):
        total = total + weight * (features[name] - centre) / scale
    return total


#: Load and predict of a linear model as JSON: intercept, and weight, centre and scale of each feature.
LINEAR = (json.loads, _linear)


def forest_scores(df: DataFrame, key: str, smiles: str, target: str, task: str = "regression", test: float = 0.2, seed: int = 13, bits: int = 256, trees: int = 200) -> DataFrame:
    """(key, part, target, prediction, vector) of both parts: a random forest over hashed fingerprints that learns from the part train; for classes the split is stratified and both classes weigh the same.

    With a single class in training, a model of class 0 alone gives 0 for the other, and one of class 1 alone gives 1.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    from quillmark.operators.molecules import dense_fingerprint
    from quillmark.sources.scratch import kept

    parts = split(df.select(key, smiles, target), key, test, seed, target if task == "binary" else None)
    rows = kept(dense_fingerprint(parts, key, smiles, bits).withColumn("__label", F.col(target).cast("double")), "fingerprints")
    train = rows.where("part = 'train'")
    out = [F.col(key), F.col("part"), F.col(target)]
    vector = vector_to_array("features").alias("vector")
    if task == "binary":
        classes = {r["__label"]: r["count"] for r in train.groupBy("__label").count().collect()}
        if len(classes) < 2:
            return rows.select(*out, F.lit(float(next(iter(classes), 0.0))).alias("prediction"), vector)
        weight = F.when(F.col("__label") == 1, sum(classes.values()) / (2.0 * classes[1.0])).otherwise(sum(classes.values()) / (2.0 * classes[0.0]))
        model = RandomForestClassifier(featuresCol="features", labelCol="__label", weightCol="__weight", numTrees=trees, seed=seed, probabilityCol="__p").fit(train.withColumn("__weight", weight))
        return model.transform(rows).select(*out, F.get(vector_to_array("__p"), 1).alias("prediction"), vector)
    model = RandomForestRegressor(featuresCol="features", labelCol="__label", numTrees=trees, seed=seed, predictionCol="prediction").fit(train)
    return model.transform(rows).select(*out, "prediction", vector)


def baseline(df: DataFrame, key: str, smiles: str, target: str, task: str = "regression", test: float = 0.2, seed: int = 13, bits: int = 256, trees: int = 200) -> DataFrame:
    """(key, target, prediction) of the test part of ``forest_scores``."""
    return forest_scores(df, key, smiles, target, task, test, seed, bits, trees).where("part = 'test'").select(key, target, "prediction")
