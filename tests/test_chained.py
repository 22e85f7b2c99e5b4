"""Splits that are judged as a whole."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import chained, models


def found(df):
    return {(r["section"], r["name"]): r["value"] if r["label"] is None else r["label"] for r in df.collect()}


def test_chain_of_a_perfect_model_that_knows_its_members(spark):
    rows = [("train" if i % 2 else "test", float(i), float(i) + (0.0 if i % 2 else 1.0), [float(i % 2), 1.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "part string, y double, p double, v array<double>")
    got = found(chained.evaluated_split(v, "part", "y", "p", "regression", "v", {"gap": chained.mean_gap}))
    assert got["size", "n_train"] == got["size", "n_test"] == 20
    assert got["metrics", "mae"] == got["errors", "mean_bias"] == 1.0 and got["metrics", "n"] == 20
    assert got["risk", "advantage"] == 1.0 and got["risk", "level"] == "high" and got["risk", "direction"] == "loss_le" and got["risk", "threshold"] == 0.0
    assert got["shift", "l2"] == 1.0 and got["shift", "train_density"] == 1.0 and got["shift", "test_density"] == 0.5
    assert got["attack:gap", "gap"] == 1.0 and got["attack:gap", "standardized"] == pytest.approx(2.0)


def test_chain_refuses_what_is_no_split(spark):
    v = spark.createDataFrame([("train", 0, 0.1), ("test", 1, 0.9), ("train", 1, 0.8)], "part string, y int, p double")
    assert found(chained.evaluated_split(v, "part", "y", "p", "binary"))["metrics", "accuracy"] == 1.0
    for bad in (
        v.where("part = 'train'"), v.limit(0), v.withColumn("part", F.lit(None).cast("string")), v.withColumn("part", F.lit("other")),
        v.withColumn("p", F.when(F.col("y") == 1, F.lit(float("nan"))).otherwise(F.col("p"))), v.withColumn("y", F.lit(None).cast("int")),
    ):
        with pytest.raises(ValueError):
            chained.evaluated_split(bad, "part", "y", "p", "binary")
    with pytest.raises(ValueError):
        chained.evaluated_split(v, "part", "y", "p", "ranking")


def test_columns_with_the_chains_own_names(spark):
    v = spark.createDataFrame([("test", "train", 1.0, 1.0), ("train", "test", 2.0, 4.0), ("train", "test", 2.0, 2.0)], "score string, part string, member double, loss double")
    got = found(chained.evaluated_split(v, "part", "member", "loss", "regression"))
    assert got["size", "n_test"] == 2 and got["metrics", "mae"] == 1.0


def test_attacks_give_one_row(spark):
    v = spark.createDataFrame([(True, 0.5), (False, 0.5)], "member boolean, loss double")
    assert found(chained.attacked(v, {"gap": chained.mean_gap})) == {("attack:gap", "gap"): 0.0, ("attack:gap", "standardized"): None}
    for run in (lambda d, m, x: d.select(x), lambda d, m, x: d.limit(0)):
        with pytest.raises(ValueError):
            chained.attacked(v, {"odd": run})
    with pytest.raises(ValueError):
        chained.attacked(v, {})


def test_forest_scores_of_both_parts(spark):
    v = spark.createDataFrame([(i, "C" * (1 + i % 6) + ("O" if i % 2 else "N"), i % 2) for i in range(80)], "k int, smiles string, label int")
    scores = models.forest_scores(v, "k", "smiles", "label", "binary", bits=16, trees=5)
    assert scores.groupBy("part").count().orderBy("part").collect() == [("test", 16), ("train", 64)]
    got = found(chained.evaluated_split(scores, "part", "label", "prediction", "binary", "vector"))
    assert got["metrics", "accuracy"] == 1.0 and got["size", "n_train"] == 64
    ones = models.forest_scores(v.withColumn("label", F.lit(1)), "k", "smiles", "label", "binary", bits=16, trees=5)
    assert {r["prediction"] for r in ones.collect()} == {1.0}
