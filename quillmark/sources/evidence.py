"""Readers of receipts and of public benchmark snapshots that lie on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.ordered import running
from quillmark.sources.tables import owner_table

RECEIPTS = "schema string, scope string, model struct<id: string, revision: string>, task string, protocol string, n bigint, metrics map<string, double>, intervals map<string, array<double>>, digest string"


def receipts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Receipt files as rows under a fixed schema, with the file's path; a file that isn't a receipt raises."""
    return spark.read.schema(RECEIPTS).option("multiLine", True).option("mode", "FAILFAST").json(paths).withColumn("path", F.col("_metadata.file_path"))


def evidence(found: DataFrame) -> DataFrame:
    """(model, revision, task, n, metric, estimate, lower, upper, status) from receipts, one row for each metric."""
    rows = found.select(F.col("model.id").alias("model"), F.col("model.revision").alias("revision"), "task", "n", F.explode("metrics").alias("metric", "estimate"), "intervals")
    bounds = F.try_element_at("intervals", F.col("metric"))
    return rows.select("model", "revision", "task", "n", "metric", "estimate", F.get(bounds, 0).alias("lower"), F.get(bounds, 1).alias("upper"), F.when(F.col("estimate").isNull(), "undefined").otherwise("evaluated").alias("status"))


def split_oriented(spark: SparkSession, path: str, kinds: str | None = None) -> DataFrame:
    """A JSON table in split orientation (index, columns, data), gzipped or not, with its index as sample_id.

    Spark reads the file and deals its rows out; values are text unless ``kinds`` gives a schema of the columns, to which they are cast.
    """
    raw = spark.read.schema("index array<string>, columns array<string>, data array<array<string>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    shape = raw.select("columns", F.size("index").alias("index"), F.size("data").alias("data")).collect()
    if len(shape) != 1 or shape[0]["index"] != shape[0]["data"] or len(set(shape[0]["columns"])) != len(shape[0]["columns"]):
        raise ValueError("index, data and columns don't fit together")
    rows = raw.select(F.explode(F.arrays_zip("index", "data")).alias("x"))
    fields = dict(zip(shape[0]["columns"], range(len(shape[0]["columns"]))))
    cast = {f.name: f.dataType for f in spark.createDataFrame([], kinds).schema} if kinds else {}
    return rows.select(F.col("x.index").alias("sample_id"), *(F.get(F.col("x.data"), i).cast(cast.get(c, "string")).alias(c) for c, i in fields.items()))


def folds(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(fold, sample_id) from a JSON object of fold names to lists of ids; raises unless there are ``expected`` folds."""
    raw = spark.read.schema("value string").option("wholetext", True).text(path).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    out = raw.select(F.explode("m").alias("fold", "ids")).select("fold", F.explode("ids").alias("sample_id"))
    if expected is not None and (k := out.select("fold").distinct().count()) != expected:
        raise ValueError(f"{k} folds instead of {expected}")
    return out


def assay(spark: SparkSession, path: str, name: str, mutant: str = "mutant", score: str = "DMS_score") -> DataFrame:
    """A variant table as (assay, sample_id, target) with ids made of the assay and the variant."""
    table = spark.read.option("header", True).csv(path)
    return table.select(F.lit(name).alias("assay"), F.concat_ws(":", F.lit(name), mutant).alias("sample_id"), F.col(score).cast("double").alias("target"))


def ordinal_ids(df: DataFrame, order: str, prefix: str) -> DataFrame:
    """``df`` with sample_id prefix-000000, prefix-000001 and so on, by the declared order of a fixed split; ``order`` is unique. No task holds all rows."""
    placed = running(df.withColumn("__one", F.lit(1).cast("long")), [], order, ["__one"])
    return placed.withColumn("sample_id", F.format_string(f"{prefix}-%06d", F.col("before___one"))).drop("__one", "before___one")


def template(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that a submission has to fill in."""
    return df.select(*keys, F.lit(None).cast("double").alias("prediction"))


def submission(owner: DataFrame, given: DataFrame, key: str = "sample_id", label: str = "target", prediction: str = "prediction") -> DataFrame:
    """(key, target, prediction) of a hidden benchmark; the submission must have exactly its two columns and the owner's ids."""
    if set(given.columns) != {key, prediction} or len(given.columns) != 2:
        raise ValueError(f"a submission has exactly the columns {key} and {prediction}")
    both = owner.select(F.col(key).alias("__o"), F.col(label).alias("target")).join(given.select(F.col(key).alias("__g"), F.col(prediction).cast("double").alias("prediction")), F.col("__o") == F.col("__g"), "full_outer")
    owner_table(owner, key, label)
    bad = both.agg(F.count_if(F.col("__o").isNull() | F.col("__g").isNull() | F.col("prediction").isNull() | F.isnan("prediction") | (F.abs("prediction") == float("inf"))).alias("bad"), F.count(F.lit(1)).alias("rows"), F.countDistinct("__o").alias("ids")).first()
    if bad["bad"] or bad["rows"] != bad["ids"]:
        raise ValueError("the submission doesn't cover each id once with a finite prediction")
    return both.select(F.col("__o").alias(key), "target", "prediction")
