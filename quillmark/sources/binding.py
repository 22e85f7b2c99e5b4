"""Binding of a table's columns to roles, and the checks that a bound table must pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from quillmark.functions.stats import missing

#: Names that may mean a role; where several are present the role must be named.
TARGETS, PREDICTIONS = ("target", "label", "y", "y_true"), ("prediction", "pred", "y_pred", "probability", "score")


@dataclass(frozen=True)
class Binding:
    """Which column plays which role."""

    sample_id: str = "sample_id"
    target: str = "target"
    predictions: tuple[str, ...] = ("prediction",)
    task: str = "regression"
    labels: tuple[str, ...] = ()
    slices: tuple[str, ...] = field(default=())

    def __post_init__(self):
        named = [self.sample_id, self.target, *self.predictions]
        if len(set(named)) != len(named):
            raise ValueError("target, prediction and id must be different columns")
        if self.task not in ("regression", "binary", "multiclass"):
            raise ValueError(f"unknown task: {self.task}")
        if self.task == "multiclass" and len(self.labels) != len(self.predictions):
            raise ValueError("multiclass predictions need one label each, in order")

    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.sample_id, self.target, *self.predictions, *self.slices]))


def bind(columns: list[str], target: str | None = None, prediction: str | None = None, sample_id: str = "sample_id") -> Binding:
    """A binding by convention; refuses to choose among several candidates."""
    if len(set(columns)) != len(columns):
        raise ValueError("column names must be unique")

    def choose(given, names, role):
        if given:
            if given not in columns:
                raise ValueError(f"{role} column {given} is absent")
            return given
        found = [c for c in names if c in columns]
        if len(found) != 1:
            raise ValueError(f"name the {role} column; candidates: {found}")
        return found[0]

    if sample_id not in columns:
        raise ValueError(f"id column {sample_id} is absent")
    return Binding(sample_id, choose(target, TARGETS, "target"), (choose(prediction, PREDICTIONS, "prediction"),))


def read_csv(spark: SparkSession, path: str, binding: Binding, strings: tuple[str, ...] = ()) -> DataFrame:
    """A prediction CSV with ids, labels, slices and ``strings`` kept as text and scores as doubles; only bound columns are read."""
    header = spark.read.option("header", True).csv(path).columns
    absent = [c for c in binding.columns() if c not in header]
    if absent:
        raise ValueError(f"columns are absent: {absent}")
    numbers = {*binding.predictions, *([binding.target] if binding.task == "regression" else [])}
    schema = StructType([StructField(c, DoubleType() if c in numbers else StringType()) for c in header])
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path).select(*dict.fromkeys([*binding.columns(), *strings]))


def client_directory(spark: SparkSession, path: str, binding: Binding) -> DataFrame:
    """A folder of CSV files, one client each, with client_id from the file's name; unreadable numbers are an error, as is a folder without files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = [str(f.getPath().getName()) for f in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)]
    if not any(f.endswith(".csv") for f in files):
        raise ValueError(f"no CSV files in {path}")
    numbers = {*binding.predictions, *([binding.target] if binding.task == "regression" else [])}
    header = spark.read.option("header", True).option("pathGlobFilter", "*.csv").csv(path).columns
    schema = StructType([StructField(c, DoubleType() if c in numbers else StringType()) for c in header])
    return spark.read.option("header", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.csv").schema(schema).csv(path).select("*", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.csv$", "").alias("client_id"))


def violations(df: DataFrame, key: list[str] | None = None, numbers: list[str] | None = None, unit_interval: list[str] | None = None) -> DataFrame:
    """One row (rows, blank_ids, repeated_ids, missing, out_of_range) from one pass over the table and one over its keys."""
    kinds = dict(df.dtypes)
    flag = lambda cs: _count_any(cs)
    gone = [missing(F.col(c), kinds[c] in ("double", "float")) for c in numbers or []]
    outside = [missing(F.col(c), kinds[c] in ("double", "float")) | (F.col(c) < 0) | (F.col(c) > 1) for c in unit_interval or []]
    blank = [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in key or []]
    plain = df.agg(F.count(F.lit(1)).alias("rows"), flag(blank).alias("blank_ids"), flag(gone).alias("missing"), flag(outside).alias("out_of_range"))
    if not key:
        return plain.select("rows", "blank_ids", F.lit(0).cast("long").alias("repeated_ids"), "missing", "out_of_range")
    repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated_ids"))
    return plain.crossJoin(repeated).select("rows", "blank_ids", "repeated_ids", "missing", "out_of_range")


def _count_any(conditions: list[Column]) -> Column:
    hit = F.lit(False)
    for c in conditions:
        hit = hit | c
    return F.count_if(hit)


def validate(df: DataFrame, binding: Binding) -> DataFrame:
    """``df`` unchanged, or an error that names the first kinds of violation with up to three examples of repeated ids."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("column names must be unique")
    absent = [c for c in binding.columns() if c not in df.columns]
    if absent:
        raise ValueError(f"columns are absent: {absent}")
    unit = list(binding.predictions) if binding.task != "regression" else []
    found = violations(df, [binding.sample_id], [c for c in (binding.target, *binding.predictions)], unit).first()
    if not found["rows"]:
        raise ValueError("the table is empty")
    if found["repeated_ids"]:
        examples = [r[0] for r in df.groupBy(binding.sample_id).count().where("count > 1").orderBy(binding.sample_id).limit(3).collect()]
        raise ValueError(f"ids are repeated, such as {examples}")
    numeric = [c for c in (binding.target, *binding.predictions) if dict(df.dtypes)[c] in ("double", "float")]
    infinite = F.lit(False)
    for c in numeric:
        infinite = infinite | (F.abs(F.col(c)) == float("inf"))
    wrong = ~F.col(binding.target).cast("string").isin("0", "1", "0.0", "1.0") if binding.task == "binary" else F.lit(False)
    if binding.task == "binary" and binding.labels:
        wrong = ~F.col(binding.target).cast("string").isin(*binding.labels)
    more = df.agg(F.count_if(infinite).alias("infinite"), F.count_if(wrong).alias("wrong")).first()
    if more["infinite"]:
        raise ValueError(f"values are infinite: {more['infinite']} rows")
    if more["wrong"]:
        raise ValueError(f"binary targets must be 0 or 1, or of the two labels: {more['wrong']} rows")
    for name, text in (("blank_ids", "ids are missing"), ("missing", "targets or predictions are missing"), ("out_of_range", "scores are outside 0 to 1")):
        if found[name]:
            raise ValueError(f"{text}: {found[name]} rows")
    if binding.task == "multiclass":
        total = sum((F.col(c) for c in binding.predictions[1:]), F.col(binding.predictions[0]))
        off = df.where(F.abs(total - 1) > 1e-8 + 1e-7).limit(1).count()
        unknown = df.where(~F.col(binding.target).cast("string").isin(*binding.labels)).limit(1).count()
        if off or unknown:
            raise ValueError("probabilities don't sum to 1" if off else "targets hold undeclared labels")
    return df


def is_floating(kind) -> bool:
    return isinstance(kind, DoubleType | FloatType)
