"""Public benchmarks that lie on disk: pinned snapshots, alignment of predictions with them, and their scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillmark.operators import evidence, metrics
from quillmark.operators.ordered import running


@dataclass(frozen=True)
class Benchmark:
    """A pinned benchmark: its files by part with their SHA-256 digests, its task, the metric that counts, and the columns of ids and targets."""

    name: str
    task: str
    metric: str
    files: tuple[tuple[str, str], ...]
    sample_id: str = "sample_id"
    target: str = "target"


def file_digests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, sha256, length) of whole files, read by Spark wherever they are."""
    content = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return content.select("path", F.sha2("content", 256).alias("sha256"), "length")


def verified(spark: SparkSession, path: str, sha256: str) -> str:
    """``path``, if the file there has the pinned digest; raises otherwise."""
    found = file_digests(spark, path).collect()
    if len(found) != 1 or found[0]["sha256"] != sha256:
        raise ValueError(f"{path} doesn't have the pinned digest {sha256}")
    return path


def fixed_split(spark: SparkSession, folder: str, benchmark: Benchmark, columns: Sequence[str], numbers: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Each part of a benchmark of CSV files, after its digest was checked, with ``columns`` as text but for ``numbers``."""
    schema = StructType([StructField(c, DoubleType() if c in numbers else StringType()) for c in columns])
    read = spark.read.option("header", True).option("mode", "FAILFAST").schema(schema)
    return {part: read.csv(verified(spark, f"{folder}/{part}.csv", digest)) for part, digest in benchmark.files}


def zip_member(spark: SparkSession, path: str, member: str, schema: str, most: int = 256 << 20) -> DataFrame:
    """A CSV file inside a ZIP file as a table of ``schema``; the member is unpacked in a task, and refused beyond ``most`` bytes."""

    def unpack(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if archive.getinfo(member).file_size > most:
                        raise ValueError(f"{member} is larger than {most} bytes")
                    with archive.open(member) as file:
                        yield from pd.read_csv(file, chunksize=10_000)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, schema)


def selected(reference: DataFrame, where: Mapping[str, Sequence]) -> DataFrame:
    """The rows of a benchmark's metadata whose columns hold one of the given values each."""
    out = reference
    for column, values in where.items():
        out = out.where(F.col(column).isin(*values))
    return out


def check_folds(rows: DataFrame, folds: DataFrame, key: str = "sample_id", expected: int = 5) -> None:
    """Raises unless ``folds`` (fold, key) has ``expected`` folds, each row in exactly one of them, and no other ids."""
    count = folds.select("fold").distinct().count()
    cover = evidence.fold_cover(rows, folds, key).first().asDict()
    if count != expected or any(cover.values()):
        raise ValueError(f"{count} folds instead of {expected}, or ids that are {cover}")


def _matched(owner: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables by ``keys``, full outer; raises if either has repeated keys or keys that the other lacks."""
    for name, side in (("owner", owner), ("predictions", given)):
        again = side.groupBy(*keys).count().where("count > 1").orderBy(*keys).limit(3).collect()
        if again:
            raise ValueError(f"{name}: keys are repeated, such as {[tuple(r)[:-1] for r in again]}")
    left = owner.select(*(F.col(c).alias(f"__o_{c}") for c in owner.columns))
    right = given.select(*(F.col(c).alias(f"__g_{c}") for c in given.columns))
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(f"__o_{k}") == F.col(f"__g_{k}"))
    both = left.join(right, condition, "full_outer")
    bad = both.agg(F.count_if(F.col(f"__o_{keys[0]}").isNull()).alias("unknown"), F.count_if(F.col(f"__g_{keys[0]}").isNull()).alias("missing")).first()
    if bad["unknown"] or bad["missing"]:
        raise ValueError(f"predictions lack {bad['missing']} rows of the benchmark and hold {bad['unknown']} others")
    return both


def align(owner: DataFrame, given: DataFrame, keys: Sequence[str], target: str = "target", prediction: str = "prediction", tolerance: float = 0.0, lower: bool = False) -> DataFrame:
    """(keys, target, prediction) of every row of the benchmark; keys are an id, a fold and an id, or an assay and an id.

    If the predictions bring targets along, these must be the benchmark's within ``tolerance``. With ``lower``, smaller scores were better and are turned.
    """
    keys = list(keys)
    both = _matched(owner, given, keys)
    score = F.col(f"__g_{prediction}").cast("double")
    if target in given.columns:
        off = F.abs(F.col(f"__o_{target}").cast("double") - F.col(f"__g_{target}").cast("double")) > tolerance
        if wrong := both.where(off | F.col(f"__g_{target}").isNull()).limit(1).count():
            raise ValueError(f"the predictions' targets aren't the benchmark's ({wrong} or more rows)")
    if both.where(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))).limit(1).count():
        raise ValueError("predictions aren't finite")
    return both.select(*(F.col(f"__o_{k}").alias(k) for k in keys), F.col(f"__o_{target}").alias(target), (-score if lower else score).alias(prediction))


def align_positions(owner: DataFrame, given: DataFrame, order: str, target: str = "target", prediction: str = "prediction") -> DataFrame:
    """(order, target, prediction) where predictions follow the benchmark's own order, declared as such: places in the column ``order`` of either table are matched, not its values."""

    def placed(df):
        return running(df.withColumn("__one", F.lit(1).cast("long")), [], order, ["__one"]).withColumnRenamed("before___one", "__place").drop("__one")

    return align(placed(owner).select("__place", target), placed(given).select("__place", prediction), ["__place"], target, prediction).withColumnRenamed("__place", order)


def _score(rows: DataFrame, task: str, metric: str, by: list[str], target: str, prediction: str) -> DataFrame:
    """(by, n, score) of one metric."""
    if metric == "auroc":
        return metrics.auroc(rows, target, prediction, by).select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), F.col("auroc").alias("score"))
    if task == "binary":
        return metrics.binary(rows, target, prediction, by).select(*by, "n", F.col(metric).alias("score"))
    return metrics.regression(rows, target, prediction, by).select(*by, "n", F.col(metric).alias("score"))


def evaluate_split(rows: DataFrame, benchmark: Benchmark, prediction: str = "prediction") -> DataFrame:
    """One row (n, score) of aligned predictions for a fixed split."""
    return _score(rows, benchmark.task, benchmark.metric, [], benchmark.target, prediction)


def evaluate_folds(rows: DataFrame, benchmark: Benchmark, prediction: str = "prediction") -> DataFrame:
    """One row (n_folds, mean, std, min, max): every fold is scored by itself; the mean is null if any score is."""
    scores = _score(rows, benchmark.task, benchmark.metric, ["fold"], benchmark.target, prediction)
    whole = scores.agg(F.count(F.lit(1)).alias("__n"), F.count("score").alias("__fine"))
    out = evidence.fold_statistics(scores).crossJoin(whole)
    return out.select("n_folds", *(F.when(F.col("__n") == F.col("__fine"), F.col(c)).alias(c) for c in ("mean", "std", "min", "max")))


def assay_ranks(rows: DataFrame, target: str = "target", prediction: str = "prediction") -> DataFrame:
    """(assay, n, score): the rank correlation of each assay."""
    from quillmark.operators.ordered import average_rank

    ranked = rows
    for c in (target, prediction):
        ranked = ranked.join(average_rank(rows, c, ["assay"]).withColumnRenamed("rank", f"__r_{c}"), ["assay", c])
    a, b = F.col(f"__r_{target}"), F.col(f"__r_{prediction}")
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return ranked.groupBy("assay").agg(F.count(F.lit(1)).alias("n"), F.when(spread > 0, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))).alias("score"))


def evaluate_assays(rows: DataFrame, reference: DataFrame, group: str = "group", target: str = "target", prediction: str = "prediction") -> DataFrame:
    """(level, key, mean) of rank correlations: assays are averaged within the ``group`` that ``reference`` (assay, group) gives them, and groups overall."""
    return evidence.hierarchical_means(assay_ranks(rows, target, prediction).join(reference, "assay"), "assay", group, "score")
