"""Task metrics, overall or by groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.stats import EPSILON, arg_max, mae, number, r2, ratio, rmse
from quillmark.operators.ordered import average_rank, quantiles, running


def regression(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """n, mae, rmse, r2 and mean, standard deviation (population), minimum and maximum of target and prediction."""
    a, b = F.col(y), F.col(p)
    summary = [f(c).alias(f"{name}_{what}") for name, c in (("target", a), ("prediction", b)) for what, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), mae(a, b).alias("mae"), rmse(a, b).alias("rmse"), r2(a, b).alias("r2"), *summary)


def spearman(df: DataFrame, y: str, p: str) -> DataFrame:
    """n and the correlation of average ranks; null below two rows or if either is constant."""
    one = average_rank(df, y).select(F.col(y), F.col("rank").alias("__ra"))
    two = average_rank(df, p).select(F.col(p), F.col("rank").alias("__rb"))
    ranked = df.select(y, p).join(one, y).join(two, p)
    fine = (F.count(F.lit(1)) >= 2) & (F.stddev_pop("__ra") > 0) & (F.stddev_pop("__rb") > 0)
    correlation = ratio(F.covar_pop("__ra", "__rb"), F.stddev_pop("__ra") * F.stddev_pop("__rb"))  # corr() raises on constants
    value = F.greatest(F.least(correlation, number(1)), number(-1))
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when(fine, value).alias("spearman"))


def auroc(df: DataFrame, y: str, score: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auroc): the chance that a positive scores above a negative, ties half; null with one class only.

    Rows first shrink to one for each distinct score.
    """
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    pos, neg = F.sum(F.when(F.col(y) == 1, w).otherwise(0)), F.sum(F.when(F.col(y) == 0, w).otherwise(0))
    grouped = df.groupBy(*by, score).agg(pos.cast("double").alias("__pos"), neg.cast("double").alias("__neg"))
    placed = running(grouped, by, score, ["__neg"])
    wins = F.sum(F.col("__pos") * (F.col("before___neg") + F.col("__neg") / 2))
    total = F.sum("__pos") * F.sum("__neg")
    return placed.groupBy(*by).agg(F.sum("__pos").cast("long").alias("n_pos"), F.sum("__neg").cast("long").alias("n_neg"), ratio(wins, total).alias("auroc"))


def with_baseline(df: DataFrame, y: str, p: str, baseline: str) -> DataFrame:
    """One row (n, mae, rmse, r2, base_mae, base_rmse, base_r2) of a candidate and a baseline in the same table, in one pass."""
    from quillmark.functions.stats import mae, r2, rmse

    target = F.col(y)
    each = [f(target, F.col(c)).alias(f"{prefix}{name}") for prefix, c in (("", p), ("base_", baseline)) for name, f in (("mae", mae), ("rmse", rmse), ("r2", r2))]
    return df.agg(F.count(F.lit(1)).alias("n"), *each)


def distinct_sets(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the sorted different values of each column; for columns of few values, such as labels, tasks and models."""
    return df.agg(*(F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in columns))


def binary(df: DataFrame, y: str, score: str, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """n, accuracy, f1, positive_rate and auroc of labels 0 and 1 with scores; f1 is 0 without positives on either side."""
    by = by or []
    hit, truth = (F.col(score) >= threshold).cast("int"), F.col(y)
    tp, fp, fn = (F.sum(((hit == a) & (truth == b)).cast("int")) for a, b in ((1, 1), (1, 0), (0, 1)))
    plain = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((hit == truth).cast("double")).alias("accuracy"), F.coalesce(ratio(2.0 * tp, 2.0 * tp + fp + fn), number(0)).alias("f1"),
        F.avg(truth.cast("double")).alias("positive_rate"),
    )
    area = auroc(df, y, score, by).drop("n_pos", "n_neg")
    return plain.join(area, by) if by else plain.crossJoin(area)  # one row each


def multiclass(df: DataFrame, y: str, probs: str, classes: int) -> DataFrame:
    """n, accuracy, macro_f1 (over declared classes), weighted_f1, log_loss, macro_auroc_ovr, mean_confidence and mean_entropy.

    ``y`` is a class index and ``probs`` an array in the order of the classes.
    """
    truth, p = F.col(y), F.col(probs)
    guess = arg_max(p)
    true_p = F.element_at(p, truth + 1)
    entropy = F.aggregate(p, number(0), lambda s, x: s - x * F.log(F.greatest(x, number(1e-12))))
    counts = []
    for k in range(classes):
        counts += [F.sum(((truth == k) & (guess == k)).cast("int")).alias(f"tp{k}"), F.sum((truth == k).cast("int")).alias(f"t{k}"), F.sum((guess == k).cast("int")).alias(f"g{k}")]
    base = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg((guess == truth).cast("double")).alias("accuracy"),
        F.avg(-F.log(F.greatest(F.least(true_p, number(1 - EPSILON)), number(EPSILON)))).alias("log_loss"),
        F.avg(F.array_max(p)).alias("mean_confidence"), F.min(F.array_max(p)).alias("min_confidence"), F.max(F.array_max(p)).alias("max_confidence"), F.avg(entropy).alias("mean_entropy"), *counts,
    )
    f1 = [F.coalesce(ratio(2.0 * F.col(f"tp{k}"), 1.0 * (F.col(f"t{k}") + F.col(f"g{k}"))), number(0)) for k in range(classes)]
    macro = sum(f1[1:], f1[0]) / classes
    weighted = sum((f1[k] * F.col(f"t{k}") for k in range(1, classes)), f1[0] * F.col("t0")) / F.col("n")
    by_class = df.select(truth.alias("truth"), F.posexplode(p).alias("class", "score")).select("class", "score", (F.col("truth") == F.col("class")).cast("int").alias("is"))
    areas = auroc(by_class, "is", "score", ["class"]).agg(F.when(F.count("auroc") == classes, F.avg("auroc")).alias("macro_auroc_ovr"))
    out = base.select("n", "accuracy", macro.alias("macro_f1"), weighted.alias("weighted_f1"), "log_loss", "mean_confidence", "min_confidence", "max_confidence", "mean_entropy")
    return out.crossJoin(areas)  # one row each


def unpivoted(df: DataFrame, slices: list[str]) -> DataFrame:
    """One row for each row and slice column, with slice_column and slice_value (``<NA>`` for null)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("slice_column"), F.coalesce(F.col(c).cast("string"), F.lit("<NA>")).alias("slice_value")) for c in slices))
    return df.withColumn("__slice", F.explode(pairs)).select("*", "__slice.slice_column", "__slice.slice_value").drop("__slice")


def gate(least: int) -> Column:
    return F.when(F.col("n") >= least, "evaluated").otherwise("skipped_min_slice_size")


def slices(df: DataFrame, y: str, p: str, columns: list[str], least: int = 5) -> DataFrame:
    """(slice_column, slice_value, n, status, mae, rmse, r2): each slice column on its own, metrics null below ``least`` rows."""
    out = regression(unpivoted(df.select(y, p, *columns), columns), y, p, ["slice_column", "slice_value"]).withColumn("status", gate(least))
    return out.select("slice_column", "slice_value", "n", "status", *(F.when(F.col("status") == "evaluated", F.col(m)).alias(m) for m in ("mae", "rmse", "r2")))


def slice_auroc(df: DataFrame, y: str, score: str, columns: list[str], least: int = 5) -> DataFrame:
    """(slice_column, slice_value, n, status, auroc)."""
    out = auroc(unpivoted(df.select(y, score, *columns), columns), y, score, ["slice_column", "slice_value"]).withColumn("n", F.col("n_pos") + F.col("n_neg"))
    out = out.withColumn("status", gate(least))
    return out.select("slice_column", "slice_value", "n", "status", F.when(F.col("status") == "evaluated", F.col("auroc")).alias("auroc"))


def colliding_slices(df: DataFrame, columns: list[str]) -> DataFrame:
    """(slice_column, labels, values): columns in which different values have the same label, which callers refuse."""
    parts = [
        df.agg(F.lit(c).alias("slice_column"), F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("<NA>"))).alias("labels"), (F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias("values"))
        for c in columns
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.where("labels <> values")


def error_slices_regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """Errors by target quartile, the 90th percentile of errors and the share at or above it, biases, and the share of predictions three deviations from their mean."""
    e = df.select(F.col(y).alias("y"), F.col(p).alias("p"), (F.col(p) - F.col(y)).alias("d"), F.abs(F.col(p) - F.col(y)).alias("a"))
    cut = e.agg(F.stddev_pop("p").alias("sd"), F.avg("p").alias("centre"), F.avg("d").alias("mean")).crossJoin(quantiles(e, {"q1": ("y", 0.25), "q3": ("y", 0.75), "p90": ("a", 0.9), "med": ("d", 0.5)}))  # one row each
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    return e.crossJoin(cut).agg(
        F.avg(F.when(F.col("y") <= F.col("q1"), F.col("a"))).alias("low_target_mae"), F.avg(F.when(F.col("y") >= F.col("q3"), F.col("a"))).alias("high_target_mae"),
        F.max("p90").alias("large_error_threshold"), F.avg((F.col("a") >= F.col("p90")).cast("double")).alias("large_error_fraction"),
        F.max("mean").alias("mean_bias"), F.max("med").alias("median_bias"), F.avg((F.abs(F.col("p") - F.col("centre")) >= 3 * sd).cast("double")).alias("outlier_fraction"),
    )


def error_slices_binary(df: DataFrame, y: str, score: str) -> DataFrame:
    """Error rates overall and by class, confident errors, mean scores by class and bias; 0 for an empty class."""
    truth, s = F.col(y), F.col(score)
    wrong = ((s >= 0.5).cast("int") != truth).cast("double")
    confident = F.greatest(s, 1 - s) >= 0.8
    zero = lambda c: F.coalesce(c, number(0))
    return df.agg(
        F.avg(wrong).alias("error_rate"), zero(F.avg(F.when(truth == 1, wrong))).alias("positive_error_rate"), zero(F.avg(F.when(truth == 0, wrong))).alias("negative_error_rate"),
        F.avg(F.when(confident, wrong).otherwise(0.0)).alias("high_confidence_error_rate"), zero(F.avg(F.when(truth == 1, s))).alias("mean_score_positive"),
        zero(F.avg(F.when(truth == 0, s))).alias("mean_score_negative"), (F.avg(s) - F.avg(truth.cast("double"))).alias("bias"),
    )
