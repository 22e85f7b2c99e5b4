"""Differences between a reference and a current cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions.stats import DIRECTIONS, mae, missing, ratio, rmse
from quillmark.operators.metrics import gate, unpivoted
from quillmark.operators.ordered import running


def numeric(df: DataFrame, cohort: str, column: str) -> DataFrame:
    """One row: counts, missing, means, deviations, standardized mean change and the Kolmogorov-Smirnov distance.

    ``cohort`` holds reference or current. The distance is over distinct values, whose running counts need no single task.
    """
    c = F.col(column).cast("double")
    gone = missing(c, True)
    ref, cur = F.col(cohort) == "reference", F.col(cohort) == "current"
    stats = df.agg(*(f(F.when(who & ~gone, c)).alias(f"{name}_{side}") for side, who in (("reference", ref), ("current", cur)) for name, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))),
                   *(F.count_if(who & gone).alias(f"missing_{side}") for side, who in (("reference", ref), ("current", cur))))
    counts = df.where(~gone).groupBy(c.alias("value")).agg(F.count_if(ref).alias("r"), F.count_if(cur).alias("u"))
    placed = running(counts, [], "value", ["r", "u"])
    gap = F.abs(ratio(F.col("before_r") + F.col("r"), F.col("n_reference")) - ratio(F.col("before_u") + F.col("u"), F.col("n_current")))
    distance = placed.crossJoin(stats.select("n_reference", "n_current")).agg(F.max(gap).alias("ks"))
    return stats.crossJoin(distance).select(
        F.lit(column).alias("feature"), "n_reference", "n_current", "missing_reference", "missing_current", "mean_reference", "mean_current", "std_reference", "std_current",
        ratio(F.col("mean_current") - F.col("mean_reference"), F.col("std_reference")).alias("standardized"), "ks",
    )


def categorical(df: DataFrame, cohort: str, column: str) -> DataFrame:
    """One row: missing counts, smallest observed cell and total variation distance; missing values are counted apart."""
    ref, cur = F.col(cohort) == "reference", F.col(cohort) == "current"
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count_if(ref).alias("r"), F.count_if(cur).alias("u"))
    totals = counts.agg(F.sum("r").alias("tr"), F.sum("u").alias("tu"), F.least(F.min(F.when(F.col("r") > 0, F.col("r"))), F.min(F.when(F.col("u") > 0, F.col("u")))).alias("min_cell"))
    tv = counts.crossJoin(totals).agg((F.sum(F.abs(ratio(F.col("r"), F.col("tr")) - ratio(F.col("u"), F.col("tu")))) / 2).alias("tv"))
    lost = df.agg(F.count_if(ref & F.col(column).isNull()).alias("missing_reference"), F.count_if(cur & F.col(column).isNull()).alias("missing_current"))
    return totals.crossJoin(tv).crossJoin(lost).select(F.lit(column).alias("feature"), F.col("tr").alias("n_reference"), F.col("tu").alias("n_current"), "missing_reference", "missing_current", "min_cell", "tv")


def degradation(df: DataFrame, cohort: str, y: str, p: str, columns: list[str], metric: str = "mae", least: int = 5, prevalence_threshold: float = 0.1) -> DataFrame:
    """(slice_column, slice_value, n_reference, n_current, prevalence_change, material, degradation, relative, status) of every slice in either cohort.

    Degradation is above 0 where the current cohort is worse; relative to 0 it is null. A slice in one cohort alone is new or missing.
    """
    value = {"mae": mae, "rmse": rmse}[metric]
    rows = unpivoted(df.select(cohort, y, p, *columns), columns)
    ref, cur = F.col(cohort) == "reference", F.col(cohort) == "current"
    pick = lambda who: value(F.when(who, F.col(y)), F.when(who, F.col(p)))
    cells = rows.groupBy("slice_column", "slice_value").agg(F.count_if(ref).alias("n_reference"), F.count_if(cur).alias("n_current"), pick(ref).alias("reference"), pick(cur).alias("current"))
    return degradation_of(cells, df.agg(F.count_if(ref).alias("tr"), F.count_if(cur).alias("tc")), metric, least, prevalence_threshold)


def degradation_of(cells: DataFrame, size: DataFrame, metric: str, least: int = 5, prevalence_threshold: float = 0.1) -> DataFrame:
    """``degradation`` of cells (slice_column, slice_value, n_reference, n_current, reference, current: the metric in either cohort) and one row (tr, tc) of the cohorts' sizes."""
    sign = 1.0 if DIRECTIONS[metric] == "lower_is_better" else -1.0
    change = ratio(F.col("n_current"), F.col("tc")) - ratio(F.col("n_reference"), F.col("tr"))
    status = F.when(F.col("n_reference") == 0, "new_slice").when(F.col("n_current") == 0, "missing_slice").when(F.least("n_reference", "n_current") < least, "skipped_min_slice_size").otherwise("evaluated")
    worse = F.when(F.col("status") == "evaluated", sign * (F.col("current") - F.col("reference")))
    out = cells.crossJoin(size).withColumn("status", status).withColumn("prevalence_change", change).withColumn("degradation", worse)  # size is one row
    return out.select("slice_column", "slice_value", "n_reference", "n_current", "prevalence_change", (F.abs("prevalence_change") > prevalence_threshold).alias("material"), "degradation", ratio(F.col("degradation"), F.abs("reference")).alias("relative"), "status")


def ranked(degradations: DataFrame) -> DataFrame:
    """``degradations`` with rank: the worst evaluated slice is 1; ties by slice_column and slice_value; slices that aren't evaluated have none."""
    fine = F.col("status") == "evaluated"
    order = W.partitionBy(fine).orderBy(F.desc("degradation"), "slice_column", "slice_value")  # a row for each slice, not for each row of data
    return degradations.withColumn("rank", F.when(fine, F.row_number().over(order)))


def diagnose(df: DataFrame, cohort: str, key: str, y: str, p: str, slices: list[str], numbers: Sequence[str] = (), labels: Sequence[str] = (), unit: str | None = None, independent: bool = False, metric: str = "mae", resamples: int = 1000, seed: int = 13, least: int = 5) -> dict[str, DataFrame]:
    """The whole diagnosis of two cohorts: slices (ranked degradations), numeric and categorical features, and overall (degradation, lower, upper, valid_resamples, status).

    The interval draws the units of each cohort apart; it is only given for cohorts that are declared independent and share neither rows nor units.
    """
    from quillmark.operators import resampling

    own, c = unit or key, {"mae": "sa", "rmse": "ss"}[metric]
    e = F.col(y) - F.col(p)
    units = df.groupBy(cohort, own).agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(e) if c == "sa" else e * e).alias(c))
    sums = []
    for side in ("reference", "current"):
        for x in ("n", c):
            units = units.withColumn(f"{x}_{side}", F.when(F.col(cohort) == side, F.col(x)).otherwise(F.lit(0)))
            sums.append(f"{x}_{side}")
    value = lambda side: ratio(F.col(f"{c}_{side}"), F.col(f"n_{side}")) if c == "sa" else F.sqrt(ratio(F.col(f"{c}_{side}"), F.col(f"n_{side}")))
    change = value("current") - value("reference")
    point = units.agg(*(F.sum(x).alias(x) for x in sums)).select(change.alias("degradation"))
    status = cohort_status(df, cohort, key, own, independent)
    if status == "evaluated":
        draws = resampling.replicates(units, own, resamples, seed, sums, [cohort]).select("b", change.alias("v"))
        overall = point.crossJoin(resampling.interval(draws, "v", resamples))
    else:
        overall = point.select("degradation", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"), F.lit(0).cast("long").alias("valid_resamples"), F.lit(status).alias("status"))
    out = {"slices": ranked(degradation(df, cohort, y, p, slices, metric, least)), "overall": overall}
    for name, columns, one in (("numeric", numbers, numeric), ("categorical", labels, categorical)):
        for column in columns:
            part = one(df, cohort, column)
            out[name] = out[name].union(part) if name in out else part
    return out


def cohort_status(df: DataFrame, cohort: str, key: str, unit: str, independent: bool) -> str:
    """Whether an interval of the change may be given: cohorts must be declared independent and share neither rows nor units."""
    if not independent:
        return "independence_not_declared"
    for c in (key, unit):
        shared = df.groupBy(c).agg(F.countDistinct(cohort).alias("k")).where("k > 1").limit(1)
        if shared.count():
            return "overlapping_cohorts_not_supported"
    return "evaluated"


def feature_shift(df: DataFrame, vector: str, train: str) -> DataFrame:
    """One row (l2, train_density, test_density): distance of mean vectors, and the shares of positive entries. ``train`` is a boolean column."""
    each = df.select(F.col(train).alias("t"), F.posexplode(vector).alias("pos", "x"))
    means = each.groupBy("pos").agg(*(f(F.when(who, value)).alias(f"{name}_{side}") for side, who in (("train", F.col("t")), ("test", ~F.col("t"))) for name, f, value in (("mean", F.avg, F.col("x")), ("pos", F.avg, (F.col("x") > 0).cast("double")))))
    return means.agg(F.sqrt(F.sum((F.col("mean_test") - F.col("mean_train")) * (F.col("mean_test") - F.col("mean_train")))).alias("l2"), F.avg("pos_train").alias("train_density"), F.avg("pos_test").alias("test_density"))
