"""Aggregates of evidence: sites, periods, models, folds and rules. These tables are small; rows of data never reach them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions.stats import DIRECTIONS, ratio

#: How a metric's site values pool; others don't.
POOLED = {"mae": "mean", "accuracy": "mean", "log_loss": "mean", "rmse": "square"}


def pooled_sites(sites: DataFrame, material: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, pooled, status, min, max, spread, relative, best_sites, worst_sites, material) from rows (site, metric, n, value) of disjoint sites.

    Means are weighted by n, rmse through squares; other metrics are not poolable and keep their range. Ties are listed, in order.
    """
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in POOLED.items() for x in pair)), F.col("metric"))
    mean = ratio(F.sum(F.col("value") * F.col("n")), F.sum("n"))
    square = F.sqrt(ratio(F.sum(F.col("value") * F.col("value") * F.col("n")), F.sum("n")))
    better = [m for m, d in DIRECTIONS.items() if d == "lower_is_better"]
    grouped = sites.groupBy(*by, "metric").agg(mean.alias("mean"), square.alias("square"), F.min("value").alias("min"), F.max("value").alias("max"), F.collect_list(F.struct("site", "value")).alias("all"))
    at = lambda c: F.array_join(F.array_sort(F.transform(F.filter("all", lambda x: x["value"] == F.col(c)), lambda x: x["site"])), ",")
    low = F.col("metric").isin(*better)
    spread = F.col("max") - F.col("min")
    return grouped.select(
        *by, "metric", F.when(kind == "mean", F.col("mean")).when(kind == "square", F.col("square")).alias("pooled"), F.when(kind.isNotNull(), "pooled").otherwise("not_poolable").alias("status"),
        "min", "max", spread.alias("spread"), ratio(spread, F.abs("min")).alias("relative"), F.when(low, at("min")).otherwise(at("max")).alias("best_sites"),
        F.when(low, at("max")).otherwise(at("min")).alias("worst_sites"), (F.lit(None).cast("boolean") if material is None else spread > material).alias("material"),
    )


def population_units(sites: DataFrame, floor: int) -> DataFrame:
    """(site, units, status) of rows (site, units): a site's receipts must agree on its independent units, and these must reach the floor."""
    per = sites.groupBy("site").agg(F.min("units").alias("units"), F.countDistinct("units").alias("k"), F.count_if(F.col("units").isNull()).alias("gone"))
    status = F.when((F.col("k") > 1) | ((F.col("k") == 1) & (F.col("gone") > 0)), "inconsistent_units").when(F.col("k") == 0, "missing_units").when(F.col("units") < floor, "below_population_floor").otherwise("evaluated")
    return per.select("site", F.when(F.col("k") == 1, F.col("units")).alias("units"), status.alias("status"))


def require(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """``receipts``, if they are verified and agree in all ``keys``; raises otherwise, as differing evaluations aren't pooled or compared."""
    found = receipts.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("verified"), F.lit(False))).alias("bad"), *(F.countDistinct(F.to_json(F.struct(k))).alias(f"k_{i}") for i, k in enumerate(keys))).first()
    if not found["n"]:
        raise ValueError("there are no receipts")
    if found["bad"]:
        raise ValueError(f"{found['bad']} receipts aren't verified")
    if differ := [k for i, k in enumerate(keys) if found[f"k_{i}"] > 1]:
        raise ValueError(f"receipts differ in {differ}")
    return receipts


def aggregated(receipts: DataFrame, metric: str, keys: Sequence[str] = ("task", "protocol", "benchmark"), approved: Mapping[str, Sequence[str]] | None = None, material: float | None = None) -> DataFrame:
    """``pooled_sites`` of each model over its sites: receipts (model, site, metric, n, value, verified, and ``keys``) are checked by ``require``, every model needs the same sites, and a site counts once.

    ``approved`` names the models and sites that may be shown; anything else is refused rather than left out.
    """
    own = require(receipts.where(F.col("metric") == metric), list(keys))
    for column, names in (approved or {}).items():
        if own.where(~F.coalesce(F.col(column).isin(*names), F.lit(False))).limit(1).count():
            raise ValueError(f"receipts hold a {column} that isn't approved")
    again = own.groupBy("model", "site").count().where("count > 1").limit(1).count()
    if again or not site_coverage(own).first()["identical"]:
        raise ValueError("a site has several receipts of a model" if again else "models don't cover the same sites")
    return pooled_sites(own, material, ["model"])


def weighted_means(clients: DataFrame) -> DataFrame:
    """(metric, value, weight): n-weighted means of (metric, n, value); a missing value leaves its own denominator, clients without rows count nothing."""
    use = F.col("value").isNotNull() & ~F.isnan("value") & (F.col("n") > 0)
    w = F.when(use, F.col("n"))
    return clients.groupBy("metric").agg(ratio(F.sum(w * F.col("value")), F.sum(w)).alias("value"), F.coalesce(F.sum(w), F.lit(0)).alias("weight"))


def trend(series: DataFrame, metric: str, threshold: float = 0.0) -> DataFrame:
    """(period, estimate, from_reference, from_previous, relative, point_change) in the given order of periods; the first is the reference.

    Changes are above 0 where the metric grew; point_change says whether that is better or worse by at least the threshold.
    """
    order = W.orderBy("period")
    first, last = F.first("estimate").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lag("estimate").over(order)
    out = series.select("period", "estimate", (F.col("estimate") - first).alias("from_reference"), (F.col("estimate") - last).alias("from_previous"), ratio(F.col("estimate") - first, F.abs(first)).alias("relative"))
    gain = F.col("from_reference") * (-1.0 if DIRECTIONS[metric] == "lower_is_better" else 1.0)
    label = F.when(gain.isNull(), "undefined").when((gain > 0) & (gain >= threshold), "improved").when((gain < 0) & (gain <= -threshold), "degraded").otherwise("unchanged")
    return out.withColumn("point_change", label)


def trend_bounds(metric: str, low: Column, high: Column, ref_low: Column, ref_high: Column) -> tuple[Column, Column]:
    """Bounds of the degradation between two intervals: their outer differences, the sign turned for metrics of which more is better."""
    if DIRECTIONS[metric] == "lower_is_better":
        return low - ref_high, high - ref_low
    return ref_low - high, ref_high - low


def check_order(series: DataFrame, position: str, period: str) -> DataFrame:
    """``series``, if periods, in the order of the caller's ``position``, are distinct and go forward; they are never sorted anew."""
    order = W.orderBy(position)
    wrong = series.withColumn("__before", F.lag(period).over(order)).where(F.col("__before") >= F.col(period)).limit(1).count()
    if wrong:
        raise ValueError("periods aren't in order of time, or repeat")
    return series


def trend_slices(series: DataFrame, metric: str, position: str = "position", threshold: float = 0.0) -> DataFrame:
    """(position, slice_column, slice_value, estimate, from_reference, from_previous, low, high, coverage, point_change, interval_change, status) of every slice in every period.

    ``series`` has (position, slice_column, slice_value, estimate, lower, upper, level), a row for each slice and period; the first position is the
    reference. ``low`` to ``high`` bounds the degradation between the two intervals, and holds with at least the coverage a + b - 1 of their levels. Slices without
    a reference, or without a row in a later period, have a row that says so.
    """
    keys = ["slice_column", "slice_value"]
    places = series.select(position).distinct()
    grid = places.crossJoin(series.select(*keys).distinct())  # periods and slices are few: a row for each pair is the result
    full = grid.join(series.withColumn("__there", F.lit(True)), [position, *keys], "left")
    order = W.partitionBy(*keys).orderBy(position)
    before = lambda c, k: (F.first(c).over(order.rowsBetween(W.unboundedPreceding, 0)) if k == "r" else F.lag(c).over(order))
    out = full.withColumns({f"__r_{c}": before(c, "r") for c in ("estimate", "lower", "upper", "level")}).withColumn("__previous", before("estimate", "p")).withColumn("__first", F.min(position).over(order))
    low, high = trend_bounds(metric, F.col("lower"), F.col("upper"), F.col("__r_lower"), F.col("__r_upper"))
    itself = F.col(position) == F.col("__first")
    known = F.col("lower").isNotNull() & F.col("upper").isNotNull() & F.col("__r_lower").isNotNull() & F.col("__r_upper").isNotNull()
    low, high = F.when(known, F.when(itself, 0.0).otherwise(low)), F.when(known, F.when(itself, 0.0).otherwise(high))
    coverage = F.when(known, F.when(itself, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("level") + F.col("__r_level") - 1)))
    gone, new = F.col("__there").isNull(), F.col("__r_estimate").isNull()
    status = F.when(gone, "missing_slice").when(new & ~itself, "no_reference").when(F.col("estimate").isNull(), "undefined").otherwise("evaluated")
    change = F.col("estimate") - F.col("__r_estimate")
    worse = change * (1.0 if DIRECTIONS[metric] == "lower_is_better" else -1.0)
    point = F.when(worse.isNull(), "undefined").when((worse > 0) & (worse >= threshold), "degraded").when((worse < 0) & (worse <= -threshold), "improved").otherwise("unchanged")
    sure = F.when(~known, "undefined").when((F.col("low") > 0) & (F.col("low") >= threshold), "confident_degradation").when((F.col("high") < 0) & (F.col("high") <= -threshold), "confident_improvement").otherwise("inconclusive")
    held = out.withColumn("low", low).withColumn("high", high).withColumn("coverage", coverage)
    return held.select(position, *keys, "estimate", change.alias("from_reference"), (F.col("estimate") - F.col("__previous")).alias("from_previous"), "low", "high", "coverage", point.alias("point_change"), sure.alias("interval_change"), status.alias("status"))


def largest_degradations(trends: DataFrame, metric: str, threshold: float = 0.0, most: int = 3, position: str = "position") -> DataFrame:
    """(position, place, slice_column, slice_value, degradation): the ``most`` largest degradations above the threshold of each period; ties by name."""
    worse = F.col("from_reference") * (1.0 if DIRECTIONS[metric] == "lower_is_better" else -1.0)
    rows = trends.withColumn("degradation", worse).where(F.col("degradation") > threshold)
    order = W.partitionBy(position).orderBy(F.desc("degradation"), "slice_column", "slice_value")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(position, "place", "slice_column", "slice_value", "degradation")


def leaderboard(submissions: DataFrame, metric: str, tolerance: float = 0.0) -> DataFrame:
    """(place, model, revision, submission, estimate, lower, upper, rank_group) of verified submissions, once each.

    ``submissions`` has (submission, digest, model, revision, estimate, lower, upper, verified) and is refused if a row isn't verified. Rows of one submission, digest
    and model are one; a submission with several digests or models is refused. Order is by estimate, then model, revision and submission.
    """
    if submissions.where(~F.coalesce(F.col("verified"), F.lit(False)) | F.col("estimate").isNull()).limit(1).count():
        raise ValueError("a submission isn't verified or has no score")
    once = submissions.dropDuplicates(["submission", "digest", "model"])
    if once.groupBy("submission").count().where("count > 1").limit(1).count():
        raise ValueError("a submission occurs with different contents")
    named = once.withColumn("__model", F.col("model")).withColumn("model", F.col("submission"))
    ranked = rank_groups(named.withColumn("lower", F.coalesce("lower", "estimate")).withColumn("upper", F.coalesce("upper", "estimate")), metric, tolerance)
    sign = 1.0 if DIRECTIONS[metric] == "lower_is_better" else -1.0
    order = W.orderBy(sign * F.col("estimate"), "__model", "revision", "submission")
    return ranked.withColumn("place", F.row_number().over(order)).select("place", F.col("__model").alias("model"), "revision", "submission", "estimate", "lower", "upper", "rank_group")


def rank_groups(rows: DataFrame, metric: str, tolerance: float = 0.0) -> DataFrame:
    """``rows`` (model, estimate, lower, upper) with rank_group: models whose intervals connect share a group; intervals are widened to their point."""
    sign = 1.0 if DIRECTIONS[metric] == "lower_is_better" else -1.0
    point = sign * F.col("estimate")
    a, b = (F.col("lower"), F.col("upper")) if sign > 0 else (-F.col("upper"), -F.col("lower"))
    wide = rows.withColumn("__p", point).withColumn("__l", F.least(a, point)).withColumn("__u", F.greatest(b, point))
    order = W.orderBy("__l", "__p", "model")
    frontier = F.max("__u").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(frontier.isNull() | (F.col("__l") > frontier + tolerance), 1).otherwise(0)
    flagged = wide.withColumn("__new", new)
    return flagged.withColumn("rank_group", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__p", "__l", "__u", "__new")


def mean_or_null(c: str) -> Column:
    """The mean, null if any value is."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def hierarchical_means(rows: DataFrame, leaf: str, middle: str, value: str, digits: int = 3) -> DataFrame:
    """(level, key, mean): rounded leaf values are averaged within ``middle``, and those means overall; a null makes what is above it null."""
    leaves = rows.groupBy(middle, leaf).agg(mean_or_null(value).alias("v")).withColumn("v", F.bround("v", digits))
    groups = leaves.groupBy(middle).agg(mean_or_null("v").alias("v"))
    top = groups.agg(mean_or_null("v").alias("mean"))
    return groups.select(F.lit(middle).alias("level"), F.col(middle).alias("key"), F.col("v").alias("mean")).union(top.select(F.lit("all"), F.lit("all"), "mean"))


def fold_statistics(folds: DataFrame, score: str = "score") -> DataFrame:
    """One row (n_folds, mean, std, min, max), unweighted, population deviation."""
    return folds.agg(F.count(F.lit(1)).alias("n_folds"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))


def fold_cover(rows: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """One row (missing, unknown, repeated): rows in no fold, fold members that are no row, members of several folds. All are 0 for a partition."""
    members = folds.groupBy(key).agg(F.count(F.lit(1)).alias("k"))
    joined = rows.select(F.col(key).alias("__r")).join(members.select(F.col(key).alias("__m"), "k"), F.col("__r") == F.col("__m"), "full_outer")
    return joined.agg(F.count_if(F.col("__m").isNull()).alias("missing"), F.count_if(F.col("__r").isNull()).alias("unknown"), F.count_if(F.col("k") > 1).alias("repeated"))


def gate(evidence: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """(rule, observed, threshold, status) for rules on evidence rows (scope, metric, estimate, status, and, where a rule asks for them, lower, upper, baseline, decision).

    A rule has name, type, metric, scope and threshold. minimum and maximum look at the estimate; lower_bound and upper_bound at the interval's ends;
    absolute_regression and relative_regression at how much worse the estimate is than the baseline; comparison needs one of its ``decisions``; status needs the scope's
    status to be one of its ``decisions`` (a design audit's or a privacy audit's). The scope worst takes the worst slice and needs every slice evaluated;
    ``slices`` names critical slices, all of which have to pass. Missing evidence asks for investigation, it never fails or passes.
    """
    has = set(evidence.columns)
    column = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    parts = None
    for rule in rules:
        kind, rows = rule["type"], evidence.where(F.col("metric") == rule["metric"])
        lower_better = DIRECTIONS.get(rule["metric"]) == "lower_is_better"
        worse = (F.col("estimate") - column("baseline", "double")) * (1.0 if lower_better else -1.0)
        value, low = {
            "minimum": (F.col("estimate"), False), "maximum": (F.col("estimate"), True), "lower_bound": (column("lower", "double"), False), "upper_bound": (column("upper", "double"), True),
            "absolute_regression": (worse, True), "relative_regression": (ratio(worse, F.abs(column("baseline", "double"))), True),
            "comparison": (column("decision", "string"), None), "status": (F.col("status"), None),
        }[kind]
        fine = F.col("status") == "evaluated"
        if kind in ("comparison", "status"):
            one = rows.where(F.col("scope") == rule["scope"]).agg(F.max(F.when(fine | F.lit(kind == "status"), value)).alias("said"))
            good, observed, limit = F.col("said").isin(*rule["decisions"]), F.lit(None).cast("double"), F.lit(None).cast("double")
            unknown = F.col("said").isNull() | F.col("said").isin("undefined", "not_testable")
        else:
            if rule["scope"] == "worst" or rule.get("slices"):
                slices = rows.where("scope <> 'overall'")
                wanted = list(rule.get("slices") or [])
                slices = slices.where(F.col("scope").isin(*wanted)) if wanted else slices
                worst = F.max(value) if low else F.min(value)
                whole = F.bool_and(fine & value.isNotNull()) & (F.lit(True) if not wanted else F.countDistinct("scope") == len(set(wanted)))
                one = slices.agg(F.when(whole, worst).alias("observed"))
            else:
                one = rows.where(F.col("scope") == rule["scope"]).agg(F.max(F.when(fine, value)).alias("observed"))
            observed, limit = F.col("observed"), F.lit(float(rule["threshold"]))
            good, unknown = F.col("observed") <= limit if low else F.col("observed") >= limit, F.col("observed").isNull()
        row = one.select(F.lit(rule["name"]).alias("rule"), observed.alias("observed"), limit.alias("threshold"), F.when(unknown, "investigate").when(good, "pass").otherwise("fail").alias("status"))
        parts = row if parts is None else parts.union(row)
    return parts


def gate_overall(results: DataFrame) -> DataFrame:
    """fail before investigate before pass."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    return results.agg(F.when(has("fail"), "fail").when(has("investigate"), "investigate").otherwise("pass").alias("status"))


def compatible(receipts: DataFrame, keys: list[str]) -> Column | DataFrame:
    """One row (variants): how many different combinations of the keys the receipts hold; 1 means that they may be compared."""
    return receipts.agg(F.countDistinct(F.to_json(F.struct(*keys))).alias("variants"))


def site_coverage(receipts: DataFrame) -> DataFrame:
    """One row (identical): whether every model has the same set of sites."""
    per = receipts.groupBy("model").agg(F.array_sort(F.collect_set("site")).alias("sites"))
    return per.agg((F.countDistinct("sites") == 1).alias("identical"))


def best_runs(runs: DataFrame) -> DataFrame:
    """(metric, best_run, value) of rows (run, metric, value), by each metric's direction."""
    lower = [m for m, d in DIRECTIONS.items() if d == "lower_is_better"]
    signed = F.when(F.col("metric").isin(*lower), F.col("value")).otherwise(-F.col("value"))
    best = runs.where("value is not null").groupBy("metric").agg(F.min(F.struct(signed.alias("s"), "run", "value")).alias("b"))
    return best.select("metric", F.col("b.run").alias("best_run"), F.col("b.value").alias("value"))
