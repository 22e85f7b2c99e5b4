"""Two models on the same rows: alignment, improvement, winners and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.stats import DIRECTIONS, mae, r2, rmse
from quillmark.operators.metrics import gate, unpivoted


def alignment(a: DataFrame, b: DataFrame, key: str, target: str, metadata: list[str] | None = None) -> DataFrame:
    """One row: only_in_a, only_in_b, target_mismatch, metadata_mismatch. A paired comparison needs all four to be 0; nothing is dropped silently."""
    metadata = metadata or []
    left = a.select(F.col(key).alias("__a"), F.col(target).alias("__ta"), *(F.col(c).alias(f"__a_{c}") for c in metadata))
    right = b.select(F.col(key).alias("__b"), F.col(target).alias("__tb"), *(F.col(c).alias(f"__b_{c}") for c in metadata))
    both = left.join(right, F.col("__a") == F.col("__b"), "full_outer")
    matched = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    same = F.lit(True)
    for c in metadata:
        same = same & F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))
    return both.agg(
        F.count_if(F.col("__b").isNull()).alias("only_in_a"), F.count_if(F.col("__a").isNull()).alias("only_in_b"),
        F.count_if(matched & ~F.col("__ta").eqNullSafe(F.col("__tb"))).alias("target_mismatch"), F.count_if(matched & ~same).alias("metadata_mismatch"),
    )


def faults(df: DataFrame, key: str, target: str, prediction: str, task: str = "regression") -> DataFrame:
    """One row (rows, blank_ids, repeated_ids, not_finite, bad_targets, out_of_range) of one of the two tables; a comparison needs all but rows to be 0.

    Ids are grouped once, with their rows' faults summed on the way, so a repeated id never meets itself in a join.
    """
    kinds = dict(df.dtypes)
    number = lambda c: F.col(c).cast("double")
    wrong = lambda c: F.col(c).isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf")) if kinds[c] != "string" else F.col(c).isNull()
    both = wrong(prediction) | wrong(target)
    badly = ~number(target).isin(0.0, 1.0) if task == "binary" else F.lit(False)
    outside = (number(prediction) < 0) | (number(prediction) > 1) if task == "binary" else F.lit(False)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("k"), count(both).alias("not_finite"), count(badly).alias("bad_targets"), count(outside).alias("out_of_range"))
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(blank, F.col("k"))), F.lit(0)).alias("blank_ids"), F.coalesce(F.sum(F.when(~blank, F.col("k") - 1)), F.lit(0)).alias("repeated_ids"), sums("not_finite"), sums("bad_targets"), sums("out_of_range"))


def aligned(a: DataFrame, b: DataFrame, key: str, target: str, prediction: str, metadata: list[str] | None = None, task: str = "regression") -> DataFrame:
    """(key, target, metadata, p_a, p_b); raises if either table is empty or has blank or repeated ids, values that aren't finite or are out of range, or if they don't hold the same rows."""
    for name, side in (("A", a), ("B", b)):
        absent = [c for c in (key, target, prediction, *(metadata or [])) if c not in side.columns]
        if absent:
            raise ValueError(f"columns are absent from {name}: {absent}")
        found = faults(side, key, target, prediction, task).first().asDict()
        if not found.pop("rows"):
            raise ValueError(f"table {name} is empty")
        if any(found.values()):
            raise ValueError(f"table {name} can't be compared: {found}")
    problem = alignment(a, b, key, target, metadata).first()
    if any(problem):
        raise ValueError(f"paired tables differ: {problem.asDict()}")
    other = b.select(key, F.col(prediction).alias("p_b"))
    return a.withColumnRenamed(prediction, "p_a").select(key, target, *(metadata or []), "p_a").join(other, key)


def oriented(metric: str, a: Column, b: Column) -> Column:
    """Improvement of A over B: above 0 whenever A is better."""
    return b - a if DIRECTIONS[metric] == "lower_is_better" else a - b


def winner(improvement: Column, tolerance: float = 0.0) -> Column:
    return F.when(improvement.isNull(), None).when(improvement > tolerance, "a").when(improvement < -tolerance, "b").otherwise("tie")


def point_decision(improvement: Column, threshold: float) -> Column:
    """Against a practical threshold; a threshold of 0 is strict."""
    better = improvement > 0 if threshold == 0 else improvement >= threshold
    worse = improvement < 0 if threshold == 0 else improvement <= -threshold
    return F.when(improvement.isNull(), "undefined").when(better, "practically_better").when(worse, "practically_worse").otherwise("no_practical_difference")


def interval_decision(lower: Column, upper: Column, threshold: float, margin: float | None = None) -> tuple[Column, Column]:
    """Decision with confidence, and noninferiority against a margin."""
    better = lower > 0 if threshold == 0 else lower >= threshold
    worse = upper < 0 if threshold == 0 else upper <= -threshold
    decision = F.when(lower.isNull() | upper.isNull(), "undefined").when(better, "confident_improvement").when(worse, "confident_regression").otherwise("inconclusive")
    noninferior = F.lit(None).cast("string") if margin is None else F.when(lower.isNull(), "undefined").when(lower >= -margin, "noninferior").otherwise("not_established")
    return decision, noninferior


#: Most values of a slice column of ``compare``, which has a plan for each; ``compare_models`` takes any number.
SLICES = 200
_METRICS = {"mae": mae, "rmse": rmse, "r2": r2}


def compare(a: DataFrame, b: DataFrame, key: str, target: str, prediction: str, slices: list[str] | None = None, unit: str | None = None, resamples: int = 1000, permutations: int = 1000, seed: int = 13, threshold: float = 0.0, margin: float | None = None, metric: str = "mae", exchangeable: bool = False, least: int = 20) -> DataFrame:
    """One row for the whole comparison and one for each slice: (slice_column, slice_value, n, metric_a, metric_b, improvement, lower, upper, valid_resamples, status, decision, noninferiority, p_value).

    The tables are aligned first. ``metric`` is mae or rmse. Whole ``unit``s are drawn and swapped (rows, if there is none), a slice's with a seed of its own; swapping units
    needs them to be declared exchangeable. Below ``least`` rows there are no intervals.
    """
    from quillmark.operators import resampling

    metadata = list(dict.fromkeys([*(slices or []), *([unit] if unit else [])]))
    rows = aligned(a, b, key, target, prediction, metadata)
    own, c = unit or key, {"mae": "sa", "rmse": "ss"}[metric]
    e = lambda side: F.col(target) - F.col(f"p_{side}")
    each = lambda side: F.sum(F.abs(e(side)) if c == "sa" else e(side) * e(side)).alias(f"{c}_{side}")
    value = (lambda s: s / F.col("n")) if c == "sa" else (lambda s: F.sqrt(s / F.col("n")))
    sums = ["n", f"{c}_a", f"{c}_b"]
    gain = value(F.col(sums[2])) - value(F.col(sums[1]))

    def one(part: DataFrame, column: str, label: Column, seed: int) -> DataFrame:
        units = part.groupBy(own).agg(F.count(F.lit(1)).alias("n"), each("a"), each("b"))
        point = units.agg(*(F.sum(x).alias(x) for x in sums)).select("n", value(F.col(sums[1])).alias("metric_a"), value(F.col(sums[2])).alias("metric_b"), gain.alias("estimate"))
        draws = resampling.replicates(units, own, resamples, seed, sums).select("b", "n", gain.alias("v"))
        found = resampling.interval(draws, "v", resamples, rows="n").withColumn("metric", F.lit(metric)).crossJoin(point.withColumnRenamed("n", "__n"))
        held = resampling.guarded(found).crossJoin(point.drop("estimate"))
        test = resampling.swap_outcome(resampling.swap_test(units, own, permutations, seed, metric), permutations, exchangeable or unit is None).select("p_value")
        decision, noninferior = interval_decision(F.col("lower"), F.col("upper"), threshold, margin)
        few = F.col("n") < least
        blank = lambda x: F.when(~few, F.col(x)).alias(x)
        held = held.withColumn("lower", blank("lower")).withColumn("upper", blank("upper")).withColumn("status", F.when(few, "skipped_min_samples").otherwise(F.col("status"))).crossJoin(test)
        return held.select(F.lit(column).alias("slice_column"), label.alias("slice_value"), "n", "metric_a", "metric_b", F.col("estimate").alias("improvement"), "lower", "upper", "valid_resamples", "status", decision.alias("decision"), noninferior.alias("noninferiority"), "p_value")

    out = one(rows, "<all>", F.lit("<all>"), seed)
    for k, column in enumerate(slices or []):
        label = F.coalesce(F.col(column).cast("string"), F.lit("<NA>"))
        for i, v in enumerate(sorted(r[0] for r in rows.select(label).distinct().limit(SLICES + 1).collect())):
            if i >= SLICES:
                raise ValueError(f"{column} has more than {SLICES} values; slice by a column with fewer")
            out = out.union(one(rows.where(label == v), column, F.lit(v), seed + 1 + k * SLICES + i))
    return out


def _long(wide: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    one = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("metric_a"), F.col(f"b_{m}").alias("metric_b"), oriented(m, F.col(f"a_{m}"), F.col(f"b_{m}")).alias("improvement")) for m in _METRICS))
    out = wide.select(*keys, F.explode(one).alias("x")).select(*keys, "x.*")
    return out.select(*keys, "metric", "metric_a", "metric_b", "improvement", winner(F.col("improvement")).alias("winner"), point_decision(F.col("improvement"), threshold).alias("decision"))


def improvement(df: DataFrame, y: str, a: str, b: str, threshold: float = 0.0) -> DataFrame:
    """(metric, metric_a, metric_b, improvement, winner, decision) in one pass over the aligned rows."""
    wide = df.agg(*(f(F.col(y), F.col(p)).alias(f"{side}_{m}") for m, f in _METRICS.items() for side, p in (("a", a), ("b", b))))
    return _long(wide, [], threshold)


def slice_improvement(df: DataFrame, y: str, a: str, b: str, columns: list[str], least: int = 5, threshold: float = 0.0) -> DataFrame:
    """The same for every slice of every column that holds ``least`` rows."""
    rows = unpivoted(df.select(y, a, b, *columns), columns)
    wide = rows.groupBy("slice_column", "slice_value").agg(F.count(F.lit(1)).alias("n"), *(f(F.col(y), F.col(p)).alias(f"{side}_{m}") for m, f in _METRICS.items() for side, p in (("a", a), ("b", b))))
    return _long(wide.withColumn("status", gate(least)).where("status = 'evaluated'"), ["slice_column", "slice_value", "n"], threshold)


def compare_models(a: DataFrame, b: DataFrame, key: str, target: str, prediction: str, task: str = "regression", classes: int = 2, metrics: list[str] | None = None, slices: tuple[str, ...] = (), design=None, config=None, mode: str = "counts") -> DataFrame:
    """Two prediction tables of the same rows, aligned and compared by every metric of a task: the rows of ``resampled.paired_intervals``, for the whole table and each slice as one plan of any number of slices.

    ``design`` (SamplingDesign) names units, strata, critical slices and the multiplicity policy, ``config`` (PairedConfig) the rest. Targets are numbers or class indexes; predictions of several classes are arrays.
    Raises if the tables don't hold the same rows, as ``aligned`` does.
    """
    from quillmark.operators import resampled
    from quillmark.operators.designs import PairedConfig

    config = config or PairedConfig()
    wanted = tuple(dict.fromkeys([*slices, *(c for c, _ in (design.critical_slices if design else ()))]))
    metadata = list(dict.fromkeys([*wanted, *(design.columns if design else ())]))
    if task == "multiclass":
        problem = alignment(a, b, key, target, metadata).first()
        if any(problem):
            raise ValueError(f"paired tables differ: {problem.asDict()}")
        rows = a.withColumnRenamed(prediction, "p_a").select(key, target, *metadata, "p_a").join(b.select(key, F.col(prediction).alias("p_b")), key)
    else:
        rows = aligned(a, b, key, target, prediction, metadata, task)
    return resampled.paired_intervals(rows, key, target, "p_a", "p_b", task, classes, metrics, slices, design, config, mode)
