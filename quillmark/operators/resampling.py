"""Bootstrap and randomization by counted hash draws.

A draw is a hash of the seed, stratum, replicate and slot, so a result doesn't depend on partitions, retries or random state. Rows shrink to
sums by unit first; replicates then add up the sums of the drawn units. Each stratum keeps its number of units. Draws of whole units and of rows
are counted by ranges of slots (``tallies``); where draws are joined (levels, classes and areas by clusters), units that fit are broadcast to them, and draws never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions.stats import label_index, partials, ratio
from quillmark.operators import tallies
from quillmark.operators.ordered import running, suffix_least
from quillmark.sources.scratch import kept, task_count

#: Share of replicates that must be defined, and the least of them; most rows of a replicate; bytes of units that are broadcast.
VALID, FEWEST, MOST_ROWS, BROADCAST = 0.8, 20, 2_000_000, 64 << 20
SUMS = ("n", "sa", "ss", "sy", "syy", "lo", "hi")
#: Sums that are combined by minimum or maximum rather than added up.
_EXTREMES = {"lo": F.min, "hi": F.max}
#: Most numbers made from a row at once.
_BLOCK = 1024


def draw(size: Column, *key: Column | str, mode: str = "xxhash64") -> Column:
    """A number from 0 to size - 1 from the parts of a key, by a hash of 64 bits, or by 60 bits of md5, which other engines have too."""
    text = F.concat_ws("|", *(k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key))
    value = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") if mode == "md5" else F.xxhash64(text)
    return F.pmod(value, size.cast("long"))


def combined(sums: list[str]) -> list[Column]:
    return [_EXTREMES.get(c, F.sum)(c).alias(c) for c in sums]


def fitting(units: DataFrame, rows: int | None = None) -> DataFrame:
    """``units``, marked for broadcast if their ``rows``, counted unless the caller knows a bound, are within BROADCAST bytes.

    Others are marked to be merged: the size of draws is estimated from the few rows that they come from, so that Spark would broadcast the draws.
    """
    return F.broadcast(units) if (units.count() if rows is None else rows) * 16 * (len(units.columns) + 1) <= BROADCAST else units.hint("merge")


def indexed(units: DataFrame, unit: str, strata: list[str], rows: int | None = None) -> DataFrame:
    """``units`` (one row each) with slot, the place of a unit among its stratum's in string order, and size, the stratum's units. No task holds a whole stratum."""
    named = units.withColumn("__unit", F.col(unit).cast("string")).withColumn("__one", F.lit(1).cast("long"))
    placed = running(named, strata, "__unit", ["__one"], rows).withColumnRenamed("before___one", "slot").drop("__unit", "__one")
    sizes = units.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    return placed.join(sizes, strata) if strata else placed.crossJoin(sizes)


def numbered(df: DataFrame, count: Column, name: str, first: Column | None = None) -> DataFrame:
    """``df`` with a row for each number from ``first`` (0) on, ``count`` of them; no array is longer than _BLOCK or than a _BLOCK-th of the count."""
    begin = F.lit(0).cast("long") if first is None else first.cast("long")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / _BLOCK).cast("long")))
    rows = df.where(count > 0).withColumn("__begin", begin).withColumn("__count", count.cast("long")).withColumn("__block", blocks)
    low, last = F.col("__block") * _BLOCK, F.least((F.col("__block") + 1) * _BLOCK, F.col("__count")) - 1
    return rows.withColumn(name, F.explode(F.sequence(low + F.col("__begin"), last + F.col("__begin")))).drop("__begin", "__count", "__block")


def unit_sums(df: DataFrame, y: str, p: str, unit: str, strata: list[str] | None = None) -> DataFrame:
    """Regression sums of each unit; targets are taken from their mean over all rows, so that large offsets don't cancel.

    Rows are read once: a unit's own mean and squared deviations are kept, and moved to the mean of all afterwards.
    """
    t = F.col(y)
    each = kept(df.groupBy(*(strata or []), unit).agg(*partials(t, F.col(p)), F.avg(t).alias("__own"), (F.var_pop(t) * F.count(t)).alias("__within")), "units")
    centred = each.crossJoin(each.agg(F.coalesce(F.sum(F.col("n") * F.col("__own")) / F.sum("n"), F.lit(0.0)).alias("__mean")))
    gap = F.col("__own") - F.col("__mean")
    return centred.withColumn("sy", F.col("n") * gap).withColumn("syy", F.col("__within") + F.col("n") * gap * gap).select(*(strata or []), unit, *SUMS)


def drawn(table: DataFrame, resamples: int, seed: int, strata: list[str], mode: str) -> DataFrame:
    """(strata, b, slot): as many draws with replacement from each stratum of an indexed ``table`` as it has units, for each replicate."""
    dealt = table.select(*strata, F.col("slot").alias("__slot"), "size").repartition(task_count(table))  # few rows that become many
    slots = numbered(dealt, F.lit(resamples), "b")
    label = F.concat_ws("/", *(F.col(s).cast("string") for s in strata)) if strata else F.lit("")
    return slots.select(*strata, "b", _once(draw(F.col("size"), seed, label, F.col("b"), F.col("__slot"), mode=mode)).alias("slot"))


def _once(number: Column) -> Column:
    """``number``, which is never null, marked so: a join then has no filter that computes it again."""
    return F.coalesce(number, F.lit(0).cast("long"))


def replicates(units: DataFrame, unit: str, resamples: int, seed: int, sums: list[str], strata: list[str] | None = None, mode: str = "xxhash64") -> DataFrame:
    """(b, sums): totals of ``resamples`` draws with replacement of whole units, within strata."""
    strata, rows = strata or [], units.count()
    table = kept(indexed(units, unit, strata, rows), "slots")
    kinds = {c: "min" if c == "lo" else "max" for c in sums if c in _EXTREMES}
    return tallies.slot_sums(table, strata, [], sums, kinds, rows, resamples, seed, mode, draw).groupBy("b").agg(*combined(sums))


def nested(rows: DataFrame, levels: list[str], resamples: int, seed: int, sums: list[str], mode: str = "xxhash64") -> DataFrame:
    """(b, sums): roots are drawn, then as many children of each drawn node as it has, level by level; ``rows`` is one row for each path of ``levels``.

    With a row's id as the last level, rows of the leaves are drawn again as well. Multiplicities aren't stored: each drawn node is a row.
    """
    rows = rows.select(*levels, *sums)
    most = rows.count()
    if not 1 <= len(levels) <= 8:
        raise ValueError("one to eight levels are supported")
    roots = indexed(rows.select(levels[0]).distinct(), levels[0], [], most)
    first = numbered(roots.select(F.col("slot").alias("__slot"), "size"), F.lit(resamples), "b").repartition(task_count(rows), "b", "__slot")  # few rows that become many
    now = first.select("b", F.col("__slot").cast("string").alias("path"), _once(draw(F.col("size"), seed, "root", F.col("b"), F.col("__slot"), mode=mode)).alias("slot"))
    now = now.join(fitting(roots.select("slot", levels[0]), most), "slot").select("b", "path", levels[0])
    for k in range(1, len(levels)):
        above, own, last = levels[:k], levels[k], k + 1 == len(levels)
        held = [*above, own, *(sums if last else [])]
        table = indexed(rows.select(*held) if last else rows.select(*held).distinct(), own, above, most)
        sizes = table.groupBy(*above).agg(F.max("size").alias("size"))
        below = numbered(now.join(fitting(sizes, most), above), F.col("size"), "c")
        name = "child" + (str(k) if k > 1 else "")
        picked = below.select("b", F.concat_ws("|", "path", F.col("c").cast("string")).alias("path"), *above, _once(draw(F.col("size"), seed, name, F.col("b"), F.col("path"), F.col("c"), mode=mode)).alias("slot"))
        now = picked.join(fitting(table.select(*above, own, "slot", *(sums if last else [])), most), [*above, "slot"]).drop("slot")
    return (now if len(levels) > 1 else now.join(fitting(rows.select(levels[0], *sums)), levels[0])).groupBy("b").agg(*combined(sums))


def metric_values(suffix: str = "") -> dict[str, Column]:
    """mae, rmse and r2 from sums; r2 is null for a constant target."""
    n, sa, ss, sy, syy = (F.col(c + (suffix if c in ("sa", "ss") else "")) for c in SUMS[:5])
    sst = syy - sy * sy / n
    return {"mae": sa / n, "rmse": F.sqrt(ss / n), "r2": F.when((F.col("lo") < F.col("hi")) & (sst > 1e-13 * syy), 1 - ss / sst)}


def interval(values: DataFrame, column: str, resamples: int, by: list[str] | None = None, level: float = 0.95, rows: str | None = None) -> DataFrame:
    """(by, lower, upper, valid_resamples, status): percentiles of the defined replicates, of which at least max(20, 80 %) are needed; with ``rows``, also the most of that column as __rows."""
    need = max(FEWEST, -(-int(VALID * 1000) * resamples // 1000))
    low = (1 - level) / 2
    fine = F.count_if(F.col(column).isNotNull() & ~F.isnan(column))
    p = lambda q: F.percentile(F.when(~F.isnan(column), F.col(column)), q)
    more = [F.max(rows).alias("__rows")] if rows else []
    out = values.groupBy(*(by or [])).agg(fine.alias("valid_resamples"), p(low).alias("lower"), p(1 - low).alias("upper"), *more)
    enough = F.col("valid_resamples") >= need
    return out.select(*(by or []), F.when(enough, F.col("lower")).alias("lower"), F.when(enough, F.col("upper")).alias("upper"), "valid_resamples", F.when(enough, "evaluated").otherwise("insufficient_valid_resamples").alias("status"), *(["__rows"] if rows else []))


def intervals(estimate: DataFrame, values: DataFrame, resamples: int, level: float = 0.95, most: int | None = MOST_ROWS) -> DataFrame:
    """(metric, estimate, lower, upper, valid_resamples, status) of the regression metrics from totals and from replicates.

    If any replicate holds more than ``most`` rows there are no intervals, and the status says so: no draw is ever left out to keep the limit. None is no limit.
    """
    def long(df, name):
        one = F.array(*(F.struct(F.lit(m).alias("metric"), v.alias(name)) for m, v in metric_values().items()))
        return df.select("n", F.explode(one).alias("x")).select("n", "x.*")

    found = interval(long(values, "value"), "value", resamples, ["metric"], level, "n")
    return guarded(long(estimate, "estimate").drop("n").join(found, "metric"), most)


def guarded(found: DataFrame, most: int | None = MOST_ROWS) -> DataFrame:
    """``found`` (metric, estimate, lower, upper, valid_resamples, status, __rows) under the limit of rows in a replicate, if there is one."""
    over = F.lit(False) if most is None else F.coalesce(F.col("__rows") > most, F.lit(False))
    status = F.when(over, "not_supported_resource_limit").when(F.col("estimate").isNull(), "undefined_point_estimate").otherwise(F.col("status"))
    limit = lambda c: F.when(~over, F.col(c)).alias(c)
    return found.select("metric", "estimate", limit("lower"), limit("upper"), F.when(over, F.lit(0).cast("long")).otherwise(F.col("valid_resamples")).alias("valid_resamples"), status.alias("status"))


def totals(units: DataFrame) -> DataFrame:
    return units.agg(*combined(list(SUMS)))


def stratified_auroc(df: DataFrame, y: str, score: str, resamples: int, seed: int, mode: str = "xxhash64") -> DataFrame:
    """(b, auroc): each class keeps its number of rows.

    Rows shrink to a count for each distinct score and class; a drawn row number falls into the score whose running count covers it.
    """
    from quillmark.operators.metrics import auroc

    placed = kept(_placed(df, y, score), "scores")
    return auroc(_stratified(placed, y, resamples, seed, mode).withColumnRenamed("times", "w"), y, score, ["b"], "w")


def _placed(df: DataFrame, y: str, *others: str) -> DataFrame:
    """A row for each different (y, others) with k, its rows, first, those of its class before it, and size, those of its class."""
    counts = df.groupBy(y, *others).agg(F.count(F.lit(1)).alias("k"))
    order = others[0] if len(others) == 1 else "__order"
    if len(others) != 1:
        counts = counts.withColumn("__order", F.concat_ws("|", *(F.col(c).cast("string") for c in others)))
    placed = running(counts, [y], order, ["k"]).withColumnRenamed("before_k", "first").drop("__order")
    return placed.join(counts.groupBy(y).agg(F.sum("k").alias("size")), y)


def _stratified(placed: DataFrame, y: str, resamples: int, seed: int, mode: str) -> DataFrame:
    """(b, y, others, times) of draws of rows, as many in each class as it has. Every row of a class is a slot, and no array holds them all."""
    others = [c for c in placed.columns if c not in (y, "k", "first", "size")]
    return tallies.cell_times(placed, y, [y, *others], resamples, seed, mode, draw).groupBy("b", y, *others).agg(F.sum("times").alias("times"))


def _classes(cells: DataFrame, by: list[str], y: str, p: str, times: str) -> DataFrame:
    """(by, n, accuracy, macro_f1, weighted_f1) from counts of (y, p); a class without rows and predictions has no part in macro_f1, one without hits has an f1 of 0."""
    both = F.array(F.struct(F.col(y).alias("class"), F.col(times).alias("actual"), F.lit(0).cast("long").alias("said"), F.when(F.col(y) == F.col(p), F.col(times)).otherwise(0).alias("hit")), F.struct(F.col(p).alias("class"), F.lit(0).cast("long").alias("actual"), F.col(times).alias("said"), F.lit(0).cast("long").alias("hit")))
    per = cells.select(*by, F.explode(both).alias("x")).groupBy(*by, F.col("x.class").alias("class")).agg(*(F.sum(f"x.{c}").alias(c) for c in ("actual", "said", "hit")))
    f1 = 2 * F.col("hit") / (F.col("actual") + F.col("said"))
    return per.groupBy(*by).agg(F.sum("actual").alias("n"), (F.sum("hit") / F.sum("actual")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("weighted_f1"))


def stratified_classes(df: DataFrame, y: str, p: str, resamples: int, seed: int, mode: str = "xxhash64") -> DataFrame:
    """(b, n, accuracy, macro_f1, weighted_f1) of predicted classes: each class keeps its number of rows, whatever the number of classes."""
    return _classes(_stratified(kept(_placed(df, y, p), "classes"), y, resamples, seed, mode), ["b"], y, p, "times")


def class_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row (n, accuracy, macro_f1, weighted_f1)."""
    return _classes(df.groupBy(y, p).agg(F.count(F.lit(1)).alias("k")).withColumn("__all", F.lit(0)), ["__all"], y, p, "k").drop("__all")


def cluster_classes(df: DataFrame, y: str, p: str, unit: str, resamples: int, seed: int, strata: list[str] | None = None, mode: str = "xxhash64") -> DataFrame:
    """(b, n, accuracy, macro_f1, weighted_f1) of predicted classes under draws of whole units."""
    strata = strata or []
    cells = kept(df.groupBy(*strata, unit, y, p).agg(F.count(F.lit(1)).alias("times")), "cells")
    table = indexed(cells.select(*strata, unit).distinct(), unit, strata)
    held = table.select(*strata, unit, "slot").join(cells, [*strata, unit]).select(*strata, "slot", y, p, "times")
    counted = drawn(table, resamples, seed, strata, mode).join(fitting(held), [*strata, "slot"]).groupBy("b", y, p).agg(F.sum("times").alias("times"))
    return _classes(counted, ["b"], y, p, "times")


def cluster_auroc(df: DataFrame, y: str, score: str, unit: str, resamples: int, seed: int, strata: list[str] | None = None, mode: str = "xxhash64") -> DataFrame:
    """(b, auroc) under draws of whole units; rows shrink to a count for each unit, class and score first."""
    from quillmark.operators.metrics import auroc

    strata = strata or []
    cells = kept(df.groupBy(*strata, unit, y, score).agg(F.count(F.lit(1)).alias("times")), "cells")
    table = indexed(cells.select(*strata, unit).distinct(), unit, strata)
    held = table.select(*strata, unit, "slot").join(cells, [*strata, unit]).select(*strata, "slot", y, score, "times")
    counted = drawn(table, resamples, seed, strata, mode).join(fitting(held), [*strata, "slot"]).groupBy("b", y, score).agg(F.sum("times").alias("w"))
    return auroc(counted, y, score, ["b"], "w")


def flip(seed: int, permutation: Column, unit: Column, mode: str = "xxhash64") -> Column:
    """A fair coin of a permutation and unit."""
    return draw(F.lit(2), seed + 1, permutation, unit, mode=mode) == 1


def swap_test(units: DataFrame, unit: str, permutations: int, seed: int, metric: str = "mae", mode: str = "xxhash64") -> DataFrame:
    """(observed, extreme, valid, p_value): models are swapped by whole units; ``units`` has n and the sums of both models: sa_a and sa_b for mae, ss_a and ss_b for rmse, hit_a and hit_b for accuracy, loss_a and loss_b for log_loss.

    Two-sided: the share of permutations whose improvement is at least as large as the observed one, both counted with it.
    """
    units = kept(units, "units")
    every = numbered(units.repartition(task_count(units)), F.lit(permutations), "b")
    swapped = flip(seed, F.col("b"), F.col(unit), mode)
    pick = lambda c: (F.sum(F.when(swapped, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a"))), F.sum(F.when(swapped, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b"))))
    value = {"rmse": lambda s, n: F.sqrt(s / n), "accuracy": lambda s, n: -s / n}.get(metric, lambda s, n: s / n)  # more hits are better
    c = {"mae": "sa", "rmse": "ss", "accuracy": "hit", "log_loss": "loss"}[metric]
    a, b = pick(c)
    permuted = every.groupBy("b").agg((value(b, F.sum("n")) - value(a, F.sum("n"))).alias("value"))
    seen = units.agg((value(F.sum(f"{c}_b"), F.sum("n")) - value(F.sum(f"{c}_a"), F.sum("n"))).alias("observed"))
    joined = permuted.crossJoin(seen).groupBy("observed").agg(F.count_if(F.abs("value") >= F.abs("observed") - 1e-15).alias("extreme"), F.count("value").alias("valid"))
    return joined.withColumn("p_value", (F.col("extreme") + 1) / (F.col("valid") + 1))


def swap_outcome(tested: DataFrame, permutations: int, exchangeable: bool) -> DataFrame:
    """``tested`` (a row of ``swap_test``) with status; p_value is null unless units were declared exchangeable and max(20, 80 %) of the permutations are valid."""
    need = max(FEWEST, -(-int(VALID * 1000) * permutations // 1000))
    status = F.when(F.lit(not exchangeable), "not_supported_exchangeability_not_declared").when(F.col("observed").isNull(), "undefined_point_estimate").when(F.col("valid") < need, "insufficient_valid_permutations").otherwise("evaluated")
    return tested.withColumn("status", status).withColumn("p_value", F.when(F.col("status") == "evaluated", F.col("p_value")))


def ladder(df: DataFrame, enabled: bool = True, least: int = 20) -> DataFrame:
    """One row (status, n): whether intervals are computed at all: disabled, skipped_min_samples or evaluated."""
    status = F.when(F.lit(not enabled), "disabled").when(F.col("n") < least, "skipped_min_samples").otherwise("evaluated")
    return df.agg(F.count(F.lit(1)).alias("n")).select(status.alias("status"), "n")


def family(slices: DataFrame, declared: DataFrame, keys: list[str], p: str, method: str, alpha: float = 0.05) -> DataFrame:
    """``adjusted`` over the slices that a design declares and those that it doesn't: a declared slice that is absent has no p and the status missing_prespecified_slice."""
    both = declared.select(*keys).distinct().withColumn("__declared", F.lit(True)).join(slices.withColumn("__there", F.lit(True)), keys, "full_outer")
    label = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    found = adjusted(both.withColumn("__label", label), p, method, alpha, "__label")
    status = F.when(F.col("__there").isNull(), "missing_prespecified_slice").otherwise(F.col("status"))
    return found.withColumn("status", status).withColumn("prespecified", F.coalesce("__declared", F.lit(False))).drop("__declared", "__there", "__label")


def plan_status(df: DataFrame, unit: str, parent: str | None = None, stratum: str | None = None, least: int = 5) -> DataFrame:
    """One row (status, n_units, min_size, max_size, median_size): whether the units fit for resampling."""
    checks = df.groupBy(unit).agg(F.count(F.lit(1)).alias("k"), (F.countDistinct(stratum) if stratum else F.lit(1)).alias("strata"), (F.countDistinct(parent) if parent else F.lit(1)).alias("parents"), (F.min(stratum) if stratum else F.lit("")).alias("of"))
    per = checks.groupBy("of").agg(F.count(F.lit(1)).alias("units")).agg(F.min("units").alias("fewest"))
    out = checks.agg(
        F.count_if(F.col(unit).isNull()).alias("absent"), F.count_if(F.col("strata") > 1).alias("mixed"), F.count_if(F.col("parents") > 1).alias("crossed"),
        F.count(F.lit(1)).alias("n_units"), F.min("k").alias("min_size"), F.max("k").alias("max_size"), F.percentile("k", 0.5).alias("median_size"),
    ).crossJoin(per)
    status = F.when(F.col("absent") > 0, "missing_unit_ids").when(F.col("mixed") > 0, "non_constant_strata").when(F.col("crossed") > 0, "crossed_clusters")
    status = status.when(F.col("n_units") < least, "skipped_min_independent_units").when((F.col("fewest") < 2) & F.lit(stratum is not None), "skipped_min_units_per_stratum").otherwise("evaluated")
    return out.select(status.alias("status"), "n_units", "min_size", "max_size", "median_size")


def stepped_up(df: DataFrame, p: str, method: str, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """``df`` with adjusted_p and reject, by Benjamini-Hochberg (bh) or -Yekutieli (by) over each family ``by``; a missing p counts as 1, stays null and isn't rejected (null).

    Equal p have equal results, so ranks are taken of different p: the last of its rank. One family of any size is ordered by ranges, several families each on its own; no p is collected.
    """
    if method not in ("bh", "by"):
        raise ValueError("method must be bh or by")
    by = by or []
    value = F.coalesce(F.col(p), F.lit(1.0))
    wrong = df.where(F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)).limit(1).count()
    if wrong:
        raise ValueError("p values must be between 0 and 1")
    counts = kept(df.groupBy(*by, value.alias("__p")).agg(F.count(F.lit(1)).alias("__k")), "p-values")
    size = counts.groupBy(*by).agg(F.sum("__k").alias("__m"))
    n = counts.count()
    ranked = running(counts, by, "__p", ["__k"], n)
    harmonic = F.when(F.col("__m") <= 10_000, F.aggregate(F.sequence(F.lit(1), F.least("__m", F.lit(10_000)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)).otherwise(
        F.log(F.col("__m").cast("double")) + 0.5772156649015329 + 1 / (2.0 * F.col("__m")) - 1 / (12.0 * F.col("__m") * F.col("__m"))  # to the last digits beyond 10,000 tests
    )
    sized = ranked.join(size, by) if by else ranked.crossJoin(size)  # one row without families
    raw = sized.withColumn("__raw", F.col("__p") * F.col("__m") * (harmonic if method == "by" else F.lit(1.0)) / (F.col("before___k") + F.col("__k")))
    if by:
        least = raw.withColumn("least___raw", F.min("__raw").over(W.partitionBy(*by).orderBy("__p").rowsBetween(0, W.unboundedFollowing)))
    else:
        least = suffix_least(raw, "__p", "__raw", n)
    found = kept(least.select(*by, "__p", F.least("least___raw", F.lit(1.0)).alias("__a")), "p-adjusted")
    joined = df.withColumn("__p", value).join(found, [*by, "__p"], "left")
    shown = F.when(F.col(p).isNotNull(), F.col("__a"))
    return joined.select(*df.columns, shown.alias("adjusted_p"), (shown <= alpha).alias("reject"))


def adjusted(df: DataFrame, p: str, method: str, alpha: float = 0.05, tie: str = "label") -> DataFrame:
    """``stepped_up`` over one family, with reject false where p is missing, and status; ``tie`` doesn't matter, as equal p have equal results."""
    out = stepped_up(df, p, method, alpha)
    return out.withColumn("reject", F.coalesce("reject", F.lit(False))).withColumn("status", F.when(F.col(p).isNull(), "missing").otherwise("evaluated"))


__all__ = [
    "adjusted", "class_metrics", "cluster_auroc", "cluster_classes", "combined", "draw", "drawn", "family", "fitting", "flip", "guarded", "indexed", "interval", "intervals", "label_index", "ladder", "nested",
    "numbered", "plan_status", "ratio", "replicates", "stepped_up", "stratified_auroc", "stratified_classes", "swap_outcome", "swap_test", "totals", "unit_sums",
]
