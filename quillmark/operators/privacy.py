"""Privacy operators: membership audit, bounded means, suppression of small cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.stats import number, ratio
from quillmark.operators.ordered import running

#: Signal from which a risk is moderate, and high.
MODERATE, HIGH = 0.15, 0.35


def loss(y: Column, score: Column, task: str) -> Column:
    """Absolute error, or cross entropy with scores kept 1e-6 from 0 and 1."""
    if task == "regression":
        return F.abs(y - score)
    p = F.greatest(F.least(score, number(1 - 1e-6)), number(1e-6))
    return F.when(y == 1, -F.log(p)).otherwise(-F.log(1 - p))


def membership_audit(df: DataFrame, member: str, loss_column: str) -> DataFrame:
    """One row: the best balanced accuracy of telling members (boolean column) from others by a loss threshold in either direction, its threshold, direction and
    advantage, the folded area under the curve, mean losses and the risk level.

    Whole groups of equal losses are evaluated by running counts; of equal accuracies the direction loss_le comes first, then the lowest threshold.
    """
    counts = df.groupBy(F.col(loss_column).alias("loss")).agg(F.count_if(F.col(member)).alias("m"), F.count_if(~F.col(member)).alias("o"))
    size = counts.agg(F.sum("m").alias("tm"), F.sum("o").alias("to"), F.sum(F.col("m") * F.col("loss")).alias("lm"), F.sum(F.col("o") * F.col("loss")).alias("lo"))
    placed = running(counts, [], "loss", ["m", "o"]).crossJoin(size)
    low = 0.5 * (ratio(F.col("before_m") + F.col("m"), F.col("tm")) + 1 - ratio(F.col("before_o") + F.col("o"), F.col("to")))
    wins = F.col("m") * (F.col("to") - F.col("before_o") - F.col("o") + F.col("o") / 2)  # a member scores above others of a larger loss
    one = placed.withColumn("low", low)
    both = one.select("*", F.explode(F.array(F.struct(F.lit(0).alias("d"), F.col("low").alias("acc")), F.struct(F.lit(1).alias("d"), (1 - F.col("low")).alias("acc")))).alias("x"))
    best = both.agg(F.max(F.struct(F.round("x.acc", 12).alias("acc"), (-F.col("x.d")).alias("d"), (-F.col("loss")).alias("t"))).alias("best"))
    area = placed.agg(ratio(F.sum(wins), F.max("tm") * F.max("to")).alias("directional"), F.max("tm").alias("n_member"), F.max("to").alias("n_nonmember"), F.max(ratio(F.col("lm"), F.col("tm"))).alias("member_loss"), F.max(ratio(F.col("lo"), F.col("to"))).alias("nonmember_loss"))
    out = area.crossJoin(best).select(
        "n_member", "n_nonmember", F.greatest(number(0), (F.col("best.acc") - 0.5) * 2).alias("advantage"), F.greatest("directional", 1 - F.col("directional")).alias("auc"),
        (-F.col("best.t")).alias("threshold"), F.when(F.col("best.d") == 0, "loss_le").otherwise("loss_gt").alias("direction"), "member_loss", "nonmember_loss",
    )
    signal = F.greatest(F.col("advantage"), (F.col("auc") - 0.5) * 2)
    return out.withColumn("level", F.when(signal >= HIGH, "high").when(signal >= MODERATE, "moderate").otherwise("low"))


def bounded_center(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row (n, clipped_mean, sensitivity): the part of a bounded mean that is computed before noise; noise is drawn on the driver alone."""
    clipped = F.least(F.greatest(F.col(column), number(low)), number(high))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(clipped).alias("clipped_mean"), ratio(number(high) - number(low), F.count(F.lit(1))).alias("sensitivity"))


def suppressed(df: DataFrame, column: str, least: int, approved: list[str] | None = None, unit: str | None = None) -> DataFrame:
    """(slice_column, slice_value, n, status): the cells of a partition, or one withheld row for all of it.

    A partition is released only if its labels are the approved ones and every cell holds ``least`` rows and, if given, units.
    """
    cells = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<NA>")).alias("slice_value")).agg(F.count(F.lit(1)).alias("n"), (F.countDistinct(unit) if unit else F.count(F.lit(1))).alias("units"))
    whole = cells.agg(F.bool_and((F.col("n") >= least) & (F.col("units") >= least)).alias("large"), F.array_sort(F.collect_set("slice_value")).alias("labels"))
    good = F.coalesce(F.col("large"), F.lit(False))
    if approved is not None:
        good = good & (F.col("labels") == F.array(*(F.lit(x) for x in sorted(approved))))
    marked = cells.crossJoin(whole.select(good.alias("good")))
    shown = marked.where("good").select(F.lit(column).alias("slice_column"), "slice_value", "n", F.lit("released").alias("status"))
    withheld = whole.where(~good).select(F.lit(column), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit("withheld"))
    return shown.union(withheld)


def release_gate(clients: DataFrame, least_clients: int, least_total: int, least_each: int) -> DataFrame:
    """One row (n_clients, total, smallest, status) for an aggregate over clients (client, n)."""
    out = clients.agg(F.count(F.lit(1)).alias("n_clients"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.min("n"), F.lit(0)).alias("smallest"))
    fine = (F.col("n_clients") >= least_clients) & (F.col("total") >= least_total) & (F.col("smallest") >= least_each)
    return out.withColumn("status", F.when(fine, "allowed").otherwise("denied"))


def risk_gate(audit: DataFrame, level: str = "moderate", advantage: float | None = None, auc: float | None = None) -> DataFrame:
    """``audit`` with passed: its level is at most the given one, its advantage and area within their limits."""
    rank = lambda c: F.when(c == "low", 0).when(c == "moderate", 1).otherwise(2)
    fine = rank(F.col("level")) <= rank(F.lit(level))
    if advantage is not None:
        fine = fine & (F.col("advantage") <= advantage)
    if auc is not None:
        fine = fine & (F.col("auc") <= auc)
    return audit.withColumn("passed", fine)


def floored(statistics: DataFrame, least: int) -> DataFrame:
    """Statistics (n, n_units, estimate, lower, upper) with values nulled and status suppressed where rows or units are too few."""
    small = (F.col("n") < least) | (F.coalesce(F.col("n_units"), F.col("n")) < least)
    kept = {c: F.when(~small, F.col(c)) for c in ("estimate", "lower", "upper") if c in statistics.columns}
    return statistics.withColumns(kept).withColumn("status", F.when(small, "suppressed").otherwise("released"))


def approved_family(tests: DataFrame, approved: DataFrame, keys: list[str], p: str, method: str = "by", alpha: float = 0.05) -> DataFrame:
    """(keys, p, adjusted_p, reject) of the tests that may be shown, adjusted anew as a family of their own: adjusted values of a larger family would tell of tests that aren't shown.

    Approved keys without a test are tests without a p, which keep their place in the family. Repeated keys in ``approved`` count once.
    """
    from quillmark.operators.resampling import stepped_up

    shown = approved.select(*keys).distinct().join(tests.select(*keys, p), keys, "left")
    return stepped_up(shown, p, method, alpha)
