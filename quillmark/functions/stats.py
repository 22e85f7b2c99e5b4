"""Metric expressions. Every metric is a function of mergeable sums, so that one pass serves any grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whether more or less is better.
DIRECTIONS = {
    "mae": "lower_is_better", "rmse": "lower_is_better", "r2": "higher_is_better", "spearman": "higher_is_better", "accuracy": "higher_is_better",
    "f1": "higher_is_better", "auroc": "higher_is_better", "macro_f1": "higher_is_better", "weighted_f1": "higher_is_better",
    "log_loss": "lower_is_better", "macro_auroc_ovr": "higher_is_better",
}
#: The least probability that a logarithm is taken of: the spacing of doubles at 1.
EPSILON = 2.220446049250313e-16


def number(value) -> Column:
    return F.lit(float(value))


def r6(value: Column, name: str) -> Column:
    return F.round(value, 6).alias(name)


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the bottom is 0."""
    return top / F.nullif(bottom, F.lit(0))


def missing(c: Column, floating: bool) -> Column:
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def r2(y: Column, p: Column) -> Column:
    """1 - SSE/SST; a constant target gives 1 if met exactly, else 0; null below two rows."""
    sse, sst = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    constant = F.min(y) == F.max(y)
    return F.when(F.count(y) < 2, None).when(constant & (sse == 0), 1.0).when(constant, 0.0).otherwise(1 - sse / F.nullif(sst, F.lit(0.0)))


def partials(y: Column, p: Column, centre: Column | None = None) -> list[Column]:
    """Sums from which regression metrics of any union of groups follow; sums of targets are taken from ``centre``, with their extremes."""
    e, c = y - p, y if centre is None else y - centre
    return [
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("sa"), F.sum(e * e).alias("ss"), F.sum(c).alias("sy"), F.sum(c * c).alias("syy"), F.min(y).alias("lo"), F.max(y).alias("hi"),
    ]


def label_index(c: Column, labels: list[str]) -> Column:
    """Position of a label in the declared order; null if it isn't declared."""
    at = F.array_position(F.array(*(F.lit(x) for x in labels)), c.cast("string"))
    return F.when(at > 0, (at - 1).cast("int"))


def arg_max(probs: Column) -> Column:
    """Class of the largest probability; the first of equals."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def split_role(c: Column) -> Column:
    """train or test from the usual names of either, else null."""
    v = F.lower(F.trim(c.cast("string")))
    return F.when(v.isin("train", "training", "member", "members", "in", "1", "true"), "train").when(
        v.isin("test", "holdout", "validation", "val", "nonmember", "nonmembers", "out", "0", "false"), "test"
    )
