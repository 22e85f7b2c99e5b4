"""What may be shown of trends, leaderboards, aggregates, shifts and audits: derived values are computed anew from approved rows by the same plans, and stored ones are only compared with them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators import audit, evidence, shift


@dataclass(frozen=True)
class ReleaseRules:
    """What was approved: values of naming columns, whole partitions by slice column, and the least rows and cell. With ``noisy`` values, intervals are withheld, as they tell of the clean ones."""

    named: Mapping[str, Sequence] = field(default_factory=dict)
    partitions: Mapping[str, Sequence[str]] = field(default_factory=dict)
    least_rows: int = 1
    least_cell: int = 1
    noisy: bool = False


class Release(NamedTuple):
    """``table`` is what may be shown; ``faults`` (key, column, stored, rebuilt, stored_text, rebuilt_text, fault) are the stored values that it doesn't bear out."""

    table: DataFrame
    faults: DataFrame


def approved(rows: DataFrame, named: Mapping[str, Sequence], floors: Mapping[str, int]) -> DataFrame:
    """``rows``, if every column of ``named`` holds approved values only and every column of ``floors`` at least its floor; raises otherwise, as leaving rows out would change what is derived from the rest.

    A null is neither approved nor large enough. An empty table is refused.
    """
    bad = {f"a {c} that isn't approved": ~F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in named.items()}
    bad |= {f"{c} below {least}": ~F.coalesce(F.col(c) >= least, F.lit(False)) for c, least in floors.items()}
    found = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(b).alias(f"b{i}") for i, b in enumerate(bad.values()))).first()
    wrong = [f"{found[f'b{i}']} rows with {what}" for i, what in enumerate(bad) if found[f"b{i}"]]
    if wrong or not found["n"]:
        raise ValueError("; ".join(wrong) or "there is nothing to release")
    return rows


def partitioned(cells: DataFrame, partitions: Mapping[str, Sequence[str]], whole: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``cells`` (by, slice_column, slice_value, counts) of the approved columns, if in each ``by`` these are whole partitions: approved labels, each once, whose counts (columns ``whole``) sum up to the same in every column."""
    own = cells.where(F.col("slice_column").isin(*partitions))
    label = F.lit(False)
    for column, labels in partitions.items():
        label = label | ((F.col("slice_column") == column) & F.col("slice_value").isin(*labels))
    if own.where(~F.coalesce(label, F.lit(False))).limit(1).count():
        raise ValueError("a label of a partition isn't approved")
    if own.groupBy(*by, "slice_column", "slice_value").count().where("count > 1").limit(1).count():
        raise ValueError("a cell of a partition is repeated")
    sums = own.groupBy(*by, "slice_column").agg(*(F.sum(c).alias(c) for c in whole))
    each = sums.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), *(F.countDistinct(c).alias(c) for c in whole))
    uneven = F.col("k") != len(partitions)
    for c in whole:
        uneven = uneven | (F.col(c) > 1)
    if each.where(uneven).limit(1).count():
        raise ValueError("partitions aren't whole: a column is absent, or columns hold different numbers of rows")
    return own


def _close(a: Column, b: Column, relative: float, absolute: float) -> Column:
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def compared(stored: DataFrame, rebuilt: DataFrame, keys: Sequence[str], relative: float = 1e-10, absolute: float = 1e-12) -> DataFrame:
    """(key, column, stored, rebuilt, stored_text, rebuilt_text, fault) of every stored value that isn't the rebuilt one within the tolerance, numbers apart from texts; ``key`` is the keys joined by |.

    fault is differs, missing (a rebuilt row that isn't stored), unknown (a stored row that can't be rebuilt) or repeated (a stored key with several rows, whose values aren't compared). Nulls equal nulls and nothing else;
    keys may be null. Columns that only one side has are no values to compare.
    """
    keys, kinds = list(keys), dict(rebuilt.dtypes)
    values = [c for c in rebuilt.columns if c not in keys and c in stored.columns]
    once = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k"), *(F.first(c).alias(f"__s_{c}") for c in values))
    left = once.select(*(F.col(k).alias(f"__sk{i}") for i, k in enumerate(keys)), "__k", *(f"__s_{c}" for c in values))
    right = rebuilt.select(*(F.col(k).alias(f"__rk{i}") for i, k in enumerate(keys)), F.lit(True).alias("__there"), *(F.col(c).alias(f"__r_{c}") for c in values))
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"__sk{i}").eqNullSafe(F.col(f"__rk{i}"))
    both = left.join(right, on, "full_outer")
    key = F.concat_ws("|", *(F.coalesce(F.coalesce(f"__rk{i}", f"__sk{i}").cast("string"), F.lit("<NA>")) for i in range(len(keys))))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    row = lambda fault: F.struct(text.alias("column"), none.alias("stored"), none.alias("rebuilt"), text.alias("stored_text"), text.alias("rebuilt_text"), F.lit(fault).alias("fault"))
    cells = []
    for c in values:
        a, b = F.col(f"__s_{c}"), F.col(f"__r_{c}")
        if kinds[c] in ("string", "boolean"):
            a, b = a.cast("string"), b.cast("string")
            cells.append(F.when(~a.eqNullSafe(b), F.struct(F.lit(c).alias("column"), none.alias("stored"), none.alias("rebuilt"), a.alias("stored_text"), b.alias("rebuilt_text"), F.lit("differs").alias("fault"))))
        else:
            a, b = a.cast("double"), b.cast("double")
            cells.append(F.when(~_close(a, b, relative, absolute), F.struct(F.lit(c).alias("column"), a.alias("stored"), b.alias("rebuilt"), text.alias("stored_text"), text.alias("rebuilt_text"), F.lit("differs").alias("fault"))))
    found = F.when(F.col("__k").isNull(), F.array(row("missing"))).when(F.col("__there").isNull(), F.array(row("unknown"))).when(F.col("__k") > 1, F.array(row("repeated"))).otherwise(F.array_compact(F.array(*cells)))
    return both.select(key.alias("key"), F.explode(found).alias("x")).select("key", "x.*")


def _without_intervals(rows: DataFrame, rules: ReleaseRules, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast("double") for c in columns if c in rows.columns}) if rules.noisy else rows


def trend(series: DataFrame, stored: DataFrame, rules: ReleaseRules, metric: str, threshold: float = 0.0) -> Release:
    """Changes of a trend from its estimates: ``series`` as ``evidence.trend_slices`` takes it, with n; ``stored`` as that gives it.

    ``rules.named`` holds the approved positions (all of them have to be there), and each period's partitions must be whole and large enough.
    """
    own = partitioned(series, rules.partitions, ["n"], ["position"])
    approved(own, rules.named, {"n": rules.least_cell})
    approved(own.groupBy("position", "slice_column").agg(F.sum("n").alias("n")), {}, {"n": rules.least_rows})
    for column, values in rules.named.items():
        if own.select(column).distinct().count() != len(set(values)):
            raise ValueError(f"an approved {column} is absent")
    table = evidence.trend_slices(_without_intervals(own, rules, ["lower", "upper", "level"]), metric, threshold=threshold)
    return Release(table, compared(stored, table, ["position", "slice_column", "slice_value"]))


def leaderboard(submissions: DataFrame, stored: DataFrame, rules: ReleaseRules, metric: str, tolerance: float = 0.0) -> Release:
    """Places and rank groups of approved submissions (with n) from their scores and intervals; ``stored`` as ``evidence.leaderboard`` gives it."""
    own = approved(submissions, rules.named, {"n": rules.least_rows})
    if own.select("n").distinct().limit(2).count() > 1:
        raise ValueError("submissions were scored on different numbers of rows")
    table = evidence.leaderboard(_without_intervals(own, rules, ["lower", "upper"]), metric, tolerance)
    return Release(table, compared(stored, table, ["submission"]))


def aggregate(receipts: DataFrame, stored: DataFrame, rules: ReleaseRules, metric: str, material: float | None = None) -> Release:
    """Pooled values of approved models over approved sites from the sites' own; ``stored`` as ``evidence.aggregated`` gives it."""
    own = approved(receipts.where(F.col("metric") == metric), rules.named, {"n": rules.least_cell})
    approved(own.groupBy("model").agg(F.sum("n").alias("n")), {}, {"n": rules.least_rows})
    table = evidence.aggregated(own, metric, material=material)
    return Release(table, compared(stored, table, ["model", "metric"]))


def degradation(cells: DataFrame, stored: DataFrame, rules: ReleaseRules, metric: str, least: int = 5, prevalence_threshold: float = 0.1) -> Release:
    """Ranked degradations between cohorts from cells as ``shift.degradation_of`` takes them; the cohorts' sizes are the sums over a whole partition. ``stored`` as ``shift.ranked`` gives it.

    A cell that one cohort lacks may be shown; one that is there but small may not.
    """
    own = partitioned(cells, rules.partitions, ["n_reference", "n_current"])
    counts = own.select("slice_column", *(F.when(F.col(c) > 0, F.col(c)).otherwise(rules.least_cell).alias(c) for c in ("n_reference", "n_current")))
    approved(counts, {}, {"n_reference": rules.least_cell, "n_current": rules.least_cell})
    size = own.groupBy("slice_column").agg(F.sum("n_reference").alias("tr"), F.sum("n_current").alias("tc")).agg(F.max("tr").alias("tr"), F.max("tc").alias("tc"))
    approved(size, {}, {"tr": rules.least_rows, "tc": rules.least_rows})
    table = shift.ranked(shift.degradation_of(own, size, metric, least, prevalence_threshold))
    return Release(table, compared(stored, table, ["slice_column", "slice_value"]))


def findings(rows: DataFrame, stored: DataFrame, policies: Mapping[str, str]) -> Release:
    """The status of every audit finding (check, affected_records, status) from its count and its check's policy; not_testable and pair_budget_exceeded stay, if they have no count above 0. ``stored`` is one row as ``audit.rolled_up`` gives it.

    Counts between 1 and the least cell aren't hidden here: an audit's counts are of faults, and a caller who mayn't show them shows the status alone. Faults have the summary's values under the key ``summary``.
    """
    approved(rows, {"check": list(policies)}, {})
    policy = F.try_element_at(F.create_map(*(F.lit(x) for pair in policies.items() for x in pair)), F.col("check"))
    open_status = F.col("status").isin("not_testable", "pair_budget_exceeded") & (F.coalesce("affected_records", F.lit(0)) == 0)
    status = F.when(open_status, F.col("status")).when(F.col("affected_records").isNull(), "not_testable").when(F.col("affected_records") == 0, "pass").when(policy == "forbid", "fail").otherwise("warn")
    table = rows.select("check", "affected_records", status.alias("status"))
    summary = compared(stored.withColumn("__key", F.lit("summary")), audit.rolled_up(table).withColumn("__key", F.lit("summary")), ["__key"])
    return Release(table, compared(rows, table, ["check"]).unionByName(summary))
