"""Intervals and paired comparisons of every metric, for a whole table and all its slices, as one plan.

Rows are keyed by slice and by unit (a row, or what a design declares). A unit has a vector of sums for each model; regression and class metrics are functions of summed vectors. What a replicate
draws is how often each unit occurs in it. The occurrences of all replicates are found at once: a replicate's size is split over ranges of units by multinomial draws, then over the units of
each range inside one task, where sums of all replicates are one product of matrices. So work is units x replicates at most, in numpy, with a row for each range and replicate to be shuffled.
Areas under curves need the occurrences themselves, which are joined to the units' scores and summed by ranges of scores.

Replicate number ``resamples`` holds every unit once: point estimates take the same way as replicates. Draws are seeded by slice, stratum, range and replicate, so results don't depend on partitions or
retries. With ``mode`` md5 draws are hashes that other engines can follow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.stats import DIRECTIONS, EPSILON, arg_max, ratio
from quillmark.operators import resampling, tallies
from quillmark.operators.designs import BootstrapConfig, PairedConfig, SamplingDesign
from quillmark.sources.scratch import kept, task_count

#: Units of a range, scores of a range, and cells of a matrix that a task holds at once.
RANGE, SCORES, CELLS = 50_000, 20_000, 4_000_000
BY = ["slice_column", "slice_value"]
METRICS = {
    "regression": ("mae", "rmse", "r2"), "binary": ("accuracy", "f1", "auroc"),
    "multiclass": ("accuracy", "macro_f1", "weighted_f1", "log_loss", "macro_auroc_ovr"),
}
_AREAS = ("auroc", "macro_auroc_ovr")


# --- vectors of sums


def row_values(y: str, predictions: dict[str, str], task: str, classes: int = 2) -> dict[str, Column]:
    """What a row adds to its unit's vector: for regression absolute and squared errors, for classes hits, true positives, guesses, truths and losses."""
    truth, out = F.col(y), {}
    if task == "regression":
        for m, p in predictions.items():
            e = truth - F.col(p)
            out |= {f"sa_{m}": F.abs(e), f"ss_{m}": e * e}
        return out
    one = lambda c: c.cast("double")
    out |= {f"t{k}": one(truth == k) for k in range(classes)}
    for m, p in predictions.items():
        guess = (F.col(p) >= 0.5).cast("int") if task == "binary" else arg_max(F.col(p))
        out[f"h_{m}"] = one(guess == truth)
        out |= {f"g{k}_{m}": one(guess == k) for k in range(classes)} | {f"x{k}_{m}": one((guess == k) & (truth == k)) for k in range(classes)}
        if task == "multiclass":
            out[f"l_{m}"] = -F.log(F.greatest(F.least(F.element_at(F.col(p), truth + 1), F.lit(1 - EPSILON)), F.lit(EPSILON)))
    return out


def metric_columns(model: str, task: str, classes: int = 2, point: Column | None = None) -> dict[str, Column]:
    """Metrics of a model from summed vectors. Where ``point`` holds, r2 of a constant target is 1 if it is met exactly, else 0; in replicates it is undefined."""
    n, c = F.col("n"), lambda name: F.col(f"{name}_{model}")
    if task == "regression":
        sst = F.col("syy") - F.col("sy") * F.col("sy") / n
        varied = (F.col("lo") < F.col("hi")) & (sst > 1e-13 * F.col("syy"))
        r2 = F.when(varied, 1 - c("ss") / sst)
        if point is not None:
            r2 = F.when(point & (F.col("lo") == F.col("hi")) & (n >= 2), F.when(c("ss") == 0, 1.0).otherwise(0.0)).when(n >= 2, r2)
        return {"mae": c("sa") / n, "rmse": F.sqrt(c("ss") / n), "r2": r2}
    f1 = [F.coalesce(ratio(2.0 * c(f"x{k}"), F.col(f"t{k}") + c(f"g{k}")), F.lit(0.0)) for k in range(classes)]
    out = {"accuracy": c("h") / n}
    if task == "binary":
        return out | {"f1": f1[1]}
    return out | {"macro_f1": sum(f1[1:], f1[0]) / classes, "weighted_f1": sum((f1[k] * F.col(f"t{k}") for k in range(1, classes)), f1[0] * F.col("t0")) / n, "log_loss": c("l") / n}


def unit_vectors(rows: DataFrame, unit: str, stratum: str, y: str, predictions: dict[str, str], task: str, classes: int) -> tuple[DataFrame, list[str]]:
    """(slice, stratum, unit, n, sums) of each unit, kept, and the names of the sums. Targets are summed from their slice's mean, so that large offsets don't cancel."""
    values = row_values(y, predictions, task, classes)
    t = F.col(y)
    more = [F.avg(t).alias("__own"), (F.var_pop(t) * F.count(t)).alias("__within"), F.min(t).cast("double").alias("lo"), F.max(t).cast("double").alias("hi")] if task == "regression" else []
    each = kept(rows.groupBy(*BY, stratum, unit).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(v).alias(name) for name, v in values.items()), *more), "units")
    names = ["n", *values]
    if task != "regression":
        return each, names
    middle = each.groupBy(*BY).agg((F.sum(F.col("n") * F.col("__own")) / F.sum("n")).alias("__mean"))
    gap = F.col("__own") - F.col("__mean")
    moved = each.join(middle, BY).withColumn("sy", F.col("n") * gap).withColumn("syy", F.col("__within") + F.col("n") * gap * gap)
    return moved.drop("__own", "__within", "__mean"), [*names, "sy", "syy", "lo", "hi"]


# --- occurrences of units in replicates


def _seed(*key) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, key)).encode(), digest_size=8).digest(), "little")


def _generator(key: int, b: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=key | b << 64))


def draw_counts(key: int, first: int, sizes: np.ndarray, units: int) -> np.ndarray:
    """A row for each replicate from ``first`` on: how often each of ``units`` equal units occurs among its draws."""
    out = np.empty((len(sizes), units), np.int64)
    for i, n in enumerate(sizes.tolist()):
        own = _generator(key, first + i)
        out[i] = np.bincount(own.integers(0, units, n), minlength=units) if n <= 16 * units else own.multinomial(n, np.full(units, 1 / units))
    return out


def _shares(resamples: int, seed: int):
    """Of a stratum's units by range, how many draws of each replicate fall into each range."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts = sorted((p["part"], p["k"]) for p in row["parts"])
                total = sum(k for _, k in parts)
                key = _seed(seed, "ranges", *(row[c] for c in (*BY, "stratum")))
                shares = np.array([_generator(key, b).multinomial(total, [k / total for _, k in parts]) for b in range(resamples)], np.int64).reshape(resamples, len(parts)).T
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in (*BY, "stratum")}, "part": p, "share": s.tolist()} for (p, _), s in zip(parts, shares)], _SHARE)

    return run


_SHARE = pa.schema([("slice_column", pa.string()), ("slice_value", pa.string()), ("stratum", pa.string()), ("part", pa.int32()), ("share", pa.list_(pa.int32()))])
_EXTREME = {"lo": (np.minimum, np.inf), "hi": (np.maximum, -np.inf)}


def _blocks(resamples: int, units: int):
    step = max(1, CELLS // max(units, 1))
    return ((a, min(a + step, resamples)) for a in range(0, resamples, step))


def _replicate_sums(names: list[str], resamples: int, seed: int, keep_times: bool, flips: bool):
    """Of a range of units, the sums of each replicate, or the occurrences of each unit as bytes; in both the last replicate has every unit once."""
    added = [i for i, c in enumerate(names) if c not in _EXTREME]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _empty(names, keep_times)
        left = left.sort_by("unit")
        key = [left.column(c)[0].as_py() for c in (*BY, "stratum", "part")]
        seeded, m = _seed(seed, *key), left.num_rows
        share = np.asarray(right.column("share")[0].values, np.int64)
        values = np.stack([np.asarray(left.column(c), np.float64) for c in names], axis=1)
        sums, times = np.zeros((resamples + 1, len(names))), np.ones((m, resamples + 1), np.uint16) if keep_times else None
        for a, b in _blocks(resamples, m):
            if flips:
                counts = np.stack([_generator(seeded, i).integers(0, 2, m) for i in range(a, b)])
            else:
                counts = draw_counts(seeded, a, share[a:b], m)
            if keep_times:
                times[:, a:b] = np.minimum(counts.T, 65535)
                continue
            sums[a:b, added] = counts @ values[:, added]
            for i, c in enumerate(names):
                if c in _EXTREME:
                    pick, none = _EXTREME[c]
                    sums[a:b, i] = pick.reduce(np.where(counts > 0, values[:, i], none), axis=1)
        if keep_times:
            return pa.table({"slice_column": pa.array([key[0]] * m, pa.string()), "slice_value": pa.array([key[1]] * m, pa.string()), "unit": left.column("unit"), "times": pa.array([t.tobytes() for t in times], pa.binary())})
        sums[resamples, added] = values[:, added].sum(axis=0)
        for i, c in enumerate(names):
            if c in _EXTREME:
                sums[resamples, i] = _EXTREME[c][0].reduce(values[:, i])
        head = {c: pa.array([k] * (resamples + 1), pa.string()) for c, k in zip(BY, key)}
        return pa.table({**head, "b": pa.array(np.arange(resamples + 1)), **{c: pa.array(sums[:, i]) for i, c in enumerate(names)}})

    return run


def _empty(names: list[str], keep_times: bool) -> pa.Table:
    kinds = [(c, pa.string()) for c in BY] + ([("unit", pa.string()), ("times", pa.binary())] if keep_times else [("b", pa.int64()), *((c, pa.float64()) for c in names)])
    return pa.schema(kinds).empty_table()


def _ranged(units: DataFrame, resamples: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Units with their range by hash, and the share of each range's draws. There are so many ranges that none exceeds RANGE by much."""
    ranges = max(1, -(-units.count() // RANGE))
    parted = units.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(ranges)).cast("int"))
    sizes = parted.groupBy(*BY, "stratum", "part").agg(F.count(F.lit(1)).alias("k")).groupBy(*BY, "stratum").agg(F.collect_list(F.struct("part", "k")).alias("parts"))  # a number for each range
    return parted, sizes.mapInArrow(_shares(resamples, seed), "slice_column string, slice_value string, stratum string, part int, share array<int>")


def _combined(names: list[str]) -> list[Column]:
    return [{"lo": F.min, "hi": F.max}.get(c, F.sum)(c).alias(c) for c in names]


def replicate_sums(units: DataFrame, names: list[str], resamples: int, seed: int, mode: str = "counts", flips: bool = False) -> DataFrame:
    """(slice, b, sums) of every replicate; ``units`` has slice, stratum, unit and ``names``. With ``flips`` a replicate takes each unit or leaves it, by a fair coin."""
    if mode == "counts":
        parted, shares = _ranged(units, resamples, seed)
        kinds = "slice_column string, slice_value string, b long, " + ", ".join(f"{c} double" for c in names)
        keys = [*BY, "stratum", "part"]
        found = parted.groupBy(*keys).cogroup(shares.groupBy(*keys)).applyInArrow(_replicate_sums(names, resamples, seed, False, flips), kinds)
        return found.groupBy(*BY, "b").agg(*_combined(names))
    strata = [*BY, "stratum"]
    whole = units.groupBy(*BY).agg(*_combined(names)).withColumn("b", F.lit(resamples).cast("long")).select(*BY, "b", *names)
    if not resamples:
        return whole
    if flips:
        every = resampling.numbered(units.repartition(task_count(units)), F.lit(resamples), "b").where(_coin(seed, mode))
        return every.groupBy(*BY, "b").agg(*_combined(names)).unionByName(whole)
    rows = units.count()
    table = kept(resampling.indexed(units, "unit", strata, rows), "slots")
    extremes = {c: "min" if c == "lo" else "max" for c in names if c in _EXTREME}
    return tallies.slot_sums(table, strata, BY, names, extremes, rows, resamples, seed, mode, resampling.draw).groupBy(*BY, "b").agg(*_combined(names)).unionByName(whole)


def _coin(seed: int, mode: str) -> Column:
    return resampling.draw(F.lit(2), seed + 1, F.concat_ws("/", *BY), F.col("b"), F.col("unit"), mode=mode) == 1


def occurrences(units: DataFrame, resamples: int, seed: int, mode: str = "counts", flips: bool = False) -> DataFrame:
    """(slice, unit, times): how often each unit occurs in each replicate, as bytes of 16-bit numbers; the last one is 1."""
    if mode == "counts":
        parted, shares = _ranged(units, resamples, seed)
        keys = [*BY, "stratum", "part"]
        return parted.groupBy(*keys).cogroup(shares.groupBy(*keys)).applyInArrow(_replicate_sums(["n"], resamples, seed, True, flips), "slice_column string, slice_value string, unit string, times binary")
    if not resamples:
        return units.select(*BY, "unit", F.lit(np.ones(1, np.uint16).tobytes()).alias("times"))
    strata = [*BY, "stratum"]
    if not flips:
        rows = units.count()
        table = kept(resampling.indexed(units, "unit", strata, rows), "slots")
        return tallies.slot_times(table, strata, [*BY, "unit"], rows, resamples, seed, mode, resampling.draw)
    counted = resampling.numbered(units.repartition(task_count(units)), F.lit(resamples), "b").where(_coin(seed, mode)).select(*BY, "unit", "b", F.lit(1).alias("times"))
    lists = units.select(*BY, "unit").join(counted.groupBy(*BY, "unit").agg(F.collect_list(F.struct(F.col("b").cast("int").alias("b"), F.col("times").cast("int").alias("times"))).alias("times")), [*BY, "unit"], "left")

    def packed(batches):
        for batch in batches:
            out = []
            for own in batch.column(3).to_pylist():
                line = np.zeros(resamples + 1, np.uint16)
                line[resamples] = 1
                for x in own or ():
                    line[x["b"]] = x["times"]
                out.append(line.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], [*BY, "unit", "times"])

    return lists.select(*BY, "unit", "times").mapInArrow(packed, "slice_column string, slice_value string, unit string, times binary")


# --- areas under curves


def _of_model(name: str):
    return lambda s: F.struct(F.lit(name).alias("model"), s["class"].alias("class"), s["score"].alias("score"))


def score_cells(rows: DataFrame, unit: str, y: str, predictions: dict[str, str], task: str, classes: int) -> DataFrame:
    """(slice, unit, model, class, score, pos, neg): rows of each unit, class and score, once for each class against the rest (for binary tasks the second class alone)."""
    each = []
    for m, p in predictions.items():
        scores = F.array(F.struct(F.lit(1).alias("class"), F.col(p).cast("double").alias("score"))) if task == "binary" else F.transform(F.col(p), lambda x, i: F.struct(i.alias("class"), x.alias("score")))
        each.append(F.transform(scores, _of_model(m)))
    flat = rows.select(*BY, F.col(unit).alias("unit"), F.col(y).alias("__y"), F.explode(F.concat(*each)).alias("x")).select(*BY, "unit", "x.*", (F.col("__y") == F.col("x.class")).alias("is"))
    return flat.groupBy(*BY, "unit", "model", "class", "score").agg(F.count_if("is").cast("double").alias("pos"), F.count_if(~F.col("is")).cast("double").alias("neg"))


def _areas(resamples: int, models: list[str], flips: bool):
    """Of a range of scores of one slice and class, each model's positives, negatives, and pairs of them in the right order, in each replicate."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("score")
        score, model = np.asarray(table.column("score"), np.float64), np.asarray(table.column("model").to_pylist(), object)
        pos, neg = np.asarray(table.column("pos"), np.float64), np.asarray(table.column("neg"), np.float64)
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint16).reshape(len(score), resamples + 1)
        begin = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        out = {c: [] for c in ("model", "b", "pos", "neg", "wins")}
        for side in models:
            for a, b in _blocks(resamples + 1, len(score)):
                w = times[:, a:b].astype(np.float64)
                own = model == side
                if flips:  # a unit that is flipped has the other model's scores; the last replicate has none flipped
                    w[:, np.arange(a, b) == resamples] = 0.0
                    w = np.where(own[:, None], 1.0 - w, w)
                else:
                    w *= own[:, None]
                p, q = np.add.reduceat(w * pos[:, None], begin), np.add.reduceat(w * neg[:, None], begin)
                wins = (p * (np.cumsum(q, axis=0) - q / 2)).sum(axis=0)
                for c, v in (("model", [side] * (b - a)), ("b", np.arange(a, b)), ("pos", p.sum(axis=0)), ("neg", q.sum(axis=0)), ("wins", wins)):
                    out[c].append(pa.array(v))
        head = {c: pa.array([table.column(c)[0].as_py()] * (len(models) * (resamples + 1)), k) for c, k in ((BY[0], pa.string()), (BY[1], pa.string()), ("class", pa.int32()), ("range", pa.int32()))}
        return pa.table({**head, **{c: pa.concat_arrays(v) for c, v in out.items()}})

    return run


def replicate_areas(cells: DataFrame, times: DataFrame, resamples: int, models: list[str], curves: int, flips: bool = False) -> DataFrame:
    """(slice, model, b, area): the mean of the areas under ``curves`` curves, one for each class, null if any is undefined. Scores are dealt by ranges, whose areas add up with what lies below them."""
    from pyspark.sql import Window as W

    cells = kept(cells, "cells")
    parts = -(-cells.count() // SCORES)
    cuts = sorted(set(cells.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 10_000)).first()[0] or [])) if parts > 1 else []
    at = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("score"))) if cuts else F.lit(0)
    rows = cells.join(times, [*BY, "unit"]).withColumn("range", at.cast("int"))
    kinds = "slice_column string, slice_value string, class int, range int, model string, b long, pos double, neg double, wins double"
    found = rows.groupBy(*BY, "class", "range").applyInArrow(_areas(resamples, models, flips), kinds)
    below = W.partitionBy(*BY, "class", "model", "b").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # ranges of one replicate
    whole = found.withColumn("wins", F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0.0))) if parts > 1 else found
    each = whole.groupBy(*BY, "class", "model", "b").agg(ratio(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("area"))
    return each.groupBy(*BY, "model", "b").agg(F.when(F.count("area") == curves, F.avg("area")).alias("area"))


# --- designs


def keyed_rows(df: DataFrame, key: str, y: str, predictions: dict[str, str], slices: list[str], design: SamplingDesign | None, task: str) -> DataFrame:
    """(slice, __stratum, __unit, y, predictions): the whole table as the slice ('', ''), and once for each slice column. Without a design units are rows, in strata of the target's class."""
    if design is not None and design.method != "cluster_bootstrap":
        raise ValueError("slices and comparisons are drawn by clusters or rows; levels by resampling.nested")
    unit = F.col(design.cluster_columns[0] if design else key).cast("string")
    stratum = F.col(design.strata_column).cast("string") if design and design.strata_column else F.lit("") if design or task == "regression" else F.col(y).cast("string")
    plain = df.select(unit.alias("__unit"), stratum.alias("__stratum"), F.col(y), *dict.fromkeys(predictions.values()), *(F.col(c).alias(f"__s_{i}") for i, c in enumerate(slices)))
    names = F.array(F.struct(F.lit("").alias("slice_column"), F.lit("").alias("slice_value")), *(F.struct(F.lit(c).alias("slice_column"), F.coalesce(F.col(f"__s_{i}").cast("string"), F.lit("<NA>")).alias("slice_value")) for i, c in enumerate(slices)))
    return plain.withColumn("__slice", F.explode(names)).select("__slice.*", "__stratum", "__unit", y, *dict.fromkeys(predictions.values()))


def plan_table(units: DataFrame, design: SamplingDesign | None, least: int) -> DataFrame:
    """(slice, n, n_units, status): whether a slice can be drawn from. What a replicate may hold is bounded by the units of a stratum times its largest one, and by its smallest one from below: beyond
    the limit for sure is too much, below it for sure is fine, and ``undecided`` is what counting draws have to tell. Nothing is drawn here.
    """
    limit = design.max_resample_rows if design else resampling.MOST_ROWS
    clean = units.withColumn("__absent", (F.col("unit").isNull() | (F.trim("unit") == "")).cast("int"))
    by = clean.groupBy(*BY, "stratum").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.max("n").alias("most"), F.min("n").alias("fewest"), F.sum("__absent").alias("absent"))
    all_of = by.groupBy(*BY).agg(F.sum("n").cast("long").alias("n"), F.sum("k").alias("n_units"), F.sum(F.col("k") * F.col("most")).alias("__high"), F.sum(F.col("k") * F.col("fewest")).alias("__low"), F.min("k").alias("__k"), F.sum("absent").alias("__absent"), F.count(F.lit(1)).alias("__strata"))
    mixed = units.groupBy(*BY, "unit").agg(F.count(F.lit(1)).alias("s")).where("s > 1").select(*BY).distinct().withColumn("__mixed", F.lit(True))
    status = F.when(F.col("__absent") > 0, "missing_unit_ids")
    if design:
        status = status.when(F.col("__mixed"), "non_constant_strata").when(F.col("n_units") < design.min_independent_units, "skipped_min_independent_units")
        status = status.when((F.col("__k") < 2) & F.lit(design.strata_column is not None), "skipped_min_units_per_stratum")
    status = status.when(F.col("n") < least, "skipped_min_samples").when(F.col("__low") > limit, "not_supported_resource_limit").when(F.col("__high") > limit, "undecided").otherwise("evaluated")
    return all_of.join(mixed, BY, "left").select(*BY, "n", "n_units", status.alias("status"))


def decided(units: DataFrame, design: SamplingDesign | None, least: int, resamples: int, seed: int, mode: str) -> DataFrame:
    """``plan_table`` with every slice decided, kept: sizes of replicates are drawn, without any metric, only for slices whose bounds don't tell."""
    table = kept(plan_table(units, design, least), "plan")
    open_ = table.where("status = 'undecided'").select(*BY)
    if not open_.limit(1).count():
        return table
    limit = design.max_resample_rows if design else resampling.MOST_ROWS
    sizes = replicate_sums(units.join(open_, BY, "left_semi").select(*BY, "stratum", "unit", "n"), ["n"], resamples, seed, mode).where(F.col("b") < resamples).groupBy(*BY).agg(F.max("n").alias("__most"))
    status = F.when(F.col("status") != "undecided", F.col("status")).when(F.col("__most") > limit, "not_supported_resource_limit").otherwise("evaluated")
    return kept(table.join(sizes, BY, "left").select(*BY, "n", "n_units", status.alias("status")), "plan")


def _values(units: DataFrame, names: list[str], rows: DataFrame, y: str, predictions: dict[str, str], task: str, classes: int, wanted: list[str], resamples: int, seed: int, mode: str, flips: bool = False) -> DataFrame:
    """(slice, b, model, metric, value) of every replicate; with ``flips`` models have changed places in the units that were flipped."""
    models = list(predictions)
    points = F.col("b") == resamples
    out = None
    if any(m not in _AREAS for m in wanted):
        if flips:
            own = [c[:-2] for c in names if c.endswith("_a")]
            moved = units.select(*BY, "stratum", "unit", *(c for c in names if not c.endswith(("_a", "_b"))), *(F.col(f"{c}_{m}") for c in own for m in "ab"), *((F.col(f"{c}_b") - F.col(f"{c}_a")).alias(f"d_{c}") for c in own))
            whole = moved.groupBy(*BY).agg(*_combined(names))
            gaps = replicate_sums(moved, [f"d_{c}" for c in own], resamples, seed, mode, True)
            gap = lambda c: F.when(points, 0.0).otherwise(F.col(f"d_{c}"))
            every = whole.join(resampling.numbered(whole.select(*BY), F.lit(resamples + 1), "b"), BY).join(gaps, [*BY, "b"], "left").na.fill(0.0, [f"d_{c}" for c in own])
            sums = every.select(*BY, "b", *(c for c in names if not c.endswith(("_a", "_b"))), *((F.col(f"{c}_a") + gap(c)).alias(f"{c}_a") for c in own), *((F.col(f"{c}_b") - gap(c)).alias(f"{c}_b") for c in own))
        else:
            sums = replicate_sums(units, names, resamples, seed, mode)
        each = [F.struct(F.lit(m).alias("model"), F.lit(name).alias("metric"), v.alias("value")) for m in models for name, v in metric_columns(m, task, classes, points).items() if name in wanted]
        out = sums.select(*BY, "b", F.explode(F.array(*each)).alias("x")).select(*BY, "b", "x.*")
    for name in _AREAS:
        if name in wanted:
            cells = score_cells(rows, "__unit", y, predictions, task, classes)
            times = occurrences(units.select(*BY, "stratum", "unit", "n"), resamples, seed, mode, flips)
            areas = replicate_areas(cells, times, resamples, models, 1 if task == "binary" else classes, flips).select(*BY, "b", "model", F.lit(name).alias("metric"), F.col("area").alias("value"))
            out = areas if out is None else out.unionByName(areas)
    return out


def _prepared(df, key, y, predictions, task, classes, slices, design, metrics):
    wanted = list(metrics or METRICS[task])
    if unknown := [m for m in wanted if m not in METRICS[task]]:
        raise ValueError(f"{task} has no interval of {unknown}")
    rows = keyed_rows(df, key, y, predictions, list(slices), design, task)
    units, names = unit_vectors(rows, "__unit", "__stratum", y, predictions, task, classes)
    return wanted, rows, units.withColumnRenamed("__unit", "unit").withColumnRenamed("__stratum", "stratum"), names


def metric_intervals(df: DataFrame, key: str, y: str, prediction: str, task: str, classes: int = 2, metrics: list[str] | None = None, slices: tuple[str, ...] = (), design: SamplingDesign | None = None, config: BootstrapConfig = BootstrapConfig(), mode: str = "counts") -> DataFrame:
    """(slice_column, slice_value, metric, n, n_units, estimate, lower, upper, valid_resamples, status) of every metric of a task; the whole table is the slice ('', '').

    ``y`` is a number, or a class index with ``prediction`` the score of class 1 or the probabilities. Slices are computed if the config includes them. A slice that can't be drawn from has its
    status and point estimates alone; null slice values are '<NA>'; a null unit makes the slices that hold it ``missing_unit_ids``; an empty table gives no rows.
    """
    wanted, rows, units, names = _prepared(df, key, y, {"a": prediction}, task, classes, slices if config.include_slices else (), design, metrics)
    plan = decided(units, design, config.min_samples, config.resamples, config.seed, mode) if config.enabled else plan_table(units, design, config.min_samples).withColumn("status", F.lit("disabled"))
    fine, spoilt = plan.where("status = 'evaluated'").select(*BY), plan.where("status <> 'evaluated'").select(*BY)
    drawn = _values(units.join(fine, BY, "left_semi"), names, rows.join(fine, BY, "left_semi"), y, {"a": prediction}, task, classes, wanted, config.resamples, config.seed, mode)
    still = _values(units.join(spoilt, BY, "left_semi"), names, rows.join(spoilt, BY, "left_semi"), y, {"a": prediction}, task, classes, wanted, 0, config.seed, mode) if spoilt.limit(1).count() else None
    values = kept(drawn, "values")
    point = values.where(F.col("b") == config.resamples).select(*BY, "metric", F.col("value").alias("estimate"))
    found = resampling.interval(values.where(F.col("b") < config.resamples), "value", config.resamples, [*BY, "metric"], config.confidence_level).withColumnRenamed("status", "__own")
    out = point.join(found, [*BY, "metric"])
    if still is not None:
        none = lambda t, c: F.lit(None).cast(t).alias(c)
        out = out.unionByName(still.select(*BY, "metric", F.col("value").alias("estimate"), none("double", "lower"), none("double", "upper"), F.lit(0).cast("long").alias("valid_resamples"), none("string", "__own")))
    status = F.when(F.col("status") != "evaluated", F.col("status")).when(F.col("estimate").isNull(), "undefined_point_estimate").otherwise(F.col("__own"))
    return out.join(plan, BY).select(*BY, "metric", "n", "n_units", "estimate", "lower", "upper", "valid_resamples", status.alias("status"))


def paired_intervals(pairs: DataFrame, key: str, y: str, a: str, b: str, task: str, classes: int = 2, metrics: list[str] | None = None, slices: tuple[str, ...] = (), design: SamplingDesign | None = None, config: PairedConfig = PairedConfig(), mode: str = "counts") -> DataFrame:
    """(slice_column, slice_value, metric, n, n_units, metric_a, metric_b, improvement, lower, upper, valid_resamples, status, winner, decision, noninferiority, p_value, prespecified, adjusted_p, reject, test_status)
    of two models on the same rows (as ``paired.aligned`` gives them), for the whole table and every slice at once.

    Both models share each draw. Slices have intervals if the config includes slice uncertainty, and tests if the design has a multiplicity policy; the whole table has both. A swap test needs units that are
    rows or that the design declares exchangeable. The policy's family is adjusted for each metric; a declared critical slice that is absent is a row with the status missing_prespecified_slice.
    Slices of fewer than min_slice_size rows are skipped_min_slice_size.
    """
    from quillmark.operators.paired import interval_decision, winner

    critical = list(design.critical_slices) if design else []
    slices = tuple(dict.fromkeys([*slices, *(c for c, _ in critical)]))
    predictions = {"a": a, "b": b}
    wanted, rows, units, names = _prepared(pairs, key, y, predictions, task, classes, slices, design, metrics or ([config.metric] if config.metric else None))
    plan = decided(units, design, config.min_samples, config.resamples, config.seed, mode)
    whole = F.col("slice_column") == ""
    plan = plan.withColumn("status", F.when(~whole & (F.col("n") < config.min_slice_size), "skipped_min_slice_size").otherwise(F.col("status")))
    policy = design.multiplicity if design else None
    fine = plan.where((F.col("status") == "evaluated") & (whole | F.lit(config.include_slice_uncertainty))).select(*BY)
    tested = plan.where((F.col("status") == "evaluated") & (whole | F.lit(policy is not None))).select(*BY)
    gain = lambda frame: frame.groupBy(*BY, "b", "metric").agg(F.max(F.when(F.col("model") == "a", F.col("value"))).alias("metric_a"), F.max(F.when(F.col("model") == "b", F.col("value"))).alias("metric_b")).withColumn(
        "improvement", F.when(F.col("metric").isin([m for m in wanted if DIRECTIONS[m] == "lower_is_better"]), F.col("metric_b") - F.col("metric_a")).otherwise(F.col("metric_a") - F.col("metric_b"))
    )
    run = lambda which, n, flips=False: _values(units.join(which, BY, "left_semi"), names, rows.join(which, BY, "left_semi"), y, predictions, task, classes, wanted, n, config.seed, mode, flips)
    point = kept(gain(run(plan.select(*BY), 0)).drop("b"), "points")
    drawn = gain(run(fine, config.resamples)).where(F.col("b") < config.resamples)
    found = resampling.interval(drawn, "improvement", config.resamples, [*BY, "metric"], config.confidence_level).withColumnRenamed("status", "__own")
    out = point.join(plan, BY).join(found, [*BY, "metric"], "left")
    declared = design is None or design.exchangeability == "model_vectors_within_clusters"
    need = max(resampling.FEWEST, -(-int(resampling.VALID * 1000) * config.permutations // 1000))
    if config.permutations and declared:
        swapped = gain(run(tested, config.permutations, True)).where(F.col("b") < config.permutations).select(*BY, "metric", F.col("improvement").alias("__v"))
        seen = swapped.join(point.select(*BY, "metric", F.col("improvement").alias("__o")), [*BY, "metric"])
        test = seen.groupBy(*BY, "metric").agg(F.count_if(F.abs("__v") >= F.abs("__o") - 1e-15).alias("extreme"), F.count("__v").alias("usable"))
        out = out.join(test, [*BY, "metric"], "left").withColumn("p_value", F.when((F.col("usable") >= need) & F.col("improvement").isNotNull(), (F.col("extreme") + 1) / (F.col("usable") + 1))).drop("extreme", "usable")
    else:
        out = out.withColumn("p_value", F.lit(None).cast("double"))
    status = F.when(F.col("status") != "evaluated", F.col("status")).when(F.col("improvement").isNull(), "metric_undefined").otherwise(F.coalesce("__own", F.lit("evaluated")))
    out = out.withColumn("status", status).drop("__own")
    if critical:
        wished = df_of(pairs, [(c, v, m) for c, v in critical for m in wanted]).withColumn("prespecified", F.lit(True))
        out = out.join(F.broadcast(wished), [*BY, "metric"], "full_outer").withColumn("status", F.coalesce("status", F.lit("missing_prespecified_slice"))).withColumn("prespecified", F.coalesce("prespecified", F.lit(False)))
    else:
        out = out.withColumn("prespecified", F.lit(False))
    decision, noninferior = interval_decision(F.col("lower"), F.col("upper"), config.practical_threshold, config.noninferiority_margin)
    small = F.col("status") == "skipped_min_slice_size"
    shown = lambda c: F.when(~small, F.col(c)).alias(c)
    out = out.select(
        *BY, "metric", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "n_units", *(shown(c) for c in ("metric_a", "metric_b", "improvement", "lower", "upper")), F.coalesce("valid_resamples", F.lit(0).cast("long")).alias("valid_resamples"), "status",
        F.when(~small, winner(F.col("improvement"))).alias("winner"), F.when(F.col("lower").isNotNull(), decision).alias("decision"), F.when(F.col("lower").isNotNull(), noninferior).alias("noninferiority"), "p_value", "prespecified",
    )
    if policy is None:
        return out.withColumn("adjusted_p", F.lit(None).cast("double")).withColumn("reject", F.lit(None).cast("boolean")).withColumn("test_status", F.lit("not_in_family"))
    out = kept(out, "compared")
    family = (F.col("slice_column") != "") & (F.col("prespecified") == (policy.family == "critical_slices"))
    adjusted = resampling.stepped_up(out.where(family).select(*BY, "metric", "p_value"), "p_value", {"benjamini_hochberg": "bh", "benjamini_yekutieli": "by"}[policy.method], policy.alpha, ["metric"])
    joined = out.join(adjusted.drop("p_value").withColumn("test_status", F.when(F.col("adjusted_p").isNull(), "not_testable").otherwise("evaluated")), [*BY, "metric"], "left")
    return joined.withColumn("test_status", F.coalesce("test_status", F.lit("not_in_family")))


def df_of(like: DataFrame, rows: list[tuple[str, str, str]]) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, "slice_column string, slice_value string, metric string")


__all__ = ["METRICS", "decided", "metric_intervals", "occurrences", "paired_intervals", "plan_table", "replicate_areas", "replicate_sums", "unit_vectors"]
