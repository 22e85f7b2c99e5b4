"""Keyed resampling plans against plain recomputation from the drawn occurrences."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import resampled, resampling
from quillmark.operators.designs import BootstrapConfig, MultiplicityPolicy, PairedConfig, SamplingDesign
from quillmark.operators.ordered import quantiles, suffix_least

CLUSTERS = SamplingDesign("patient", "cluster_bootstrap", ("unit",), min_independent_units=2, exchangeability="model_vectors_within_clusters")


def area(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg)) if pos and neg else None


def f1(y, g, k):
    hit, both = sum(a == b == k for a, b in zip(y, g)), sum(a == k for a in y) + sum(b == k for b in g)
    return 2 * hit / both if both else 0.0


def plain(task, y, p, k=3):
    if task == "regression":
        e, m = np.subtract(y, p), np.mean(y)
        sst = float(((np.array(y) - m) ** 2).sum())
        return {"mae": float(np.abs(e).mean()), "rmse": float(np.sqrt((e**2).mean())), "r2": 1 - float((e**2).sum()) / sst if max(y) > min(y) else None}
    if task == "binary":
        g = [int(s >= 0.5) for s in p]
        return {"accuracy": float(np.mean(np.equal(y, g))), "f1": f1(y, g, 1), "auroc": area(y, p)}
    g = [int(np.argmax(s)) for s in p]
    areas = [area([a == c for a in y], [s[c] for s in p]) for c in range(k)]
    return {
        "accuracy": float(np.mean(np.equal(y, g))), "macro_f1": sum(f1(y, g, c) for c in range(k)) / k, "weighted_f1": sum(f1(y, g, c) * y.count(c) for c in range(k)) / len(y),
        "log_loss": float(np.mean([-math.log(max(s[a], 2.220446049250313e-16)) for a, s in zip(y, p)])), "macro_auroc_ovr": None if None in areas else sum(areas) / k,
    }


def rows_of(task, n=90, seed=3):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        unit, site = f"u{draw.randint(0, 11)}", draw.choice(["s1", "s2", None])
        if task == "regression":
            y = 1e6 + draw.gauss(0, 1)
            a, b = y + draw.gauss(0, 0.3), y + draw.gauss(0.1, 0.3)
        elif task == "binary":
            y = draw.randint(0, 1)
            a, b = (round(min(1, max(0, 0.4 * y + draw.random() * 0.6)), 1) for _ in "ab")
        else:
            y = draw.randint(0, 2)
            a, b = ([float(x) for x in v / v.sum()] for v in (np.array([draw.choice([1, 2, 3]) + 2 * (c == y) for c in range(3)]) for _ in "ab"))
        out.append((i, y, a, b, unit, site))
    return out


def frame(spark, task, rows):
    kind = {"regression": ("double", "double"), "binary": ("int", "double"), "multiclass": ("int", "array<double>")}[task]
    return spark.createDataFrame(rows, f"id long, y {kind[0]}, a {kind[1]}, b {kind[1]}, unit string, site string")


@pytest.mark.parametrize("task", ["regression", "binary", "multiclass"])
@pytest.mark.parametrize("mode", ["counts", "md5"])
def test_intervals_from_the_occurrences(spark, task, mode):
    rows = rows_of(task)
    config = BootstrapConfig(resamples=100, seed=5, include_slices=True, min_samples=10)
    out = resampled.metric_intervals(frame(spark, task, rows), "id", "y", "a", task, 3, slices=("site",), design=CLUSTERS, config=config, mode=mode)
    got = {(r["slice_column"], r["slice_value"], r["metric"]): r for r in out.collect()}
    _, _, units, _ = resampled._prepared(frame(spark, task, rows), "id", "y", {"a": "a"}, task, 3, ["site"], CLUSTERS, None)
    times = {(r["slice_column"], r["slice_value"], r["unit"]): np.frombuffer(r["times"], np.uint16) for r in resampled.occurrences(units.select(*resampled.BY, "stratum", "unit", "n"), 100, 5, mode).collect()}
    assert {k[:2] for k in got} == {("", ""), ("site", "s1"), ("site", "s2"), ("site", "<NA>")} and {k[2] for k in got} == set(resampled.METRICS[task])
    for column, value in {k[:2] for k in got}:
        own = [r for r in rows if column == "" or (r[5] or "<NA>") == value]
        held = {k[2]: v for k, v in times.items() if k[:2] == (column, value)}
        assert sum(v.astype(int)[:100].sum() for v in held.values()) == 100 * len(held)  # as many draws as units in each replicate
        values = {}
        for b in range(101):
            drawn = [r for r in own for _ in range(int(held[r[4]][b]))]
            for m, v in plain(task, [r[1] for r in drawn], [r[2] for r in drawn]).items():
                values.setdefault(m, []).append(v)
        for m, v in values.items():
            r, fine = got[column, value, m], [x for x in v[:100] if x is not None]
            assert r["n"] == len(own) and r["n_units"] == len(held) and r["valid_resamples"] == len(fine)
            assert r["estimate"] == pytest.approx(v[100], rel=1e-8) and r["estimate"] == pytest.approx(plain(task, [x[1] for x in own], [x[2] for x in own])[m], rel=1e-8)
            if len(fine) >= 80:
                assert r["status"] == "evaluated" and (r["lower"], r["upper"]) == pytest.approx(tuple(np.quantile(fine, [0.025, 0.975])), rel=1e-7)


@pytest.mark.parametrize("task", ["regression", "binary", "multiclass"])
def test_swaps_and_improvements_from_coins(spark, task):
    rows = rows_of(task, 60, 8)
    df = frame(spark, task, rows)
    policy = MultiplicityPolicy("benjamini_hochberg", "critical_slices", 0.05, "independent_or_prds")
    design = SamplingDesign("patient", "cluster_bootstrap", ("unit",), min_independent_units=2, exchangeability="model_vectors_within_clusters", critical_slices=(("site", "s1"), ("site", "none")), multiplicity=policy)
    config = PairedConfig(resamples=100, permutations=100, seed=5, min_samples=5, include_slice_uncertainty=True)
    got = {(r["slice_column"], r["slice_value"], r["metric"]): r for r in resampled.paired_intervals(df, "id", "y", "a", "b", task, 3, None, ("site",), design, config).collect()}
    _, _, units, _ = resampled._prepared(df, "id", "y", {"a": "a", "b": "b"}, task, 3, ["site"], design, None)
    keyed = units.select(*resampled.BY, "stratum", "unit", "n")
    coins, times = ({(r["slice_column"], r["slice_value"], r["unit"]): np.frombuffer(r["times"], np.uint16) for r in resampled.occurrences(keyed, 100, 5, "counts", flips).collect()} for flips in (True, False))
    assert 0.4 < np.mean([v[:100].mean() for v in coins.values()]) < 0.6
    for column, value in (("", ""), ("site", "s1"), ("site", "<NA>")):
        own = [r for r in rows if column == "" or (r[5] or "<NA>") == value]
        sign = {"mae": -1, "rmse": -1, "log_loss": -1}
        whole = [plain(task, [r[1] for r in own], [r[i] for r in own]) for i in (2, 3)]
        for m in resampled.METRICS[task]:
            r, gain = got[column, value, m], lambda a, b, m=m: None if a[m] is None or b[m] is None else (a[m] - b[m]) * sign.get(m, 1)
            seen = gain(*whole)
            assert r["improvement"] == pytest.approx(seen, abs=1e-9) and r["prespecified"] == (value == "s1")
            swapped, drawn = [], []
            for b in range(100):
                flip = {k[2]: v[b] for k, v in coins.items() if k[:2] == (column, value)}
                swapped.append(gain(*(plain(task, [x[1] for x in own], [x[2 + (i ^ int(flip[x[4]]))] for x in own]) for i in (0, 1))))
                again = [x for x in own for _ in range(int(times[column, value, x[4]][b]))]
                drawn.append(gain(*(plain(task, [x[1] for x in again], [x[i] for x in again]) for i in (2, 3))))
            usable, fine = [v for v in swapped if v is not None], [v for v in drawn if v is not None]
            near = sum(abs(abs(v) - abs(seen)) < 1e-9 for v in usable)  # sums in another order may fall on either side
            p = (sum(abs(v) >= abs(seen) + 1e-9 for v in usable) + 1) / (len(usable) + 1)
            assert p - 1e-12 <= r["p_value"] <= p + near / (len(usable) + 1) + 1e-12
            assert r["valid_resamples"] == len(fine) and (r["lower"], r["upper"]) == pytest.approx(tuple(np.quantile(fine, [0.025, 0.975])), abs=1e-8)
    absent = [r for k, r in got.items() if k[1] == "none"]
    assert len(absent) == len(resampled.METRICS[task]) and all(r["status"] == "missing_prespecified_slice" and r["test_status"] == "not_testable" and r["n"] == 0 for r in absent)
    for m in resampled.METRICS[task]:
        assert got["site", "s1", m]["adjusted_p"] == pytest.approx(min(1.0, 2 * got["site", "s1", m]["p_value"])) and got["", "", m]["test_status"] == "not_in_family"


def test_draws_are_multinomial_and_fixed(spark, monkeypatch):
    monkeypatch.setattr(resampled, "RANGE", 40)
    units = spark.createDataFrame([("", "", "x" if i % 3 else "y", f"u{i}", 1.0) for i in range(300)], "slice_column string, slice_value string, stratum string, unit string, n double")
    take = lambda df: {r["unit"]: np.frombuffer(r["times"], np.uint16)[:400].astype(int) for r in resampled.occurrences(df, 400, 7).collect()}
    got = take(units)
    table = np.stack([got[f"u{i}"] for i in range(300)])
    for s in (np.arange(300) % 3 > 0, np.arange(300) % 3 == 0):
        assert (table[s].sum(axis=0) == s.sum()).all()
        assert abs(table[s].mean() - 1) < 1e-9 and abs(table[s].var(axis=1).mean() - (1 - 1 / s.sum())) < 0.03
    pairs = np.corrcoef(table[:3:1][:, :])  # units in one stratum hardly depend on each other
    assert abs(pairs[1, 2]) < 0.2
    again = take(units.repartition(7))
    assert all((again[k] == v).all() for k, v in got.items())
    big = resampled.draw_counts(1, 0, np.array([5000, 5000]), 20)
    assert big.sum(axis=1).tolist() == [5000, 5000] and abs(big - 250).max() < 100


def test_limits_are_told_before_any_draw(spark, monkeypatch):
    rows = [("", "", "", f"u{i}", float(1 + i % 4)) for i in range(40)]
    units = spark.createDataFrame(rows, "slice_column string, slice_value string, stratum string, unit string, n double")
    drawn = resampled.replicate_sums

    def design(limit):
        return SamplingDesign("u", "cluster_bootstrap", ("unit",), min_independent_units=2, max_resample_rows=limit)

    def forbidden(*_, **__):
        raise AssertionError("a draw was made")

    monkeypatch.setattr(resampled, "replicate_sums", forbidden)
    status = lambda limit: resampled.decided(units, design(limit), 20, 100, 1, "counts").first()["status"]
    assert status(39) == "not_supported_resource_limit" and status(160) == "evaluated"
    with pytest.raises(AssertionError):
        status(110)
    monkeypatch.setattr(resampled, "replicate_sums", drawn)
    assert status(101) == "not_supported_resource_limit" and status(150) == "evaluated"
    few = units.limit(10)
    assert resampled.plan_table(few, CLUSTERS, 50).first()["status"] == "skipped_min_samples"
    assert resampled.plan_table(units.unionByName(units.limit(1).withColumn("unit", F.lit(None).cast("string"))), CLUSTERS, 5).first()["status"] == "missing_unit_ids"
    assert resampled.plan_table(units.unionByName(units.limit(1).withColumn("stratum", F.lit("other"))), CLUSTERS, 5).first()["status"] == "non_constant_strata"


def test_rows_without_a_design_and_disabled_intervals(spark):
    rows = rows_of("binary", 80, 4)
    df = frame(spark, "binary", rows)
    got = {r["metric"]: r for r in resampled.metric_intervals(df, "id", "y", "a", "binary", config=BootstrapConfig(resamples=100)).collect()}
    assert all(r["status"] == "evaluated" and r["n"] == r["n_units"] == 80 and r["lower"] <= r["estimate"] <= r["upper"] for r in got.values())
    off = resampled.metric_intervals(df, "id", "y", "a", "binary", config=BootstrapConfig(enabled=False)).collect()
    assert all(r["status"] == "disabled" and r["lower"] is None and r["estimate"] == pytest.approx(got[r["metric"]]["estimate"]) for r in off)
    assert resampled.metric_intervals(df.where("false"), "id", "y", "a", "binary", config=BootstrapConfig(resamples=100)).count() == 0
    same = frame(spark, "regression", [(i, 2.0, 2.0, 2.0, f"u{i}", None) for i in range(30)])
    r2 = {r["metric"]: r for r in resampled.metric_intervals(same, "id", "y", "a", "regression", config=BootstrapConfig(resamples=100)).collect()}["r2"]
    assert r2["estimate"] == 1.0 and r2["valid_resamples"] == 0 and r2["status"] == "insufficient_valid_resamples"
    with pytest.raises(ValueError):
        resampled.metric_intervals(df, "id", "y", "a", "binary", metrics=["mae"])


def test_step_up_against_a_plain_one(spark):
    draw = random.Random(2)
    p = [draw.choice([0.001, 0.01, 0.01, 0.02, 0.3, None, 1.0, draw.random()]) for _ in range(300)]
    df = spark.createDataFrame([(i, x, "f" if i % 3 else "g") for i, x in enumerate(p)], "i int, p double, f string").repartition(5)

    def expected(values, method):
        filled = sorted((1.0 if x is None else x, i) for i, x in values)
        m = len(filled)
        c = sum(1 / k for k in range(1, m + 1)) if method == "by" else 1.0
        out, least = {}, 1.0
        for rank in range(m, 0, -1):
            least = min(least, filled[rank - 1][0] * m * c / rank)
            out[filled[rank - 1][1]] = least
        return {i: None if x is None else out[i] for i, x in values}

    for method in ("bh", "by"):
        got = {r["i"]: r["adjusted_p"] for r in resampling.stepped_up(df, "p", method).collect()}
        want = expected(list(enumerate(p)), method)
        assert all(got[i] == (None if want[i] is None else pytest.approx(want[i], rel=1e-9)) for i in want)
        own = {r["i"]: r["adjusted_p"] for r in resampling.stepped_up(df, "p", method, by=["f"]).collect()}
        for part in (0, 1):
            want = expected([(i, x) for i, x in enumerate(p) if (i % 3 > 0) == bool(part)], method)
            assert all(own[i] == (None if want[i] is None else pytest.approx(want[i], rel=1e-9)) for i in want)
    with pytest.raises(ValueError):
        resampling.stepped_up(spark.createDataFrame([(1.5,)], "p double"), "p", "bh").count()


def test_suffixes_and_quantiles_by_ranges(spark):
    draw = random.Random(1)
    rows = [(float(i), draw.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k double, v double").repartition(6)
    got = {r["k"]: r["least_v"] for r in suffix_least(df, "k", "v").collect()}
    assert all(got[float(i)] == min(v for k, v in rows if k >= i) for i in range(500))
    some = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (3.0, 2.0), (5.0, None), (9.0, 4.0)], "a double, b double")
    r = quantiles(some, {"m": ("a", 0.5), "q": ("a", 0.25), "b": ("b", 0.5)}).first()
    assert (r["m"], r["q"], r["b"]) == (5.0, 4.0, 2.0)
    many = spark.range(200_000).select(((F.col("id") * 7919) % 200_003).cast("double").alias("x"))
    values = np.array([(i * 7919) % 200_003 for i in range(200_000)], float)
    r = quantiles(many, {"a": ("x", 0.05), "b": ("x", 0.5), "c": ("x", 0.999), "lo": ("x", 0.0), "hi": ("x", 1.0)}).first()
    assert tuple(r) == pytest.approx(tuple(np.quantile(values, [0.05, 0.5, 0.999, 0.0, 1.0])))
    assert quantiles(some.where("a is null"), {"m": ("a", 0.5)}).first()["m"] is None


def test_designs_and_policies_check_what_they_say():
    value = {"schema_version": "sampling-design/v1", "unit": "patient", "method": "cluster_bootstrap", "cluster_columns": ["p"], "critical_slices": [{"column": "site", "value": "a"}], "multiplicity": {"schema_version": "multiplicity/v1", "family": "critical_slices"}}
    design = SamplingDesign.from_dict(value)
    assert SamplingDesign.from_dict(design.as_dict()) == design and design.columns == ("p",) and design.sampling_level == "p"
    wrong = [
        {"unit": "1x"}, {"method": "hierarchical_bootstrap"}, {"cluster_columns": []}, {"cluster_columns": ["a", "a"], "method": "hierarchical_bootstrap"}, {"min_independent_units": 1}, {"max_resample_rows": True}, {"resample_rows_within_leaf": True}, {"sampling_level": "q"},
        {"exchangeability": "yes"}, {"strata_column": " "}, {"critical_slices": [{"column": "site"}]}, {"critical_slices": []}, {"other": 1}, {"schema_version": "v2"}, {"multiplicity": {"schema_version": "multiplicity/v1", "method": "benjamini_hochberg"}},
        {"multiplicity": {"schema_version": "multiplicity/v1", "alpha": 1}}, {"critical_slices": [{"column": "s", "value": "a"}] * 2},
    ]
    for change in wrong:
        with pytest.raises(ValueError):
            SamplingDesign.from_dict({**value, **change})
    for change in ({"resamples": 99}, {"confidence_level": 1.0}, {"min_samples": 1}, {"seed": -1}):
        with pytest.raises(ValueError):
            BootstrapConfig(**change)
    for change in ({"permutations": 50}, {"metric": "x"}, {"practical_threshold": -1.0}, {"noninferiority_margin": math.nan}, {"min_slice_size": 0}, {"include_slice_uncertainty": 1}):
        with pytest.raises(ValueError):
            PairedConfig(**change)
