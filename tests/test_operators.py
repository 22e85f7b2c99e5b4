import math
import random

import pytest
from pyspark.sql import functions as F

from quillmark.governance.privacy import Budget, LedgerBudget, perturbed, release_mean, release_means
from quillmark.operators import audit, evidence, metrics, molecules, paired, privacy, resampling, shift
from quillmark.operators.ordered import running
from quillmark.sources.binding import Binding, bind, read_csv, validate


def test_r2_of_constant_targets(spark):
    rows = [("met", 2.0, 2.0), ("met", 2.0, 2.0), ("missed", 2.0, 3.0), ("missed", 2.0, 2.0), ("one", 1.0, 1.0)]
    got = {r["g"]: r["r2"] for r in metrics.regression(spark.createDataFrame(rows, "g string, y double, p double"), "y", "p", ["g"]).collect()}
    assert got == {"met": 1.0, "missed": 0.0, "one": None}


def test_auroc_with_ties_against_pairs(spark):
    random.seed(1)
    rows = [(random.randint(0, 1), random.randint(0, 5) / 5) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "y int, s double")
    assert math.isclose(metrics.auroc(df, "y", "s").first()["auroc"], want)
    assert metrics.auroc(df.where("y = 1"), "y", "s").first()["auroc"] is None


def test_running_sums_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), F.lit(1).alias("k"))
    for parts in (1, 3, 8):
        got = running(df.repartition(parts), [], "v", ["k"]).collect()
        assert all(r["before_k"] == r["v"] for r in got)


def test_spearman_undefined_for_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert metrics.spearman(df, "y", "p").first()["spearman"] is None


def test_alignment_counts_every_kind_of_difference(spark):
    a = spark.createDataFrame([("1", 1.0, "x"), ("2", 2.0, "x"), ("3", 3.0, None)], "id string, y double, m string")
    b = spark.createDataFrame([("2", 2.5, "x"), ("3", 3.0, "z"), ("4", 4.0, "x")], "id string, y double, m string")
    assert tuple(paired.alignment(a, b, "id", "y", ["m"]).first()) == (1, 1, 1, 1)
    with pytest.raises(ValueError):
        paired.aligned(a.withColumn("p", F.lit(1.0)), b.withColumn("p", F.lit(1.0)), "id", "y", "p")


def test_threshold_zero_is_strict(spark):
    df = spark.range(1).select(paired.point_decision(F.lit(0.0), 0.0).alias("a"), paired.point_decision(F.lit(0.1), 0.1).alias("b"))
    assert tuple(df.first()) == ("no_practical_difference", "practically_better")


def test_bootstrap_keeps_units_and_ignores_partitions(spark):
    units = spark.createDataFrame([(f"u{i}", i % 2, 1, float(i)) for i in range(20)], "u string, s int, n int, sa double")
    one = sorted(map(tuple, resampling.replicates(units, "u", 30, 5, ["n", "sa"], ["s"]).collect()))
    two = sorted(map(tuple, resampling.replicates(units.repartition(7), "u", 30, 5, ["n", "sa"], ["s"]).collect()))
    assert one == two and all(n == 20 for _, n, _ in one)


def test_interval_needs_most_replicates(spark):
    df = spark.range(100).select(F.when(F.col("id") < 70, F.col("id").cast("double")).alias("v"))
    row = resampling.interval(df, "v", 100).first()
    assert row["status"] == "insufficient_valid_resamples" and row["lower"] is None


def test_adjustment_with_missing(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.2)], "label string, p double")
    got = {r["label"]: r["adjusted_p"] for r in resampling.adjusted(df, "p", "by").collect()}
    assert got["d"] is None and math.isclose(got["a"], 0.114167, abs_tol=1e-6) and math.isclose(got["b"], 0.152222, abs_tol=1e-6) and math.isclose(got["e"], 0.570833, abs_tol=1e-6)


def test_plan_status_order(spark):
    df = spark.createDataFrame([("u1", "a"), ("u1", "b"), (None, "a")], "u string, s string")
    assert resampling.plan_status(df, "u", stratum="s").first()["status"] == "missing_unit_ids"
    assert resampling.plan_status(df.where("u is not null"), "u", stratum="s").first()["status"] == "non_constant_strata"


def test_kolmogorov_smirnov_quarter(spark):
    rows = [("reference", float(v)) for v in (1, 2, 3, 4)] + [("current", float(v)) for v in (2, 3, 4, 5)] + [("current", None)]
    row = shift.numeric(spark.createDataFrame(rows, "c string, v double"), "c", "v").first()
    assert row["ks"] == 0.25 and row["missing_current"] == 1


def test_new_and_missing_slices(spark):
    rows = [("reference", 1.0, 1.0, "old")] * 6 + [("current", 1.0, 2.0, "new")] * 6
    got = {r["slice_value"]: r["status"] for r in shift.degradation(spark.createDataFrame(rows, "c string, y double, p double, s string"), "c", "y", "p", ["s"]).collect()}
    assert got == {"old": "missing_slice", "new": "new_slice"}


def test_exclusions_hold_for_evaluation_rows_only(spark):
    df = spark.createDataFrame([("train", None), ("test", None), ("test", 1.0)], "role string, v double")
    got = {r["role"]: (r["kept"], r["excluded"]) for r in audit.eligibility(df, "role", [{"column": "v", "op": "is_missing"}]).collect()}
    assert got == {"train": (1, 0), "test": (1, 1)}


def test_conflicts_by_range_or_label(spark):
    df = spark.createDataFrame([("a", "1.0"), ("a", "1.05"), ("b", "x"), ("b", "y"), ("c", "x")], "e string, t string")
    assert audit.conflicts(df, "e", "t", 0.1).first()[0] == 2


def test_rank_groups_connect_transitively(spark):
    rows = [("m0", 1.0, 0.9, 1.2), ("m1", 1.3, 1.1, 1.5), ("m2", 1.6, 1.4, 1.7), ("m3", 3.0, 2.9, 3.1)]
    got = {r["model"]: r["rank_group"] for r in evidence.rank_groups(spark.createDataFrame(rows, "model string, estimate double, lower double, upper double"), "mae").collect()}
    assert got == {"m0": 1, "m1": 1, "m2": 1, "m3": 2}


def test_pooling_rmse_by_squares(spark):
    sites = spark.createDataFrame([("a", "rmse", 1, 3.0), ("b", "rmse", 1, 4.0), ("a", "r2", 1, 0.5)], "site string, metric string, n int, value double")
    got = {r["metric"]: r for r in evidence.pooled_sites(sites).collect()}
    assert math.isclose(got["rmse"]["pooled"], math.sqrt(12.5)) and got["r2"]["status"] == "not_poolable"


def test_gate_without_evidence_investigates(spark):
    rows = spark.createDataFrame([("overall", "mae", 1.0, "evaluated"), ("s=a", "mae", None, "skipped")], "scope string, metric string, estimate double, status string")
    rules = [{"name": "w", "type": "maximum", "metric": "mae", "scope": "worst", "threshold": 2.0}, {"name": "o", "type": "maximum", "metric": "mae", "scope": "overall", "threshold": 2.0}]
    result = evidence.gate(rows, rules)
    assert {r["rule"]: r["status"] for r in result.collect()} == {"w": "investigate", "o": "pass"}
    assert evidence.gate_overall(result).first()[0] == "investigate"


def test_membership_audit_against_thresholds(spark):
    random.seed(2)
    rows = [(random.random() < 0.4, random.randint(0, 9) / 10) for _ in range(300)]
    m, o = [x for k, x in rows if k], [x for k, x in rows if not k]
    best = max(max(a, 1 - a) for t in {x for _, x in rows} for a in [0.5 * (sum(x <= t for x in m) / len(m) + sum(x > t for x in o) / len(o))])
    row = privacy.membership_audit(spark.createDataFrame(rows, "m boolean, l double"), "m", "l").first()
    assert math.isclose(row["advantage"], 2 * (best - 0.5), abs_tol=1e-9)


def test_partition_is_withheld_whole(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)], "s string")
    assert [tuple(r) for r in privacy.suppressed(df, "s", 2).collect()] == [("s", None, None, "withheld")]
    assert privacy.suppressed(df, "s", 1, ["a"]).first()["status"] == "withheld"
    assert privacy.suppressed(df, "s", 1, ["a", "b"]).count() == 2


def test_budgets(tmp_path):
    for budget in (Budget(1.0), LedgerBudget(str(tmp_path / "ledger.db"), 1.0)):
        for _ in range(10):
            budget.spend(0.1 - 1e-9)
        with pytest.raises(ValueError):
            budget.spend(0.1)
    again = LedgerBudget(str(tmp_path / "ledger.db"), 1.0)
    assert 0.99 < float(again.spent()) < 1
    b = Budget(1.0)
    assert release_mean(0.5, 10, 0, 1, 0.5, b, seed=1) != 0.5
    release_means([("x", 0.1, 5, 0, 1), ("y", 0.2, 5, 0, 1), ("z", 0.3, 5, 0, 1)], 0.5, b, seed=1)
    assert b.spent() <= 1
    assert math.isnan(perturbed({"a": float("nan"), "b": 1.0}, 1.0, 1.0, 3)["a"])


def test_fingerprint_is_unit_length(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "C")], "k int, s string")
    got = molecules.fingerprint(df, "k", "s").groupBy("k").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert all(math.isclose(r["n"], 1.0) for r in got) and len(got) == 2


def test_binding(spark, tmp_path):
    with pytest.raises(ValueError):
        bind(["sample_id", "target", "label", "prediction"])
    (tmp_path / "p.csv").write_text("sample_id,target,prediction,site\n007,1.0,1.5,1\n008,2.0,2.5,2\n")
    b = bind(["sample_id", "target", "prediction", "site"])
    df = read_csv(spark, str(tmp_path / "p.csv"), b, ("site",))
    assert df.first()["sample_id"] == "007" and validate(df, b) is df
    with pytest.raises(ValueError, match="repeated"):
        validate(df.union(df), b)
    with pytest.raises(ValueError, match="missing"):
        validate(df.withColumn("prediction", F.lit(float("nan"))), b)
    with pytest.raises(ValueError):
        Binding(target="x", predictions=("x",))
