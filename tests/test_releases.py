"""Derived values that are computed anew from approved rows."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import audit, evidence, releases, shift
from quillmark.operators.releases import ReleaseRules

SERIES = "position int, slice_column string, slice_value string, n long, estimate double, lower double, upper double, level double"


def faults(release):
    return sorted((r["key"], r["column"] or "", r["fault"]) for r in release.faults.collect())


def series(spark):
    rows = [(p, "site", s, n, e + 0.1 * p, e + 0.1 * p - 0.01, e + 0.1 * p + 0.01, 0.95) for p in range(3) for s, n, e in (("a", 10, 1.0), ("b", 20, 2.0))]
    return spark.createDataFrame(rows, SERIES)


RULES = ReleaseRules({"position": [0, 1, 2]}, {"site": ["a", "b"]}, 30, 10)


def test_trend_is_rebuilt(spark):
    v = series(spark)
    stored = evidence.trend_slices(v, "mae")
    clean = releases.trend(v, stored, RULES, "mae")
    assert faults(clean) == [] and clean.table.count() == 6
    forged = stored.withColumn("from_reference", F.when((F.col("position") == 2) & (F.col("slice_value") == "a"), F.lit(0.0)).otherwise(F.col("from_reference"))).where("not (position = 1 and slice_value = 'b')")
    got = releases.trend(v, forged.unionByName(forged.where("position = 0 and slice_value = 'b'")), RULES, "mae")
    assert faults(got) == [("0|site|b", "", "repeated"), ("1|site|b", "", "missing"), ("2|site|a", "from_reference", "differs")]
    assert sorted(map(tuple, got.table.collect()), key=repr) == sorted(map(tuple, clean.table.collect()), key=repr)


def test_noisy_trends_have_no_intervals(spark):
    v = series(spark)
    got = releases.trend(v, evidence.trend_slices(v, "mae"), ReleaseRules(RULES.named, RULES.partitions, 30, 10, True), "mae")
    assert {r["interval_change"] for r in got.table.collect()} == {"undefined"} and got.table.where("low is not null").count() == 0
    assert {f for _, _, f in faults(got)} == {"differs"}


@pytest.mark.parametrize(
    "change",
    [
        lambda v: v.where("not (position = 1 and slice_value = 'b')").unionByName(v.where("position = 1 and slice_value = 'a'")),
        lambda v: v.withColumn("slice_value", F.when(F.col("slice_value") == "b", "c").otherwise("a")), lambda v: v.where("position < 2"), lambda v: v.withColumn("n", F.col("n") - 1),
        lambda v: v.withColumn("n", F.lit(None).cast("long")), lambda v: v.limit(0), lambda v: v.withColumn("slice_value", F.lit(None).cast("string")),
    ],
)
def test_trends_that_may_not_be_shown(spark, change):
    v = series(spark)
    with pytest.raises(ValueError):
        releases.trend(change(v), evidence.trend_slices(v, "mae"), RULES, "mae")


def test_partitions_of_different_sums_are_not_whole(spark):
    cells = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("b", "z", 9)], "slice_column string, slice_value string, n int")
    with pytest.raises(ValueError):
        releases.partitioned(cells, {"a": ["x", "y"], "b": ["z"]}, ["n"])
    with pytest.raises(ValueError):
        releases.partitioned(cells, {"a": ["x", "y"], "c": ["z"]}, ["n"])
    assert releases.partitioned(cells, {"a": ["x", "y"]}, ["n"]).count() == 2


def test_leaderboard_is_rebuilt(spark):
    v = spark.createDataFrame([(f"s{i}", "d", f"m{i}", "1", float(i), i - 0.1, i + 0.1, True, 100) for i in range(4)], "submission string, digest string, model string, revision string, estimate double, lower double, upper double, verified boolean, n int")
    rules = ReleaseRules({"model": [f"m{i}" for i in range(4)]}, least_rows=100)
    stored = evidence.leaderboard(v, "mae")
    assert faults(releases.leaderboard(v, stored, rules, "mae")) == []
    forged = stored.withColumn("place", F.when(F.col("place") == 4, 1).otherwise(F.col("place")))
    assert faults(releases.leaderboard(v, forged, rules, "mae")) == [("s3", "place", "differs")]
    for bad in (v.withColumn("n", F.when(F.col("model") == "m0", 101).otherwise(100)), v.withColumn("n", F.lit(99)), v.withColumn("model", F.lit("m9")), v.withColumn("verified", F.lit(False))):
        with pytest.raises(ValueError):
            releases.leaderboard(bad, stored, rules, "mae")


def test_aggregate_is_rebuilt(spark):
    v = spark.createDataFrame([(m, s, "mae", 10, float(i + j), True, "t", "p", "b") for i, m in enumerate("xy") for j, s in enumerate("st")], "model string, site string, metric string, n int, value double, verified boolean, task string, protocol string, benchmark string")
    rules = ReleaseRules({"model": ["x", "y"], "site": ["s", "t"]}, least_rows=20, least_cell=10)
    stored = evidence.aggregated(v, "mae")
    assert faults(releases.aggregate(v, stored, rules, "mae")) == []
    assert faults(releases.aggregate(v, stored.withColumn("pooled", F.col("pooled") * (1 + 1e-12)), rules, "mae")) == []  # within the tolerance
    assert faults(releases.aggregate(v, stored.withColumn("spread", F.lit(None).cast("double")), rules, "mae")) == [("x|mae", "spread", "differs"), ("y|mae", "spread", "differs")]
    for named in ({"model": ["x"]}, {"site": ["s"]}):
        with pytest.raises(ValueError):
            releases.aggregate(v, stored, ReleaseRules(named), "mae")
    with pytest.raises(ValueError):
        releases.aggregate(v, stored, ReleaseRules(rules.named, least_rows=21), "mae")


def test_degradation_is_rebuilt(spark):
    cells = spark.createDataFrame([("site", "a", 10, 20, 1.0, 2.0), ("site", "b", 30, 20, 3.0, 1.0), ("site", "c", 0, 10, None, 1.0)], "slice_column string, slice_value string, n_reference long, n_current long, reference double, current double")
    size = cells.agg(F.sum("n_reference").alias("tr"), F.sum("n_current").alias("tc"))
    stored = shift.ranked(shift.degradation_of(cells, size, "mae"))
    rules = ReleaseRules({}, {"site": ["a", "b", "c"]}, 40, 10)
    assert faults(releases.degradation(cells, stored, rules, "mae")) == []
    forged = stored.withColumn("status", F.lit("evaluated")).withColumn("rank", F.when(F.col("slice_value") == "a", 2).otherwise(F.col("rank")))
    assert faults(releases.degradation(cells, forged, rules, "mae")) == [("site|a", "rank", "differs"), ("site|c", "status", "differs")]
    with pytest.raises(ValueError):
        releases.degradation(cells, stored, ReleaseRules({}, rules.partitions, 40, 11), "mae")
    with pytest.raises(ValueError):
        releases.degradation(cells, stored, ReleaseRules({}, rules.partitions, 41, 10), "mae")


def test_findings_are_rebuilt(spark):
    rows = spark.createDataFrame([("overlap", 3, "pass"), ("repeated", 2, "warn"), ("conflicts", 0, "not_testable"), ("similar", None, "pair_budget_exceeded"), ("cutoff", None, "pass")], "check string, affected_records long, status string")
    policies = {"overlap": "forbid", "repeated": "review", "conflicts": "forbid", "similar": "forbid", "cutoff": "forbid"}
    got = releases.findings(rows, audit.rolled_up(rows), policies)
    assert faults(got) == [("cutoff", "status", "differs"), ("overlap", "status", "differs"), ("summary", "failed", "differs"), ("summary", "not_testable", "differs"), ("summary", "status", "differs")]
    assert faults(releases.findings(got.table, audit.rolled_up(got.table), policies)) == []
    hidden = rows.withColumn("status", F.lit("not_testable"))
    assert {r["check"]: r["status"] for r in releases.findings(hidden, audit.rolled_up(hidden), policies).table.collect()}["overlap"] == "fail"
    with pytest.raises(ValueError):
        releases.findings(rows, audit.rolled_up(rows), {"overlap": "forbid"})


def test_null_keys_and_values_are_compared(spark):
    a = spark.createDataFrame([(None, 1.0, "x", float("nan")), ("k", None, None, 1.0)], "k string, v double, t string, w double")
    assert releases.compared(a, a, ["k"]).count() == 0
    b = a.withColumn("v", F.lit(2.0)).withColumn("t", F.lit(None).cast("string")).withColumn("extra", F.lit(1))
    got = sorted((r["key"], r["column"], r["stored"], r["rebuilt"]) for r in releases.compared(b, a, ["k"]).where("stored_text is null and rebuilt_text is null").collect())
    assert got == [("<NA>", "v", 2.0, 1.0), ("k", "v", 2.0, None)]
    assert [(r["key"], r["stored_text"], r["rebuilt_text"]) for r in releases.compared(b, a, ["k"]).where("column = 't'").collect()] == [("<NA>", None, "x")]
    assert [r["fault"] for r in releases.compared(a.limit(0), a, ["k"]).collect()] == ["missing"] * 2
    assert [r["fault"] for r in releases.compared(a, a.limit(0), ["k"]).collect()] == ["unknown"] * 2
