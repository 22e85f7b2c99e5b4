"""Draws counted by ranges against draws one by one, and what the registered bootstraps do where tables are large."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import resampling, tallies

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


def drawn(seed, label, b, slot, size):
    return int(hashlib.md5(f"{seed}|{label}|{b}|{slot}".encode()).hexdigest()[:15], 16) % size


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("prefix, first, count", [(b"13||7|", 0, 2_500), (b"13|a/b|199|", 99_700, 600), ("13|日|0|".encode() * 6, 5, 300), (b"1|" * 30, 0, 300)])
def test_hashes_side_by_side(prefix, first, count):
    assert tallies.md5_heads(prefix, first, count).tolist() == [int(hashlib.md5(prefix + str(i).encode()).hexdigest()[:15], 16) for i in range(first, first + count)]


@pytest.mark.parametrize("mode", ["md5", "xxhash64"])
def test_units_of_strata_by_ranges(spark, mode, monkeypatch):
    monkeypatch.setattr(tallies, "BLOCK", 100)
    rows = [(f"u{i:04}", "ab"[i % 3 == 0], 1 + i % 4, None if i % 5 else float(i), -float(i), float(i)) for i in range(1_500)]
    units = spark.createDataFrame([*rows, ("v", None, 1, 1.0, 1.0, 1.0)], "u string, s string, n long, x double, lo double, hi double")
    found = resampling.replicates(units, "u", 12, 5, ["n", "x", "lo", "hi"], ["s"], mode)
    assert "Broadcast" not in planned(found)
    got = {r["b"]: tuple(r)[1:] for r in found.collect()}
    own = {s: sorted(r for r in rows if r[1] == s) for s in "ab"}
    if mode == "md5":
        at = {(s, b, i): drawn(5, s, b, i, len(own[s])) for s in "ab" for b in range(12) for i in range(len(own[s]))}
    else:
        table = resampling.indexed(units.where("s is not null"), "u", ["s"])
        places = table.select("s", "size", F.col("slot").alias("i")).crossJoin(spark.range(12).withColumnRenamed("id", "b"))
        at = {(r.s, r.b, r.i): r.at for r in places.select("s", "b", "i", resampling.draw(F.col("size"), 5, F.col("s"), F.col("b"), F.col("i")).alias("at")).collect()}
    for b in range(12):
        picked = [own[s][at[s, b, i]] for s in "ab" for i in range(len(own[s]))]
        assert got[b] == (sum(r[2] for r in picked), sum(r[3] or 0.0 for r in picked), min(r[4] for r in picked), max(r[5] for r in picked))


def test_sums_of_nothing_are_null_and_of_odd_numbers_odd(spark):
    units = spark.createDataFrame([("a", None, 1.0), ("b", None, float("nan"))], "u string, x double, z double")
    got = {r["b"]: (r["x"], r["z"]) for r in resampling.replicates(units, "u", 8, 1, ["x", "z"], None, "md5").collect()}
    for b in range(8):
        at = [drawn(1, "", b, i, 2) for i in range(2)]
        assert got[b][0] is None and (np.isnan(got[b][1]) if 1 in at else got[b][1] == 2.0)


def test_rows_of_classes_by_ranges(spark):
    rows = [(y, (i * 7) % 11 / 10) for y, n in ((0, 700), (1, 90)) for i in range(n)]
    placed = resampling._placed(spark.createDataFrame(rows, "y int, score double"), "y", "score")
    found = resampling._stratified(placed, "y", 6, 3, "md5")
    assert "Broadcast" not in planned(found).split("CogroupInArrow")[0].split("MapInArrow")[0]
    got = {(r["b"], r["y"], r["score"]): r["times"] for r in found.collect()}
    own = {y: sorted(s for c, s in rows if c == y) for y in (0, 1)}
    assert got == Counter((b, y, own[y][drawn(3, y, b, i, len(own[y]))]) for b in range(6) for y in (0, 1) for i in range(len(own[y])))


def test_draws_are_never_broadcast(spark):
    """The size of draws is estimated from the rows they come from: F1 to F8 of the fourth round."""
    units = spark.range(3_000).select(F.col("id").alias("u"), F.lit(1).cast("long").alias("n"), F.col("id").cast("double").alias("sa"))
    assert "Broadcast" not in planned(resampling.replicates(units, "u", 200, 1, ["n", "sa"], None, "md5"))
    table = resampling.indexed(units, "u", [], 3_000)
    joined = resampling.drawn(table, 200, 1, [], "md5").join(resampling.fitting(table.select("slot", "sa"), 10**9), "slot")
    assert "SortMergeJoin" in planned(joined) and "BroadcastHashJoin" not in planned(joined)


@tables
def test_boot_iid_has_no_joined_draws(spark, monkeypatch):
    """rows are units there."""
    from quillmark.plans.queries import QUERIES

    monkeypatch.setattr(resampling, "drawn", None)
    assert {r["status"] for r in QUERIES["boot_iid"](spark, DATA).collect()} == {"evaluated"}


@tables
def test_boot_delta_cohorts_has_no_joined_draws(spark, monkeypatch):
    """rows are units in strata of cohorts, whose sums are null for the other cohort."""
    from quillmark.plans.queries import QUERIES

    monkeypatch.setattr(resampling, "drawn", None)
    assert QUERIES["boot_delta_cohorts"](spark, DATA).first()["valid_resamples"] == 200


@tables
def test_paired_classes_has_no_joined_draws(spark, monkeypatch):
    """units of all slices are drawn at once."""
    from quillmark.plans.queries import QUERIES

    monkeypatch.setattr(resampling, "drawn", None)
    rows = QUERIES["paired_classes"](spark, DATA).collect()
    assert {r["status"] for r in rows} == {"evaluated", "missing_prespecified_slice"}


@tables
def test_boot_stratified_multiclass_has_no_slot_rows(spark, monkeypatch):
    """rows of classes are counted, neither listed nor joined."""
    from quillmark.plans.queries import QUERIES

    monkeypatch.setattr(resampling, "numbered", None)
    assert {r["valid_resamples"] for r in QUERIES["boot_stratified_multiclass"](spark, DATA).collect()} == {50}


@pytest.fixture
def narrow(monkeypatch):
    """The operators' limit of rows in a replicate at 10, fewer than any table has."""
    monkeypatch.setattr(resampling.intervals, "__defaults__", (0.95, 10))


@tables
def test_boot_cluster_has_no_limit_of_rows(spark, narrow, monkeypatch):
    """neither joined draws nor a limit that its SQL lacks."""
    from quillmark.plans.queries import QUERIES

    monkeypatch.setattr(resampling, "drawn", None)
    assert {r["status"] for r in QUERIES["boot_cluster"](spark, DATA).collect()} == {"evaluated"}


@tables
def test_boot_paired_cluster_has_no_joined_draws(spark, monkeypatch):
    """customers with the sums of two models."""
    from quillmark.plans.queries import QUERIES

    monkeypatch.setattr(resampling, "drawn", None)
    assert QUERIES["boot_paired_cluster"](spark, DATA).first()["valid_resamples"] == 200


@tables
def test_boot_stratified_has_no_slot_rows(spark, monkeypatch):
    """F8: rows of two classes are counted by score, neither listed nor joined."""
    from quillmark.plans.queries import QUERIES

    monkeypatch.setattr(resampling, "numbered", None)
    assert QUERIES["boot_stratified"](spark, DATA).first()["valid_resamples"] == 200


@tables
def test_boot_cluster_strata_has_no_limit_of_rows(spark, narrow):
    """its SQL has no limit of rows."""
    from quillmark.plans.queries import QUERIES

    assert {r["status"] for r in QUERIES["boot_cluster_strata"](spark, DATA).collect()} == {"evaluated"}


@tables
def test_boot_cluster_offset_has_no_limit_of_rows(spark, narrow, monkeypatch):
    """targets far from 0."""
    from quillmark.plans.queries import QUERIES

    monkeypatch.setattr(resampling, "drawn", None)
    assert {r["status"] for r in QUERIES["boot_cluster_offset"](spark, DATA).collect()} == {"evaluated"}


@tables
def test_boot_hier_has_no_limit_of_rows(spark, narrow):
    """its SQL has no limit of rows."""
    from quillmark.plans.queries import QUERIES

    assert {r["status"] for r in QUERIES["boot_hier"](spark, DATA).collect()} == {"evaluated"}


@tables
def test_intervals_binary_has_no_limit_of_rows(spark, monkeypatch):
    """its SQL has no limit of rows."""
    from quillmark.operators import resampled
    from quillmark.plans import resampled_queries

    designs = []
    monkeypatch.setattr(resampled, "metric_intervals", lambda v, *a, design, **b: designs.append(design) or v.limit(1))
    resampled_queries.intervals_binary(spark, DATA)
    assert designs[0].max_resample_rows > 10**18
