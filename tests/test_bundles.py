"""Specifications, packs, publication, readers and the remaining operators on small tables."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmark import cli
from quillmark.governance import bundles, documents, policies
from quillmark.governance.privacy import Budget, LedgerBudget, release_means
from quillmark.operators import audit, evidence, models, paired, resampling, shift
from quillmark.operators.ordered import quantiles
from quillmark.sources import benchmarks, sinks, tables
from quillmark.sources.binding import Binding, client_directory, validate


def test_documents_are_bounded_and_unique(tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        bundles.unique_json(bundles.read_bounded(str(path)))
    with pytest.raises(ValueError):
        bundles.unique_json(b"[NaN]")
    with pytest.raises(ValueError):
        bundles.read_bounded(str(path), 3)


def test_protocols_and_runs(tmp_path):
    known, p = bundles.Protocols(), policies.Protocol("p", "1", "regression", ("mae",))
    known.add(p)
    known.add(p)
    with pytest.raises(ValueError):
        known.add(policies.Protocol("p", "1", "regression", ("rmse",)))
    path = tmp_path / "run.json"
    path.write_text(json.dumps({"protocol": "p@1", "input": "x.csv", "target": "y", "task": "regression"}))
    run = bundles.load_run(str(path), known, p.identity.partition("#")[2])
    assert run.metrics == ("mae",) and run.protocol == p.identity
    with pytest.raises(ValueError):
        bundles.load_run(str(path), known, "0" * 64)
    with pytest.raises(ValueError):
        known.resolve("q")
    (tmp_path / "p.json").write_text(json.dumps({"id": "p", "version": "2", "task": "binary", "metrics": ["auroc"]}))
    assert bundles.load_protocol(str(tmp_path / "p.json")).metrics == ("auroc",)


def test_packs(tmp_path):
    folder = tmp_path / "one"
    folder.mkdir()
    (folder / "c.json").write_text(json.dumps({"task": "regression", "target": "target", "predictions": ["prediction"]}))
    (folder / "p.csv").write_text("sample_id,target,prediction\n" + "".join(f"{i},{i}.0,{i}.5\n" for i in range(8)))
    (folder / "e.json").write_text(json.dumps({"metrics": {"mae": 0.5}}))
    (folder / "pack.json").write_text(json.dumps({"id": "one", "version": "1", "config": "c.json", "predictions": "p.csv", "expected": "e.json"}))
    assert [p.id for p in bundles.packs(str(tmp_path))] == ["one"]
    assert cli.main(["run-pack", str(tmp_path), "one@1"]) == 0
    (folder / "e.json").write_text(json.dumps({"metrics": {"mae": 0.6}}))
    assert cli.main(["run-pack", str(tmp_path), "one"]) == 1
    (folder / "pack.json").write_text(json.dumps({"id": "one", "version": "1", "config": "../x", "predictions": "p.csv", "expected": "e.json"}))
    with pytest.raises(ValueError):
        bundles.load_pack(str(folder))


def test_publication_removes_what_may_no_longer_be_shown(tmp_path):
    path, ledger = str(tmp_path / "out.json"), str(tmp_path / "ledger")
    assert bundles.publish({"a": 1}, path, lambda d: ("allow", []), ledger) == "allow" and (tmp_path / "out.json").exists()
    with bundles.locked(path), pytest.raises(FileExistsError):
        bundles.publish({"a": 1}, path, lambda d: ("allow", []), ledger)
    assert bundles.publish({"a": 2}, path, lambda d: ("deny", ["x"]), ledger) == "deny" and not (tmp_path / "out.json").exists()
    assert len((tmp_path / "ledger").read_text().splitlines()) == 2


def test_small_rules(tmp_path):
    assert bundles.slug("  A b/C! ") == "a-b-c" and bundles.public_family([{"slice_column": "s", "slice_value": "x", "p": 0.1}], {}) is None
    assert bundles.admissible({"estimate": 1.0, "lower": 0.5, "upper": 2.0}, 1.0) and not bundles.admissible({"estimate": 1.0, "lower": 0.5, "upper": 2.0}, 1.1)
    assert bundles.check_scorer({"features": [{"name": "a", "unit": "kg", "scale": 1}], "weights": {"a": 1}}) == [] and bundles.check_scorer({"features": [{"name": "a", "scale": -1}], "weights": {}})
    errors, _ = bundles.check_run({"task": "binary", "target": "y", "predictions": ["p", "y"], "metrics": ["rmse"]}, ["sample_id", "y", "p"])
    assert len(errors) == 3
    signed = documents.signed({"a": 1}, b"k")
    assert bundles.trusted(signed, {"me": b"k"}, ["me"]) == "trusted" and bundles.trusted(signed, {"me": b"k"}, []) == "known_but_not_approved" and bundles.trusted(signed | {"a": 2}, {"me": b"k"}, ["me"]) == "invalid"
    assert "a\\|b" in bundles.markdown_table([{"x": "a|b"}], ["x"]) and bundles.text_table([{"x": None}], ["x"]).endswith("-\n")
    spec = bundles.HiddenBenchmark("b", "1", "regression", "mae", "id", "y")
    assert spec.direction == "lower_is_better" and "y" not in spec.metadata()["columns"]


def test_budgets_charge_all_or_nothing(tmp_path):
    for budget in (Budget(1.0), LedgerBudget(str(tmp_path / "b"), 1.0)):
        with pytest.raises(ValueError):
            budget.spend_all([("a", 0.6), ("b", 0.6)])
        assert budget.spent() == 0
    centers = [("a", 1.0, 10, 0.0, 1.0), ("b", 1.0, 10, 0.0, 1.0)]
    assert set(release_means(centers, 0.5, Budget(1.0))) == {"a", "b"}


def test_pairs_are_checked_before_they_are_joined(spark):
    a = spark.createDataFrame([("1", 1.0, 1.1), ("2", 2.0, 2.1)], "id string, y double, p double")
    for bad in (a.union(a.limit(1)), a.withColumn("p", F.lit(float("inf"))), a.withColumn("id", F.lit(" ")), a.where("false")):
        for pair in ((a, bad), (bad, a)):
            with pytest.raises(ValueError):
                paired.aligned(*pair, "id", "y", "p")
    with pytest.raises(ValueError):
        paired.aligned(a.withColumn("y", F.lit(7.0)), a.withColumn("y", F.lit(7.0)), "id", "y", "p", task="binary")
    assert paired.aligned(a, a, "id", "y", "p").count() == 2
    with pytest.raises(ValueError):
        validate(a.withColumn("p", F.lit(float("inf"))), Binding("id", "y", ("p",)))
    with pytest.raises(ValueError):
        validate(a.withColumn("y", F.lit(7.0)).withColumn("p", F.lit(0.5)), Binding("id", "y", ("p",), "binary"))


def test_comparison_with_clusters_and_slices(spark):
    rows = [(str(i), i % 15, f"s{i % 2}", float(i), i + 0.05, i + 0.15) for i in range(60)]
    v = spark.createDataFrame(rows, "id string, unit int, s string, y double, a double, b double")
    side = lambda c: v.select("id", "unit", "s", "y", F.col(c).alias("p"))
    got = {r["slice_value"]: r for r in paired.compare(side("a"), side("b"), "id", "y", "p", ["s"], "unit", 200, 200, threshold=0.05, exchangeable=True).collect()}
    assert set(got) == {"<all>", "s0", "s1"} and all(abs(r["improvement"] - 0.1) < 1e-9 and r["decision"] == "confident_improvement" and r["p_value"] < 0.05 for r in got.values())
    few = paired.compare(side("a"), side("b"), "id", "y", "p", unit="unit", resamples=40, permutations=40, least=100).first()
    assert few["status"] == "skipped_min_samples" and few["lower"] is None and few["p_value"] is None


def test_guards_and_ladders(spark):
    v = spark.createDataFrame([(i, float(i % 7), float(i % 5), i % 10) for i in range(100)], "id int, y double, p double, unit int")
    units = resampling.unit_sums(v, "y", "p", "unit")
    found = resampling.replicates(units, "unit", 50, 1, list(resampling.SUMS))
    assert {r["status"] for r in resampling.intervals(resampling.totals(units), found, 50).collect()} == {"evaluated"}
    over = resampling.intervals(resampling.totals(units), found, 50, most=99).collect()
    assert {r["status"] for r in over} == {"not_supported_resource_limit"} and all(r["lower"] is None for r in over)
    constant = resampling.unit_sums(v.withColumn("y", F.lit(1e9)), "y", "p", "unit")
    rows = {r["metric"]: r for r in resampling.intervals(resampling.totals(constant), resampling.replicates(constant, "unit", 50, 1, list(resampling.SUMS)), 50).collect()}
    assert rows["r2"]["status"] == "undefined_point_estimate" and rows["mae"]["status"] == "evaluated"
    assert [resampling.ladder(v, *a).first()["status"] for a in ((False,), (True, 101), (True, 100))] == ["disabled", "skipped_min_samples", "evaluated"]
    assert resampling.numbered(spark.range(2), F.lit(2500), "k").where("id = 1").select(F.countDistinct("k"), F.max("k")).first()[:] == (2500, 2499)
    assert resampling.class_metrics(v.select((F.col("y") > 3).cast("int").alias("a"), (F.col("p") > 2).cast("int").alias("b")), "a", "b").first()["n"] == 100


def test_readers(spark, tmp_path):
    with pytest.raises(ValueError):
        client_directory(spark, str(tmp_path), Binding())
    (tmp_path / "a.csv").write_text("sample_id,target,prediction\n1,1.0,x\n")
    with pytest.raises(Exception):
        client_directory(spark, str(tmp_path), Binding()).collect()
    assert tables.columns_of(spark, str(tmp_path / "a.csv")) == ["sample_id", "target", "prediction"]
    digest = benchmarks.file_digests(spark, str(tmp_path / "a.csv")).first()["sha256"]
    assert benchmarks.verified(spark, str(tmp_path / "a.csv"), digest)
    with pytest.raises(ValueError):
        benchmarks.verified(spark, str(tmp_path / "a.csv"), "0")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        archive.writestr("in/x.csv", "mutant,DMS_score\nA1B,0.5\nC2D,1.5\n")
    assert benchmarks.zip_member(spark, str(tmp_path / "z.zip"), "in/x.csv", "mutant string, DMS_score double").agg(F.sum("DMS_score")).first()[0] == 2.0
    (tmp_path / "m.csv").write_text("smiles,label\nCCO,1.0\nC C,2.0\n")
    with pytest.raises(ValueError):
        tables.read_molecules(spark, str(tmp_path / "m.csv"), "label")
    v = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, x double")
    assert tables.table_digest(v, ["id", "x"]).first() == tables.table_digest(v.orderBy(F.desc("id")).repartition(3), ["id", "x"]).first() != tables.table_digest(v.union(v.limit(1)), ["id", "x"]).first()
    with pytest.raises(ValueError):
        tables.owner_table(v.union(v.limit(1)), "id", "x")
    with pytest.raises(ValueError):
        tables.features(v.withColumn("x", F.lit(float("nan"))), ["x"])
    with pytest.raises(ValueError):
        tables.one_group(v, "id")
    assert tables.eligible(v, "id", [{"column": "x", "op": "less_than", "value": 1.5}]).count() == 1
    assert tables.concatenated({"f1": v, "f2": v}, "fold").count() == 4 and tables.with_reference(v, v.select("id")).where("x is null").count() == 2


def test_alignment_with_benchmarks(spark):
    owner = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "sample_id string, target double")
    given = owner.select("sample_id", (F.col("target") + 0.5).alias("prediction"))
    assert benchmarks.align(owner, given, ["sample_id"]).count() == 3
    for bad in (given.limit(2), given.union(given.limit(1)), given.withColumn("target", F.lit(9.0)), given.withColumn("prediction", F.lit(float("inf")))):
        with pytest.raises(ValueError):
            benchmarks.align(owner, bad, ["sample_id"])
    placed = benchmarks.align_positions(owner.withColumn("at", F.col("target")), given.withColumn("at", F.col("prediction") * 10), "at")
    assert [r["prediction"] for r in placed.orderBy("at").collect()] == [1.5, 2.5, 3.5]
    folds = owner.select("sample_id", F.lit("f").alias("fold"))
    benchmarks.check_folds(owner, folds, expected=1)
    with pytest.raises(ValueError):
        benchmarks.check_folds(owner, folds.limit(2), expected=1)


def test_evidence_refuses_what_differs(spark):
    rows = spark.createDataFrame([("m", "a", "mae", 10, 1.0, "t", True), ("m", "b", "mae", 10, 2.0, "t", True)], "model string, site string, metric string, n int, value double, task string, verified boolean")
    assert evidence.aggregated(rows, "mae", ["task"]).first()["pooled"] == 1.5
    for bad in (rows.withColumn("verified", F.col("site") == "a"), rows.withColumn("task", F.col("site")), rows.withColumn("site", F.lit("a")), rows.where("false")):
        with pytest.raises(ValueError):
            evidence.aggregated(bad, "mae", ["task"])
    with pytest.raises(ValueError):
        evidence.aggregated(rows, "mae", ["task"], {"site": ["a"]})
    series = spark.createDataFrame([(0, "2024-01"), (1, "2024-03"), (2, "2024-02")], "position int, period string")
    with pytest.raises(ValueError):
        evidence.check_order(series, "position", "period")
    subs = spark.createDataFrame([("s", "d1", "m", "1", 1.0, None, None, True), ("s", "d2", "m", "1", 1.0, None, None, True)], "submission string, digest string, model string, revision string, estimate double, lower double, upper double, verified boolean")
    with pytest.raises(ValueError):
        evidence.leaderboard(subs, "mae")
    assert evidence.leaderboard(subs.limit(1).union(subs.limit(1)), "mae").count() == 1


def test_audit_roles_budget_and_summary(spark):
    v = spark.createDataFrame([(1, "tr", [1.0, 0.0]), (2, "te", [1.0, 0.1])], "k int, part string, v array<double>")
    rows = audit.mapped_roles(v, "part", {"train": ["tr"], "test": ["te"]})
    with pytest.raises(ValueError):
        audit.mapped_roles(v, "part", {"train": ["tr"]})
    assert audit.near_duplicate_finding(rows, "k", "v", "role", [("train", "test")], 0.9).first()["status"] == "fail"
    assert audit.near_duplicate_finding(rows, "k", "v", "role", [("train", "test")], 0.9, 0).first()["status"] == "pair_budget_exceeded"
    findings = spark.createDataFrame([("a", 1, "fail"), ("b", 0, "pass")], "check string, affected_records long, status string")
    summary = audit.rolled_up(findings)
    assert audit.consistent(findings, summary).first()[0] and not audit.consistent(findings, summary.withColumn("failed", F.lit(0))).first()[0]
    assert audit.examples(v, "k", 1).first()["examples"] == ["1"]


def test_shift_intervals_need_independent_cohorts(spark):
    v = spark.createDataFrame([(i, "reference" if i < 40 else "current", float(i % 5), i % 5 + (0.1 if i < 40 else 0.5), "x") for i in range(80)], "id int, cohort string, y double, p double, s string")
    got = shift.diagnose(v, "cohort", "id", "y", "p", ["s"], ["y"], ["s"], independent=True, resamples=50)
    row = got["overall"].first()
    assert abs(row["degradation"] - 0.4) < 1e-9 and row["status"] == "evaluated" and set(got) == {"slices", "overall", "numeric", "categorical"}
    assert shift.diagnose(v, "cohort", "id", "y", "p", ["s"])["overall"].first()["status"] == "independence_not_declared"


def test_more_verbs(spark, tmp_path, capsys):
    for name, off in (("a", 0.05), ("b", 0.15)):
        (tmp_path / f"{name}.csv").write_text("sample_id,target,prediction,site,part\n" + "".join(f"{name}{i:03},{i / 10},{i / 10 + off},s{i % 2},{'tr' if i % 2 else 'te'}\n" for i in range(40)))
    assert cli.main(["init", str(tmp_path / "a.csv"), "--slice", "site"]) == 0
    assert cli.main(["shift", str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), "--slice", "site", "--independent", "--resamples", "40"]) == 0
    (tmp_path / "d.json").write_text(json.dumps({"key": "sample_id", "partition": "part", "roles": {"train": ["tr"], "test": ["te"]}, "duplicates": {"columns": ["sample_id"]}}))
    assert cli.main(["audit", str(tmp_path / "a.csv"), str(tmp_path / "d.json")]) == 0
    for i in range(3):
        documents.write_json(str(tmp_path / f"r{i}.json"), documents.receipt({"id": "m", "revision": "1"}, "regression", {"mae": 1.0 + i}, 50, intervals={"mae": [0.9 + i, 1.1 + i]}))
    (tmp_path / "list").write_text("".join(json.dumps({"path": str(tmp_path / f"r{i}.json"), "site": f"s{i}", "position": i}) + "\n" for i in range(3)))
    for verb in ("aggregate", "trend", "leaderboard"):
        assert cli.main([verb, str(tmp_path / "list"), "--metric", "mae"]) == 0
    out = capsys.readouterr().out.strip().splitlines()
    assert json.loads(out[-3])["models"][0]["pooled"] == 2.0 and json.loads(out[-2])["periods"][2]["interval_change"] == "confident_degradation" and [p["rank_group"] for p in json.loads(out[-1])["places"]] == [1, 2, 3]
    (tmp_path / "spec.json").write_text(json.dumps({"id": "b", "version": "1", "task": "regression", "metric": "mae", "key": "sample_id", "label": "target"}))
    (tmp_path / "sub.csv").write_text("sample_id,prediction\n" + "".join(f"a{i:03},{i / 10 + 0.5}\n" for i in range(40)))
    assert cli.main(["benchmark", str(tmp_path / "spec.json"), str(tmp_path / "a.csv"), str(tmp_path / "sub.csv")]) == 0
    assert abs(json.loads(capsys.readouterr().out)["score"] - 0.5) < 1e-9
    (tmp_path / "policy.json").write_text(json.dumps({"metrics": ["mae"]}))
    assert cli.main(["release-check", str(tmp_path / "r0.json"), str(tmp_path / "policy.json")]) == 1


def test_quantiles_are_exact(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    for values in (draw.normal(size=3001), draw.integers(0, 3, 500).astype(float), np.array([2.0]), np.array([1.0, 4.0])):
        v = spark.createDataFrame([(float(x), None if i % 5 == 0 else float(x)) for i, x in enumerate(values)], "x double, y double").repartition(3)
        shares = {"a": ("x", 0.25), "b": ("x", 0.9), "c": ("x", 0.0), "d": ("x", 1.0)}
        got = quantiles(v, shares).first().asDict()
        assert all(np.isclose(got[k], np.quantile(values, q)) for k, (_, q) in shares.items()), (values[:5], got)
        rest = [x for i, x in enumerate(values) if i % 5]
        assert not rest or np.isclose(quantiles(v, {"m": ("y", 0.5)}).first()["m"], np.median(rest))
    assert quantiles(v.where("false"), {"m": ("x", 0.5)}).first()["m"] is None


def test_forest_baseline_of_classes(spark):
    rows = [(i, "C" * (1 + i % 6) + ("O" if i % 2 else "N"), i % 2) for i in range(80)]
    v = spark.createDataFrame(rows, "k int, smiles string, label int")
    out = models.baseline(v, "k", "smiles", "label", "binary", bits=16, trees=5).collect()
    assert len(out) == 16 and sum(r["label"] for r in out) == 8 and all((r["prediction"] > 0.5) == bool(r["label"]) for r in out)
    one = models.baseline(v.withColumn("label", F.lit(0)), "k", "smiles", "label", "binary", bits=16, trees=5)
    assert {r["prediction"] for r in one.collect()} == {0.0}


def test_sinks_write_whole_tables(spark, tmp_path):
    v = spark.range(5).withColumn("k", F.col("id") % 2)
    path = str(tmp_path / "t")
    sinks.write(v, path)
    with pytest.raises(ValueError):
        sinks.write(v, path)
    with pytest.raises(ValueError):
        sinks.write(spark.read.parquet(path), path, overwrite=True)
    sinks.write(v.limit(2), path, overwrite=True, by=["k"])
    assert spark.read.parquet(path).count() == 2 and not list(tmp_path.glob("*.part"))
    sinks.write_csv_file(v.orderBy("id"), str(tmp_path / "x.csv"))
    assert (tmp_path / "x.csv").read_text().splitlines()[:2] == ["id,k", "0,0"]
    with pytest.raises(ValueError):
        sinks.write_csv_file(v, str(tmp_path / "y.csv"), 4)
