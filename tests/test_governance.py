import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillmark import cli
from quillmark.governance import documents, policies
from quillmark.operators import evidence as operators
from quillmark.sources import evidence
from quillmark.streaming.metrics import windowed


def made(n=50, **more):
    return documents.receipt({"id": "m", "revision": "1"}, "regression", {"mae": 1.0, "r2": float("nan")}, n, **more)


def test_documents(tmp_path):
    r = made()
    documents.check_receipt(r)
    assert r["metrics"]["r2"] is None and documents.verified(r) and not documents.verified(r | {"n": 51})
    s = documents.signed(r, b"k")
    assert documents.verified(s, b"k") and not documents.verified(s, b"other")
    path = tmp_path / "r.json"
    documents.write_json(str(path), s)
    with pytest.raises(ValueError):
        documents.write_json(str(path), s, [str(path)])
    m = documents.manifest([str(path)])
    assert documents.check_manifest(m, str(tmp_path)) == []
    path.write_text("x")
    assert documents.check_manifest(m, str(tmp_path)) == ["r.json"]


def test_release_is_all_or_nothing():
    cells = [{"slice_column": "s", "slice_value": v, "n": n, "metrics": {"mae": 1.0, "secret": 2.0}} for v, n in (("a", 30), ("b", 20))]
    r = made(slices=cells)
    policy = policies.ReleasePolicy(("mae",), (("s", ("a", "b")),), 10)
    out = policies.sanitized(r, policy)
    assert len(out["slices"]) == 2 and "secret" not in out["slices"][0]["metrics"] and policies.release_decision(out, policy) == ("allow", [])
    assert policies.sanitized(r, policies.ReleasePolicy(("mae",), (("s", ("a", "b")),), 25))["slices"] == []
    assert policies.release_decision(r, policy)[0] == "deny"
    assert policies.release_decision(out, policies.ReleasePolicy(("mae",), (("s", ("a", "b")),), 10, "low"))[0] == "needs_review"


def test_protocol_and_registry():
    p = policies.Protocol("p", "1", "regression", ("mae",))
    assert p.applied({"task": "regression", "title": "x"})["title"] == "x"
    with pytest.raises(ValueError):
        p.applied({"task": "binary"})
    with pytest.raises(ValueError):
        policies.chosen_metrics("regression", ["mae", "mae"])
    registry = policies.Registry("thing")
    registry.register("a", print)
    with pytest.raises(ValueError):
        registry.register("a", print)
    registry.register("a", len, replace=True)
    assert registry.get("a") is len and policies.check_config({})[0]


def test_receipts_and_gate(spark, tmp_path, capsys):
    path, rules = tmp_path / "r.json", tmp_path / "rules.json"
    documents.write_json(str(path), made())
    rules.write_text(json.dumps([{"name": "x", "type": "maximum", "metric": "mae", "scope": "overall", "threshold": 2.0}]))
    rows = evidence.evidence(evidence.receipts(spark, str(path))).collect()
    assert {r["metric"]: r["status"] for r in rows} == {"mae": "evaluated", "r2": "undefined"}
    assert cli.main(["gate", str(path), str(rules)]) == 0 and cli.main(["verify", str(path)]) == 0
    assert "pass" in capsys.readouterr().out


def test_cli_evaluates_and_compares(spark, tmp_path, capsys):
    for name, off in (("a", 0.05), ("b", 0.15)):
        (tmp_path / f"{name}.csv").write_text("sample_id,target,prediction,site\n" + "".join(f"{i:03},{i / 10},{i / 10 + off},s{i % 2}\n" for i in range(40)))
    assert cli.main(["evaluate", str(tmp_path / "a.csv"), "--slice", "site"]) == 0
    r = json.loads(capsys.readouterr().out)
    assert r["n"] == 40 and abs(r["metrics"]["mae"] - 0.05) < 1e-9 and len(r["slices"]) == 2 and documents.verified(r)
    assert cli.main(["compare", str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]) == 0
    got = {x["metric"]: x for x in json.loads(capsys.readouterr().out)["improvements"]}
    assert abs(got["mae"]["improvement"] - 0.1) < 1e-9 and got["mae"]["winner"] == "a"


def test_snapshots(spark, tmp_path):
    with gzip.open(tmp_path / "t.json.gz", "wt") as file:
        json.dump({"index": ["a", "b"], "columns": ["y"], "data": [[1.0], [2.0]]}, file)
    (tmp_path / "f.json").write_text(json.dumps({"fold_0": ["a"], "fold_1": ["b", "a"]}))
    table, folds = evidence.split_oriented(spark, str(tmp_path / "t.json.gz")), evidence.folds(spark, str(tmp_path / "f.json"))
    assert tuple(operators.fold_cover(table, folds, "sample_id").first()) == (0, 0, 1)
    owner = table.withColumnRenamed("y", "target")
    good = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "sample_id string, prediction double")
    assert evidence.submission(owner, good).count() == 2
    for bad in (good.limit(1), good.withColumn("x", F.lit(1)), good.union(good.limit(1))):
        with pytest.raises(ValueError):
            evidence.submission(owner, bad)
    assert evidence.ordinal_ids(owner, "sample_id", "t").orderBy("sample_id").first()["sample_id"] == "t-000000"


def test_streaming_windows(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,cast(id as int)) as ts, cast(id as double) as y, cast(id + 1 as double) as p from range(20)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, y double, p double").parquet(str(tmp_path / "in"))
    running = windowed(stream, "ts", "y", "p").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    running.awaitTermination(60)
    rows = spark.sql("select sum(n) n, max(mae) m from w").first()
    assert rows["n"] == 20 and rows["m"] == 1.0
