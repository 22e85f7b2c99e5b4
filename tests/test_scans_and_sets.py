"""Scans that carry digests, similarity of sets within a budget, approved families, and the command line of intervals."""

import hashlib
import json
import math
import os
import random

import pytest

from quillmark import cli
from quillmark.operators import audit, paired, privacy
from quillmark.operators.designs import PairedConfig, SamplingDesign
from quillmark.sources import tables


def test_rows_and_digests_of_one_read(spark, tmp_path):
    texts = {"a.csv": 'id,note,x\n1,"two\nlines, and ""quotes""",5\r\n2,,6\n', "b.csv": "id,note,x\n", "c.csv": "id,note,x\n" + "".join(f"{i},n{i},{i % 7}\n" for i in range(20_000))}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    scan = tables.scanned_files(spark, f"file://{tmp_path}", ["id", "note", "x"], wanted=["x", "note"])
    pins = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in texts.items()}
    rows = tables.verified_rows(scan, pins).collect()
    assert len(rows) == 20_002 and {r["sha256"] for r in rows} == {pins["a.csv"], pins["c.csv"]}
    assert sorted((r["row"], r["x"], r["note"]) for r in rows if r["file"].endswith("a.csv")) == [(0, "5", 'two\nlines, and "quotes"'), (1, "6", None)]
    assert sorted(r["row"] for r in rows if r["file"].endswith("c.csv")) == list(range(20_000))
    with pytest.raises(ValueError, match="c.csv"):
        tables.verified_rows(scan, {**pins, "c.csv": "0" * 64})
    (tmp_path / "d.csv").write_text("id,x\n")
    with pytest.raises(Exception, match="columns"):
        tables.scanned_files(spark, f"file://{tmp_path}", ["id", "note", "x"]).count()


def test_files_of_one_name_are_told_apart(spark, tmp_path):
    """a task that writes several segments gives all their files one name."""
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part").write_text(f"1,{name}\n")
    digest = lambda name: hashlib.sha256(f"1,{name}\n".encode()).hexdigest()
    scan = tables.scanned_files(spark, f"file://{tmp_path}", ["id", "x"], header=False)
    assert tables.verified_rows(scan, {"a/part": digest("a"), "b/part": digest("b")}).count() == 2
    with pytest.raises(ValueError, match="b/part"):
        tables.verified_rows(scan, {"a/part": digest("a"), "b/part": digest("a")})
    with pytest.raises(ValueError):
        tables.verified_rows(scan, {"part": digest("a")})


def test_similar_sets_against_all_pairs(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, draw.choice(["train", "test", "validation"]), draw.sample(words, draw.randint(1, 6))) for i in range(90)]
    rows += [(100 + i, draw.choice(["train", "test"]), ["same", "set", "of", "five", "words"]) for i in range(40)] + [(200, "test", []), (201, "train", []), (202, None, ["same", "set", "of", "five", "words"])]
    df = spark.createDataFrame(rows, "k int, role string, s array<string>")
    pairs = [("train", "test"), ("validation", "test")]
    want = {(a, b): len({*s} & {*t}) / len({*s} | {*t}) for a, x, s in rows for b, y, t in rows if (x, y) in pairs and s and t and len({*s} & {*t}) / len({*s} | {*t}) >= 0.5}
    got = {(r["key_a"], r["key_b"]): r["similarity"] for r in audit.tanimoto(df, "k", "s", "role", pairs, 0.5).collect()}
    assert got == pytest.approx(want) and len(want) > 100
    classes, _ = audit.set_classes(df, "k", "s", "role")
    heads = audit._heads(classes, 0.5)
    assert classes.count() <= 91 and audit.candidate_bound(heads, pairs) >= audit.similar_sets(classes, heads, pairs, 0.5).where("id_a <> id_b").count()
    finding = audit.tanimoto_finding(df, "k", "s", "role", pairs, 0.5).first()
    assert finding["status"] == "fail" and finding["affected_records"] == len({k for p in want for k in p})
    monkeypatch.setattr(audit, "similar_sets", None)  # beyond the budget no pair is made
    assert audit.tanimoto_finding(df, "k", "s", "role", pairs, 0.5, 3).first()["status"] == "pair_budget_exceeded"
    with pytest.raises(audit.OverBudget):
        audit.tanimoto(df, "k", "s", "role", pairs, 0.5, 3)


def test_vectors_by_blocks_against_all_pairs(spark, monkeypatch):
    """the registered query has no budget of pairs."""
    draw = random.Random(7)
    rows = [(i, draw.choice(["train", "test", "validation"]), [draw.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for i in range(120)] + [(200, "train", None), (201, "train", [1.0, None, 0.5, 1.0]), (202, "test", [1.0]), (203, "test", [0.0] * 4)]
    cosine = lambda s, t: sum(a * b for a, b in zip(s, t)) / (math.sqrt(sum(a * a for a in s)) * math.sqrt(sum(b * b for b in t)))
    pairs = [("train", "test"), ("validation", "test"), ("train", "test")]
    whole = [r for r in rows[:120]]
    want = {(a, b): v for a, x, s in whole for b, y, t in whole if (x, y) in pairs and (v := cosine(s, t)) >= 0.6}
    monkeypatch.setattr(audit, "_VECTORS", 10)
    monkeypatch.setattr(audit, "_AT_ONCE", 3)
    df = spark.createDataFrame(rows, "k long, role string, v array<float>")
    got = {(r["key_a"], r["key_b"]): r["similarity"] for r in audit.near_duplicates(df, "k", "v", "role", pairs, 0.6, None).collect()}
    assert {k: v for k, v in got.items() if 203 not in k} == pytest.approx(want) and len(want) > 100
    assert all(math.isnan(v) for k, v in got.items() if 203 in k) and sum(203 in k for k in got) == sum(x in ("train", "validation") for _, x, _ in whole)
    with pytest.raises(audit.OverBudget):
        audit.near_duplicates(df, "k", "v", "role", pairs, 0.6, 5)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are absent")
def test_registered_vectors_have_no_budget(spark, monkeypatch):
    from quillmark.plans.queries import QUERIES

    monkeypatch.setattr(audit.near_duplicates, "__defaults__", (5,))
    assert QUERIES["audit_near_dup"](spark, "/root/testdata/sf0.001").first()["pairs"] >= 0


def test_approved_families_are_adjusted_anew(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.001), ("d", 0.9)], "s string, p double")
    shown = spark.createDataFrame([("a",), ("b",), ("e",), ("a",)], "s string")
    got = {r["s"]: r["adjusted_p"] for r in privacy.approved_family(tests, shown, ["s"], "p", "bh").collect()}
    assert got == {"a": pytest.approx(0.03), "b": pytest.approx(0.03), "e": None}


def test_exclusions_of_the_evaluation_alone(spark):
    df = spark.createDataFrame([(1, "train", 0.5), (2, "test", 0.5), (3, "test", 2.0), (4, None, 0.5)], "id int, role string, x double")
    rules = [{"column": "x", "op": "less_than", "value": 1.0}]
    assert sorted(r["id"] for r in tables.eligible(df, "role", rules, evaluation="test").collect()) == [1, 3, 4]
    assert [r["id"] for r in tables.eligible(df, "role", rules).collect()] == [3]


def test_two_models_by_any_number_of_slices(spark, tmp_path, capsys):
    draw = random.Random(4)
    rows = [(i, draw.gauss(0, 1), f"u{i % 40}", f"s{i % 250}") for i in range(1000)]
    side = lambda shift: spark.createDataFrame([(i, y, y + shift + random.Random(i).gauss(0, 0.1), u, s) for i, y, u, s in rows], "sample_id int, target double, prediction double, unit string, site string")
    design = SamplingDesign("patient", "cluster_bootstrap", ("unit",), exchangeability="model_vectors_within_clusters")
    got = paired.compare_models(side(0.0), side(0.5), "sample_id", "target", "prediction", slices=("site",), design=design, config=PairedConfig(resamples=100, permutations=100)).collect()
    whole = {r["metric"]: r for r in got if not r["slice_column"]}
    assert len(got) == 251 * 3 and whole["mae"]["decision"] == "confident_improvement" and whole["mae"]["p_value"] < 0.05 and all(r["status"] == "skipped_min_slice_size" for r in got if r["slice_column"])
    with pytest.raises(ValueError):
        paired.compare_models(side(0.0), side(0.5).where("sample_id > 3"), "sample_id", "target", "prediction")
    paths = []
    for name, shift in (("a", 0.0), ("b", 0.5)):
        path = tmp_path / f"{name}.csv"
        side(shift).toPandas().to_csv(path, index=False)
        paths.append(str(path))
    (tmp_path / "design.json").write_text(json.dumps(design.as_dict()))
    assert cli.main(["compare", *paths, "--resamples", "100", "--design", str(tmp_path / "design.json"), "--output", str(tmp_path / "c.json")]) == 0
    found = json.loads((tmp_path / "c.json").read_text())["comparison"]
    assert {r["metric"]: round(r["improvement"], 6) for r in found} == {m: round(r["improvement"], 6) for m, r in whole.items()}
    assert cli.main(["evaluate", paths[0], "--resamples", "100", "--output", str(tmp_path / "e.json")]) == 0
    assert {r["metric"] for r in json.loads((tmp_path / "e.json").read_text())["intervals"]} == {"mae", "rmse", "r2"}
