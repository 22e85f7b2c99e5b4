"""Command line: evaluate, init, compare, shift, aggregate, trend, leaderboard, gate, benchmark, run-pack, audit, verify, trust, sign, release-check, validate-config, list."""

from __future__ import annotations

import argparse
import json
import sys

from quillmark.governance import bundles, documents, policies


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _evaluate(args) -> dict:
    from quillmark.operators import metrics
    from quillmark.sources.binding import bind, read_csv, validate

    spark = _spark()
    found = bind(spark.read.option("header", True).csv(args.input).columns, args.target, args.prediction, args.sample_id)
    df = validate(read_csv(spark, args.input, found, tuple(args.slice)), found)
    y, p = found.target, found.predictions[0]
    row = metrics.regression(df, y, p).first()
    slices = [r.asDict() for r in metrics.slices(df, y, p, args.slice, args.min_slice_size).collect()] if args.slice else []
    cells = [{"slice_column": s["slice_column"], "slice_value": s["slice_value"], "n": s["n"], "status": s["status"], "metrics": {m: s[m] for m in ("mae", "rmse", "r2")}} for s in slices]
    if args.resamples:
        from quillmark.operators import resampled
        from quillmark.operators.designs import BootstrapConfig

        design = _design(args.design)
        rows = validate(read_csv(spark, args.input, found, tuple(dict.fromkeys([*args.slice, *(design.columns if design else ())]))), found)
        config = BootstrapConfig(resamples=args.resamples, include_slices=bool(args.slice))
        return {"intervals": _interval_rows(resampled.metric_intervals(rows, found.sample_id, y, p, args.task, slices=tuple(args.slice), design=design, config=config))}
    return documents.receipt({"id": args.model, "revision": args.revision}, "regression", {m: row[m] for m in ("mae", "rmse", "r2")}, row["n"], slices=cells)


def _design(path: str | None):
    """A sampling design from a JSON file, or none."""
    from quillmark.operators.designs import SamplingDesign

    return SamplingDesign.from_dict(_read(path)) if path else None


def _interval_rows(df) -> list[dict]:
    return [r.asDict() for r in df.orderBy("slice_column", "slice_value", "metric").collect()]


def _compare(args) -> dict:
    from quillmark.operators import paired
    from quillmark.sources.binding import bind, read_csv

    spark = _spark()
    if args.resamples:
        from quillmark.operators.designs import PairedConfig

        design = _design(args.design)
        found = bind(spark.read.option("header", True).csv(args.a).columns, args.target, args.prediction, args.sample_id)
        strings = tuple(dict.fromkeys([*args.slice, *(design.columns if design else ()), *(c for c, _ in (design.critical_slices if design else ()))]))
        config = PairedConfig(resamples=args.resamples, permutations=args.resamples, practical_threshold=args.threshold, include_slice_uncertainty=bool(strings))
        sides = [read_csv(spark, path, found, strings) for path in (args.a, args.b)]
        return {"comparison": _interval_rows(paired.compare_models(*sides, found.sample_id, found.target, found.predictions[0], args.task, slices=tuple(args.slice), design=design, config=config))}
    found = bind(spark.read.option("header", True).csv(args.a).columns, args.target, args.prediction, args.sample_id)
    both = paired.aligned(read_csv(spark, args.a, found), read_csv(spark, args.b, found), found.sample_id, found.target, found.predictions[0])
    return {"improvements": [r.asDict() for r in paired.improvement(both, found.target, "p_a", "p_b", args.threshold).collect()]}


def _gate(args) -> dict:
    from quillmark.operators import evidence
    from quillmark.sources import evidence as source

    with open(args.rules, encoding="utf-8") as file:
        rules = json.load(file)
    rows = source.evidence(source.receipts(_spark(), args.receipt))
    result = evidence.gate(rows.selectExpr("'overall' AS scope", "metric", "estimate", "status"), rules)
    return {"rules": [r.asDict() for r in result.collect()], "status": evidence.gate_overall(result).first()[0]}


def _init(args) -> dict:
    from quillmark.sources.tables import columns_of

    return bundles.quick_config(columns_of(_spark(), args.input), args.task, args.target or "target", args.prediction or "prediction", args.slice)


def _shift(args) -> dict:
    from quillmark.operators import shift
    from quillmark.sources.binding import bind
    from quillmark.sources.tables import columns_of, read_cohorts

    spark = _spark()
    found = bind(columns_of(spark, args.a), args.target, args.prediction, args.sample_id)
    rows = read_cohorts(spark, args.a, args.b, found, tuple(args.slice))
    out = shift.diagnose(rows, "cohort", found.sample_id, found.target, found.predictions[0], args.slice, independent=args.independent, resamples=args.resamples)
    return {name: [r.asDict() for r in df.collect()] for name, df in out.items()}


def _receipts(args):
    """Receipts with the site and period that a table of paths gives them: lines of JSON (path, site, position)."""
    from pyspark.sql import functions as F

    from quillmark.sources import evidence as source

    spark = _spark()
    with open(args.receipts, encoding="utf-8") as file:
        named = [json.loads(line) for line in file if line.strip()]
    for x in named:
        documents.check_receipt(_read(x["path"]))
    table = spark.createDataFrame([(documents.digest({k: v for k, v in _read(x["path"]).items() if k not in ("digest", "signature")}), x.get("site", ""), int(x.get("position", i))) for i, x in enumerate(named)], "digest string, site string, position int")
    found = source.receipts(spark, [x["path"] for x in named]).join(table, "digest")
    rows = found.select("digest", "site", "position", "task", "protocol", "n", F.col("model.id").alias("model"), F.col("model.revision").alias("revision"), F.explode("metrics").alias("metric", "value"), "intervals")
    bounds = F.try_element_at("intervals", F.col("metric"))
    return rows.select("*", F.get(bounds, 0).alias("lower"), F.get(bounds, 1).alias("upper"), F.lit(True).alias("verified")).where(F.col("metric") == args.metric)


def _aggregate(args) -> dict:
    from quillmark.operators import evidence

    return {"models": [r.asDict() for r in evidence.aggregated(_receipts(args), args.metric, ("task", "protocol")).collect()]}


def _trend(args) -> dict:
    from pyspark.sql import functions as F

    from quillmark.operators import evidence

    rows = evidence.require(_receipts(args), ["task", "protocol", "model"])
    series = rows.select("position", F.lit("<all>").alias("slice_column"), F.lit("<all>").alias("slice_value"), F.col("value").alias("estimate"), "lower", "upper", F.lit(0.95).alias("level"))
    return {"periods": [r.asDict() for r in evidence.trend_slices(series, args.metric, threshold=args.threshold).orderBy("position").collect()]}


def _leaderboard(args) -> dict:
    from pyspark.sql import functions as F

    from quillmark.operators import evidence

    rows = evidence.require(_receipts(args), ["task", "protocol"]).select(F.col("digest").alias("submission"), "digest", "model", "revision", F.col("value").alias("estimate"), "lower", "upper", "verified")
    return {"places": [r.asDict() for r in evidence.leaderboard(rows, args.metric, args.threshold).orderBy("place").collect()]}


def _audit(args) -> dict:
    from quillmark.operators import audit

    design = policies.load_config(args.rules)
    rows = _spark().read.option("header", True).csv(args.input)
    rows = audit.mapped_roles(rows, design["partition"], design["roles"], design.get("role", "role"))
    found = audit.audited(rows, {"role": "role", **design})
    return {"findings": [r.asDict() for r in found.collect()], **audit.rolled_up(found).first().asDict()}


def _benchmark(args) -> dict:
    from quillmark.operators import metrics
    from quillmark.sources import evidence as source

    spark, spec = _spark(), bundles.load_benchmark(args.rules)
    owner = spark.read.option("header", True).csv(args.owner)
    if args.submission is None:
        return {"columns": [spec.key, "prediction"], "rows": [r.asDict() for r in source.template(owner, [spec.key]).collect()]}
    given = spark.read.option("header", True).csv(args.submission)
    rows = source.submission(owner.withColumn(spec.label, owner[spec.label].cast("double")), given, spec.key, spec.label)
    found = metrics.binary(rows, "target", "prediction") if spec.task == "binary" else metrics.regression(rows, "target", "prediction")
    row = found.first().asDict()
    return {"benchmark": spec.metadata(), "n": row["n"], "score": row[spec.metric], "submission": bundles.submission_identity(spec, args.model, args.revision, documents.file_digest(args.submission))}


def _run_pack(args) -> dict:
    from quillmark.operators import metrics
    from quillmark.sources.binding import Binding, read_csv, validate

    def evaluate(config, path):
        own = Binding(config.get("sample_id", "sample_id"), config["target"], tuple(config["predictions"]), config["task"])
        row = metrics.regression(validate(read_csv(_spark(), path, own), own), own.target, own.predictions[0]).first()
        return {m: row[m] for m in ("mae", "rmse", "r2")}

    return bundles.run_pack(bundles.find_pack(args.folder, args.name), evaluate)


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmark")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("evaluate", "compare"):
        one = verbs.add_parser(name)
        for side in ("input",) if name == "evaluate" else ("a", "b"):
            one.add_argument(side)
        for option, default in (("--target", None), ("--prediction", None), ("--sample-id", "sample_id"), ("--output", None)):
            one.add_argument(option, default=default)
        one.add_argument("--slice", action="append", default=[])
        one.add_argument("--task", default="regression", choices=("regression", "binary"))
        one.add_argument("--resamples", type=int, default=0, help="intervals of every metric by so many replicates")
        one.add_argument("--design", default=None, help="a sampling design as JSON")
        if name == "evaluate":
            one.add_argument("--min-slice-size", type=int, default=5)
            one.add_argument("--model", default="model")
            one.add_argument("--revision", default="1")
        else:
            one.add_argument("--threshold", type=float, default=0.0)
    gate = verbs.add_parser("gate")
    gate.add_argument("receipt")
    gate.add_argument("rules")
    init = verbs.add_parser("init")
    init.add_argument("input")
    init.add_argument("--task", default="regression")
    shifted = verbs.add_parser("shift")
    for side in ("a", "b"):
        shifted.add_argument(side)
    shifted.add_argument("--independent", action="store_true")
    shifted.add_argument("--resamples", type=int, default=1000)
    for one in (init, shifted):
        for option, default in (("--target", None), ("--prediction", None), ("--sample-id", "sample_id"), ("--output", None)):
            one.add_argument(option, default=default)
        one.add_argument("--slice", action="append", default=[])
    for name in ("aggregate", "trend", "leaderboard"):
        one = verbs.add_parser(name)
        one.add_argument("receipts")
        one.add_argument("--metric", required=True)
        one.add_argument("--threshold", type=float, default=0.0)
        one.add_argument("--output", default=None)
    checked = verbs.add_parser("audit")
    checked.add_argument("input")
    checked.add_argument("rules")
    hidden = verbs.add_parser("benchmark")
    hidden.add_argument("rules")
    hidden.add_argument("owner")
    hidden.add_argument("submission", nargs="?")
    hidden.add_argument("--model", default="model")
    hidden.add_argument("--revision", default="1")
    pack = verbs.add_parser("run-pack")
    pack.add_argument("folder")
    pack.add_argument("name")
    release = verbs.add_parser("release-check")
    release.add_argument("path")
    release.add_argument("rules")
    trust = verbs.add_parser("trust")
    trust.add_argument("path")
    trust.add_argument("--key-file", required=True)
    trust.add_argument("--signer", default="signer")
    for name in ("verify", "sign", "validate-config"):
        one = verbs.add_parser(name)
        one.add_argument("path")
        if name != "validate-config":
            one.add_argument("--key-file")
    verbs.add_parser("list")
    args = parser.parse_args(arguments)
    key = None
    if getattr(args, "key_file", None):
        with open(args.key_file, "rb") as file:
            key = file.read().strip()
    code = 0
    if args.verb == "verify":
        fine = documents.verified(_read(args.path), key)
        out, code = {"verified": fine}, int(not fine)
    elif args.verb == "sign":
        if key is None:
            parser.error("sign needs --key-file")
        out = documents.signed(_read(args.path), key)
    elif args.verb == "trust":
        state = bundles.trusted(_read(args.path), {args.signer: key}, [args.signer])
        out, code = {"trust": state}, int(state != "trusted")
    elif args.verb == "release-check":
        rules = _read(args.rules)
        policy = policies.ReleasePolicy(tuple(rules["metrics"]), tuple((c, tuple(v)) for c, v in rules.get("partitions", {}).items()), rules.get("min_cell_size", 10), rules.get("risk_level"))
        decision, reasons = policies.release_decision(_read(args.path), policy, rules.get("evidence"))
        out, code = {"decision": decision, "reasons": reasons}, {"allow": 0, "deny": 1, "needs_review": 2}[decision]
    elif args.verb == "validate-config":
        errors, warnings = policies.check_config(policies.load_config(args.path))
        out, code = {"errors": errors, "warnings": warnings}, int(bool(errors))
    elif args.verb == "list":
        from quillmark.plans.queries import QUERIES

        out = {"queries": sorted(QUERIES), "tasks": sorted(policies.TASKS)}
    else:
        run = {"evaluate": _evaluate, "compare": _compare, "gate": _gate, "init": _init, "shift": _shift, "aggregate": _aggregate, "trend": _trend, "leaderboard": _leaderboard, "audit": _audit, "benchmark": _benchmark, "run-pack": _run_pack}
        out = run[args.verb](args)
        if args.verb in ("gate", "audit", "run-pack"):
            code = {"pass": 0, "warn": 0, "fail": 1, "investigate": 2, "not_testable": 2}[out["status"]]
    if getattr(args, "output", None):
        documents.write_json(args.output, out, [getattr(args, n) for n in ("input", "a", "b") if getattr(args, n, None)])
    else:
        print(json.dumps(out, sort_keys=True, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
