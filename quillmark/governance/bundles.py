"""Specifications, packs, manifests and publication: small documents that are read, checked and written on the driver alone."""

from __future__ import annotations

import contextlib
import json
import os
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from importlib import metadata

from quillmark.functions.stats import DIRECTIONS
from quillmark.governance.documents import append_audit, canonical, digest, file_digest, verified, write_json
from quillmark.governance.policies import DEFAULT, LABEL, TASKS, Protocol, Registry, chosen_metrics, load_config

#: Bytes of a document that are read at most.
MOST = 4 << 20


def read_bounded(path: str, most: int = MOST) -> bytes:
    """A small file; a larger one is refused rather than cut."""
    with open(path, "rb") as file:
        content = file.read(most + 1)
    if len(content) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return content


def unique_json(content: bytes):
    """JSON whose objects name each key once, without numbers that aren't finite."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("a key occurs twice")
        return out

    def constant(name):
        raise ValueError(f"{name} isn't allowed")

    return json.loads(content, object_pairs_hook=pairs, parse_constant=constant)


def load_protocol(path: str) -> Protocol:
    """A protocol from JSON or YAML; unknown settings are refused."""
    given = load_config(path)
    known = set(Protocol.__dataclass_fields__)
    if unknown := set(given) - known:
        raise ValueError(f"a protocol has no {sorted(unknown)}")
    return Protocol(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


class Protocols:
    """Protocols by id and version; the same id and version may be given again only unchanged."""

    def __init__(self):
        self._known: dict[tuple[str, str], Protocol] = {}

    def add(self, protocol: Protocol) -> None:
        old = self._known.setdefault((protocol.id, protocol.version), protocol)
        if old.identity != protocol.identity:
            raise ValueError(f"{protocol.id}@{protocol.version} is defined differently already")

    def resolve(self, name: str) -> Protocol:
        """``id@version``, or ``id`` where it has one version."""
        own, _, version = name.partition("@")
        found = [p for (i, v), p in self._known.items() if i == own and (not version or v == version)]
        if len(found) != 1:
            raise ValueError(f"{name} names {len(found)} protocols; known: {self.names()}")
        return found[0]

    def names(self) -> list[str]:
        return sorted(f"{i}@{v}" for i, v in self._known)


def discovered(group: str, registry: Registry | Protocols) -> list[str]:
    """Adds the plug-ins that installed packages offer under an entry-point ``group``; names that are taken are refused, unless it is by an unchanged protocol.

    A registry is given functions: one, a (name, function) pair, or a list of pairs. Protocols are given protocols: one, a list, or a function without arguments that gives either; anything else is refused before any of it is added.
    """
    added = []
    for entry in sorted(metadata.entry_points(group=group), key=lambda e: e.name):
        offered = entry.load()
        if isinstance(registry, Protocols):
            found = offered() if callable(offered) else offered
            found = [found] if isinstance(found, Protocol) else list(found)
            if not all(isinstance(p, Protocol) for p in found):
                raise ValueError(f"{entry.value} offers something that is no protocol")
            for protocol in found:
                registry.add(protocol)
                added.append(f"{protocol.id}@{protocol.version}")
            continue
        pairs = [(entry.name, offered)] if callable(offered) else [offered] if isinstance(offered, tuple) else list(offered)
        for name, runner in pairs:
            registry.register(name, runner, f"from {entry.value}")
            added.append(name)
    return added


@dataclass(frozen=True)
class Run:
    """A run's settings after its protocol was applied."""

    task: str
    input: str
    target: str
    metrics: tuple[str, ...]
    protocol: str = ""
    slices: tuple[str, ...] = ()
    settings: Mapping = field(default_factory=dict)


def load_run(path: str, protocols: Protocols | None = None, protocol_digest: str | None = None) -> Run:
    """A run's configuration; a protocol that it names fixes its scientific settings, and has the pinned digest if one is given."""
    given = dict(load_config(path))
    name = given.pop("protocol", "")
    if name:
        if protocols is None:
            raise ValueError("the run names a protocol, but none are known")
        protocol = protocols.resolve(name)
        if protocol_digest and not protocol.identity.endswith(f"#{protocol_digest}"):
            raise ValueError(f"{name} doesn't have the pinned digest")
        given, name = protocol.applied(given), protocol.identity
    metrics_ = chosen_metrics(given.get("task", ""), given.get("metrics"))
    for key in ("input", "target"):
        if not given.get(key):
            raise ValueError(f"{key} is absent")
    return Run(given["task"], given["input"], given["target"], metrics_, name, tuple(given.get("slices", ())), given)


def quick_config(columns: Sequence[str], task: str, target: str, prediction: str, slices: Sequence[str] = ()) -> dict:
    """A first configuration for a table with these columns, by the task's usual metrics."""
    if absent := [c for c in (target, prediction, *slices) if c not in columns]:
        raise ValueError(f"columns are absent: {absent}")
    return {"task": task, "target": target, "predictions": [prediction], "metrics": list(chosen_metrics(task)), "slices": list(slices), "decides": DEFAULT[task], "resamples": 1000, "seed": 13, "min_slice_size": 5}


@dataclass(frozen=True)
class HiddenBenchmark:
    """An owner's benchmark: participants see its ids and inputs, never its labels."""

    id: str
    version: str
    task: str
    metric: str
    key: str
    label: str
    inputs: tuple[str, ...] = ()
    tie_tolerance: float = 0.0

    def __post_init__(self):
        chosen_metrics(self.task, [self.metric])
        if not LABEL.fullmatch(self.id) or self.tie_tolerance < 0 or len({self.key, self.label, *self.inputs}) != 2 + len(self.inputs):
            raise ValueError("a benchmark needs a plain id, different columns and a tolerance of at least 0")

    @property
    def direction(self) -> str:
        return DIRECTIONS[self.metric]

    def metadata(self) -> dict:
        """What participants may see."""
        return {"id": self.id, "version": self.version, "task": self.task, "metric": self.metric, "direction": self.direction, "columns": [self.key, *self.inputs]}


def load_benchmark(path: str) -> HiddenBenchmark:
    given = load_config(path)
    if unknown := set(given) - set(HiddenBenchmark.__dataclass_fields__):
        raise ValueError(f"a benchmark has no {sorted(unknown)}")
    return HiddenBenchmark(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def submission_identity(benchmark: HiddenBenchmark, model: str, revision: str, predictions_digest: str) -> str:
    """A submission's identity: the benchmark, the model and what it predicted."""
    return digest({"benchmark": benchmark.metadata(), "model": model, "revision": revision, "predictions": predictions_digest})


@dataclass(frozen=True)
class Pack:
    """A folder with a run's configuration, its predictions and the receipt that they must give."""

    id: str
    version: str
    folder: str
    config: str
    predictions: str
    expected: str


def load_pack(folder: str) -> Pack:
    given = unique_json(read_bounded(os.path.join(folder, "pack.json")))
    needed = ("id", "version", "config", "predictions", "expected")
    if set(given) != set(needed):
        raise ValueError(f"a pack has exactly {list(needed)}")
    root = os.path.realpath(folder)
    for key in needed[2:]:
        path = os.path.realpath(os.path.join(folder, given[key]))
        if os.path.commonpath([root, path]) != root or not os.path.isfile(path):
            raise ValueError(f"{key} isn't a file of the pack")
    return Pack(folder=folder, **given)


def packs(folder: str) -> list[Pack]:
    """All packs below a folder, by id and version."""
    found = [load_pack(os.path.join(folder, d)) for d in sorted(os.listdir(folder)) if os.path.isfile(os.path.join(folder, d, "pack.json"))]
    return sorted(found, key=lambda p: (p.id, p.version))


def find_pack(folder: str, name: str) -> Pack:
    own, _, version = name.partition("@")
    found = [p for p in packs(folder) if p.id == own and (not version or p.version == version)]
    if len(found) != 1:
        raise ValueError(f"{name} names {len(found)} packs")
    return found[0]


def run_pack(pack: Pack, evaluate: Callable[[dict, str], Mapping[str, float]], tolerance: float = 1e-9) -> dict:
    """Evaluates a pack by ``evaluate(config, predictions)`` and compares metrics with its expected receipt: (status, differences)."""
    config = load_config(os.path.join(pack.folder, pack.config))
    expected = unique_json(read_bounded(os.path.join(pack.folder, pack.expected)))["metrics"]
    found = evaluate(config, os.path.join(pack.folder, pack.predictions))
    differ = {m: [v, found.get(m)] for m, v in expected.items() if found.get(m) is None or abs(found[m] - v) > tolerance * max(1.0, abs(v))}
    return {"pack": f"{pack.id}@{pack.version}", "status": "fail" if differ else "pass", "differences": differ}


def check_scorer(manifest: Mapping) -> list[str]:
    """All faults of a scorer's manifest: features with units and their place and scale, weights for each, nothing else."""
    faults = []
    features = manifest.get("features", [])
    names = [f.get("name") for f in features]
    if not names or len(set(names)) != len(names):
        faults.append("features must have different names")
    for f in features:
        if not f.get("unit"):
            faults.append(f"{f.get('name')} has no unit")
        if not float(f.get("scale", 1)) > 0:
            faults.append(f"{f.get('name')} has no positive scale")
    if set(manifest.get("weights", {})) != set(names):
        faults.append("weights and features differ")
    return faults


def check_units(manifest: Mapping, units: Mapping[str, str]) -> None:
    """Raises unless a table's units are exactly the manifest's; nothing is converted."""
    if differ := {f["name"]: [f["unit"], units.get(f["name"])] for f in manifest["features"] if units.get(f["name"]) != f["unit"]}:
        raise ValueError(f"units differ: {differ}")


#: What an external validation must tell about a model, and may show of it.
PROFILE = ("id", "revision", "training_data", "intended_use", "owner")


def check_profile(profile: Mapping) -> dict:
    """The public part of a model's profile for an external validation."""
    if absent := [k for k in PROFILE if not str(profile.get(k, "")).strip()]:
        raise ValueError(f"a profile lacks {absent}")
    return {k: str(profile[k]) for k in PROFILE}


def approve(document: Mapping, approvals: Mapping[str, Sequence[str]]) -> dict:
    """``document`` of an external validation rebuilt from values that the owner approved: models, metrics and labels; others are refused."""
    model, metrics_ = document["model"]["id"], document["metrics"]
    if model not in approvals.get("models", ()) or (extra := set(metrics_) - set(approvals.get("metrics", ()))):
        raise ValueError(f"not approved: {model if model not in approvals.get('models', ()) else sorted(extra)}")
    return {"schema": "external-validation/v1", "model": dict(document["model"]), "task": document["task"], "n": int(document["n"]), "metrics": {k: float(v) for k, v in metrics_.items()}}


@contextlib.contextmanager
def locked(path: str):
    """Holds a lock file while a publication runs; another one is refused meanwhile."""
    handle = os.open(f"{path}.lock", os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        yield
    finally:
        os.close(handle)
        os.unlink(f"{path}.lock")


def publish(document: Mapping, path: str, decide: Callable[[Mapping], tuple[str, list[str]]], ledger: str) -> str:
    """Writes a document that ``decide`` allows, under a lock and with an entry in the ledger; if it doesn't, an older export is removed, as it may no longer be shown."""
    with locked(path):
        decision, reasons = decide(document)
        if decision != "allow":
            if os.path.exists(path):
                os.unlink(path)
            append_audit(ledger, {"path": os.path.basename(path), "decision": decision, "reasons": reasons})
            return decision
        write_json(path, document)
        append_audit(ledger, {"path": os.path.basename(path), "decision": decision, "sha256": file_digest(path)})
    return decision


def public_family(slices: Sequence[Mapping], approved: Mapping[str, Sequence[str]]) -> list[dict] | None:
    """The family of a multiplicity correction if every slice of it may be shown, else nothing: a correction over a part would be another one."""
    if any(s["slice_value"] not in approved.get(s["slice_column"], ()) for s in slices):
        return None
    return [{"slice_column": s["slice_column"], "slice_value": s["slice_value"], "p": s["p"]} for s in slices]


def reported(clean: Mapping[str, float | None], perturbed: Mapping[str, float | None] | None) -> tuple[dict, str]:
    """The metrics that a receipt shows, and whether they are clean or perturbed; with noise, intervals of the clean ones are withheld too."""
    return (dict(perturbed), "perturbed") if perturbed is not None else (dict(clean), "clean")


def admissible(entry: Mapping, point: float | None) -> bool:
    """Whether a stored interval may serve as evidence: clean, ordered, and about the point estimate that it comes with."""
    if point is None or entry.get("basis", "clean") != "clean" or entry.get("lower") is None or entry.get("upper") is None:
        return False
    close = abs(entry.get("estimate", float("nan")) - point) <= max(1e-10 * max(abs(point), abs(entry.get("estimate", 0.0))), 1e-12)
    return bool(close and entry["lower"] <= entry["upper"])


def trusted(document: Mapping, keys: Mapping[str, bytes], approved: Sequence[str]) -> str:
    """trusted, known_but_not_approved, unsigned or invalid: whose signature a document carries."""
    if "signature" not in document:
        return "unsigned" if verified(document) else "invalid"
    for name, key in keys.items():
        if verified(document, key):
            return "trusted" if name in approved else "known_but_not_approved"
    return "invalid"


def attestation(runner: str, commit: str, packages: Sequence[str] = ("pyspark", "numpy", "pyarrow")) -> dict:
    """Who ran what with which versions."""
    versions = {}
    for name in packages:
        with contextlib.suppress(metadata.PackageNotFoundError):
            versions[name] = metadata.version(name)
    return {"runner": runner, "commit": commit, "packages": versions}


def slug(text: str) -> str:
    """Lower-case letters, digits and single hyphens."""
    return re.sub("[^a-z0-9]+", "-", text.strip().lower()).strip("-")


def text_table(rows: Sequence[Mapping], columns: Sequence[str], title: str = "") -> str:
    """Rows for a terminal, numbers to six digits, undefined ones as a dash."""
    show = lambda v: "-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    cells = [list(columns), *([show(r.get(c)) for c in columns] for r in rows)]
    wide = [max(len(r[k]) for r in cells) for k in range(len(columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in cells]
    return "\n".join([*([title, ""] if title else []), lines[0], "  ".join("-" * w for w in wide), *lines[1:]]) + "\n"


def markdown_table(rows: Sequence[Mapping], columns: Sequence[str], title: str = "") -> str:
    """The same as Markdown; a bar in a value can't break out of its cell."""
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(columns)} |", f"| {' | '.join('---' for _ in columns)} |", *(f"| {' | '.join(show(r.get(c)) for c in columns)} |" for r in rows)]
    return "\n".join([*([f"# {title}", ""] if title else []), *lines]) + "\n"


def check_output(path: str, inputs: Sequence[str], overwrite: bool = False) -> list[str]:
    """All faults of an output path: it is an input, its folder is absent, or it exists."""
    faults = []
    if any(os.path.realpath(path) == os.path.realpath(i) for i in inputs):
        faults.append("the output is one of the inputs")
    if not os.path.isdir(os.path.dirname(os.path.abspath(path))):
        faults.append("the output's folder doesn't exist")
    if os.path.exists(path) and not overwrite:
        faults.append("the output exists")
    return faults


def check_run(config: Mapping, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """All errors and warnings of a run's configuration against its table's columns: roles, metrics, uncertainty, privacy and reports."""
    errors, warnings = [], []
    task = config.get("task")
    if task not in TASKS:
        errors.append(f"unknown task: {task}")
    roles = [config.get("sample_id", "sample_id"), config.get("target"), *config.get("predictions", ()), *config.get("slices", ())]
    named = [r for r in roles if r]
    if repeated := sorted({r for r in named if named.count(r) > 1}):
        errors.append(f"columns have several roles: {repeated}")
    if absent := [r for r in named if r not in columns]:
        errors.append(f"columns are absent: {absent}")
    if not config.get("predictions"):
        errors.append("no prediction is named")
    elif task != "multiclass" and len(config["predictions"]) > 1:
        errors.append(f"{task} takes one prediction")
    elif task == "multiclass" and len(config["predictions"]) != len(config.get("labels", ())):
        errors.append("multiclass needs a label for each prediction")
    if task in TASKS and config.get("metrics") is not None:
        try:
            chosen_metrics(task, config["metrics"])
        except ValueError as e:
            errors.append(str(e))
    resamples, level = config.get("resamples", 1000), config.get("level", 0.95)
    if resamples < 0 or not 0 < level < 1:
        errors.append("resamples must not be negative, and the level between 0 and 1")
    elif 0 < resamples < 100:
        warnings.append("few resamples give rough intervals")
    privacy = config.get("privacy") or {}
    if privacy and not 0 < privacy.get("epsilon", 0) <= privacy.get("budget", float("inf")):
        errors.append("epsilon must be above 0 and within the budget")
    if privacy and config.get("report_clean"):
        errors.append("a private run doesn't report clean metrics")
    if not privacy and config.get("scope") == "shareable":
        warnings.append("a shareable run without privacy settings shows clean metrics")
    return errors, warnings


__all__ = [n for n, v in list(globals().items()) if getattr(v, "__module__", None) == __name__] + ["canonical"]
