"""Declared definitions and what they decide: protocols, designs, release policies and plug-in registries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass

from quillmark.functions.stats import DIRECTIONS
from quillmark.governance.documents import digest

#: Metrics of each task, and the one that decides by default.
TASKS = {
    "regression": ("mae", "rmse", "r2", "spearman"), "binary": ("accuracy", "f1", "auroc"),
    "multiclass": ("accuracy", "macro_f1", "weighted_f1", "log_loss", "macro_auroc_ovr"),
}
DEFAULT = {"regression": "rmse", "binary": "auroc", "multiclass": "macro_auroc_ovr"}
#: A label that may be published.
LABEL = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.@+-]{0,127}")


def chosen_metrics(task: str, names: Sequence[str] | None = None) -> tuple[str, ...]:
    """The metrics asked for, each once and known to the task; spearman only where it is named."""
    if task not in TASKS:
        raise ValueError(f"unknown task: {task}")
    if names is None:
        return tuple(m for m in TASKS[task] if m != "spearman")
    if len(set(names)) != len(names) or (unknown := [m for m in names if m not in TASKS[task]]):
        raise ValueError(f"metrics must be distinct and supported: {unknown if len(set(names)) == len(names) else names}")
    return tuple(names)


@dataclass(frozen=True)
class Protocol:
    """The scientific settings of an evaluation, which a run may repeat but not change."""

    id: str
    version: str
    task: str
    metrics: tuple[str, ...]
    slices: tuple[str, ...] = ()
    min_slice_size: int = 5
    resamples: int = 1000
    seed: int = 13

    def __post_init__(self):
        chosen_metrics(self.task, self.metrics)
        if self.min_slice_size < 1 or self.resamples < 0:
            raise ValueError("sizes must not be negative")

    @property
    def identity(self) -> str:
        return f"{self.id}@{self.version}#{digest(asdict(self) | {'metrics': list(self.metrics), 'slices': list(self.slices)})}"

    def applied(self, settings: Mapping) -> dict:
        """A run's settings under the protocol; a setting that differs is refused."""
        own = asdict(self)
        for key, value in settings.items():
            fixed = own.get(key)
            if key in own and (tuple(value) if isinstance(value, list | tuple) else value) != (tuple(fixed) if isinstance(fixed, list | tuple) else fixed):
                raise ValueError(f"{key} is fixed by the protocol")
        return {**settings, **own}


class Registry:
    """Named plug-ins; a name is given once unless it is replaced on purpose."""

    def __init__(self, kind: str):
        self.kind, self._known = kind, {}

    def register(self, name: str, runner: Callable, description: str = "", replace: bool = False) -> None:
        if not LABEL.fullmatch(name) or not callable(runner):
            raise ValueError(f"a {self.kind} needs a plain name and a function")
        if name in self._known and not replace:
            raise ValueError(f"{self.kind} {name} is registered already")
        self._known[name] = (runner, description)

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"unknown {self.kind} {name}; known: {self.names()}")
        return self._known[name][0]

    def names(self) -> list[str]:
        return sorted(self._known)


tasks, attacks = Registry("task"), Registry("privacy attack")


@dataclass(frozen=True)
class ReleasePolicy:
    """What may leave: metrics, slice columns with their labels, and the least cell."""

    metrics: tuple[str, ...]
    partitions: tuple[tuple[str, tuple[str, ...]], ...] = ()
    min_cell_size: int = 10
    risk_level: str | None = None

    def __post_init__(self):
        if self.min_cell_size < 1 or any(not LABEL.fullmatch(x) for _, labels in self.partitions for x in labels):
            raise ValueError("labels must be plain and cells at least 1")


def sanitized(document: Mapping, policy: ReleasePolicy) -> dict:
    """The approved part of a receipt, rebuilt from approved values alone; a partition is withheld whole unless every cell is large and approved."""
    out = {"schema": document["schema"], "scope": "shareable", "model": dict(document["model"]), "task": document["task"], "n": document["n"]}
    if document["n"] < policy.min_cell_size:
        return out | {"status": "suppressed", "metrics": {}, "slices": []}
    out["metrics"] = {m: document["metrics"][m] for m in policy.metrics if m in document["metrics"]}
    slices = []
    for column, labels in policy.partitions:
        own = [s for s in document.get("slices", ()) if s["slice_column"] == column]
        whole = {s["slice_value"] for s in own} == set(labels) and all(s["n"] >= policy.min_cell_size for s in own) and sum(s["n"] for s in own) == document["n"]
        if whole:
            slices += [{"slice_column": column, "slice_value": s["slice_value"], "n": s["n"], "metrics": {m: s["metrics"][m] for m in policy.metrics if m in s.get("metrics", {})}} for s in own]
    return out | {"status": "released", "slices": slices}


def release_decision(document: Mapping, policy: ReleasePolicy, evidence: Mapping | None = None) -> tuple[str, list[str]]:
    """allow, deny or needs_review, with reasons: unapproved content denies, absent evidence asks for review."""
    reasons = []
    if extra := set(document.get("metrics", {})) - set(policy.metrics):
        reasons.append(f"metrics aren't approved: {sorted(extra)}")
    approved = dict(policy.partitions)
    for s in document.get("slices", ()):
        if s["slice_value"] not in approved.get(s["slice_column"], ()) or s["n"] < policy.min_cell_size:
            reasons.append(f"a cell of {s['slice_column']} isn't approved or too small")
            break
    if document.get("scope") != "shareable" or "inputs" in document:
        reasons.append("only shareable documents without inputs leave")
    if reasons:
        return "deny", reasons
    if policy.risk_level is not None:
        level = (evidence or {}).get("risk_level")
        if level is None:
            return "needs_review", ["no privacy audit"]
        order = ("low", "moderate", "high")
        if order.index(level) > order.index(policy.risk_level):
            return "deny", [f"risk is {level}"]
    return "allow", []


def check_config(config: Mapping) -> tuple[list[str], list[str]]:
    """All errors and warnings of a run's configuration."""
    errors, warnings = [], []
    task = config.get("task")
    if task not in TASKS:
        errors.append(f"unknown task: {task}")
    for name in ("input", "target"):
        if not config.get(name):
            errors.append(f"{name} is absent")
    if task in TASKS and config.get("metrics") is not None:
        try:
            chosen_metrics(task, config["metrics"])
        except ValueError as e:
            errors.append(str(e))
    if config.get("resamples", 1000) < 0:
        errors.append("resamples must not be negative")
    elif config.get("resamples", 1000) < 100:
        warnings.append("few resamples give rough intervals")
    if config.get("output") and config.get("output") == config.get("input"):
        errors.append("the output is the input")
    return errors, warnings


def load_config(path: str) -> dict:
    """A configuration from JSON, or from YAML where PyYAML is installed."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("PyYAML isn't installed; write the configuration as JSON") from e
    return yaml.safe_load(text)


def optional_adapter(name: str) -> dict:
    """The status of an adapter whose package is absent here (molecule toolkits, certified noise, sandboxes)."""
    return {"adapter": name, "status": "optional_adapter_unavailable"}


__all__ = ["DIRECTIONS", "Protocol", "Registry", "ReleasePolicy", "attacks", "check_config", "chosen_metrics", "load_config", "optional_adapter", "release_decision", "sanitized", "tasks"]
