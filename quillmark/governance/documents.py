"""Canonical JSON documents: digests, signatures, receipts and their checks."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import os
import tempfile
from collections.abc import Mapping, Sequence

#: The form of receipts written here.
RECEIPT = "evaluation-receipt/v1"


def canonical(value) -> bytes:
    """JSON with sorted keys, no spaces and no escapes beyond what JSON needs; numbers that aren't finite are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(value) -> str:
    return hashlib.sha256(canonical(value)).hexdigest()


def file_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def sealed(payload: Mapping) -> dict:
    """The document with its own digest."""
    body = {k: v for k, v in payload.items() if k not in ("digest", "signature")}
    return body | {"digest": digest(body)}


def signed(payload: Mapping, key: bytes) -> dict:
    """A sealed document with an HMAC over its digest."""
    out = sealed(payload)
    return out | {"signature": hmac.new(key, out["digest"].encode(), hashlib.sha256).hexdigest()}


def verified(document: Mapping, key: bytes | None = None) -> bool:
    """Whether a document's digest, and with a key its signature, are its own."""
    body = {k: v for k, v in document.items() if k not in ("digest", "signature")}
    if not hmac.compare_digest(str(document.get("digest", "")), digest(body)):
        return False
    if key is None:
        return True
    own = hmac.new(key, document["digest"].encode(), hashlib.sha256).hexdigest()
    return hmac.compare_digest(str(document.get("signature", "")), own)


def receipt(model: Mapping, task: str, metrics: Mapping[str, float | None], n: int, *, protocol: str = "", intervals: Mapping | None = None, slices: Sequence[Mapping] = (), scope: str = "local", inputs: Mapping[str, str] | None = None) -> dict:
    """A sealed record of one evaluation; undefined metrics are null."""
    if set(model) != {"id", "revision"}:
        raise ValueError("a model is named by id and revision")
    if scope not in ("local", "shareable"):
        raise ValueError("scope must be local or shareable")
    clean = {k: None if v is None or not math.isfinite(v) else float(v) for k, v in metrics.items()}
    body = {"schema": RECEIPT, "scope": scope, "model": dict(model), "task": task, "protocol": protocol, "n": int(n), "metrics": clean, "intervals": dict(intervals or {}), "slices": list(slices)}
    if scope == "local":
        body["inputs"] = dict(inputs or {})
    return sealed(body)


def check_receipt(document: Mapping) -> None:
    """Raises unless a document has the form of a receipt and its own digest."""
    needed = {"schema", "scope", "model", "task", "n", "metrics", "digest"}
    if absent := needed - set(document):
        raise ValueError(f"a receipt lacks {sorted(absent)}")
    if document["schema"] != RECEIPT or not verified(document):
        raise ValueError("the receipt's form or digest is wrong")


def manifest(paths: Sequence[str]) -> dict:
    """Names, sizes and digests of a run's files."""
    return sealed({"schema": "run-manifest/v1", "files": [{"name": os.path.basename(p), "bytes": os.path.getsize(p), "sha256": file_digest(p)} for p in sorted(paths)]})


def check_manifest(document: Mapping, folder: str) -> list[str]:
    """Names of files that are absent or changed; raises if the manifest itself was changed."""
    if not verified(document):
        raise ValueError("the manifest's digest is wrong")
    bad = []
    for entry in document["files"]:
        path = os.path.join(folder, entry["name"])
        if not os.path.isfile(path) or file_digest(path) != entry["sha256"]:
            bad.append(entry["name"])
    return bad


def write_json(path: str, value, inputs: Sequence[str] = ()) -> None:
    """Writes a document at once or not at all; an output may be neither an input nor a link to one."""
    for other in inputs:
        if os.path.realpath(other) == os.path.realpath(path) or (os.path.exists(path) and os.path.exists(other) and os.path.samefile(other, path)):
            raise ValueError("an output is one of the inputs")
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(canonical(value))
            file.flush()
            os.fsync(file.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def append_audit(path: str, event: Mapping) -> None:
    """Adds a line to an audit log."""
    with open(path, "ab") as file:
        file.write(canonical(event) + b"\n")


def markdown(document: Mapping) -> str:
    """A receipt for readers."""
    lines = [f"# {document['model']['id']} ({document['model']['revision']})", "", f"Task {document['task']}, {document['n']} rows.", "", "| metric | value | interval |", "| --- | --- | --- |"]
    for name, value in sorted(document["metrics"].items()):
        bounds = document.get("intervals", {}).get(name)
        lines.append(f"| {name} | {'undefined' if value is None else f'{value:.6g}'} | {f'{bounds[0]:.6g} to {bounds[1]:.6g}' if bounds else ''} |")
    return "\n".join(lines) + "\n"
