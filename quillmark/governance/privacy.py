"""Noise and budgets. Noise is drawn on the driver alone: a repeated task must never draw again."""

from __future__ import annotations

import hashlib
import math
import random
import sqlite3
from contextlib import closing
from fractions import Fraction


class HashSource:
    """Uniform numbers from 0 to 1 by hashes of a seed and a counter, the same in any engine; for tests, never for a release."""

    def __init__(self, seed: int):
        self.seed, self.count = seed, 0

    def random(self) -> float:
        text = hashlib.md5(f"{self.seed}|{self.count}".encode(), usedforsecurity=False).hexdigest()
        self.count += 1
        return int(text[:13], 16) / 2.0**52


def laplace(scale: float, draw: random.Random | HashSource) -> float:
    """One Laplace draw by the inverse of its distribution function."""
    u = draw.random() - 0.5
    return -scale * math.copysign(1.0, u) * math.log1p(-2 * min(abs(u), 0.5 - 2**-54))


def _source(seed: int | None) -> random.Random | HashSource:
    """The system's randomness; counted hashes only where a test names a seed."""
    return random.SystemRandom() if seed is None else HashSource(seed)


def _positive(value: float, name: str) -> Fraction:
    if isinstance(value, bool) or not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be finite and above 0")
    return Fraction.from_float(float(value))


class Budget:
    """A privacy budget under sequential composition, summed exactly; it is charged before anything is drawn."""

    def __init__(self, limit: float):
        self.limit, self.entries = _positive(limit, "limit"), []

    def spent(self) -> Fraction:
        return sum((e for _, e in self.entries), Fraction(0))

    def spend(self, epsilon: float, label: str = "") -> None:
        self.spend_all([(label, epsilon)])

    def spend_all(self, charges: list[tuple[str, float]]) -> None:
        """Charges all of (label, epsilon) or none."""
        costs = [(label, _positive(epsilon, "epsilon")) for label, epsilon in charges]
        if self.spent() + sum((c for _, c in costs), Fraction(0)) > self.limit:
            raise ValueError("the privacy budget is exhausted")
        self.entries += costs


class LedgerBudget:
    """The same, kept in a SQLite file that several processes may charge; rows are only appended and numbers are kept exactly as hex text."""

    def __init__(self, path: str, limit: float):
        self.path, self.limit = path, _positive(limit, "limit")
        with closing(self._open()) as db, db:
            db.execute("CREATE TABLE IF NOT EXISTS charge (id INTEGER PRIMARY KEY, label TEXT NOT NULL, epsilon TEXT NOT NULL)")

    def _open(self):
        return sqlite3.connect(self.path, timeout=30, isolation_level=None)

    def spent(self) -> Fraction:
        with closing(self._open()) as db:
            return self._sum(db)

    @staticmethod
    def _sum(db) -> Fraction:
        return sum((Fraction.from_float(float.fromhex(e)) for (e,) in db.execute("SELECT epsilon FROM charge")), Fraction(0))

    def spend(self, epsilon: float, label: str = "") -> None:
        self.spend_all([(label, epsilon)])

    def spend_all(self, charges: list[tuple[str, float]]) -> None:
        """Charges all of (label, epsilon) or none, in one transaction."""
        cost = sum((_positive(epsilon, "epsilon") for _, epsilon in charges), Fraction(0))
        with closing(self._open()) as db:
            db.execute("BEGIN IMMEDIATE")
            try:
                if self._sum(db) + cost > self.limit:
                    raise ValueError("the privacy budget is exhausted")
                db.executemany("INSERT INTO charge (label, epsilon) VALUES (?, ?)", [(label, float(epsilon).hex()) for label, epsilon in charges])
                db.execute("COMMIT")
            except BaseException:
                db.execute("ROLLBACK")
                raise


def release_mean(mean: float, n: int, low: float, high: float, epsilon: float, budget, seed: int | None = None, label: str = "mean") -> float:
    """A bounded mean with Laplace noise of scale (high - low) / n / epsilon, after the budget was charged."""
    if n <= 0 or not low < high:
        raise ValueError("a bounded mean needs rows and low < high")
    budget.spend(epsilon, label)
    return mean + laplace((high - low) / n / epsilon, _source(seed))


def release_means(centers: list[tuple[str, float, int, float, float]], total: float, budget, weights: list[float] | None = None, seed: int | None = None) -> dict[str, float]:
    """Several means (label, mean, n, low, high) that share ``total`` by weight; shares are rounded down, so that they never exceed it, and are charged together or not at all."""
    shares = [Fraction.from_float(float(w)) for w in weights or [1.0] * len(centers)]
    draw, out, every = _source(seed), {}, _positive(total, "epsilon")
    parts = []
    for share in shares:
        exact = every * share / sum(shares)
        value = float(exact)
        parts.append(math.nextafter(value, 0.0) if Fraction.from_float(value) > exact else value)
    budget.spend_all([(label, part) for (label, *_), part in zip(centers, parts)])
    for (label, mean, n, low, high), part in zip(centers, parts):
        out[label] = mean + laplace((high - low) / n / part, draw)
    return out


def perturbed(metrics: dict[str, float], epsilon: float, sensitivity: float, seed: int | None = None) -> dict[str, float]:
    """Metrics with Laplace noise in their order; undefined ones stay so and take no draw. This makes no formal privacy claim."""
    _positive(epsilon, "epsilon")
    draw = _source(seed)
    return {k: v if v is None or math.isnan(v) else v + laplace(sensitivity / epsilon, draw) for k, v in metrics.items()}
