"""Choice of a reject threshold on validation scores.

A search sees one short row for each threshold of its grid (``scores.at_thresholds``), ordered by
threshold; folds whose ties depend on order run over those rows on the driver, which holds at most a
few hundred of them whatever the size of the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from scoreloom.operators import scores

SCAN = [0.05 + i * (0.90 / 180) for i in range(181)]
FINE = [0.01 + i * (0.98 / 196) for i in range(197)]


@dataclass(frozen=True)
class Point:
    threshold: float
    tp: int
    fp: int
    tn: int
    fn: int

    @property
    def precision(self) -> float:
        return self.tp / (self.tp + self.fp) if self.tp + self.fp else 0.0

    @property
    def recall(self) -> float:
        return self.tp / (self.tp + self.fn) if self.tp + self.fn else 0.0

    @property
    def reject_rate(self) -> float:
        return (self.tp + self.fp) / max(self.tp + self.fp + self.tn + self.fn, 1)

    @property
    def f1(self) -> float:
        d = 2 * self.tp + self.fp + self.fn
        return 2 * self.tp / d if d else 0.0

    @property
    def balanced_accuracy(self) -> float:
        parts = [a / b for a, b in ((self.tp, self.tp + self.fn), (self.tn, self.tn + self.fp)) if b]
        return sum(parts) / len(parts) if parts else 0.0


def points(table: DataFrame, grid: list[float]) -> list[Point]:
    """Confusion counts of every threshold, from the collected gap counts (one row for each gap)."""
    gaps, cuts = scores.gap_counts(table, grid)
    found = {r.gap: (r.n, r.pos) for r in gaps.collect()}
    if not found:
        return []
    n, pos = (sum(v[k] for v in found.values()) for k in (0, 1))
    out, rejected, tp = [], 0, 0
    for i in range(len(cuts), 0, -1):
        rejected, tp = rejected + found.get(i, (0, 0))[0], tp + found.get(i, (0, 0))[1]
        out.append(Point(cuts[i - 1], tp, rejected - tp, n - pos - rejected + tp, pos - tp))
    return out[::-1]


def nearly(a: float, b: float) -> bool:
    return a == b or (math.isfinite(a) and math.isfinite(b) and abs(a - b) <= 1e-8 + 1e-5 * abs(b))


def best_by(found: list[Point], metric: str = "balanced_accuracy", floor: float | None = None) -> dict:
    """Best threshold of the scan: the first with the highest metric.

    'recall_at_precision_floor' breaks near-ties by precision, then by the higher threshold, and
    falls back to f1 if no threshold reaches the floor.  Without rows the threshold is 0.5.
    """
    if not found:
        return {"threshold": 0.5, "score": None, "satisfied": False, "fallback": None}
    if metric == "recall_at_precision_floor":
        pick, score, precision = None, -math.inf, -math.inf
        for p in found:
            if floor is not None and p.precision < floor:
                continue
            tie = nearly(p.recall, score)
            if p.recall > score or (tie and p.precision > precision) or (tie and nearly(p.precision, precision) and (pick is None or p.threshold > pick.threshold)):
                pick, score, precision = p, p.recall, p.precision
        if pick:
            return {"threshold": pick.threshold, "score": pick.recall, "satisfied": True, "fallback": None}
        return best_by(found, "f1") | {"satisfied": False, "fallback": "f1"}
    value = {"f1": lambda p: p.f1, "precision": lambda p: p.precision, "recall": lambda p: p.recall}.get(metric, lambda p: p.balanced_accuracy)
    pick = max(found, key=lambda p: (value(p), -p.threshold))
    return {"threshold": pick.threshold, "score": value(pick), "satisfied": False, "fallback": None}


def business_grid(table: DataFrame) -> list[float]:
    """Even grid joined with the scores' percentiles."""
    percentiles = [r.value for r in scores.quantiles(table, [0.01 + i * (0.98 / 98) for i in range(99)]).collect()]
    return sorted(set(FINE) | {v for v in percentiles if v is not None})


def best_business(found: list[Point], scan: list[Point], objective: str = "precision_at_reject_rate_bounds", precision_floor: float = 0.0, recall_floor: float = 0.0, low: float = 0.0, high: float = 1.0, target: float | None = None) -> dict:
    """Best threshold inside a band of reject rates, floors relaxed in turn if nothing is left.

    Order of preference: the objective, its companion, nearness to the target rate, the lower
    rate, the higher threshold.  Without any point in the band the plain scan decides.
    """
    if objective not in ("precision_at_reject_rate_bounds", "recall_at_precision_floor"):
        raise ValueError(f"unknown objective: {objective}")
    low, high = (min(max(x, 0.0), 1.0) for x in sorted((low, high)))
    aim = min(max(target, low), high) if target is not None else (low + high) / 2
    for level, (pf, rf) in enumerate([(max(0.0, precision_floor), max(0.0, recall_floor)), (0.0, max(0.0, recall_floor)), (0.0, 0.0)]):
        inside = [p for p in found if low <= p.reject_rate <= high and p.precision >= pf and p.recall >= rf]
        if inside:
            first = (lambda p: (p.precision, p.recall)) if objective.startswith("precision") else (lambda p: (p.recall, p.precision))
            pick = max(inside, key=lambda p: (*first(p), -abs(p.reject_rate - aim), -p.reject_rate, p.threshold))
            return {"threshold": pick.threshold, "score": first(pick)[0], "satisfied": level == 0, "fallback": (None, "without_precision_floor", "without_floors")[level], "precision": pick.precision, "recall": pick.recall, "reject_rate": pick.reject_rate}
    rest = best_by(scan, "precision" if objective.startswith("precision") else "recall_at_precision_floor", precision_floor)
    return rest | {"satisfied": False, "fallback": "no_threshold_in_band", "precision": None, "recall": None, "reject_rate": None}
