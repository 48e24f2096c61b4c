"""Reject policies: from validation scores to a threshold, and what it does with and without review.

Under manual review the rows nearest to the threshold leave the automatic decision, so every
threshold has another set of rows.  The search needs no row-by-threshold product: a histogram of the
scores says which buckets are reviewed whole, and only the buckets at the edge are looked at by score
and, where scores tie, by row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.operators import scores, thresholds
from scoreloom.operators.alignment import row_ids
from scoreloom.operators.thresholds import FINE, SCAN, Point

BINS = 4096
FIXED, BAND, FLOOR, REVIEW = "fixed_reject_rate", "precision_in_band", "recall_at_floor", "manual_review"


@dataclass(frozen=True)
class Policy:
    """What a threshold must do on validation; ``kind`` is one of the four above."""

    kind: str = FIXED
    target_rate: float = 0.35
    precision_floor: float = 0.0
    recall_floor: float = 0.0
    low: float = 0.0
    high: float = 1.0
    manual_rate: float = 0.1
    least_auto: float = 0.8


@dataclass(frozen=True)
class Reviewed:
    """Automatic decisions of a threshold under review, among all rows."""

    threshold: float
    tp: int
    fp: int
    tn: int
    fn: int
    rows: int
    positives: int

    @property
    def auto(self) -> int:
        return self.tp + self.fp + self.tn + self.fn

    @property
    def measures(self) -> dict[str, float]:
        """Automatic precision and bad rate, and shares of the whole portfolio; 0 where nothing is counted."""
        share = lambda a, b: a / b if b else 0.0
        n = max(self.rows, 1)
        return {
            "precision_reject_auto": share(self.tp, self.tp + self.fp),
            "recall_default_auto_on_total": share(self.tp, self.positives),
            "reject_rate_auto_on_total": (self.tp + self.fp) / n,
            "auto_rate": self.auto / n,
            "manual_rate": (self.rows - self.auto) / n,
            "bad_rate_in_auto_approve": share(self.fn, self.tn + self.fn),
        }


def _bounds(t: float, k: int, bins: list[tuple[int, int]]) -> tuple[float, float]:
    """Distances between which the k-th nearest row lies, from (bucket, rows) of scores in [0, 1]."""
    near = sorted((max(i / BINS - t, t - (i + 1) / BINS, 0.0), n) for i, n in bins)
    far = sorted((max(abs(i / BINS - t), abs((i + 1) / BINS - t)), n) for i, n in bins)
    out = []
    for ordered in (near, far):
        seen, at = 0, 0.0
        for at, n in ordered:
            seen += n
            if seen >= k:
                break
        out.append(at)
    return out[0], out[1]


def review_points(df: DataFrame, score: str, target: str, key: str, rate: float, grid: list[float] | None = None) -> list[Reviewed]:
    """Every threshold of the grid when the floor(rate * n) rows nearest to it go to review.

    Distances are compared at 12 decimals and ties go to the smaller key.  Scores must lie in [0, 1];
    rows without a score or target are left out.
    """
    grid = [float(t) for t in (FINE if grid is None else grid)]
    rows = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(F.col(key).alias("k"), F.col(score).cast("double").alias("score"), (F.col(target) == 1).cast("long").alias("y"))
    bucket = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    table = scores.score_table(rows, "score", "y").withColumn("bin", bucket)
    held = {r.bin: (r.n, r.pos) for r in table.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).collect()}
    total, positives = sum(n for n, _ in held.values()), sum(p for _, p in held.values())
    if not total:
        return []
    k = min(math.floor(total * rate + 1e-9), total - 1)
    # Sure buckets are added up here: review, or automatic on either side of the threshold.
    sums = {t: {"tp": 0, "fp": 0, "tn": 0, "fn": 0} for t in grid}

    def automatic(t: float, over: bool, n: int, pos: int) -> None:
        a, b = ("tp", "fp") if over else ("fn", "tn")
        sums[t][a] += pos
        sums[t][b] += n - pos

    edge, left = [], {}
    for t in grid:
        low, high = _bounds(t, k, [(i, n) for i, (n, _) in held.items()]) if k else (-1.0, -1.0)
        left[t] = k
        for i, (n, pos) in held.items():
            near, far = max(i / BINS - t, t - (i + 1) / BINS, 0.0), max(abs(i / BINS - t), abs((i + 1) / BINS - t))
            if far < low - 1e-9:
                left[t] -= n
            elif near > high + 1e-9 and near > 0:
                automatic(t, i / BINS >= t, n, pos)
            else:
                edge.append((t, i))
    spark = df.sparkSession
    wanted = spark.createDataFrame([(t, i, left[t]) for t, i in edge], "t double, bin int, take long")
    at_edge = table.join(F.broadcast(wanted), "bin").select("t", "take", "score", "n", "pos", (F.col("score") >= F.col("t")).alias("over"), F.round(F.abs(F.col("score") - F.col("t")), 12).alias("d"))
    cut = scores.ranked(at_edge.groupBy("t", "take", (-F.col("d")).alias("score")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), ["t", "take"])
    # The distance at which the review ends; with nothing to review it ends before the first row.
    ends = cut.where((F.col("n_above") < F.col("take")) & (F.col("n_above") + F.col("n") >= F.col("take"))).select("t", (-F.col("score")).alias("end"), (F.col("take") - F.col("n_above")).alias("rest"))
    found = {r.t: (r.end, r.rest) for r in ends.collect()}
    reach = spark.createDataFrame([(t, *found.get(t, (-1.0, 0))) for t in grid], "t double, end double, rest long")
    beyond = at_edge.join(F.broadcast(reach), "t").where("d > end").groupBy("t", "over").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    for r in beyond.collect():
        automatic(r.t, r.over, r.n, r.pos)
    # Rows that tie at the end are placed by key, over ranges and not in one task.
    ties = at_edge.join(F.broadcast(reach), "t").where("d = end").select("t", "score", "over", "rest").distinct()
    tied = rows.join(F.broadcast(ties), "score").select("t", "k", "y", "over", "rest", F.struct("t", "k").alias("place"))
    placed = row_ids(tied, "place", "at")
    first = placed.groupBy("t").agg(F.min("at").alias("first"))
    outside = placed.join(F.broadcast(first), "t").where(F.col("at") - F.col("first") >= F.col("rest")).groupBy("t", "over").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    for r in outside.collect():
        automatic(r.t, r.over, r.n, r.pos)
    return [Reviewed(t, **sums[t], rows=total, positives=positives) for t in grid]


def _prefer(rows: list[tuple[tuple[float, ...], float, dict]]) -> tuple[float, dict] | None:
    """The best of (measures to maximise, threshold, report): near-equal measures defer to the next, then the higher threshold."""
    best = None
    for measures, threshold, report in rows:
        if best is None:
            best = (measures, threshold, report)
            continue
        for mine, other in zip((*measures, threshold), (*best[0], best[1])):
            if not thresholds.nearly(mine, other):
                if mine > other:
                    best = (measures, threshold, report)
                break
    return (best[1], best[2]) if best else None


def in_band(found: list[Point], scan: list[Point], policy: Policy) -> dict:
    """Best threshold inside the band of reject rates and over both floors; of equals the lower rate.

    One fallback only: without any such threshold the plain scan decides, by precision, or by recall
    at the precision floor.
    """
    rows = []
    for p in found:
        if policy.low <= p.reject_rate <= policy.high and p.precision >= policy.precision_floor and p.recall >= policy.recall_floor:
            first, second = (p.precision, p.recall) if policy.kind == BAND else (p.recall, p.precision)
            rows.append(((first, second, -p.reject_rate), p.threshold, {"score": first}))
    pick = _prefer(rows)
    if pick:
        return {"threshold": pick[0], "metric": policy.kind, "satisfied": True, "fallback": None, **pick[1]}
    rest = thresholds.best_by(scan, "precision" if policy.kind == BAND else "recall_at_precision_floor", policy.precision_floor)
    return {"threshold": rest["threshold"], "metric": policy.kind, "satisfied": False, "fallback": "precision" if policy.kind == BAND else "recall_at_precision_floor", "score": rest["score"]}


def under_review(found: list[Reviewed], policy: Policy) -> dict | None:
    """Best threshold under review, or none: recall on all defaults, then precision, then the automatic share."""
    rows = []
    for p in found:
        m = p.measures
        if m["precision_reject_auto"] >= policy.precision_floor and policy.low <= m["reject_rate_auto_on_total"] <= policy.high and m["auto_rate"] >= policy.least_auto:
            rows.append(((m["recall_default_auto_on_total"], m["precision_reject_auto"], m["auto_rate"]), p.threshold, {"score": m["recall_default_auto_on_total"]}))
    pick = _prefer(rows)
    return {"threshold": pick[0], "metric": REVIEW, "satisfied": True, "fallback": None, **pick[1]} if pick else None


def choose(df: DataFrame, score: str, target: str, key: str, policy: Policy) -> dict:
    """(threshold, metric, satisfied, fallback, score) of a policy on validation rows."""
    table = scores.score_table(df, score, target)
    if policy.kind == FIXED:
        cut = scores.reject_thresholds(table, [policy.target_rate])[policy.target_rate]
        return {"threshold": cut, "metric": FIXED, "satisfied": True, "fallback": None, "score": None}
    if policy.kind == REVIEW:
        pick = under_review(review_points(df, score, target, key, policy.manual_rate), policy)
        if pick:
            return pick
        plain = choose(df, score, target, key, replace(policy, kind=FLOOR, recall_floor=0.0))
        return plain | {"metric": REVIEW, "satisfied": False, "fallback": FLOOR}
    if policy.kind not in (BAND, FLOOR):
        raise ValueError(f"unknown policy: {policy.kind}")
    return in_band(thresholds.points(table, FINE), thresholds.points(table, SCAN), policy)


def evaluate(df: DataFrame, score: str, target: str, key: str, split: str, policy: Policy, model: str) -> dict:
    """One row of a model's summary: the policy's threshold, and what it does on validation and test.

    Counts at the threshold, at the target rate's own threshold, ranking measures, and the review
    of manual_rate rows (none unless the policy reviews).
    """
    parts = {name: df.where(F.col(split) == name) for name in ("validation", "test")}
    pick = choose(parts["validation"], score, target, key, policy)
    t = float(pick["threshold"])
    out = {"model_name": model, "threshold_metric": pick["metric"], "threshold": t, "threshold_best_score": pick["score"], "constraint_satisfied": pick["satisfied"], "fallback_metric": pick["fallback"], "target_reject_rate": policy.target_rate}
    for name, rows in parts.items():
        table = scores.score_table(rows, score, target)
        p = (thresholds.points(table, [t]) or [Point(t, 0, 0, 0, 0)])[0]
        approved = p.tn + p.fn
        out |= {f"precision_reject_{name}": p.precision, f"recall_default_{name}": p.recall, f"reject_rate_{name}": p.reject_rate, f"approval_bad_rate_{name}": p.fn / approved if approved else 0.0, f"lift_{name}": p.precision / policy.target_rate, f"f1_{name}": p.f1, f"balanced_accuracy_{name}": p.balanced_accuracy}
        ranking = scores.ranking_metrics(table).first()
        out |= {f"pr_auc_{name}": ranking.pr_auc, f"roc_auc_{name}": ranking.roc_auc}
        if policy.kind == REVIEW:
            review = review_points(rows, score, target, key, policy.manual_rate, [t])
            out |= {f"{k}_{name}": v for k, v in (review[0].measures if review else {}).items()}
    return out


def preference(row: dict, policy: Policy) -> tuple[float, ...]:
    """What models are compared by under a policy, on validation, greatest first."""
    if policy.kind == FIXED:
        return row["precision_reject_validation"], row["recall_default_validation"], -abs(row["reject_rate_validation"] - policy.target_rate)
    if policy.kind == REVIEW:
        return row["recall_default_auto_on_total_validation"], row["precision_reject_auto_validation"], row["auto_rate_validation"]
    first = row["precision_reject_validation"] if policy.kind == BAND else row["threshold_best_score"]
    return first, row["recall_default_validation"] if policy.kind == BAND else row["precision_reject_validation"], -row["reject_rate_validation"]


#: What a leaderboard is ordered by, per policy; a minus sorts upwards.
ORDERS = {
    FIXED: ["precision_reject_validation", "recall_default_validation", "-reject_rate_validation"],
    REVIEW: ["recall_default_auto_on_total_validation", "precision_reject_auto_validation", "auto_rate_validation"],
    BAND: ["precision_reject_validation", "recall_default_validation", "-reject_rate_validation"],
    FLOOR: ["threshold_best_score", "precision_reject_validation", "-reject_rate_validation"],
}


def summary(rows: list[dict], policy: Policy) -> list[dict]:
    """Models in the policy's order with ``place`` and ``selected``; the first of the best is selected."""
    best = max(range(len(rows)), key=lambda i: (preference(rows[i], policy), -i)) if rows else None
    value = lambda r, name: -r[name[1:]] if name.startswith("-") else r[name]
    order = sorted(range(len(rows)), key=lambda i: ([-value(rows[i], n) for n in ORDERS[policy.kind]], i))
    return [rows[i] | {"selected": i == best, "place": at + 1} for at, i in enumerate(order)]


def with_decisions(df: DataFrame, score: str, key: str, threshold: float, manual_rate: float = 0.0) -> DataFrame:
    """Rows with y_pred_binary, is_manual_review and y_pred_with_manual (-1 for review)."""
    marked = scores.uncertain(df, score, key, threshold, manual_rate, "_manual") if manual_rate > 0 else df.withColumn("_manual", F.lit(False))
    pred: Column = F.when(F.col(score) >= threshold, 1).otherwise(0)
    return marked.withColumns({"y_pred_binary": pred, "is_manual_review": F.col("_manual").cast("int"), "y_pred_with_manual": F.when(F.col("_manual"), -1).otherwise(pred), "threshold_used": F.lit(threshold)}).drop("_manual")
