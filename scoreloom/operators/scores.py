"""Measures of scored rows, all from one table of distinct scores.

``score_table`` reduces the rows to (keys, score, n, pos) with map-side combine.  Everything else,
the confusion counts of any number of thresholds, average precision, AUC, quantiles, gains curves, is
computed on that table; running sums over it go bucket by bucket, with the buckets' offsets added,
so that no task sees all scores however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.alignment import row_ids
from scoreloom.session import checkpointed

STEPS = 1024  # buckets of an octave


def bucket_of(value: Column) -> Column:
    """An order-keeping bucket of a number of any size: steps of a 1024th of an octave, either sign."""
    size = F.floor((F.log2(F.abs(value)) + 1100) * STEPS)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def score_table(df: DataFrame, score: str, target: str, by: list[str] | None = None) -> DataFrame:
    """(by..., score, n, pos); rows with a null score or target are left out."""
    kept = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    return kept.groupBy(*(by or []), F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("pos"))


def ranked(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The score table with sums over all higher scores: n_above, pos_above, and totals n_all, pos_all."""
    by = by or []
    t = table.withColumn("bucket", bucket_of(F.col("score")))
    offsets = t.groupBy(*by, "bucket").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bp"))
    over = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("bucket"))
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = offsets.select(*by, "bucket", (F.sum("bn").over(over) - F.col("bn")).alias("on"), (F.sum("bp").over(over) - F.col("bp")).alias("op"), F.sum("bn").over(every).alias("n_all"), F.sum("bp").over(every).alias("pos_all"))
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("score"))
    return t.join(offsets, [*by, "bucket"]).select(
        *by, "score", "n", "pos", (F.col("on") + F.sum("n").over(inside) - F.col("n")).alias("n_above"), (F.col("op") + F.sum("pos").over(inside) - F.col("pos")).alias("pos_above"), "n_all", "pos_all"
    )


def ranking_metrics(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., pr_auc, roc_auc): step-wise average precision and tie-aware AUC.

    pr_auc is null without a positive, roc_auc unless both classes are present.
    """
    r = ranked(table, by)
    neg = F.col("n") - F.col("pos")
    ap = F.sum(F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("n_above") + F.col("n")))
    area = F.sum(neg * (F.col("pos_above") + F.col("pos") / 2))
    p, n = F.max("pos_all"), F.max("n_all")
    return r.groupBy(*(by or [])).agg(F.try_divide(ap, p).alias("pr_auc"), F.try_divide(area, p * (n - p)).alias("roc_auc"))


def quantiles(table: DataFrame, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., prob, value): exact quantiles with linear interpolation between neighbours."""
    by = by or []
    r = ranked(table, by)
    below = F.col("n_all") - F.col("n_above") - F.col("n")
    wants = F.array(*[F.struct(F.lit(float(p)).alias("prob")) for p in probs])
    at = r.select(*by, "score", "n", "n_all", below.alias("below"), F.explode(wants).alias("w")).select("*", "w.prob", (F.col("w.prob") * (F.col("n_all") - 1)).alias("pos"))
    low, high = F.floor("pos"), F.ceil("pos")
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    near = at.where(holds(low) | holds(high))
    return near.groupBy(*by, "prob").agg(F.max(F.when(holds(low), F.col("score"))).alias("a"), F.max(F.when(holds(high), F.col("score"))).alias("b"), F.max(F.col("pos") - low).alias("_frac")).select(*by, "prob", (F.col("a") + (F.col("b") - F.col("a")) * F.col("_frac")).alias("value"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, target: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by..., tp, fp, tn, fn) of rows with both values."""
    y, p = F.col(target) == 1, F.col(predicted) == 1
    cells = {"tp": y & p, "fp": ~y & p, "tn": ~y & ~p, "fn": y & ~p}
    return df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(k) for k, c in cells.items()])


def business_columns(tp="tp", fp="fp", tn="tn", fn="fn") -> dict[str, Column]:
    """Business measures of confusion counts; 0 where a denominator is 0."""
    tp, fp, tn, fn = map(F.col, (tp, fp, tn, fn))
    n = tp + fp + tn + fn
    return {
        "reject_rate": ratio(tp + fp, n),
        "approve_rate": ratio(tn + fn, n),
        "default_capture_recall": ratio(tp, tp + fn),
        "bad_rate_in_reject_precision": ratio(tp, tp + fp),
        "bad_rate_in_approve": ratio(fn, tn + fn),
    }


def classification_columns(tp="tp", fp="fp", tn="tn", fn="fn") -> dict[str, Column]:
    """Accuracy, precision, recall, f1, and balanced accuracy over the classes present."""
    tp, fp, tn, fn = map(F.col, (tp, fp, tn, fn))
    recalls = F.array_compact(F.array(F.try_divide(tp.cast("double"), tp + fn), F.try_divide(tn.cast("double"), tn + fp)))
    balanced = F.aggregate(recalls, F.lit(0.0), lambda a, x: a + x) / F.size(recalls)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": F.when(F.size(recalls) > 0, balanced),
    }


def gap_counts(table: DataFrame, thresholds: list[float], by: list[str] | None = None) -> tuple[DataFrame, list[float]]:
    """(by..., gap, n, pos) of the gaps between sorted thresholds, and those thresholds.

    Gap i holds the scores that reach i thresholds; each distinct score is placed by binary search.
    """
    from pyspark.ml.feature import Bucketizer

    grid = sorted(set(map(float, thresholds)))
    if not grid:
        raise ValueError("no thresholds")
    binned = Bucketizer(splits=[float("-inf"), *grid, float("inf")], inputCol="score", outputCol="_gap").transform(table)
    return binned.groupBy(*(by or []), F.col("_gap").cast("int").alias("gap")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), grid


def at_thresholds(table: DataFrame, thresholds: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., threshold, tp, fp, tn, fn) for each threshold; a score of the threshold is rejected.

    The gap counts, one short row for each gap, are summed from the top in a window of their own
    size.  No row meets a threshold twice.
    """
    by = by or []
    gaps, grid = gap_counts(table, thresholds, by)
    groups = gaps.groupBy(*by).agg(F.sum("n").alias("n_all"), F.sum("pos").alias("pos_all"))
    frame = groups.select("*", F.posexplode(F.array(*map(F.lit, grid))).alias("_i", "threshold")).withColumn("gap", F.col("_i") + 1)
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    filled = frame.join(gaps, [*by, "gap"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "pos": F.coalesce("pos", F.lit(0))})
    down = over.orderBy(F.desc("gap"))
    rows = filled.select(*by, "threshold", "n_all", "pos_all", F.sum("n").over(down).alias("rejected"), F.sum("pos").over(down).alias("tp"))
    return rows.select(*by, "threshold", "tp", (F.col("rejected") - F.col("tp")).alias("fp"), (F.col("n_all") - F.col("pos_all") - F.col("rejected") + F.col("tp")).alias("tn"), (F.col("pos_all") - F.col("tp")).alias("fn"))


def in_unit_range(df: DataFrame, score: str, out: str) -> DataFrame:
    """Scores as they are if all lie in [0, 1], else their logistic function."""
    outside = df.agg(F.coalesce(F.bool_or((F.col(score) < 0) | (F.col(score) > 1)), F.lit(False)).alias("_outside"))
    return df.crossJoin(F.broadcast(outside)).withColumn(out, F.when(F.col("_outside"), 1 / (1 + F.exp(-F.col(score)))).otherwise(F.col(score))).drop("_outside")


def reject_thresholds(table: DataFrame, rates: list[float]) -> dict[float, float]:
    """Threshold of each target reject rate: quantile 1 - rate; none for 0, all for 1; 0.5 if there are no scores."""
    wanted = sorted({0.0, 1.0, *(1 - r for r in rates if 0 < r < 1)})
    values = {round(r.prob, 12): r.value for r in quantiles(table, wanted).collect()}
    out = {}
    for r in rates:
        if not values:
            out[r] = 0.5
        elif r <= 0:
            out[r] = values[1.0] + 1e-12
        elif r >= 1:
            out[r] = values[0.0] - 1e-12
        else:
            out[r] = values[round(1 - r, 12)]
    return out


def gains_curve(df: DataFrame, score: str, target: str, split: str, rates: list[float] | None = None) -> DataFrame:
    """Validation thresholds of reject rates, and what they do on validation and test."""
    rates = rates or [i / 100 for i in range(5, 51, 5)]
    spark = df.sparkSession
    # Read for the thresholds and for both sides of the curve: kept in the shared folder.
    table = checkpointed(score_table(df.where(F.col(split).isin("validation", "test")), score, target, [split]))
    cuts = reject_thresholds(table.where(F.col(split) == "validation"), rates)
    wide = at_thresholds(table, list(cuts.values()), [split]).select(split, "threshold", "tp", "fp", "tn", "fn").withColumns(business_columns())
    plan = spark.createDataFrame([(float(r), float(t)) for r, t in cuts.items()], "target_reject_rate double, threshold double")
    side = lambda name: wide.where(F.col(split) == name).select("threshold", *[F.col(c).alias(f"{name}_{c}") for c in business_columns()])
    both = plan.join(side("validation"), "threshold", "left").join(side("test"), "threshold", "left")
    return both.select(
        "target_reject_rate",
        F.col("threshold").alias("threshold_from_validation"),
        F.col("validation_reject_rate"),
        F.col("validation_bad_rate_in_reject_precision").alias("validation_precision"),
        F.col("validation_default_capture_recall").alias("validation_recall"),
        F.col("test_reject_rate"),
        F.col("test_bad_rate_in_reject_precision").alias("test_precision"),
        F.col("test_default_capture_recall").alias("test_recall"),
        F.col("test_bad_rate_in_approve").alias("test_approval_bad_rate"),
        F.try_divide(F.col("test_bad_rate_in_reject_precision"), F.col("target_reject_rate")).alias("test_lift"),
    )


def exact_top(df: DataFrame, score: str, key: str, rate: float, out: str = "rejected") -> DataFrame:
    """Marks exactly floor(rate * n) rows of highest score, ties by smaller key.

    The cut score comes from the score table; only the rows that tie at it are ordered, by ranges of
    the key, so that ties of any number are not one task's.
    """
    table = ranked(score_table(df.withColumn("_one", F.lit(1)), score, "_one"))
    k = F.floor(F.col("n_all") * F.lit(rate) + 1e-9)
    cut = table.where((F.col("n_above") < k) & (F.col("n_above") + F.col("n") >= k)).select(F.col("score").alias("_cut"), (k - F.col("n_above")).alias("_left")).limit(1)
    marked = df.join(F.broadcast(cut), how="left")
    tied = row_ids(marked.where(F.col(score) == F.col("_cut")).select(F.col(key).alias("_tied"), "_left"), "_tied", "_rn").where("_rn < _left").select("_tied")
    return marked.join(tied, marked[key] == tied["_tied"], "left").withColumn(out, F.coalesce(F.col(score) > F.col("_cut"), F.lit(False)) | F.col("_tied").isNotNull()).drop("_cut", "_left", "_tied")


def uncertain(df: DataFrame, score: str, key: str, threshold: float, rate: float, out: str = "manual") -> DataFrame:
    """Marks floor(rate * n) rows (n - 1 at most) nearest to a threshold, ties by smaller key."""
    near = df.withColumn("_near", -F.round(F.abs(F.col(score) - threshold), 12))
    n = df.where(F.col(score).isNotNull()).count()
    k = min(int(rate * n + 1e-9), max(n - 1, 0))
    return exact_top(near, "_near", key, (k + 0.5) / n if n and k else 0.0, out).drop("_near")
