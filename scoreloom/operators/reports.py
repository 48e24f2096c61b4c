"""Report tables over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators import scores, splits

STABLE, WARN = 0.01, 0.03


def fixed_rate(df: DataFrame, score: str, target: str, split: str, rate: float) -> DataFrame:
    """What a validation threshold for a reject rate does on test; lift against target and base rate."""
    table = scores.score_table(df.where(F.col(split).isin("validation", "test")), score, target, [split])
    cut = scores.reject_thresholds(table.where(F.col(split) == "validation"), [rate])[rate]
    at = scores.at_thresholds(table.where(F.col(split) == "test").drop(split), [cut]).withColumns(scores.business_columns())
    base = scores.ratio(F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    p = F.col("bad_rate_in_reject_precision")
    return at.select(F.col("reject_rate").alias("actual_reject_rate"), p.alias("precision_at_target"), F.col("default_capture_recall").alias("recall_at_target"), F.col("bad_rate_in_approve").alias("approval_bad_rate"), F.try_divide(p, F.lit(rate)).alias("lift_vs_target_rr"), F.try_divide(p, base).alias("lift_vs_base_rate"))


def gap_state(gap):
    size = F.round(F.abs(gap), 9)
    return F.when(size <= STABLE, "stable").when(size <= WARN, "warn").otherwise("recalibrate")


def rate_gaps(df: DataFrame, score: str, by: str, threshold: float, rate: float) -> DataFrame:
    """Reject rate of each group against the target rate, and what the gap asks for."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(score) >= threshold).alias("k"))
    actual = F.col("k") / F.col("n")
    return g.select(by, "n", F.round(actual, 9).alias("actual_reject_rate"), F.round(actual - rate, 9).alias("gap"), gap_state(actual - rate).alias("state"))


def per_thousand(confusion: DataFrame) -> DataFrame:
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return confusion.withColumns({f"{c}_per_1000": F.try_divide(F.col(c) * 1000, n) for c in ("tp", "fn", "fp")})


def leaderboard(df: DataFrame, model: str, score: str, target: str, split: str, rate: float) -> DataFrame:
    """Models by precision, recall and nearness to the rate, at their validation thresholds."""
    table = scores.score_table(df.where(F.col(split).isin("validation", "test")), score, target, [model, split])
    cuts = scores.quantiles(table.where(F.col(split) == "validation").drop(split), [1 - rate], [model]).select(model, F.col("value").alias("threshold"))
    test = table.where(F.col(split) == "test").join(F.broadcast(cuts), model)
    over = F.col("score") >= F.col("threshold")
    c = test.groupBy(model, "threshold").agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("rej"), F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"))
    r = lambda a, b: F.round(scores.ratio(a, b), 9)
    board = c.select(model, F.round("threshold", 9).alias("threshold"), r(F.col("rej"), F.col("n")).alias("reject_rate"), r(F.col("tp"), F.col("rej")).alias("precision"), r(F.col("tp"), F.col("p")).alias("recall"), F.round(F.abs(scores.ratio(F.col("rej"), F.col("n")) - rate), 9).alias("rr_gap"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("precision"), F.desc("recall"), "rr_gap", model))
    return board.withColumn("place", place)


def boards(board: DataFrame) -> DataFrame:
    """Main board for models near the target rate, extended board for the rest."""
    return board.withColumn("board", F.when(F.col("rr_gap") <= WARN, "main").otherwise("extended"))


def confidence(df: DataFrame, target: str, predicted: str, draws: int = 1000) -> DataFrame:
    """95 % bootstrap intervals of precision, recall and approval bad rate."""
    y, p = F.col(target) == 1, F.col(predicted) == 1
    sums = splits.bootstrap(df, {"tp": y & p, "fp": ~y & p, "tn": ~y & ~p, "fn": y & ~p}, draws)
    m = {"precision": scores.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": scores.ratio(F.col("tp"), F.col("tp") + F.col("fn")), "approval_bad_rate": scores.ratio(F.col("fn"), F.col("tn") + F.col("fn"))}
    long = sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in m.items()])).alias("x")).select("x.*")
    return long.groupBy("measure").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg("v").alias("mean")).select("measure", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"), F.round("mean", 6).alias("mean"))
