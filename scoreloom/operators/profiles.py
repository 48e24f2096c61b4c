"""Risk profiles: smoothed bad rates of value buckets, and scores made of them.

All features of a frame are profiled by one plan: values are laid out in long form as (feature,
bucket), counted, folded and weighted.  Numeric buckets are numbers of right-closed bins, so edges
and values never meet as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.scores import ranked

MISSING, OTHER = "__MISSING__", "__OTHER__"
LEAST_WEIGHT = 1e-6


def quantile_edges(df: DataFrame, columns: list[str], max_bins: int = 8) -> DataFrame:
    """(feature, edges): inner edges of each numeric column's quantile bins, ascending.

    q = min(max_bins, distinct values) bins; equal edges count once and the outermost are open, so a
    column with two values has a single bin.  Columns without a value are left out.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v IS NOT NULL AND NOT isnan(v)")
    values = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    size = values.groupBy("feature").agg(F.sum("n").alias("total"), F.least(F.count(F.lit(1)), F.lit(max_bins)).cast("int").alias("q"))
    table = ranked(values.select("feature", F.col("v").alias("score"), "n", F.lit(0).alias("pos")), ["feature"])
    placed = table.select("feature", F.col("score").alias("v"), "n", (F.col("n_all") - F.col("n_above") - F.col("n")).alias("below")).join(size, "feature")
    # Quantile k/q lies between two ranks; each value knows which of these ranks it holds.
    ks = F.transform(F.sequence(F.lit(0), F.col("q")), lambda k: F.struct(k.alias("k"), (k / F.col("q") * (F.col("total") - 1)).alias("pos")))
    holds = lambda r: (F.col("below") <= r) & (r < F.col("below") + F.col("n"))
    hit = placed.select("feature", "v", "n", "below", F.explode(ks).alias("w")).where(holds(F.floor("w.pos")) | holds(F.ceil("w.pos")))
    cut = hit.groupBy("feature", "w.k").agg(F.max(F.when(holds(F.floor("w.pos")), F.col("v"))).alias("a"), F.max(F.when(holds(F.ceil("w.pos")), F.col("v"))).alias("b"), F.max(F.col("w.pos") - F.floor("w.pos")).alias("f"))
    edges = cut.groupBy("feature").agg(F.array_sort(F.collect_set(F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))).alias("e"))
    return edges.select("feature", F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))).alias("edges"))


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin: how many inner edges lie below the value."""
    if not edges:
        return F.lit(0)
    out = F.lit(0)
    for e in edges:
        out = out + F.when(value > float(e), 1).otherwise(0)
    return out


def bucket_columns(numeric: dict[str, list[float]], categorical: list[str]) -> dict[str, Column]:
    """Bucket of each feature as text: a bin number, a category, or MISSING."""
    out = {}
    for name, edges in numeric.items():
        v = F.col(name).cast("double")
        out[name] = F.when(v.isNull() | F.isnan(v), MISSING).otherwise(bin_of(v, edges).cast("string"))
    for name in categorical:
        v = F.col(name).cast("string")
        out[name] = F.when(v.isNull() | v.isin("", "nan"), MISSING).otherwise(v)
    return out


def edges_of(df: DataFrame, columns: list[str], max_bins: int = 8) -> dict[str, list[float]]:
    """The edges on the driver: at most max_bins - 1 numbers for each column."""
    found = {r.feature: list(r.edges) for r in quantile_edges(df, columns, max_bins).collect()}
    return {c: found[c] for c in columns if c in found}


def build(df: DataFrame, target: str, numeric: dict[str, list[float]], categorical: list[str], least: int = 80, smoothing: float = 20.0) -> DataFrame:
    """(feature, feature_type, bucket, n, bad, risk, weight, default_risk) of all features.

    Buckets of fewer than ``least`` rows are folded into OTHER.  risk is the bad rate drawn towards
    the overall rate; weight is the range of a feature's risks.
    """
    buckets = bucket_columns(numeric, categorical)
    cells = [F.struct(F.lit(k).alias("feature"), F.lit("numeric" if k in numeric else "categorical").alias("feature_type"), b.alias("bucket")) for k, b in buckets.items()]
    long = df.select(F.col(target).cast("long").alias("y"), F.explode(F.array(*cells)).alias("c")).select("y", "c.*")
    counts = long.groupBy("feature", "feature_type", "bucket").agg(F.count("y").alias("n"), F.sum("y").alias("bad"))
    whole = Window.partitionBy("feature")
    # Every row is in one bucket of each feature, so each feature's sums give the overall rate.
    rate = F.sum("bad").over(whole) / F.sum("n").over(whole)
    folded = counts.withColumn("rate", rate).withColumn("bucket", F.when(F.col("n") < least, OTHER).otherwise(F.col("bucket"))).groupBy("feature", "feature_type", "bucket", "rate").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    risk = folded.withColumn("risk", (F.col("bad") + smoothing * F.col("rate")) / (F.col("n") + smoothing))
    weight = F.greatest(F.max("risk").over(whole) - F.min("risk").over(whole), F.lit(LEAST_WEIGHT))
    other = F.max(F.when(F.col("bucket") == OTHER, F.col("risk"))).over(whole)
    return risk.select("feature", "feature_type", "bucket", "n", "bad", "risk", weight.alias("weight"), F.coalesce(other, F.col("rate")).alias("default_risk"))


def score(df: DataFrame, profile: DataFrame, numeric: dict[str, list[float]], categorical: list[str], out: str = "score", contributions: bool = False) -> DataFrame:
    """Rows with the weighted mean of their features' risks (and risk_<feature> columns).

    The profile is a few dozen rows for each feature (bins, and categories of at least ``least``
    rows), so it becomes literal maps in the expression and scoring needs no shuffle.
    """
    rows: dict[str, dict] = {}
    for r in profile.collect():
        p = rows.setdefault(r.feature, {"risks": {}, "weight": r.weight, "default": r.default_risk})
        p["risks"][r.bucket] = r.risk
    total, weights, parts = F.lit(0.0), 0.0, []
    for name, bucket in bucket_columns(numeric, categorical).items():
        if name not in rows:
            continue
        p = rows[name]
        table = F.create_map(*[F.lit(x) for kv in sorted(p["risks"].items()) for x in kv])
        risk = F.coalesce(F.try_element_at(table, bucket), F.lit(p["default"]))
        parts.append(risk.alias(f"risk_{name}"))
        total = total + risk * p["weight"]
        weights += p["weight"]
    return df.select("*", (total / (weights or 1.0)).alias(out), *(parts if contributions else []))


def export(profile: DataFrame) -> DataFrame:
    """The profile with bad_rate and ``place`` by falling weight, risk and rows; it has a few dozen rows a feature."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("weight"), F.desc("risk"), F.desc("n"), "feature", "bucket"))
    return profile.withColumn("bad_rate", F.try_divide("bad", "n")).withColumn("place", place)
