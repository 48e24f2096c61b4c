"""Exploration of a table: summaries of numbers and categories, correlations, feature choice."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.cleaning import constants, missing_ratios
from scoreloom.operators.scores import quantiles

PROBS = [0.01, 0.05, 0.5, 0.95, 0.99]


def by_group(df: DataFrame, column: str, target: str) -> DataFrame:
    """(column, n, target_rate) with null as a group."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("target_rate"))


def by_two(df: DataFrame, a: str, b: str, target: str) -> DataFrame:
    """Counts and rates by each of two columns in one pass (grouping sets)."""
    return df.groupingSets([[F.col(a)], [F.col(b)]], F.col(a), F.col(b)).agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("target_rate"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, mean, std, min, p1, p5, p50, p95, p99, max) over values that are not NaN.

    Quantiles are exact and come from counts of distinct values, column by column in one plan.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*").where("v IS NOT NULL AND NOT isnan(v)")
    values = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("k"))
    total = values.groupBy("column_name").agg(F.sum("k").alias("n"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    spread = values.join(total, "column_name").groupBy("column_name", "n", "mean", "min", "max").agg(F.sqrt(F.try_divide(F.sum(F.col("k") * F.pow(F.col("v") - F.col("mean"), 2)), F.col("n") - 1)).alias("std"))
    cut = quantiles(values.select("column_name", F.col("v").alias("score"), F.col("k").alias("n"), F.lit(0).alias("pos")), PROBS, ["column_name"])
    wide = cut.groupBy("column_name").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{round(p * 100)}") for p in PROBS])
    return spread.join(wide, "column_name").select("column_name", "n", "mean", "std", "min", *[f"p{round(p * 100)}" for p in PROBS], "max")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n) with null as a value."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("x")).groupBy("x.column_name", "x.value").agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_distinct, n_with_null): exact counts from value counts, so that no row is expanded by column sets."""
    return value_counts(df, columns).groupBy("column_name").agg(F.count("value").alias("n_distinct"), F.count(F.lit(1)).alias("n_with_null"))


def categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_unique, top_value, top_ratio, missing_ratio); of equal counts the smaller value."""
    counts = value_counts(df, columns)
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("k"), "value")))
    return counts.groupBy("column_name").agg(F.count("value").alias("n_unique"), best.alias("b"), F.sum("n").alias("total"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("gone")).select(
        "column_name", "n_unique", F.col("b.value").alias("top_value"), F.try_divide(-F.col("b.k"), F.col("total")).alias("top_ratio"), F.try_divide("gone", "total").alias("missing_ratio")
    )


def correlations(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """(a, b, r) for each pair (and each column with the target), over rows that have both values.

    Each Arrow batch adds to sums of products of values and of presence, a few matrix products; one
    small row for each pair and task is shuffled.  r is null where a column does not vary.
    """
    names = [*columns, *([target] if target else [])]
    pairs = [*combinations(range(len(columns)), 2), *([(i, len(columns)) for i in range(len(columns))] if target else [])]

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, len(names), len(names)))
        for part in parts:
            x = part.to_numpy(dtype=float)
            has = (np.isfinite(x) & (np.abs(x) < 1e150)).astype(float)
            x = np.where(has > 0, x, 0.0)
            total += [has.T @ has, x.T @ has, has.T @ x, (x * x).T @ has, has.T @ (x * x), x.T @ x]
        yield pd.DataFrame([(names[i], names[j], *total[:, i, j]) for i, j in pairs], columns=["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    s = values.mapInPandas(sums, "a string, b string, n double, x double, y double, xx double, yy double, xy double").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    spread = lambda v, vv: F.when(n * vv - v * v > 1e-12 * n * vv, n * vv - v * v)
    return s.select("a", "b", F.try_divide(n * F.col("xy") - x * y, F.sqrt(spread(x, F.col("xx")) * spread(y, F.col("yy")))).alias("r"))


def prune(columns: list[str], pair: dict[tuple[str, str], float | None], with_target: dict[str, float | None], missing: dict[str, float], limit: float = 0.98) -> list[str]:
    """Columns to drop so that no kept pair correlates at the limit or above.

    Of a pair, the weaker goes: lower correlation with the target, then more missing values, then
    the later.  A correlation that is not defined keeps both (constant columns go elsewhere).
    """
    worth = lambda c: (abs(with_target.get(c) or 0.0), -missing.get(c, 0.0))
    gone: list[str] = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            if a in gone:
                break
            r = pair.get((a, b))
            if b in gone or r is None or abs(r) < limit:
                continue
            gone.append(a if worth(a) < worth(b) else b)
    return gone


def choose_features(df: DataFrame, numeric: list[str], categorical: list[str], target: str, most_missing: float = 0.30, limit: float = 0.98) -> dict:
    """Feature selection report of a training frame."""
    ratios = {r.column_name: r.missing_ratio or 0.0 for r in missing_ratios(df, [*numeric, *categorical]).collect()}
    sparse = [c for c in [*numeric, *categorical] if ratios[c] > most_missing]
    rest = [c for c in [*numeric, *categorical] if c not in sparse]
    still = {r.column_name for r in constants(df, rest).collect() if r.is_constant} if rest else set()
    left = [c for c in numeric if c in rest and c not in still]
    found = {(r.a, r.b): r.r for r in correlations(df, left, target).collect()} if left else {}
    gone = prune(left, found, {c: found.get((c, target)) for c in left}, ratios, limit)
    return {
        "selected_numeric_columns": [c for c in left if c not in gone],
        "selected_categorical_columns": [c for c in categorical if c in rest and c not in still],
        "dropped_by_missing_ratio": {c: ratios[c] for c in sparse},
        "dropped_by_constant": sorted(still),
        "dropped_by_high_correlation": gone,
    }


def bundle(df: DataFrame, target: str, groups: list[str], texts: list[str], numbers: list[str]) -> DataFrame:
    """(part, item, measure, value): the exploration report of a table in one long frame; a null item is ''."""
    row = lambda d, part, item, measure, value: d.select(F.lit(part).alias("part"), item.alias("item"), F.lit(measure).alias("measure"), value.cast("double").alias("value"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = [row(by_group(df, g, target), f"target_by_{g.removeprefix('issue_')}", text(g), "target_rate", F.col("target_rate")) for g in groups]
    parts.append(row(value_counts(df, texts), "value_counts", F.concat("column_name", F.lit("="), text("value")), "n", F.col("n")))
    told = describe(df, numbers)
    parts += [row(told, "numbers", F.col("column_name"), m, F.col(m)) for m in ("mean", "min", "p50", "max")]
    parts.append(row(missing_ratios(df, numbers), "missing", F.col("column_name"), "missing_ratio", F.col("missing_ratio")))
    return reduce(DataFrame.unionByName, parts)
