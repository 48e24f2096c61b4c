"""Splits and samples that a rerun repeats row by row.

Rows of a class are ordered by md5 of seed and row id; quotas are closed forms of the class counts,
so sizes and rates are exact.  A class is never sorted whole for a small share of it: the hash is
uniform, and the first hexadecimal digits cut the rows down before they are ranked.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def class_rank(df: DataFrame, key: str, target: str, seed: str) -> DataFrame:
    """Rows with their position (from 1) in their class, by hash and then id.

    Positions come from counts of 4096 hash ranges added up, so a class is ranked range by range.
    """
    h = df.withColumn("_h", hash_key(key, seed)).withColumn("_r", F.substring("_h", 1, 3))
    sizes = h.groupBy(target, "_r").count()
    before = sizes.withColumn("_before", F.sum("count").over(Window.partitionBy(target).orderBy("_r")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy(target, "_r").orderBy("_h", key))
    return h.withColumn("_in", inside).join(before, [target, "_r"]).withColumn("rank", F.col("_in") + F.col("_before")).drop("_h", "_r", "_in", "_before")


def proportional(counts: dict, total: int) -> dict:
    """A total shared by classes in proportion, by largest remainder (ties: smaller class)."""
    n = sum(counts.values())
    exact = {k: total * v / n for k, v in counts.items()} if n else dict.fromkeys(counts, 0.0)
    out = {k: min(math.floor(x + 1e-9), counts[k]) for k, x in exact.items()}
    for k in sorted(counts, key=lambda k: (-(exact[k] - out[k]), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def class_counts(df: DataFrame, target: str) -> dict:
    return {r[0]: r[1] for r in df.where(F.col(target).isNotNull()).groupBy(target).count().collect()}


def split_quotas(counts: dict, test_size: float = 0.2, val_size: float = 0.2) -> tuple[dict, dict]:
    """Test and validation rows of each class: the test share first, then validation of the rest."""
    if not 0 < test_size < 0.5 or not 0 < val_size < 0.5:
        raise ValueError("test_size and val_size must lie between 0 and 0.5")
    n = sum(counts.values())
    test = proportional(counts, math.ceil(n * test_size - 1e-9))
    rest = {k: v - test[k] for k, v in counts.items()}
    return test, proportional(rest, math.ceil(sum(rest.values()) * val_size - 1e-9))


def _by_class(target: str, values: dict) -> Column:
    out = F.lit(0)
    for k, v in values.items():
        out = F.when(F.col(target) == k, v).otherwise(out)
    return out


def stratified_split(df: DataFrame, key: str, target: str, test_size: float = 0.2, val_size: float = 0.2, seed: str = "42") -> DataFrame:
    """Rows with ``split``: test, validation or train_fit, with equal class shares up to rounding."""
    test, val = split_quotas(class_counts(df, target), test_size, val_size)
    r = class_rank(df, key, target, seed)
    t, v = _by_class(target, test), _by_class(target, val)
    return r.withColumn("split", F.when(F.col("rank") <= t, "test").when(F.col("rank") <= t + v, "validation").otherwise("train_fit")).drop("rank")


def two_way_split(df: DataFrame, key: str, target: str, test_size: float = 0.2, seed: str = "42") -> DataFrame:
    """Rows with ``split``: train or test, with equal class shares up to rounding."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    counts = class_counts(df, target)
    test = proportional(counts, math.ceil(sum(counts.values()) * test_size - 1e-9))
    return class_rank(df, key, target, seed).withColumn("split", F.when(F.col("rank") <= _by_class(target, test), "test").otherwise("train")).drop("rank")


def checked_split(df: DataFrame, key: str, target: str, test_size: float = 0.2, val_size: float = 0.2, seed: str = "42", tolerance: float = 0.01, strict: bool = True) -> tuple[DataFrame, dict]:
    """(split rows, summary); an error if the positive rates differ by more than ``tolerance`` and it is strict.

    Quotas are closed forms of the class counts, so another seed has the same rates and one attempt
    is all there is to make.
    """
    counts = class_counts(df, target)
    test, val = split_quotas(counts, test_size, val_size)
    sizes = {"full": counts, "train_fit": {k: n - test[k] - val[k] for k, n in counts.items()}, "validation": val, "test": test}
    rates = {k: (v.get(1, 0) / sum(v.values()) if sum(v.values()) else math.nan) for k, v in sizes.items()}
    parts = [r for k, r in rates.items() if k != "full" and not math.isnan(r)]
    gap, pair = max((abs(r - rates["full"]) for r in parts), default=0.0), max(parts, default=0.0) - min(parts, default=0.0)
    met = gap <= tolerance and pair <= tolerance
    if strict and not met:
        raise ValueError(f"positive rates differ by {max(gap, pair):.4f}, more than {tolerance}")
    report = {"selected_seed": seed, "attempts_used": 1, "rate_tolerance": tolerance, "rate_match_satisfied": met, "best_max_gap_vs_full": gap, "best_max_pair_gap": pair}
    report |= {k: {"rows": sum(v.values()), "positive_rate": rates[k], "class_counts": v} for k, v in sizes.items()}
    return stratified_split(df, key, target, test_size, val_size, seed), report


def split_report(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Rows and positive rate of the whole and of each split, with the gap to the whole."""
    parts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("pos"))
    every = Window.partitionBy(F.lit(0))
    rate = F.col("pos") / F.col("n")
    full = F.sum("pos").over(every) / F.sum("n").over(every)
    return parts.select(split, F.col("n").alias("rows"), "pos", rate.alias("positive_rate"), F.abs(rate - full).alias("gap_vs_full"), (F.max(rate).over(every) - F.min(rate).over(every)).alias("max_pair_gap"))


def take(df: DataFrame, key: str, target: str, quota: dict, seed: str = "42") -> DataFrame:
    """The first ``quota`` rows of each class by hash."""
    r = class_rank(df.where(F.col(target).isin(list(quota))), key, target, seed) if quota else df.limit(0).withColumn("rank", F.lit(0))
    return r.where(F.col("rank") <= _by_class(target, quota)).drop("rank")


def ratio_sample(df: DataFrame, key: str, target: str, ratio: float, seed: str = "42") -> DataFrame:
    """A share of each class, rounded half to even, at least one row."""
    if ratio <= 0:
        raise ValueError("ratio must be positive")
    quota = {k: max(1, min(v, round(v * min(ratio, 1.0)))) for k, v in class_counts(df, target).items()}
    return take(df, key, target, quota, seed)


def capped(df: DataFrame, key: str, target: str, caps: dict, seed: str = "42") -> DataFrame:
    """At most so many rows of a class; no cap, or one of 0 or less, keeps all."""
    counts = class_counts(df, target)
    return take(df, key, target, {k: min(v, caps[k]) if (caps.get(k) or 0) > 0 else v for k, v in counts.items()}, seed)


def equal_classes(df: DataFrame, key: str, target: str, cap: int | None = None, seed: str = "42") -> DataFrame:
    """As many rows of each class as the smallest has (at most ``cap``)."""
    counts = class_counts(df, target)
    n = min([*counts.values(), *([cap] if cap else [])], default=0)
    return take(df, key, target, dict.fromkeys(counts, n), seed)


def downsample_negatives(df: DataFrame, key: str, target: str, cap: int | None = None, seed: str = "42") -> DataFrame:
    """All positives (at most ``cap``) and as many negatives; an error if there are too few."""
    counts = class_counts(df, target)
    pos = min(counts.get(1, 0), cap) if cap else counts.get(1, 0)
    if not pos or counts.get(0, 0) < pos:
        raise ValueError("too few rows of a class")
    return take(df, key, target, {0: pos, 1: pos}, seed)


def preserve_ratio(df: DataFrame, key: str, target: str, size: int | None, seed: str = "42") -> DataFrame:
    """About ``size`` rows with the classes' share kept, at least one of each; all rows if there are no more."""
    counts = class_counts(df, target)
    n = sum(counts.values())
    if not size or size <= 0 or size >= n:
        return df
    pos = max(1, int(size * (counts.get(1, 0) / n)))
    quota = {1: min(pos, counts.get(1, 0)), 0: min(max(1, size - pos), counts.get(0, 0))}
    return take(df, key, target, quota, seed)


def first_by_hash(df: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """A plain sample of n rows: those of the smallest hash.

    Each task keeps its n smallest, so no task orders all rows.
    """
    return df.withColumn("_h", hash_key(key, seed)).orderBy("_h", key).limit(n).drop("_h")


def balanced_time_split(df: DataFrame, key: str, target: str, year: str, train: tuple[int, int], test: tuple[int, int], cap: int | None = None, seed: str = "42") -> tuple[DataFrame, DataFrame, dict]:
    """(train, test, summary): rows of the years, the train rows with as many negatives as positives.

    An error if a period is empty or the train period has too few rows of a class.
    """
    before = df.where(F.col(year).between(*train))
    later = df.where(F.col(year).between(*test))
    old, new = class_counts(before, target), class_counts(later, target)
    if not sum(old.values()) or not sum(new.values()):
        raise ValueError("a period has no rows")
    chosen = downsample_negatives(before, key, target, cap, seed)
    n = min(old[1], cap) if cap else old[1]
    summary = {"train_total_before": sum(old.values()), "train_pos_before": old.get(1, 0), "train_neg_before": old.get(0, 0), "train_pos_after": n, "train_neg_after": n, "test_total": sum(new.values()), "test_pos": new.get(1, 0), "test_neg": new.get(0, 0)}
    return chosen, later, summary


def oversample_positives(df: DataFrame, key: str, target: str, seed: str = "42") -> DataFrame:
    """Negatives once, positives drawn with replacement up to the same number; ``draw_no`` numbers draws.

    Unchanged (draw_no 0) if a class is empty.  Draw i takes the positive at position
    hash(i) mod positives, so draws are joined to rows by position.
    """
    counts = class_counts(df, target)
    neg, pos = counts.get(0, 0), counts.get(1, 0)
    if not neg or not pos:
        return df.withColumn("draw_no", F.lit(0).cast("long"))
    r = class_rank(df.where(F.col(target) == 1), key, target, seed)
    draws = df.sparkSession.range(1, neg + 1).select(F.col("id").alias("draw_no"), (F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/draw:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long"), F.lit(pos)) + 1).alias("rank"))
    drawn = draws.join(r, "rank").drop("rank")
    return df.where(F.col(target) == 0).withColumn("draw_no", F.lit(0).cast("long")).unionByName(drawn.select(*df.columns, "draw_no"))


def folds(df: DataFrame, key: str, target: str, k: int = 5, seed: str = "42") -> DataFrame:
    """Rows with ``fold`` 0..k-1, classes spread evenly."""
    return class_rank(df, key, target, seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def bootstrap(df: DataFrame, cells: dict[str, Column], draws: int = 1000, seed: int = 42) -> DataFrame:
    """(draw_no, <cell>...): counts of cells in samples of as many rows, drawn with replacement.

    cells: conditions that exclude each other and of which one holds for every row.  Measures of the
    cells depend on their counts alone, and these are multinomial: one aggregate over the rows, then
    ``draws`` short rows, however many rows there are.
    """
    row = df.agg(*[F.count_if(c).alias(n) for n, c in cells.items()]).first()
    counts = np.array([row[n] for n in cells], float)
    drawn = np.random.default_rng(seed).multinomial(int(counts.sum()), counts / counts.sum(), draws) if counts.sum() else np.zeros((draws, len(cells)), int)
    return df.sparkSession.createDataFrame([(i + 1, *map(int, r)) for i, r in enumerate(drawn)], "draw_no int, " + ", ".join(f"{n} long" for n in cells))
