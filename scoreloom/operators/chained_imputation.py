"""Filling missing values by chained equations within groups of similar records.

Each incomplete field is modelled from the others, separately in every group (say, load and grade):
numbers by ridge-regularised linear regression, categories by a Gaussian discriminant classifier.
Fits need only sums of cross products, so one aggregation with map-side combine fits the models of
all groups; the solved coefficients (one short row for each group) are joined back.  Cycles repeat
with the values filled so far.  A filled number is the prediction plus a residual of the group's own
spread; a filled category is drawn from the predicted distribution.  Draws come from a hash of the
row's key, so a filled value does not depend on how the data is partitioned or on retries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.session import checkpointed

CYCLES = 2
RIDGE = 1e-3


def _uniform(key: Column, salt: str) -> Column:
    """A number in (0, 1) fixed by a row's key."""
    return (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(2**40)).cast("double") + 0.5) / float(2**40)


def _normal(key: Column, salt: str) -> Column:
    """A standard normal number fixed by a row's key."""
    return F.sqrt(-2 * F.log(_uniform(key, salt + "/r"))) * F.cos(2 * np.pi * _uniform(key, salt + "/a"))


def _by_group(stats: DataFrame, groups: list[str], solve, fields: str) -> DataFrame:
    """One model row for each row of sums; each batch is solved where it lies."""
    kinds = ", ".join(f"`{g}` {stats.schema[g].dataType.simpleString()}" for g in groups)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [[*r[:-1], *solve(r[-1])] for r in part.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=[*groups, *[f.split()[0] for f in fields.split(", ")]])

    return checkpointed(stats.mapInPandas(run, f"{kinds}, {fields}"))


def _regression(df: DataFrame, groups: list[str], field: str, inputs: list[Column], n_inputs: int) -> DataFrame:
    """(groups, beta, sigma) from rows where the field is known."""
    x = [F.lit(1.0), *inputs, F.col(f"v_{field}")]
    k = len(x)
    sums = [F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)]
    stats = df.where(f"ok_{field}").groupBy(*groups).agg(F.array(*sums).alias("s"))

    def solve(s) -> tuple[list[float], float]:
        m = np.zeros((k, k))
        m[np.triu_indices(k)] = s
        m = m + np.triu(m, 1).T
        n = m[0, 0]
        a, b = m[:-1, :-1], m[:-1, -1]
        mean = a[0] / n
        scale = np.sqrt(np.maximum(np.diag(a) / n - mean**2, 0))
        scale[0] = 1.0
        live = (scale > 1e-9) | (np.arange(k - 1) == 0)
        # Centred and scaled inputs, so the ridge is the same for every unit.
        shift = np.eye(k - 1)
        shift[1:, 0] = -mean[1:]
        t = (shift / np.where(live, scale, 1.0)[:, None])[live]
        c = t @ a @ t.T + np.diag(np.r_[0.0, np.full(live.sum() - 1, RIDGE * n)])
        beta = t.T @ np.linalg.solve(c, t @ b)
        rest = max(m[-1, -1] - 2 * beta @ b + beta @ a @ beta, 0.0)
        return beta.tolist(), float(np.sqrt(rest / max(n - live.sum(), 1)))

    return _by_group(stats, groups, solve, "beta array<double>, sigma double")


def _discriminant(df: DataFrame, groups: list[str], field: str, inputs: list[Column], classes: list[str]) -> DataFrame:
    """(groups, base, slope): log prior and linear terms of every class; unseen classes get none."""
    sums = []
    for c in classes:
        mine = F.col(f"v_{field}") == c
        sums += [F.sum(F.when(mine, 1.0).otherwise(0.0))] + [F.sum(F.when(mine, x).otherwise(0.0)) for x in inputs]
    stats = df.where(f"ok_{field}").groupBy(*groups).agg(F.array(*sums, *[F.sum(x * x) for x in inputs]).alias("s"))
    k, d = len(classes), len(inputs)

    def solve(s) -> tuple[list[float | None], list[float]]:
        s = np.asarray(s, float)
        table, squares = s[: k * (d + 1)].reshape(k, d + 1), s[k * (d + 1) :]
        n = table[:, 0]
        seen = n > 0
        means = table[:, 1:] / np.maximum(n, 1)[:, None]
        spread = np.maximum((squares - (n[:, None] * means**2).sum(0)) / max(n.sum(), 1), 1e-9)
        # Means of small classes lean on the group's mean.
        means = (n[:, None] * means + 5.0 * (n @ means / n.sum())) / (n[:, None] + 5.0)
        base = np.log(np.maximum(n, 1) / n.sum()) - 0.5 * (means**2 / spread).sum(1)
        return [float(b) if ok else None for b, ok in zip(base, seen)], (means / spread).ravel().tolist()

    return _by_group(stats, groups, solve, "base array<double>, slope array<double>")


def impute(
    df: DataFrame,
    key: str,
    groups: list[Column],
    numbers: dict[str, tuple[float, float]],
    categories: dict[str, list[str]],
    missing: dict[str, Column],
    valid: dict[str, Column],
    helpers: list[str],
    cycles: int = CYCLES,
) -> DataFrame:
    """The rows' fields filled from records of the same group, with a mark on every filled cell.

    numbers: field -> range of filled values; categories: field -> classes, in a meaningful order.
    missing: which cells to fill; valid: which cells models may learn from (others, such as odd
    wordings, are kept and not learnt).  helpers: numeric columns used
    as inputs; where one is null, NaN or infinite, the group's mean stands in for it.
    Result: key, the group columns g0.., and for each field its value and ``<field>_filled``.

    A cell is filled only if its group is complete (no null group column) and some row of the group
    has a valid value in the field; other cells keep what they held and their mark is false.  Rows
    are neither dropped nor merged, repeated and null keys included.  An empty table gives an empty
    result.
    """
    names = [f"g{i}" for i in range(len(groups))]
    fields = [*numbers, *categories]
    base = df.select(
        F.col(key).alias("key"),
        *[g.alias(n) for g, n in zip(groups, names)],
        *[F.when(F.abs(F.col(h).cast("double")) < 1e150, F.col(h).cast("double")).alias(f"h{i}") for i, h in enumerate(helpers)],
        *[F.col(f).alias(f"raw_{f}") for f in fields],
        *[F.coalesce(missing[f], F.lit(False)).alias(f"gap_{f}") for f in fields],
        *[F.coalesce(valid[f], F.lit(False)).alias(f"ok_{f}") for f in fields],
    )
    base = checkpointed(base)
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(n).isNotNull()
    # First cycle starts from the group's mean and most common class; helpers that a row lacks get its mean.
    means = [F.avg(f"h{i}").alias(f"s_h{i}") for i in range(len(helpers))]
    starts = base.where(whole).groupBy(*names).agg(*[F.avg(F.when(F.col(f"ok_{f}"), F.col(f"raw_{f}"))).alias(f"s_{f}") for f in numbers], *[F.mode(F.when(F.col(f"ok_{f}"), F.col(f"raw_{f}")), True).alias(f"s_{f}") for f in categories], *means)
    starts = checkpointed(starts)
    work = base.join(starts, names, "left")
    for f in fields:
        work = work.withColumn(f"fill_{f}", F.col(f"gap_{f}") & F.col(f"s_{f}").isNotNull())
        work = work.withColumn(f"v_{f}", F.when(F.col(f"ok_{f}"), F.col(f"raw_{f}")).otherwise(F.col(f"s_{f}")))
    for i in range(len(helpers)):
        work = work.withColumn(f"h{i}", F.coalesce(f"h{i}", f"s_h{i}", F.lit(0.0)))
    work = work.drop(*[f"s_{f}" for f in fields], *[f"s_h{i}" for i in range(len(helpers))])

    def inputs(but: str) -> list[Column]:
        xs = [F.col(f"h{i}") for i in range(len(helpers))]
        xs += [F.coalesce(F.col(f"v_{f}"), F.lit(0.0)) for f in numbers if f != but]
        for f, classes in categories.items():
            if f != but:
                xs.append(F.coalesce(F.array_position(F.array(*map(F.lit, classes)), F.col(f"v_{f}")).cast("double"), F.lit(0.0)))
        return xs

    for cycle in range(cycles):
        # Written once a cycle, so that a fit repeats no more than the joins of its own cycle.
        work = checkpointed(work)
        for f in fields:
            xs = inputs(f)
            learn = work.where(whole)
            if f in numbers:
                low, high = numbers[f]
                model = _regression(learn, names, f, xs, len(xs))
                mean = F.element_at("beta", 1)
                for i, x in enumerate(xs):
                    mean = mean + F.element_at("beta", i + 2) * x
                drawn = mean + F.col("sigma") * _normal(F.col("key"), f"{f}/{cycle}")
                value = F.least(F.greatest(drawn, F.lit(low)), F.lit(high))
                spare = ["beta", "sigma"]
            else:
                classes = categories[f]
                model = _discriminant(learn, names, f, xs, classes)
                scores = []
                for c in range(len(classes)):
                    score = F.element_at("base", c + 1)
                    for i, x in enumerate(xs):
                        score = score + F.element_at("slope", c * len(xs) + i + 1) * x
                    scores.append(score)
                # Gumbel noise turns the best score into a draw from the predicted distribution.
                noisy = [F.struct(F.coalesce(s - F.log(-F.log(_uniform(F.col("key"), f"{f}/{cycle}/{c}"))), F.lit(float("-inf"))).alias("s"), F.lit(classes[c]).alias("c")) for c, s in enumerate(scores)]
                value = F.array_max(F.array(*noisy))["c"]
                spare = ["base", "slope"]
            work = work.join(model, names, "left").withColumn(f"v_{f}", F.when(F.col(f"fill_{f}"), F.coalesce(value, F.col(f"v_{f}"))).otherwise(F.col(f"v_{f}"))).drop(*spare)
    return work.select(
        F.col("key").alias(key),
        *names,
        *[c for f in fields for c in (F.when(F.col(f"fill_{f}"), F.col(f"v_{f}")).otherwise(F.col(f"raw_{f}")).alias(f), F.col(f"fill_{f}").alias(f"{f}_filled"))],
    )
