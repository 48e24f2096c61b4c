"""Samples that match target category proportions in two dimensions at once.

For each group (a load), the fractional two-way quota table comes from raking the available counts
to the target margins.  Controlled rounding makes it integer: a maximum flow with lower and upper
bounds finds a table whose cells, margins and total are each the floor or the ceiling of the
fractional ones.  Every cell then gives exactly its quota of records, those with the smallest random
keys (a hash of the record's id, so a rerun draws the same sample).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
ROUNDS = 5000


def _max_flow(n: int, edges: list[list], s: int, t: int) -> int:
    """Augmenting shortest paths; edges are [from, to, capacity, flow], changed in place."""
    out: list[list[int]] = [[] for _ in range(n)]
    for i, (a, b, *_) in enumerate(edges):
        out[a].append(i)
        out[b].append(~i)
    total = 0
    while True:
        via: dict[int, int] = {s: 0}
        queue = deque([s])
        while queue and t not in via:
            a = queue.popleft()
            for i in out[a]:
                e = edges[i if i >= 0 else ~i]
                b, room = (e[1], e[2] - e[3]) if i >= 0 else (e[0], e[3])
                if room > 0 and b not in via:
                    via[b] = i
                    queue.append(b)
        if t not in via:
            return total
        path, b = [], t
        while b != s:
            i = via[b]
            path.append(i)
            b = edges[i][0] if i >= 0 else edges[~i][1]
        push = min(edges[i][2] - edges[i][3] if i >= 0 else edges[~i][3] for i in path)
        for i in path:
            if i >= 0:
                edges[i][3] += push
            else:
                edges[~i][3] -= push
        total += push


def controlled_rounding(table: np.ndarray) -> np.ndarray:
    """An integer table whose cells, row sums, column sums and total are floors or ceilings of the given ones."""
    table = np.where(np.abs(table - np.round(table)) < 1e-9, np.round(table), table)
    r, c = table.shape
    low = lambda x: int(np.floor(x + 1e-9))
    high = lambda x: int(np.ceil(x - 1e-9))
    source, sink, s, t = r + c, r + c + 1, r + c + 2, r + c + 3
    bounded = [(sink, source, low(table.sum()), high(table.sum()))]
    bounded += [(source, i, low(table[i].sum()), high(table[i].sum())) for i in range(r)]
    bounded += [(i, r + j, low(table[i, j]), high(table[i, j])) for i in range(r) for j in range(c)]
    bounded += [(r + j, sink, low(table[:, j].sum()), high(table[:, j].sum())) for j in range(c)]
    # A feasible flow with lower bounds: what every edge must carry is supplied from outside.
    edges = [[a, b, hi - lo, 0] for a, b, lo, hi in bounded]
    need = sum(lo for *_, lo, _ in bounded)
    for a, b, lo, _ in bounded:
        if lo:
            edges += [[s, b, lo, 0], [a, t, lo, 0]]
    if _max_flow(r + c + 4, edges, s, t) != need:
        raise ArithmeticError("no controlled rounding")  # cannot be: the fractional table is a flow
    cells = range(1 + r, 1 + r + r * c)
    return np.array([bounded[k][2] + edges[k][3] for k in cells]).reshape(r, c)


def raked(available: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The available counts scaled to both margins, without taking more of a cell than there is.

    Rounds go on until nothing changes.  Margins that no table under the available counts has are not
    reached; the report then says by how much each category fell short.
    """
    x = available.astype(float)
    for _ in range(ROUNDS):
        last = x
        x = np.minimum(x * np.divide(rows, x.sum(1), out=np.zeros(len(rows)), where=x.sum(1) > 0)[:, None], available)
        x = np.minimum(x * np.divide(columns, x.sum(0), out=np.zeros(len(columns)), where=x.sum(0) > 0)[None], available)
        if np.abs(x - last).max() < 1e-9:
            break
    # The last scaling was by columns; rows above their margin give way.
    return x * np.minimum(1.0, np.divide(rows, x.sum(1), out=np.ones(len(rows)), where=x.sum(1) > 0))[:, None]


def quotas(counts: dict[tuple[str, str], int], targets: dict[str, dict[str, tuple[float, int, int]]], dims: tuple[str, str]) -> dict[tuple[str, str], int]:
    """Integer quota of every cell: targets by dimension and category are (share, least, size)."""
    a, b = sorted(targets.get(dims[0], {})), sorted(targets.get(dims[1], {}))
    if not a or not b:
        return {}
    available = np.array([[counts.get((i, j), 0) for j in b] for i in a], float)
    # The sample has the smaller of the sizes asked, so that both margins describe one sample.
    size = min(n for d in dims for *_, n in targets[d].values())
    margins = []
    for d, names, have in ((dims[0], a, available.sum(1)), (dims[1], b, available.sum(0))):
        want = np.array([max(targets[d][k][0] * size, targets[d][k][1]) for k in names])
        margins.append(np.minimum(want, have))
    total = min(m.sum() for m in margins)
    if total <= 0:
        return {}
    least = [np.minimum([targets[d][k][1] for k in names], m) for d, names, m in ((dims[0], a, margins[0]), (dims[1], b, margins[1]))]
    # Both margins are brought to one total; what is above a category's minimum gives way.
    for m, low in zip(margins, least):
        spare = m - low
        if m.sum() > total and spare.sum() > 0:
            m -= spare * min(1.0, (m.sum() - total) / spare.sum())
    whole = controlled_rounding(raked(available, *margins))
    return {(i, j): int(min(whole[x, y], available[x, y])) for x, i in enumerate(a) for y, j in enumerate(b)}


def plan(eligible: DataFrame, targets: DataFrame, group: str, dims: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(quota of each cell, report of each target category) of eligible records.

    eligible: (group, dims...) one row for each record, categories as text.  targets: (group,
    dimension, category, target_share, min_rows, sample_rows).  The report has the eligible count,
    what the targets ask (the greater of min_rows and target_share * sample_rows, unrounded) and
    ``met``, here only whether there are that many (``judged`` looks at what was drawn).  A category without eligible records counts 0.
    """
    cells = eligible.groupBy(group, *dims).agg(F.count(F.lit(1)).alias("n"))
    sides = [cells.where(F.col(d).isNotNull()).groupBy(group, F.lit(d).alias("dimension"), F.col(d).alias("category")).agg(F.sum("n").alias("eligible")) for d in dims]
    have = sides[0].unionByName(sides[1])
    asked = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_rows"))
    wanted = targets.where(F.col("category").isNotNull()).select(group, "dimension", "category", "target_share", "min_rows", "sample_rows", F.coalesce(asked, F.lit(0.0)).alias("asked"))
    report = wanted.join(have, [group, "dimension", "category"], "left").withColumn("eligible", F.coalesce("eligible", F.lit(0))).withColumn("met", F.col("eligible") >= F.col("asked") - 1e-9)
    # One short row of cells and targets for each group goes to the rounding.
    kind = eligible.schema[group].dataType.simpleString()
    left = cells.where(F.col(dims[0]).isNotNull() & F.col(dims[1]).isNotNull()).groupBy(group).agg(F.collect_list(F.struct(F.col(dims[0]).alias("a"), F.col(dims[1]).alias("b"), "n")).alias("cells"))
    right = wanted.groupBy(group).agg(F.collect_list(F.struct("dimension", "category", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("min_rows", F.lit(0)).alias("least"), F.coalesce("sample_rows", F.lit(0)).alias("size"))).alias("asks"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for g, cs, asks in zip(part["g"], part["cells"], part["asks"]):
                by: dict[str, dict] = {}
                for x in asks:
                    by.setdefault(x["dimension"], {})[x["category"]] = (x["share"], x["least"], x["size"])
                rows += [(g, i, j, q) for (i, j), q in quotas({(c["a"], c["b"]): c["n"] for c in cs}, by, dims).items() if q]
            yield pd.DataFrame(rows, columns=["g", "a", "b", "quota"])

    quota = left.join(right, group).withColumnRenamed(group, "g").mapInPandas(run, f"g {kind}, a string, b string, quota long")
    return quota.withColumnsRenamed({"g": group, "a": dims[0], "b": dims[1]}), report


def draw(eligible: DataFrame, quota: DataFrame, group: str, dims: tuple[str, str], key: str, seed: str = "42") -> DataFrame:
    """Exactly the quota of every cell, by smallest random key.

    A histogram of keys finds the bucket in which a cell's quota ends: records of earlier buckets are
    taken whole, and only those of that bucket, one in BUCKETS of a cell, are ranked.  Ties of the key go to the smaller
    record id.  Records with a null category or group are in no cell.
    """
    by = ["_g", "_a", "_b"]
    cell = [F.col(c).alias(n) for c, n in zip([group, *dims], by)]
    key_ = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**52))
    # The record travels as one column, so its own column names cannot clash with these.
    keyed = eligible.select(*cell, F.struct("*").alias("_row"), F.col(key).alias("_id"), key_.alias("_key")).withColumn("_bucket", F.floor(F.col("_key") / (2**52 / BUCKETS)))
    wanted = quota.select(*cell, F.col("quota").alias("_quota"))
    upto = Window.partitionBy(*by).orderBy("_bucket")
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    last = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).join(wanted, by).where("_before < _quota").groupBy(*by).agg(F.max(F.struct("_bucket", (F.col("_quota") - F.col("_before")).alias("_left"))).alias("_last"))
    reached = keyed.join(last, by).where("_bucket <= _last._bucket")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_key", "_id"))
    ranked = reached.where("_bucket = _last._bucket").withColumn("_rank", rank).where("_rank <= _last._left").drop("_rank")
    return reached.where("_bucket < _last._bucket").unionByName(ranked).select("_row.*")


def judged(report: DataFrame, quota: DataFrame, drawn: DataFrame, group: str, dims: tuple[str, str]) -> DataFrame:
    """The report with each category's ``rounded`` quota, ``drawn`` records, ``short_by`` and ``met``.

    short_by is what the drawn sample lacks of the target, whether records are missing (not
    ``attainable``) or the category gave way to the other dimension; met allows for rounding down.
    """

    def margins(df: DataFrame, n: Column, name: str) -> DataFrame:
        sides = [df.groupBy(group, F.lit(d).alias("dimension"), F.col(d).alias("category")).agg(n.alias(name)) for d in dims]
        return sides[0].unionByName(sides[1])

    by = [group, "dimension", "category"]
    both = report.withColumnRenamed("met", "attainable").join(margins(quota, F.sum("quota"), "rounded"), by, "left").join(margins(drawn, F.count(F.lit(1)), "drawn"), by, "left").fillna(0, ["rounded", "drawn"])
    return both.withColumns({"short_by": F.greatest(F.col("asked") - F.col("drawn"), F.lit(0.0)), "met": F.col("drawn") >= F.floor(F.col("asked") + 1e-9)})
