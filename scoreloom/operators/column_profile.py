"""Column-level quality profile of the loads of a table, and departures from a baseline.

Every column is reduced to a value table (group, column, value, rows): one scan and one shuffle with
map-side combine, after which null rates, distinct counts, ranges, pattern violations and shares
below cut points are sums over values.

Power sums are exact and mergeable: a number is read at six decimals as a whole number X, and the
sums of X, X**2, X**3 and X**4 are whole numbers of any size, carried as limbs of 18 digits that are
added as decimals.  So moments and standardised differences between loads do not depend on the order
of adding, nor on how the table is divided.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.session import checkpointed

# Ways of writing that there is no answer, lower case and trimmed (fixed values).
NO_ANSWER = ["", "-", "--", "---", ".", "?", "n/a", "n.a.", "na", "#n/a", "nan", "none", "null", "nil", "not given", "not provided", "not available", "not stated", "not applicable", "no answer", "unknown", "undefined", "missing", "<na>", "(blank)", "blank", "prefer not to say", "unspecified", "tbd"]
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\u0085\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u3000\ufeff"
SCALE, LIMB = 10**6, 10**18
LONG = 64  # characters of a value that are carried
TOLERANCE_ABSENT, TOLERANCE_INVALID, TOLERANCE_SHIFT = 0.05, 0.02, 0.10


def is_absent(c: Column, kind: T.DataType, answers: list[str] | None = None) -> Column:
    """Null, NaN, blank, or a word or mark for 'no answer'; ``answers`` are words that are one here."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if isinstance(kind, T.StringType):
        word = F.lower(F.btrim(c, F.lit(BLANKS)))
        return c.isNull() | word.isin([w for w in NO_ANSWER if w not in (answers or [])])
    return c.isNull()


def brief(text: Column) -> Column:
    """A text as it is, or the start of a long one with its digest, which is as good for telling texts apart."""
    return F.when(F.length(text) > LONG, F.concat(F.substring(text, 1, LONG), F.lit("…"), F.md5(text))).otherwise(text)


def value_table(df: DataFrame, group: str, columns: list[str], answers: Mapping[str, list[str]] | None = None, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """(group, column_name, value, number, absent, bad, rows): what each column of each group holds.

    value is the text of a value (``brief``), number its number (null for texts); bad: the whole text
    does not match the column's pattern.  Rows with a null group form a group of their own.
    """
    cells = []
    for name in columns:
        kind = df.schema[name].dataType
        c = F.col(f"`{name}`")
        numeric = isinstance(kind, T.NumericType)
        absent = is_absent(c, kind, (answers or {}).get(name))
        text, rule = c.cast("string"), (patterns or {}).get(name)
        bad = ~absent & ~F.regexp_like(text, F.lit(f"^(?:{rule})$")) if rule else F.lit(False)
        cells.append(F.struct(F.lit(name).alias("column_name"), F.when(~absent, brief(text)).alias("value"), F.when(~absent, c.cast("double")).alias("number") if numeric else F.lit(None).cast("double").alias("number"), absent.alias("absent"), F.coalesce(bad, F.lit(False)).alias("bad")))
    if not cells:
        raise ValueError("no columns to profile")
    long = df.select(F.col(f"`{group}`").alias("group"), F.explode(F.array(*cells)).alias("cell")).select("group", "cell.*")
    return long.groupBy("group", "column_name", "value", "number", "absent", "bad").agg(F.count(F.lit(1)).alias("rows"))


def power_sums(values: DataFrame) -> DataFrame:
    """(group, column_name, n_numbers, s1..s4, mean, variance) of a value table's finite numbers.

    Whole numbers are summed in the tasks as they are and cross the shuffle as limbs.  s1 to s4 are
    the exact sums, rounded once to a double.
    """
    kind = values.schema["group"].dataType.simpleString()

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list[int]] = defaultdict(lambda: [0] * 5)
        for part in parts:
            for (group, name), own in part.groupby(["group", "column_name"], dropna=False, sort=False):
                numbers = own["number"].to_numpy()
                finite = np.isfinite(numbers)
                numbers, power = numbers[finite], own["rows"].to_numpy()[finite].astype(object)
                small = np.abs(numbers) < 1e9
                x = np.rint(np.where(small, numbers, 0.0) * SCALE).astype(np.int64).astype(object)
                x[~small] = [round(v * SCALE) if abs(v) < 1e15 else int(v) * SCALE for v in numbers[~small].tolist()]
                mine = sums[None if group != group else group, name]
                for p in range(5):
                    mine[p] += int(power.sum())
                    power = power * x
        out = []
        for (group, name), mine in sums.items():
            for p, total in enumerate(mine):
                sign, rest, i = (-1 if total < 0 else 1), abs(total), 0
                while rest or not i:
                    out.append((group, name, p, i, sign * (rest % LIMB)))
                    rest, i = rest // LIMB, i + 1
        yield pd.DataFrame(out, columns=["group", "column_name", "power", "limb", "part"])

    limbs = values.where("number IS NOT NULL").select("group", "column_name", "number", "rows").mapInPandas(add, f"group {kind}, column_name string, power int, limb int, part long")
    merged = limbs.groupBy("group", "column_name", "power", "limb").agg(F.sum(F.col("part").cast("decimal(20,0)")).cast("string").alias("part"))
    short = merged.groupBy("group", "column_name").agg(F.collect_list(F.struct("power", "limb", "part")).alias("limbs"))

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for group, name, limbs in zip(part["group"], part["column_name"], part["limbs"]):
                s = [0] * 5
                for x in limbs:
                    s[x["power"]] += int(x["part"]) * LIMB ** x["limb"]
                n = s[0]
                out.append((group, name, n, *(_ratio(s[p], SCALE**p) for p in range(1, 5)), _ratio(s[1], n * SCALE), _ratio(n * s[2] - s[1] ** 2, (n * SCALE) ** 2)))
            yield pd.DataFrame(out, columns=["group", "column_name", "n_numbers", "s1", "s2", "s3", "s4", "mean", "variance"])

    return short.mapInPandas(whole, f"group {kind}, column_name string, n_numbers long, s1 double, s2 double, s3 double, s4 double, mean double, variance double")


def _ratio(a: int, b: int) -> float:
    """a / b to the nearest double, infinite where it is too large for one."""
    try:
        return a / b
    except OverflowError:
        return float("inf") if a > 0 else float("-inf")


def _checks(watched: list[Row], name: Column, number: Column, value: Column) -> tuple[Column, dict[str, tuple[list[Column], list[float], bool]]]:
    """Whether a value is valid by the baseline, and by column the conditions whose shares are watched."""
    valid, points = F.lit(None).cast("boolean"), {}
    for r in watched:
        if r.value_type == "string":
            known = [brief(F.lit(v)) for v in r.valid_values or []]
            valid = F.when(name == r.column_name, value.isin(known) if known else F.lit(False)).otherwise(valid)
            points[r.column_name] = ([value == v for v in known], [float((r.value_shares or {}).get(v) or 0.0) for v in r.valid_values or []], True)
        else:
            valid = F.when(name == r.column_name, number.between(r.valid_min, r.valid_max)).otherwise(valid)
            points[r.column_name] = ([number <= c for c in r.cut_points or []], list(r.cut_shares or []), False)
    return valid, points


def profile(df: DataFrame, group: str, columns: list[str] | None = None, patterns: Mapping[str, str] | None = None, answers: Mapping[str, list[str]] | None = None, watched: list[Row] | None = None) -> DataFrame:
    """One row for each group and column: counts, ranges, violations, power sums, shift.

    columns: all atomic columns but the group, if not given.  patterns: a regular expression that
    the whole text of a column's values must match.  answers: words for 'no answer' that are values
    of a column.  watched: baseline rows (see ``departures``); their columns get the counts of valid
    values and ``shift``, the greatest difference of a watched share (half the sum of differences for
    texts).  An empty table gives an empty result; a column without a present value has null ranges
    and moments.  Of texts of more than LONG characters, min_text and max_text give the start and a
    digest.  Infinite numbers are in the ranges and counted, and in no moment.
    """
    atomic = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    columns = columns or [f.name for f in df.schema if f.name != group and isinstance(f.dataType, atomic)]
    # Read by the counts and by the power sums, and far smaller than the table: kept in the shared folder.
    values = checkpointed(value_table(df, group, columns, answers, patterns))
    n, here = F.col("rows"), ~F.col("absent")
    total = lambda c: F.sum(F.when(c, n).otherwise(0))
    valid, points = _checks(watched or [], F.col("column_name"), F.col("number"), F.col("value"))
    finite = F.abs("number") < float("inf")
    rows = values.withColumn("fit", F.coalesce(valid & here, F.lit(False)))
    stats = rows.groupBy("group", "column_name").agg(
        F.sum(n).alias("n_rows"),
        total(F.col("absent")).alias("n_absent"),
        F.count("value").alias("n_distinct"),
        F.min("number").alias("min_number"),
        F.max("number").alias("max_number"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
        total(F.col("number").isNotNull() & ~finite).alias("n_not_finite"),
        total(F.col("bad")).alias("n_violations"),
        total(F.col("fit")).alias("n_valid"),
        *[total((F.col("column_name") == c) & F.col("fit") & p).alias(f"p_{i}_{j}") for i, (c, (ps, *_)) in enumerate(points.items()) for j, p in enumerate(ps)],
    )
    shift = F.lit(None).cast("double")
    for i, (c, (ps, shares, text)) in enumerate(points.items()):
        gaps = F.array(*[F.abs(F.try_divide(F.col(f"p_{i}_{j}"), F.col("n_valid")) - s) for j, s in enumerate(shares[: len(ps)])])
        mine = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / 2 if text else F.array_max(gaps)
        shift = F.when(F.col("column_name") == c, mine if ps else F.lit(None).cast("double")).otherwise(shift)
    moments = power_sums(values).withColumnsRenamed({"group": "_group", "column_name": "_name"})
    stats = stats.withColumn("shift", shift).join(moments, F.col("group").eqNullSafe(F.col("_group")) & (F.col("column_name") == F.col("_name")), "left")
    before = Window.partitionBy("column_name").orderBy("group")
    pooled = F.sqrt((F.col("variance") + F.lag("variance").over(before)) / 2)
    absent = F.try_divide(F.col("n_absent"), F.col("n_rows"))
    watch = [F.when(F.col("column_name").isin(list(points)), F.col("n_valid")).alias("n_valid"), "shift"] if points else []
    return stats.select(
        F.col("group").alias(group),
        "column_name",
        "n_rows",
        "n_absent",
        absent.alias("absent_share"),
        "n_distinct",
        "min_number",
        "max_number",
        "min_text",
        "max_text",
        "n_not_finite",
        "n_violations",
        *watch,
        "mean",
        F.sqrt("variance").alias("std"),
        "s1",
        "s2",
        "s3",
        "s4",
        F.try_divide(F.col("mean") - F.lag("mean").over(before), pooled).alias("standardised_difference"),
        (absent - F.lag(absent).over(before)).alias("absent_change"),
    )


def departures(df: DataFrame, group: str, baseline: DataFrame) -> DataFrame:
    """(column_name, group, issue): where the profile of a load departs from the baseline of a column.

    baseline has a row for each column to watch (see TESTDATA.md); its rows are few and read by the
    driver to know the columns.  Issues: 'absent', 'invalid', 'shift'.  Without any present value
    there is no 'invalid', without any valid one no 'shift'.  Baseline columns that the table lacks
    are left out; an empty table or baseline gives an empty result.
    """
    watched = [r for r in baseline.toLocalIterator() if r.column_name in df.columns]
    if not watched:
        return df.limit(0).select(F.lit("").alias("column_name"), F.col(group), F.lit("").alias("issue"))
    found = profile(df, group, [r.column_name for r in watched], watched=watched)
    usual = F.lit(None).cast("double")
    for r in watched:
        usual = F.when(F.col("column_name") == r.column_name, r.absent_share).otherwise(usual)
    present = F.col("n_rows") - F.col("n_absent")
    issues = F.array_compact(
        F.array(
            F.when(F.abs(F.col("absent_share") - usual) > TOLERANCE_ABSENT, F.lit("absent")),
            F.when(F.try_divide(present - F.col("n_valid"), present) > TOLERANCE_INVALID, F.lit("invalid")),
            F.when(F.col("shift") > TOLERANCE_SHIFT, F.lit("shift")),
        )
    )
    return found.select("column_name", group, F.explode(issues).alias("issue"))
