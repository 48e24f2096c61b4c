"""Queries on data quality: column profiles by load, and filling of missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import chained_imputation, column_profile

EMP_LENGTHS = ["< 1 year", "1 year", "2 years", "3 years", "4 years", "5 years", "6 years", "7 years", "8 years", "9 years", "10+ years"]
PATTERNS = {
    "emp_length": r"< 1 year|1 year|[2-9] years|10\+ years",
    "grade": "[A-G]",
    "sub_grade": "[A-G][1-5]",
    "term": " (?:36|60) months",
    "issue_d": "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-(?:19|20)[0-9]{2}",
    "addr_state": "[A-Z]{2}",
    "home_ownership": "[A-Z]+",
    "purpose": "[a-z_]+",
}


# Words of NO_ANSWER that are categories of a column.
ANSWERS = {"home_ownership": ["none"]}


def _accepted(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/accepted_2007_to_2018q4.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return column_profile.departures(_accepted(spark, sf), "load_no", spark.read.parquet(f"{sf}/column_baseline.parquet"))


def p2_profile(spark: SparkSession, sf: str) -> DataFrame:
    return column_profile.profile(_accepted(spark, sf), "load_no", patterns=PATTERNS, answers=ANSWERS)


# Written down on their own, from how the columns are filled in.
_WORDS = "'', '-', 'n/a', 'not given', 'null', 'unknown', 'none', 'nan'"
ABSENT_TEXT = f"(emp_length IS NULL OR lower(regexp_replace(emp_length, '^\\s+|\\s+$', '', 'g')) IN ({_WORDS}))"
P2_FOUND = f"""
WITH cells AS (
  SELECT 'dti' AS column_name, load_no, dti AS number, NULL AS word, dti IS NULL OR isnan(dti) AS absent FROM accepted_2007_to_2018q4
  UNION ALL SELECT 'revol_util', load_no, revol_util, NULL, revol_util IS NULL OR isnan(revol_util) FROM accepted_2007_to_2018q4
  UNION ALL SELECT 'emp_length', load_no, NULL, emp_length, {ABSENT_TEXT} FROM accepted_2007_to_2018q4),
marked AS (
  SELECT c.*, b.absent_share, b.value_type, b.cut_points, b.cut_shares, b.valid_values, b.value_shares,
    NOT c.absent AND CASE WHEN b.value_type = 'string' THEN list_contains(b.valid_values, c.word) ELSE c.number BETWEEN b.valid_min AND b.valid_max END AS valid
  FROM cells c JOIN column_baseline b USING (column_name)),
shares AS (
  SELECT column_name, load_no, count(*) AS n, count(*) FILTER (absent) AS a, count(*) FILTER (NOT absent) AS p, count(*) FILTER (valid) AS v, any_value(absent_share) AS absent_share
  FROM marked GROUP BY 1, 2),
cuts AS (
  SELECT column_name, load_no, max(abs(below / v - share)) AS gap FROM (
    SELECT m.column_name, m.load_no, u.i, any_value(m.cut_shares[u.i]) AS share, count(*) FILTER (m.number <= m.cut_points[u.i]) AS below, count(*)::DOUBLE AS v
    FROM marked m, range(1, 10) u(i) WHERE m.valid AND m.value_type <> 'string' AND u.i <= len(m.cut_points) GROUP BY 1, 2, 3) GROUP BY 1, 2),
kinds AS (
  SELECT column_name, load_no, sum(abs(hits / v - share)) / 2 AS gap FROM (
    SELECT m.column_name, m.load_no, u.i, any_value(m.value_shares[m.valid_values[u.i]]) AS share, count(*) FILTER (m.word = m.valid_values[u.i]) AS hits, count(*)::DOUBLE AS v
    FROM marked m, range(1, 12) u(i) WHERE m.valid AND m.value_type = 'string' AND u.i <= len(m.valid_values) GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT column_name, load_no, 'absent' AS issue FROM shares WHERE abs(a / n - absent_share) > 0.05
UNION ALL SELECT column_name, load_no, 'invalid' FROM shares WHERE p > 0 AND (p - v) / p > 0.02
UNION ALL SELECT column_name, load_no, 'shift' FROM (SELECT * FROM cuts UNION ALL SELECT * FROM kinds) WHERE gap > 0.10
"""


def _profile_sql(c: str, kind: str) -> str:
    """SQL of one column's profile by load; numbers at six decimals, whole-number sums."""
    if kind == "number":
        absent, v, x = f"({c} IS NULL OR isnan({c}))", f"CASE WHEN NOT isnan({c}) THEN {c} END", f"CASE WHEN isfinite({c}) THEN {c} END"
        low, high, odd, bad = f"min({v})", f"max({v})", f"count(*) FILTER (isinf({c}))", "0"
        mean, std = f"avg({x})", f"stddev_pop({x})"
        distinct = f"count(DISTINCT {v})"
    else:
        none = "" if c == "home_ownership" else ", 'none'"
        absent = f"({c} IS NULL OR lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) IN ('', '-', 'n/a', 'not given', 'null', 'unknown', 'nan'{none}))"
        low = high = mean = std = "NULL::DOUBLE"
        odd, distinct = "0", f"count(DISTINCT {c}) FILTER (NOT {absent})"
        bad = f"count(*) FILTER (NOT {absent} AND NOT regexp_full_match({c}, '{PATTERNS[c]}'))" if c in PATTERNS else "0"
    return f"""SELECT load_no, '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({absent}) AS n_absent, {distinct} AS n_distinct, {low} AS min_number, {high} AS max_number,
    {odd} AS n_not_finite, {bad} AS n_violations, round({mean}, 5) AS mean, round({std}, 4) AS std FROM accepted_2007_to_2018q4 GROUP BY 1"""


PROFILED = {c: "number" for c in ("dti", "revol_util", "int_rate", "open_acc", "pub_rec")} | {c: "text" for c in ("emp_length", "grade", "term", "home_ownership", "purpose", "addr_state", "sub_grade")}
P2_COLUMNS = " UNION ALL ".join(_profile_sql(c, k) for c, k in PROFILED.items())


def p2_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, ranges and moments of the profile, in a form that SQL can say."""
    found = column_profile.profile(_accepted(spark, sf), "load_no", list(PROFILED), PATTERNS, ANSWERS)
    return found.select("load_no", "column_name", "n_rows", "n_absent", "n_distinct", "min_number", "max_number", "n_not_finite", "n_violations", F.round("mean", 5).alias("mean"), F.round("std", 4).alias("std"))


def p3_filled(spark: SparkSession, sf: str) -> DataFrame:
    df = _accepted(spark, sf)
    low, high = {"dti": 0.0, "revol_util": 0.0}, {"dti": 100.0, "revol_util": 200.0}
    for r in spark.read.parquet(f"{sf}/column_baseline.parquet").where("column_name IN ('dti', 'revol_util')").collect():
        low[r.column_name], high[r.column_name] = r.valid_min, r.valid_max
    numbers = {f: (low[f], high[f]) for f in low}
    valid = {f: F.coalesce(F.col(f).between(*numbers[f]), F.lit(False)) for f in numbers}
    missing = {f: ~valid[f] for f in numbers}
    missing["emp_length"] = column_profile.is_absent(F.col("emp_length"), df.schema["emp_length"].dataType)
    valid["emp_length"] = F.col("emp_length").isin(EMP_LENGTHS)
    return chained_imputation.impute(
        df, "_shared_row_id", [F.col("load_no"), F.upper(F.trim("grade"))], numbers, {"emp_length": EMP_LENGTHS}, missing, valid, ["loan_amnt", "int_rate", "annual_inc", "revol_bal", "open_acc"]
    ).withColumnsRenamed({"g0": "load_no", "g1": "grade"})


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    filled = p3_filled(spark, sf)
    names = F.array(*[F.when(F.col(f"{f}_filled"), F.lit(f)) for f in ("dti", "revol_util", "emp_length")])
    return filled.select(F.explode(F.array_compact(names)).alias("column_name"), "_shared_row_id")


_VALID_WORDS = ", ".join(f"'{w}'" for w in EMP_LENGTHS)
P3_FOUND = f"""
WITH base AS (
  SELECT _shared_row_id, load_no, upper(trim(grade)) AS g, coalesce(dti BETWEEN 0 AND 100, false) AS dti_ok, coalesce(revol_util BETWEEN 0 AND 200, false) AS util_ok,
    coalesce(emp_length IN ({_VALID_WORDS}), false) AS emp_ok, {ABSENT_TEXT} AS emp_gap
  FROM accepted_2007_to_2018q4),
groups AS (SELECT load_no, g, bool_or(dti_ok) AS d, bool_or(util_ok) AS u, bool_or(emp_ok) AS e FROM base WHERE g IS NOT NULL AND load_no IS NOT NULL GROUP BY 1, 2),
both_ AS (SELECT * FROM base JOIN groups USING (load_no, g))
SELECT 'dti' AS column_name, _shared_row_id FROM both_ WHERE NOT dti_ok AND d
UNION ALL SELECT 'revol_util', _shared_row_id FROM both_ WHERE NOT util_ok AND u
UNION ALL SELECT 'emp_length', _shared_row_id FROM both_ WHERE emp_gap AND e
"""

P3_MARKS = P3_FOUND[: P3_FOUND.index("SELECT 'dti' AS column_name")] + """SELECT b._shared_row_id, coalesce(NOT b.dti_ok AND g.d, false) AS dti_filled, coalesce(NOT b.util_ok AND g.u, false) AS revol_util_filled, coalesce(b.emp_gap AND g.e, false) AS emp_length_filled,
  a.emp_length AS kept FROM base b LEFT JOIN groups g ON g.load_no = b.load_no AND g.g = b.g JOIN accepted_2007_to_2018q4 a ON a._shared_row_id = b._shared_row_id WHERE NOT coalesce(b.emp_gap AND g.e, false)
UNION ALL SELECT b._shared_row_id, coalesce(NOT b.dti_ok AND g.d, false), coalesce(NOT b.util_ok AND g.u, false), true, NULL FROM base b JOIN groups g ON g.load_no = b.load_no AND g.g = b.g WHERE b.emp_gap AND g.e"""


def p3_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Every row's marks, and what stands in emp_length where it was not filled."""
    filled = p3_filled(spark, sf)
    marks = [f"{f}_filled" for f in ("dti", "revol_util", "emp_length")]
    return filled.select("_shared_row_id", *marks, F.when(~F.col("emp_length_filled"), F.col("emp_length")).alias("kept"))


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_columns, p3_found, p3_filled, p3_marks)}
ORACLES = {"p2_found": P2_FOUND, "p2_columns": P2_COLUMNS, "p3_found": P3_FOUND, "p3_marks": P3_MARKS}
