"""Queries of ingest, cleaning, exploration, splits, samples and joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import parsing, texts
from scoreloom.operators import alignment, cleaning, splits, summaries
from scoreloom.plans.tables import CATEGORICAL, LOANS, NUMERIC, accepted, clean_sql, loans, split_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ID = "_shared_row_id"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- rows and columns ---------------------------------------------------------------------------


@query(f"WITH {LOANS} SELECT _shared_row_id, target FROM loans")
def status_filter_target(spark: SparkSession, sf: str) -> DataFrame:
    return loans(spark, sf).select(ID, "target")


@query(f"""WITH {LOANS} SELECT _shared_row_id FROM loans WHERE "desc" IS NOT NULL AND regexp_matches("desc", '[^\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]')""")
def text_present(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.finished(accepted(spark, sf), text="desc").select(ID)


@query("""SELECT _shared_row_id FROM accepted_2007_to_2018q4 WHERE dti IS NOT NULL AND NOT isnan(dti) AND revol_util IS NOT NULL AND NOT isnan(revol_util)
  AND emp_length IS NOT NULL AND trim(emp_length) <> '' AND lower(trim(emp_length)) <> 'nan'""")
def required_non_missing(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.required(accepted(spark, sf), ["dti", "revol_util", "emp_length", "no_such_column"]).select(ID)


_RATIO = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL OR {'isnan(' + c + ')' if c in NUMERIC else f'trim({c}) = chr(0) OR length(trim({c})) = 0 OR lower(trim({c})) = chr(110) || chr(97) || chr(110)'}) AS n_missing FROM shared_split" for c in [*NUMERIC, *CATEGORICAL]
)


@query(f"SELECT *, n_missing / n_rows AS missing_ratio FROM ({_RATIO})")
def missing_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.missing_ratios(split_rows(spark, sf), [*NUMERIC, *CATEGORICAL])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {v}) + max(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END) <= 1 AS is_constant FROM shared_split" for c, v in [(c, clean_sql(c)) for c in NUMERIC] + [(c, c) for c in CATEGORICAL]
    )
)
def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.constants(split_rows(spark, sf), [*NUMERIC, *CATEGORICAL])


@query(f"""WITH {LOANS} SELECT _shared_row_id FROM loans WHERE upper(trim(grade)) IN ('D', 'E', 'F', 'G') AND {clean_sql('int_rate')} >= 16.0 AND {clean_sql('annual_inc')} <= 50000 AND issue_year IS NOT NULL""")
def subset_rule(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.subset(loans(spark, sf), **cleaning.PRESETS["default"]).where("issue_year IS NOT NULL").select(ID)


@query(f"""WITH {LOANS} SELECT _shared_row_id FROM loans WHERE upper(trim(grade)) IN ('E', 'F', 'G') AND {clean_sql('int_rate')} >= 18.5 AND {clean_sql('annual_inc')} <= 92500 AND issue_year IS NOT NULL""")
def subset_rule_published(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.subset(loans(spark, sf), **cleaning.PRESETS["published"]).where("issue_year IS NOT NULL").select(ID)


@query(f"WITH {LOANS} SELECT _shared_row_id, CASE WHEN issue_year <= 2013 THEN 'train' ELSE 'test' END AS period FROM loans WHERE issue_year BETWEEN 2007 AND 2016")
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    df = loans(spark, sf)
    parts = [cleaning.years(df, "issue_year", a, b).select(ID, F.lit(p).alias("period")) for p, a, b in (("train", 2007, 2013), ("test", 2014, 2016))]
    return alignment.union_all(parts)


@query(f"WITH {LOANS} SELECT _shared_row_id FROM loans WHERE issue_year BETWEEN 2007 AND 2013")
def year_range(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.years(loans(spark, sf), "issue_year", 2007, 2013).select(ID)


@query("SELECT _shared_row_id FROM accepted_2007_to_2018q4 ORDER BY _shared_row_id LIMIT 500")
def head_cap(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.head(accepted(spark, sf).select(ID), ID, 500)


@query(f"WITH {LOANS} SELECT _shared_row_id, row_number() OVER (ORDER BY _shared_row_id) - 1 AS row_id FROM loans")
def row_ids(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.row_ids(loans(spark, sf).select(ID), ID).select(ID, "row_id")


@query(f"""WITH {LOANS}, s AS (SELECT _shared_row_id, row_number() OVER (ORDER BY issue_year NULLS FIRST, target, grade NULLS FIRST, {clean_sql('int_rate')} NULLS FIRST, {clean_sql('annual_inc')} NULLS FIRST, loan_amnt NULLS FIRST, _shared_row_id) AS pos FROM loans) SELECT * FROM s""")
def stable_order(spark: SparkSession, sf: str) -> DataFrame:
    """Position of every row under a sort by several keys: one sortable key, then ranges."""
    v = lambda c: parsing.null_if_nan(F.col(c))
    keyed = loans(spark, sf).select(ID, F.struct("issue_year", "target", "grade", v("int_rate"), v("annual_inc"), "loan_amnt", ID).alias("k"))
    return alignment.row_ids(keyed, "k", "pos").select(ID, (F.col("pos") + 1).alias("pos"))


_RAW_TEXTS = ["addr_state", "application_type", "desc", "emp_length", "grade", "home_ownership", "issue_d", "loan_status", "partner_ref", "purpose", "sub_grade", "term", "verification_status"]
_RAW_DOUBLES = ["annual_inc", "dti", "fico_range_high", "fico_range_low", "installment", "int_rate", "loan_amnt", "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc"]
_RAW_OTHERS = ["_shared_row_id", "issue_year", "load_no", "loaded_at", "loan_id", "target"]
_NAMED = ["sub_grade", "fico_range_high"]


def _gone_sql(c: str) -> str:
    q = f'"{c}"'
    if c in _RAW_TEXTS:
        return f"({q} IS NULL OR lower(regexp_replace({q}, '^{_SPACE_}+|{_SPACE_}+$', '', 'g')) IN ('', 'nan'))"
    return f"({q} IS NULL OR isnan({q}))" if c in _RAW_DOUBLES else f"({q} IS NULL)"


_SPACE_ = r"[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}\x{0085}]"
_STILL = lambda c: f'CASE WHEN NOT isnan("{c}") THEN "{c}" END' if c in _RAW_DOUBLES else f'"{c}"'
_LEFT = [c for c in [*_RAW_TEXTS, *_RAW_DOUBLES, *_RAW_OTHERS] if c not in _NAMED]
_FACTS = " UNION ALL ".join(
    f"SELECT '{c}' AS c, count(*) FILTER ({_gone_sql(c)}) / count(*) > 0.4 AS sparse, count({_STILL(c)}) = 0 OR count({_STILL(c)}) = count(*) AND min({_STILL(c)}) = max({_STILL(c)}) AS still FROM sound" for c in _LEFT if c != "target"
)
_CLEANED = f"""WITH {LOANS}, sound AS (SELECT * FROM loans WHERE NOT {_gone_sql('desc')} AND NOT {_gone_sql('issue_year')} AND NOT {_gone_sql('loan_amnt')} AND NOT {_gone_sql('dti')}), f AS ({_FACTS}),
n AS (SELECT (SELECT count(*) FROM loans) AS a, (SELECT count(*) FROM sound) AS b)
SELECT a::VARCHAR AS rows_before, b::VARCHAR AS rows_after, (a - b)::VARCHAR AS rows_dropped, '{",".join(_NAMED)}' AS dropped_named, coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM f WHERE sparse), '') AS dropped_missing,
coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM f WHERE still AND NOT sparse), '') AS dropped_constant, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT c FROM f WHERE NOT sparse AND NOT still UNION ALL SELECT 'target')) AS columns FROM n"""


@query(_CLEANED)
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    rows, report = cleaning.clean(loans(spark, sf), ["desc", "issue_year", "loan_amnt", "dti"], _NAMED, True, 0.4, ["target"])
    out = {k: v if isinstance(v, int) else ",".join(v) for k, v in report.items()} | {"columns": ",".join(sorted(rows.columns))}
    return spark.createDataFrame([{k: str(v) for k, v in out.items()}])


# --- values --------------------------------------------------------------------------------------

_NUM = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


@query(f"SELECT _shared_row_id, CASE WHEN regexp_matches(emp_length, {_NUM}) THEN try_cast(trim(emp_length) AS DOUBLE) END AS emp_number, CASE WHEN regexp_matches(term, {_NUM}) THEN try_cast(trim(term) AS DOUBLE) END AS term_number FROM accepted_2007_to_2018q4")
def numeric_coercion(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(spark, sf).select(ID, parsing.number(F.col("emp_length")).alias("emp_number"), parsing.number(F.col("term")).alias("term_number"))


@query("SELECT _shared_row_id, CASE WHEN contains(lower(emp_length), '< 1') THEN 0.5 ELSE try_cast(nullif(regexp_extract(emp_length, '([0-9]+)', 1), '') AS DOUBLE) END AS emp_length_years FROM accepted_2007_to_2018q4")
def parse_emp_length(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(spark, sf).select(ID, parsing.emp_length_years(F.col("emp_length")).alias("emp_length_years"))


@query("SELECT _shared_row_id, try_cast(nullif(regexp_extract(term, '([0-9]+)', 1), '') AS DOUBLE) AS term_months FROM accepted_2007_to_2018q4")
def parse_term(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(spark, sf).select(ID, parsing.term_months(F.col("term")).alias("term_months"))


@query("SELECT _shared_row_id, try_cast(nullif(regexp_extract(issue_d, '((19|20)[0-9]{2})', 1), '') AS INTEGER) AS issue_year FROM accepted_2007_to_2018q4")
def parse_issue_year(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(spark, sf).select(ID, parsing.issue_year(F.col("issue_d")).alias("issue_year"))


@query("SELECT _shared_row_id, (fico_range_low + fico_range_high) / 2 AS fico_mean FROM accepted_2007_to_2018q4")
def fico_mean(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(spark, sf).select(ID, parsing.fico_mean(F.col("fico_range_low"), F.col("fico_range_high")).alias("fico_mean"))


@query("SELECT _shared_row_id, try_cast(replace(replace(format('{:.2f}%', int_rate), '%', ''), ',', '') AS DOUBLE) AS rate, try_cast(replace(printf('%,d', loan_amnt::BIGINT), ',', '') AS DOUBLE) AS amount FROM accepted_2007_to_2018q4")
def safe_float(spark: SparkSession, sf: str) -> DataFrame:
    df = accepted(spark, sf)
    return df.select(ID, parsing.safe_float(F.concat(F.format_string("%.2f", "int_rate"), F.lit("%"))).alias("rate"), parsing.safe_float(F.format_number(F.col("loan_amnt").cast("bigint"), 0)).alias("amount"))


_SPACE = r"[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}\x{0085}]"
# Entities that writers use (fixed values); the ampersand comes last, so that nothing is resolved twice.
_ENTITIES = [("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]
_PLAIN = "CASE WHEN lower(trim(\"desc\")) = 'nan' THEN '' ELSE \"desc\" END"
for _a, _b in _ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"
CLEAN = f"lower(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '<[^>]+>', ' ', 'g'), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g'))"


@query(f'SELECT _shared_row_id, {CLEAN} AS desc_clean FROM accepted_2007_to_2018q4 WHERE "desc" IS NOT NULL')
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return accepted(spark, sf).where(F.col("`desc`").isNotNull()).select(ID, texts.clean_text(F.col("`desc`")).alias("desc_clean"))


# --- exploration ---------------------------------------------------------------------------------


@query(f"WITH {LOANS} SELECT issue_year, count(*) AS n, avg(target) AS target_rate FROM loans GROUP BY 1")
def target_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.by_group(loans(spark, sf), "issue_year", "target")


@query(f"WITH {LOANS} SELECT grade, count(*) AS n, avg(target) AS target_rate FROM loans GROUP BY 1")
def target_by_grade(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.by_group(loans(spark, sf), "grade", "target")


@query(f"WITH {LOANS} SELECT issue_year, grade, count(*) AS n, avg(target) AS target_rate FROM loans GROUP BY GROUPING SETS ((issue_year), (grade))")
def by_year_grade_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.by_two(loans(spark, sf), "issue_year", "grade", "target")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM accepted_2007_to_2018q4 GROUP BY 2" for c in ["grade", "term", "home_ownership", "purpose"]))
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.value_counts(accepted(spark, sf), ["grade", "term", "home_ownership", "purpose"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS n_with_null FROM accepted_2007_to_2018q4" for c in ["grade", "emp_length", "term", "addr_state", "loan_id", "partner_ref"]))
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.distinct_counts(accepted(spark, sf), ["grade", "emp_length", "term", "addr_state", "loan_id", "partner_ref"])


def _describe_sql(c: str) -> str:
    q = ", ".join(f"quantile_cont(v, {p}) AS p{round(p * 100)}" for p in summaries.PROBS)
    return f"SELECT '{c}' AS column_name, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, {q}, max(v) AS max FROM (SELECT {clean_sql(c)} AS v FROM shared_split) HAVING count(v) > 0"


@query(" UNION ALL ".join(map(_describe_sql, NUMERIC)))
def numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.describe(split_rows(spark, sf), NUMERIC).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def _category_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique, (SELECT {c} FROM shared_split WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS top_value,
      (SELECT count(*) FROM shared_split WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) / count(*) AS top_ratio, count(*) FILTER ({c} IS NULL) / count(*) AS missing_ratio FROM shared_split"""


@query(" UNION ALL ".join(map(_category_sql, CATEGORICAL)))
def categorical_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.categories(split_rows(spark, sf), CATEGORICAL)


@query(f"WITH {LOANS} SELECT count(*) AS n, round(avg(loan_amnt), 6) AS mean, min(loan_amnt) AS min, max(loan_amnt) AS max, median(loan_amnt) AS median FROM loans WHERE loan_amnt IS NOT NULL")
def subset_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = summaries.describe(loans(spark, sf), ["loan_amnt"])
    return d.select("n", F.round("mean", 6).alias("mean"), "min", "max", F.col("p50").alias("median"))


def _corr_sql() -> str:
    from itertools import combinations

    pairs = [*combinations(NUMERIC, 2), *[(c, "target") for c in NUMERIC]]
    v = lambda c: "target" if c == "target" else f"CASE WHEN isfinite({c}) THEN {c} END"
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS r FROM (SELECT {v(a)} AS x, {v(b)} AS y FROM shared_split) WHERE x IS NOT NULL AND y IS NOT NULL" for a, b in pairs)


@query(_corr_sql())
def corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.correlations(split_rows(spark, sf), NUMERIC, "target").withColumn("r", F.round("r", 6))


def _worth_sql(names: list[str], source: str) -> str:
    """SQL: (c, i, worth, gap) of columns, and the pairs (a, b) that correlate at 0.98 or above."""
    from itertools import combinations

    v = lambda c: "target" if c == "target" else f"CASE WHEN isfinite({c}) THEN {c} END"
    r = lambda a, b: f"(SELECT covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) FROM (SELECT {v(a)} AS x, {v(b)} AS y FROM {source}) WHERE x IS NOT NULL AND y IS NOT NULL)"
    cols = " UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS i, coalesce(abs({r(c, 'target')}), 0) AS worth, (SELECT count(*) FILTER ({c} IS NULL OR isnan({c})) / count(*) FROM {source}) AS gap" for i, c in enumerate(names))
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(a, b)} AS r" for a, b in combinations(names, 2))
    return f"cols AS ({cols}), pairs AS (SELECT * FROM ({pairs}) WHERE abs(r) >= 0.98 - 1e-12), losers AS (SELECT DISTINCT CASE WHEN (x.worth, -x.gap) < (y.worth, -y.gap) THEN a ELSE b END AS c FROM pairs JOIN cols x ON x.c = a JOIN cols y ON y.c = b)"


@query(f"WITH src AS (SELECT *, loan_amnt * 2 AS twice_loan FROM shared_split), {_worth_sql([*NUMERIC, 'twice_loan'], 'src')} SELECT c AS column_name, c IN (SELECT c FROM losers) AS dropped FROM cols")
def corr_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy pruning; no dropped column is the rival of another here, so the SQL needs no order."""
    rows = split_rows(spark, sf).withColumn("twice_loan", F.col("loan_amnt") * 2)
    names = [*NUMERIC, "twice_loan"]
    found = {(r.a, r.b): r.r for r in summaries.correlations(rows, names, "target").collect()}
    missing = {r.column_name: r.missing_ratio for r in cleaning.missing_ratios(rows, names).collect()}
    gone = summaries.prune(names, found, {c: found.get((c, "target")) for c in names}, missing)
    return spark.createDataFrame([(c, c in gone) for c in names], "column_name string, dropped boolean")


_TRAIN = "src AS (SELECT * FROM shared_split WHERE split = 'train_fit')"
_STATE = " UNION ALL ".join(
    f"SELECT '{c}' AS c, {i} AS i, {str(c in NUMERIC).lower()} AS numeric, count(*) FILTER ({c} IS NULL OR {f'isnan({c})' if c in NUMERIC else f"lower(trim({c})) IN ('', 'nan')"}) / count(*) > 0.3 AS sparse, count({v}) = 0 OR count({v}) = count(*) AND min({v}) = max({v}) AS still FROM src"
    for i, (c, v) in enumerate([(c, clean_sql(c)) for c in NUMERIC] + [(c, c) for c in CATEGORICAL])
)


@query(
    f"WITH {_TRAIN}, {_worth_sql(NUMERIC, 'src')}, st AS ({_STATE}), kept AS (SELECT * FROM st WHERE NOT sparse AND NOT still) "
    + " UNION ALL ".join(
        f"SELECT '{part}' AS part, coalesce((SELECT string_agg(c, ',' ORDER BY {order}) FROM {rows}), '') AS columns"
        for part, rows, order in (("selected_numeric_columns", "kept WHERE numeric AND c NOT IN (SELECT c FROM losers)", "i"), ("selected_categorical_columns", "kept WHERE NOT numeric", "i"), ("dropped_by_missing_ratio", "st WHERE sparse", "i"), ("dropped_by_constant", "st WHERE still AND NOT sparse", "c"), ("dropped_by_high_correlation", "kept WHERE numeric AND c IN (SELECT c FROM losers)", "i"))
    )
)
def feature_selection(spark: SparkSession, sf: str) -> DataFrame:
    report = summaries.choose_features(split_rows(spark, sf).where("split = 'train_fit'"), NUMERIC, CATEGORICAL, "target")
    return spark.createDataFrame([(k, ",".join(v)) for k, v in report.items()], "part string, columns string")


# --- splits and samples --------------------------------------------------------------------------

_RANK = "row_number() OVER (PARTITION BY target ORDER BY md5('42:' || _shared_row_id::VARCHAR), _shared_row_id)"
_COUNTS = "n AS (SELECT count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1, count(*) AS n FROM loans)"


def _share(total: str, n0: str, n1: str) -> str:
    """SQL of the negatives' part of a total shared by largest remainder (ties: class 0)."""
    e0, e1 = f"({total} * {n0} / ({n0} + {n1})::DOUBLE)", f"({total} * {n1} / ({n0} + {n1})::DOUBLE)"
    f0, f1 = f"floor({e0} + 1e-9)", f"floor({e1} + 1e-9)"
    return f"({f0} + CASE WHEN {total} - {f0} - {f1} >= 1 AND {e0} - {f0} >= {e1} - {f1} THEN 1 ELSE 0 END)"


_SPLIT = f"""WITH {LOANS}, {_COUNTS}, q AS (SELECT *, ceil(n * 0.2 - 1e-9) AS t FROM n), q2 AS (SELECT *, {_share('t', 'n0', 'n1')} AS t0 FROM q),
q3 AS (SELECT *, t - t0 AS t1, n0 - t0 AS r0, n1 - (t - t0) AS r1, ceil((n - t) * 0.2 - 1e-9) AS v FROM q2), q4 AS (SELECT *, {_share('v', 'r0', 'r1')} AS v0 FROM q3),
r AS (SELECT *, {_RANK} AS rk FROM loans),
out AS (SELECT _shared_row_id, target, CASE WHEN rk <= CASE target WHEN 0 THEN t0 ELSE t1 END THEN 'test' WHEN rk <= CASE target WHEN 0 THEN t0 + v0 ELSE t1 + v - v0 END THEN 'validation' ELSE 'train_fit' END AS split FROM r, q4)"""


@query(f"{_SPLIT} SELECT * FROM out")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_split(loans(spark, sf).select(ID, "target"), ID, "target").select(ID, "target", "split")


@query(f"{_SPLIT}, p AS (SELECT split, count(*) AS rows, sum(target)::BIGINT AS pos FROM out GROUP BY 1) SELECT split, rows, pos, pos / rows AS positive_rate, abs(pos / rows - (sum(pos) OVER () / sum(rows) OVER ())) AS gap_vs_full, max(pos / rows) OVER () - min(pos / rows) OVER () AS max_pair_gap FROM p")
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_report(splits.stratified_split(loans(spark, sf).select(ID, "target"), ID, "target"), "target")


_TAKE = f"WITH {LOANS}, {_COUNTS}, r AS (SELECT *, {_RANK} AS rk FROM loans) SELECT _shared_row_id, target FROM r, n WHERE rk <= "


@query(_TAKE + "least(n0, n1)")
def downsample_equal(spark: SparkSession, sf: str) -> DataFrame:
    return splits.equal_classes(loans(spark, sf).select(ID, "target"), ID, "target")


@query(_TAKE + "least(n1, 700)")
def downsample_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return splits.downsample_negatives(loans(spark, sf).select(ID, "target"), ID, "target", 700)


@query(_TAKE + "CASE target WHEN 0 THEN 300 ELSE n1 END")
def sample_by_cap(spark: SparkSession, sf: str) -> DataFrame:
    return splits.capped(loans(spark, sf).select(ID, "target"), ID, "target", {0: 300, 1: 0})


@query(_TAKE + "CASE target WHEN 0 THEN greatest(1, round_even(n0 * 0.05, 0)) ELSE greatest(1, round_even(n1 * 0.05, 0)) END")
def ratio_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.ratio_sample(loans(spark, sf).select(ID, "target"), ID, "target", 0.05)


@query(f"""WITH {LOANS}, {_COUNTS}, r AS (SELECT *, {_RANK} AS rk FROM loans),
d AS (SELECT i AS draw_no, 1 + ('0x' || substr(md5('42/draw:' || i::VARCHAR), 1, 12))::BIGINT % n1 AS rk FROM n, range(1, n0 + 1) u(i))
SELECT _shared_row_id, target, 0 AS draw_no FROM loans WHERE target = 0 UNION ALL SELECT r._shared_row_id, r.target, d.draw_no FROM d JOIN r ON r.rk = d.rk AND r.target = 1""")
def oversample_pos(spark: SparkSession, sf: str) -> DataFrame:
    return splits.oversample_positives(loans(spark, sf).select(ID, "target"), ID, "target")


@query(f"WITH {LOANS} SELECT _shared_row_id, ({_RANK} - 1) % 5 AS fold FROM loans")
def kfold(spark: SparkSession, sf: str) -> DataFrame:
    return splits.folds(loans(spark, sf).select(ID, "target"), ID, "target").select(ID, "fold")


# --- joins and unions ----------------------------------------------------------------------------


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY _shared_row_id) AS rn FROM accepted_2007_to_2018q4) SELECT _shared_row_id, loan_id, loan_amnt FROM f WHERE rn = 1""")
def keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.keep_first(accepted(spark, sf).select(ID, "loan_id", "loan_amnt"), "loan_id", ID)


@query("SELECT s._shared_row_id, s.split, a.loan_status, a.loan_amnt FROM shared_split s JOIN accepted_2007_to_2018q4 a USING (_shared_row_id)")
def realign_by_row_id(spark: SparkSession, sf: str) -> DataFrame:
    base = accepted(spark, sf).select(ID, "loan_status", "loan_amnt")
    return alignment.realign(split_rows(spark, sf).select(ID, "split"), base, ID, ID).select(ID, "split", "loan_status", "loan_amnt")


@query(f"WITH {LOANS} SELECT _shared_row_id FROM loans WHERE _shared_row_id NOT IN (SELECT _shared_row_id FROM shared_split)")
def missing_ids(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.missing_ids(loans(spark, sf), split_rows(spark, sf), ID)


@query(f"WITH {LOANS} SELECT l._shared_row_id, l.target, s.target AS predicted, s._shared_row_id IS NULL AS missing_prediction FROM loans l LEFT JOIN shared_split s USING (_shared_row_id)")
def prediction_label_join(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.with_predictions(loans(spark, sf).select(ID, "target"), split_rows(spark, sf).select(ID, F.col("target").alias("predicted")), ID)


@query("SELECT _shared_row_id, split, CASE WHEN split = 'train_fit' THEN grade END AS grade FROM shared_split WHERE split IN ('train_fit', 'validation')")
def union_parts(spark: SparkSession, sf: str) -> DataFrame:
    df = split_rows(spark, sf)
    return alignment.union_all([df.where("split = 'train_fit'").select(ID, "split", "grade"), df.where("split = 'validation'").select("split", ID)])
