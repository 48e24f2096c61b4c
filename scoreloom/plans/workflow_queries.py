"""Queries of policies, model choice, sampling, response parsing and generation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom import scorers
from scoreloom.functions import parsing, texts
from scoreloom.operators import cleaning, features, policies, scores, splits
from scoreloom.operators.policies import BAND, FIXED, FLOOR, REVIEW, Policy
from scoreloom.plans.data_queries import _COUNTS, _RANK, _share
from scoreloom.plans.model_queries import _PROFILE, _RESPONSES, _TEXT, _WORD, _feature_text, _profile, _responses
from scoreloom.plans.tables import CATEGORICAL, LOANS, NUMERIC, SCORED, accepted, clean_sql, loans, scored, split_rows

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


def _part(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scored(spark, sf).where(F.col("split") == name)


# --- thresholds under a policy ------------------------------------------------------------------------

_GRID = "grid AS (SELECT 0.01 + i * (0.98 / 196) AS t FROM range(0, 197) u(i)), scan AS (SELECT 0.05 + i * (0.90 / 180) AS t FROM range(0, 181) u(i))"
_CELLS = "count(*) FILTER (score >= t AND target = 1) AS tp, count(*) FILTER (score >= t AND target = 0) AS fp, count(*) FILTER (score < t AND target = 0) AS tn, count(*) FILTER (score < t AND target = 1) AS fn"


def _review_sql(source: str, grid: str, by: str = "") -> str:
    """SQL: automatic decisions of each threshold when a tenth of the rows nearest to it is reviewed."""
    g = f"{by}, " if by else ""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {g}t ORDER BY round(abs(score - t), 12), _shared_row_id) AS rk, count(*) OVER (PARTITION BY {g}t) AS n, count(*) FILTER (target = 1) OVER (PARTITION BY {g}t) AS pos FROM {source}, {grid}),
reviewed AS (SELECT {g}t, n, pos, {_CELLS}, count(*) AS auto FROM ranked WHERE rk > least(floor(n * 0.1 + 1e-9), n - 1) GROUP BY ALL)"""


_SHARE = "coalesce({0} / nullif({1}, 0), 0)"
_MEASURES = {
    "precision_reject_auto": _SHARE.format("tp", "tp + fp"),
    "recall_default_auto_on_total": _SHARE.format("tp", "pos"),
    "reject_rate_auto_on_total": "(tp + fp) / n",
    "auto_rate": "auto / n",
    "manual_rate": "(n - auto) / n",
    "bad_rate_in_auto_approve": _SHARE.format("fn", "tn + fn"),
}


@query(f"WITH {SCORED}, {_GRID}, v AS (SELECT * FROM scored WHERE split = 'validation'), {_review_sql('v', 'grid')} SELECT round(t, 9) AS threshold, tp, fp, tn, fn FROM reviewed")
def review_points(spark: SparkSession, sf: str) -> DataFrame:
    found = policies.review_points(_part(spark, sf, "validation"), "score", "target", ID, 0.1)
    return spark.createDataFrame([(round(p.threshold, 9), p.tp, p.fp, p.tn, p.fn) for p in found], "threshold double, tp long, fp long, tn long, fn long")


@query(f"WITH {SCORED}, v AS (SELECT * FROM scored WHERE split = 'test'), one AS (SELECT 0.45 AS t), {_review_sql('v', 'one')} SELECT " + ", ".join(f"round({v}, 9) AS {k}" for k, v in _MEASURES.items()) + " FROM reviewed")
def manual_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    m = policies.review_points(_part(spark, sf, "test"), "score", "target", ID, 0.1, [0.45])[0].measures
    return spark.createDataFrame([tuple(round(v, 9) for v in m.values())], ", ".join(f"{k} double" for k in m))


POLICIES = {
    "fixed": Policy(FIXED, target_rate=0.35),
    "band": Policy(BAND, low=0.2, high=0.5),
    "band_unmet": Policy(BAND, precision_floor=0.99, low=0.2, high=0.5),
    "floor": Policy(FLOOR, precision_floor=0.2, low=0.2, high=0.5),
    "review": Policy(REVIEW, precision_floor=0.2, low=0.1, high=0.6, least_auto=0.8),
}
_P, _R, _Q = _SHARE.format("tp", "tp + fp"), _SHARE.format("tp", "tp + fn"), "(tp + fp) / (tp + fp + tn + fn)"


def _thresholds_sql(source: str, by: str = "") -> str:
    """SQL: a row (policy, t, score) for each policy and each value of ``by``."""
    g = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    over = f"PARTITION BY {by} " if by else ""
    first = lambda name, rows, order, keep="true": f"SELECT {g}'{name}' AS policy, t, score FROM (SELECT *, row_number() OVER ({over}ORDER BY {order}) AS place FROM {rows} WHERE {keep}) WHERE place = 1"
    return f"""points AS (SELECT {g}t, {_CELLS} FROM {source}, grid GROUP BY ALL), wide AS (SELECT {g}t, {_CELLS} FROM {source}, scan GROUP BY ALL), {_review_sql(source, 'grid', by)},
chosen AS (SELECT {g}'fixed' AS policy, quantile_cont(score, 0.65) AS t, NULL::DOUBLE AS score FROM {source} {group}
UNION ALL {first('band', f"(SELECT *, {_P} AS score FROM points)", f"round(score, 9) DESC, round({_R}, 9) DESC, {_Q}, t DESC", f"{_Q} BETWEEN 0.2 AND 0.5")}
UNION ALL {first('floor', f"(SELECT *, {_R} AS score FROM points)", f"round(score, 9) DESC, round({_P}, 9) DESC, {_Q}, t DESC", f"{_Q} BETWEEN 0.2 AND 0.5 AND {_P} >= 0.2")}
UNION ALL {first('review', f"(SELECT *, {_MEASURES['recall_default_auto_on_total']} AS score FROM reviewed)", f"round(score, 9) DESC, round({_P}, 9) DESC, auto DESC, t DESC", f"{_P} >= 0.2 AND (tp + fp) / n BETWEEN 0.1 AND 0.6 AND auto / n >= 0.8")}
UNION ALL {first('band_unmet', f"(SELECT *, {_P} AS score FROM wide)", "score DESC, t")})"""


@query(f"WITH {SCORED}, {_GRID}, v AS (SELECT * FROM scored WHERE split = 'validation'), {_thresholds_sql('v')} SELECT policy, round(t, 9) AS threshold, round(score, 9) AS score, policy <> 'band_unmet' AS satisfied FROM chosen")
def policy_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold that each policy chooses on validation."""
    rows = _part(spark, sf, "validation")
    out = []
    for name, policy in POLICIES.items():
        pick = policies.choose(rows, "score", "target", ID, policy)
        out.append((name, round(float(pick["threshold"]), 9), None if pick["score"] is None else round(float(pick["score"]), 9), pick["satisfied"]))
    return spark.createDataFrame(out, "policy string, threshold double, score double, satisfied boolean")


# --- model summaries ------------------------------------------------------------------------------------

MODELS = {"plain": lambda s: s, "sharp": lambda s: s * s, "flat": lambda s: F.floor(s * 10) / 10}
_MODELS = "m AS (SELECT _shared_row_id, split, target, 'plain' AS model, round(score, 4) AS score FROM scored UNION ALL SELECT _shared_row_id, split, target, 'sharp', round(score * score, 4) FROM scored UNION ALL SELECT _shared_row_id, split, target, 'flat', round(floor(score * 10) / 10, 4) FROM scored), v AS (SELECT * FROM m WHERE split = 'validation')"


def _summary(spark: SparkSession, sf: str, policy: Policy) -> list[dict]:
    rows = scored(spark, sf).select(ID, "split", "target", *[F.round(f(F.col("score")), 4).alias(k) for k, f in MODELS.items()])
    return policies.summary([policies.evaluate(rows, k, "target", ID, "split", policy, k) for k in MODELS], policy)


def _frame(spark: SparkSession, rows: list[dict], columns: list[str]) -> DataFrame:
    cells = [(r["model_name"], *[None if r[c] is None else round(float(r[c]), 6) for c in columns], bool(r["selected"]), int(r["place"])) for r in rows]
    return spark.createDataFrame(cells, "model_name string, " + ", ".join(f"{c} double" for c in columns) + ", selected boolean, place int")


_AT = ["precision_reject", "recall_default", "reject_rate", "approval_bad_rate", "lift", "f1", "balanced_accuracy"]
_AT_SQL = {"precision_reject": _P, "recall_default": _R, "reject_rate": _Q, "approval_bad_rate": _SHARE.format("fn", "tn + fn"), "lift": f"{_P} / 0.35", "f1": _SHARE.format("2 * tp", "2 * tp + fp + fn"), "balanced_accuracy": "coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0))"}


def _summary_sql(policy: str, order: str) -> str:
    """SQL of a summary by the measures at the policy's threshold."""
    wide = ", ".join(f"max(CASE WHEN split = '{s}' THEN {v} END) AS {k}_{s}" for s in ("validation", "test") for k, v in _AT_SQL.items())
    ranks = ", ".join(f"max(CASE WHEN split = '{s}' THEN {k} END) AS {k}_{s}" for s in ("validation", "test") for k in ("pr_auc", "roc_auc"))
    return f"""WITH {SCORED}, {_GRID}, {_MODELS}, {_thresholds_sql('v', 'model')}, c AS (SELECT model, split, t, chosen.score AS best, {_CELLS.replace('score', 'm.score')} FROM m JOIN chosen USING (model) WHERE policy = '{policy}' AND split IN ('validation', 'test') GROUP BY ALL),
g AS (SELECT model, split, score, count(*) AS n, sum(target) AS pos FROM m WHERE split IN ('validation', 'test') GROUP BY ALL),
r AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(n) OVER (PARTITION BY model, split) AS nn, sum(pos) OVER (PARTITION BY model, split) AS pp FROM g WINDOW w AS (PARTITION BY model, split ORDER BY score DESC)),
k AS (SELECT model, {ranks} FROM (SELECT model, split, sum(pos * cp / cn) / max(pp) AS pr_auc, sum((n - pos) * (cp - pos / 2)) / (max(pp) * (max(nn) - max(pp))) AS roc_auc FROM r GROUP BY ALL) GROUP BY ALL),
s AS (SELECT model, t, best, {wide} FROM c GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY {order}, list_position(['plain', 'sharp', 'flat'], model)) AS place FROM s JOIN k USING (model))
SELECT model AS model_name, round(t, 6) AS threshold, {', '.join(f'round({k}_{x}, 6) AS {k}_{x}' for x in ('validation', 'test') for k in [*_AT_SQL, 'pr_auc', 'roc_auc'])}, place"""


_COLUMNS = ["threshold", *[f"{k}_{s}" for s in ("validation", "test") for k in [*_AT, "pr_auc", "roc_auc"]]]
_BY_BAND = "precision_reject_validation DESC, recall_default_validation DESC, reject_rate_validation"


@query(_summary_sql("fixed", _BY_BAND) + ", row_number() OVER (ORDER BY precision_reject_validation DESC, recall_default_validation DESC, abs(reject_rate_validation - 0.35), list_position(['plain', 'sharp', 'flat'], model)) = 1 AS selected FROM o")
def model_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Every model at the threshold of a fixed reject rate, in order, with the one selected."""
    return _frame(spark, _summary(spark, sf, POLICIES["fixed"]), _COLUMNS)


@query(_summary_sql("band", _BY_BAND) + ", place = 1 AS selected FROM o")
def model_summary_band(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, _summary(spark, sf, POLICIES["band"]), _COLUMNS)


@query(_summary_sql("floor", "best DESC, precision_reject_validation DESC, reject_rate_validation") + ", place = 1 AS selected FROM o")
def model_summary_floor(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, _summary(spark, sf, POLICIES["floor"]), _COLUMNS)


_REVIEW_COLUMNS = ["threshold", *[f"{k}_{s}" for s in ("validation", "test") for k in _MEASURES]]


@query(
    f"""WITH {SCORED}, {_GRID}, {_MODELS}, {_thresholds_sql('v', 'model').replace('ranked AS', 'ranked_v AS').replace('FROM ranked', 'FROM ranked_v')},
held AS (SELECT m.*, chosen.t FROM m JOIN chosen USING (model) WHERE policy = 'review' AND split IN ('validation', 'test')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY round(abs(score - t), 12), _shared_row_id) AS rk, count(*) OVER (PARTITION BY model, split) AS n, count(*) FILTER (target = 1) OVER (PARTITION BY model, split) AS pos FROM held),
c AS (SELECT model, split, t, n, pos, {_CELLS}, count(*) AS auto FROM ranked WHERE rk > least(floor(n * 0.1 + 1e-9), n - 1) GROUP BY ALL),
s AS (SELECT model, t, {', '.join(f"max(CASE WHEN split = '{x}' THEN {v} END) AS {k}_{x}" for x in ('validation', 'test') for k, v in _MEASURES.items())} FROM c GROUP BY ALL),
o AS (SELECT *, row_number() OVER (ORDER BY recall_default_auto_on_total_validation DESC, precision_reject_auto_validation DESC, auto_rate_validation DESC, list_position(['plain', 'sharp', 'flat'], model)) AS place FROM s)
SELECT model AS model_name, round(t, 6) AS threshold, {', '.join(f'round({k}_{x}, 6) AS {k}_{x}' for x in ('validation', 'test') for k in _MEASURES)}, place, place = 1 AS selected FROM o"""
)
def model_summary_review(spark: SparkSession, sf: str) -> DataFrame:
    return _frame(spark, _summary(spark, sf, POLICIES["review"]), _REVIEW_COLUMNS)


@query(f"""WITH {SCORED}, v AS (SELECT * FROM scored WHERE split = 'test'), m AS (SELECT *, row_number() OVER (ORDER BY round(abs(score - 0.45), 12), _shared_row_id) <= floor(count(*) OVER () * 0.1 + 1e-9) AS manual FROM v)
SELECT _shared_row_id, (score >= 0.45)::INT AS y_pred_binary, manual::INT AS is_manual_review, CASE WHEN manual THEN -1 ELSE (score >= 0.45)::INT END AS y_pred_with_manual FROM m""")
def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return policies.with_decisions(_part(spark, sf, "test"), "score", ID, 0.45, 0.1).select(ID, "y_pred_binary", "is_manual_review", "y_pred_with_manual")


@query(None)
def variant_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Variants fitted on the early years, tuned on validation rows and tested on test rows of the later ones."""
    from scoreloom import workflows
    from scoreloom.session import checkpointed

    rows = split_rows(spark, sf).where("issue_year IS NOT NULL")
    early, policy, found = F.col("issue_year") <= 2013, POLICIES["fixed"], []
    train, rest = rows.where(early & (F.col("split") == "train_fit")), rows.where(~early & (F.col("split") != "train_fit"))
    for name, fit in workflows.variants(NUMERIC, CATEGORICAL, "desc_clean", ["logistic_tabular", "logistic_text_fusion", "risk_profiles"]).items():
        add, _ = fit(train)
        found.append(policies.evaluate(checkpointed(add(rest).select(ID, "split", "target", "score")), "score", "target", ID, "split", policy, name))
    return _frame(spark, policies.summary(found, policy), _COLUMNS)


# --- cross-validation -------------------------------------------------------------------------------------


@query(f"""WITH {SCORED}, f AS (SELECT *, ({_RANK} - 1) % 5 AS fold FROM scored WHERE split = 'train_fit'), k AS (SELECT DISTINCT fold AS k FROM f), q AS (SELECT k, quantile_cont(score, 0.65) AS t FROM f, k WHERE fold <> k GROUP BY 1),
c AS (SELECT fold, {_CELLS} FROM f JOIN q ON k = fold GROUP BY 1), b AS (SELECT fold, {_AT_SQL['balanced_accuracy']} AS b FROM c) SELECT count(*) AS folds, round(avg(b), 9) AS mean, round(stddev_pop(b), 9) AS std FROM b""")
def cv_quantile_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated balanced accuracy of a rule: reject the scores above the other folds' quantile."""
    rows = splits.folds(_part(spark, sf, "train_fit"), ID, "target", 5)

    def fit(train: DataFrame):
        cut = scores.reject_thresholds(scores.score_table(train, "score", "target"), [0.35])[0.35]
        return lambda df: df.withColumn("pred", (F.col("score") >= cut).cast("int"))

    cv = features.cross_validated(rows, "fold", 5, "target", fit)
    return cv.select("folds", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(None)
def cv_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated balanced accuracy of the tabular logistic model."""
    rows = splits.folds(split_rows(spark, sf).where("split = 'train_fit'"), ID, "target", 3)

    def fit(train: DataFrame):
        prep = features.Tabular(NUMERIC, CATEGORICAL).fit(train)
        model = features.fit_logistic(prep.transform(train), "features", "target")
        return lambda df: features.probability(model, prep.transform(df)).withColumn("pred", (F.col("score") >= 0.5).cast("int"))

    return features.cross_validated(rows, "fold", 3, "target", fit)


# --- splits and samples ---------------------------------------------------------------------------------------


@query(f"WITH {LOANS}, {_COUNTS}, q AS (SELECT *, ceil(n * 0.25 - 1e-9) AS t FROM n), q2 AS (SELECT *, {_share('t', 'n0', 'n1')} AS t0 FROM q), r AS (SELECT *, {_RANK} AS rk FROM loans) SELECT _shared_row_id, CASE WHEN rk <= CASE target WHEN 0 THEN t0 ELSE t - t0 END THEN 'test' ELSE 'train' END AS split FROM r, q2")
def two_way_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.two_way_split(loans(spark, sf).select(ID, "target"), ID, "target", 0.25).select(ID, "split")


@query(f"""WITH {LOANS}, {_COUNTS}, q AS (SELECT *, ceil(n * 0.2 - 1e-9) AS t FROM n), q2 AS (SELECT *, {_share('t', 'n0', 'n1')} AS t0 FROM q), q3 AS (SELECT *, t - t0 AS t1, n0 - t0 AS r0, n1 - (t - t0) AS r1, ceil((n - t) * 0.2 - 1e-9) AS v FROM q2), q4 AS (SELECT *, {_share('v', 'r0', 'r1')} AS v0 FROM q3),
p AS (SELECT 'full' AS part, n AS rows, n1 AS pos FROM q4 UNION ALL SELECT 'test', t, t1 FROM q4 UNION ALL SELECT 'validation', v, v - v0 FROM q4 UNION ALL SELECT 'train_fit', n - t - v, r1 - (v - v0) FROM q4),
g AS (SELECT *, pos / rows AS rate FROM p), w AS (SELECT max(abs(rate - (SELECT rate FROM g WHERE part = 'full'))) AS gap, max(rate) - min(rate) AS pair FROM g WHERE part <> 'full')
SELECT part, rows::BIGINT AS rows, round(rate, 9) AS positive_rate, round(gap, 9) AS max_gap, round(pair, 9) AS max_pair_gap, gap <= 0.01 AND pair <= 0.01 AS satisfied FROM g, w""")
def split_checked(spark: SparkSession, sf: str) -> DataFrame:
    """The split's summary against a tolerance of its rates."""
    _, s = splits.checked_split(loans(spark, sf).select(ID, "target"), ID, "target", strict=False)
    rows = [(k, s[k]["rows"], round(s[k]["positive_rate"], 9), round(s["best_max_gap_vs_full"], 9), round(s["best_max_pair_gap"], 9), s["rate_match_satisfied"]) for k in ("full", "train_fit", "validation", "test")]
    return spark.createDataFrame(rows, "part string, rows long, positive_rate double, max_gap double, max_pair_gap double, satisfied boolean")


_PERIODS = f"""WITH {LOANS}, old AS (SELECT *, {_RANK} AS rk FROM loans WHERE issue_year BETWEEN 2007 AND 2013), new AS (SELECT * FROM loans WHERE issue_year BETWEEN 2014 AND 2016), c AS (SELECT least(count(*) FILTER (target = 1), 400) AS k FROM old)"""


def _periods(spark: SparkSession, sf: str):
    return splits.balanced_time_split(loans(spark, sf).select(ID, "target", "issue_year"), ID, "target", "issue_year", (2007, 2013), (2014, 2016), 400)


@query(f"{_PERIODS} SELECT _shared_row_id, target, 'train' AS period FROM old, c WHERE rk <= k UNION ALL SELECT _shared_row_id, target, 'test' FROM new")
def time_balanced(spark: SparkSession, sf: str) -> DataFrame:
    train, test, _ = _periods(spark, sf)
    return train.select(ID, "target", F.lit("train").alias("period")).unionByName(test.select(ID, "target", F.lit("test").alias("period")))


@query(f"{_PERIODS} SELECT (SELECT count(*) FROM old) AS train_total_before, (SELECT count(*) FROM old WHERE target = 1) AS train_pos_before, (SELECT count(*) FROM old WHERE target = 0) AS train_neg_before, k AS train_pos_after, k AS train_neg_after, (SELECT count(*) FROM new) AS test_total, (SELECT count(*) FROM new WHERE target = 1) AS test_pos, (SELECT count(*) FROM new WHERE target = 0) AS test_neg FROM c")
def time_balanced_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = _periods(spark, sf)[2]
    return spark.createDataFrame([tuple(s.values())], ", ".join(f"{k} long" for k in s))


@query(f"WITH {LOANS}, {_COUNTS}, r AS (SELECT *, {_RANK} AS rk FROM loans), q AS (SELECT greatest(1, floor(300 * (n1 / n)))::BIGINT AS p FROM n) SELECT _shared_row_id, target FROM r, q WHERE rk <= CASE target WHEN 1 THEN p ELSE greatest(1, 300 - p) END")
def preserve_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return splits.preserve_ratio(loans(spark, sf).select(ID, "target"), ID, "target", 300)


@query(f"WITH {LOANS} SELECT _shared_row_id FROM loans ORDER BY md5('42:' || _shared_row_id::VARCHAR), _shared_row_id LIMIT 250")
def simple_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.first_by_hash(loans(spark, sf).select(ID), ID, 250)


# --- inputs of models ---------------------------------------------------------------------------------------------

_RESERVED = ", ".join(f"'{c}'" for c in [*cleaning.RESERVED, *cleaning.LEAKAGE])


@query(f"SELECT column_name, CASE WHEN column_type IN ('DOUBLE', 'BIGINT', 'INTEGER') THEN 'numeric' ELSE 'categorical' END AS role FROM (DESCRIBE SELECT * FROM accepted_2007_to_2018q4) WHERE column_name NOT IN ({_RESERVED}) AND column_type IN ('DOUBLE', 'BIGINT', 'INTEGER', 'VARCHAR')")
def model_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Roles of the raw table's columns, after those that give the outcome away are dropped."""
    raw = accepted(spark, sf)
    df = cleaning.without_leakage(cleaning.with_year(cleaning.ordered_unique(raw, [*raw.columns, "loan_amnt", "no_such_column"])))
    cleaning.require(df, ["loan_amnt", cleaning.first_present(df, ["desc_clean", "desc"])])
    return spark.createDataFrame([(c, role) for role, names in cleaning.roles(df).items() for c in names], "column_name string, role string")


@query(f"SELECT count(*) AS rows_seen, count(*) FILTER (loan_status IN ('Fully Paid', 'Charged Off')) AS finished, least(count(*) FILTER (loan_status IN ('Fully Paid', 'Charged Off')), 1500) AS rows_kept FROM (SELECT loan_status, row_number() OVER (ORDER BY _shared_row_id) - 1 AS o FROM accepted_2007_to_2018q4) WHERE o < 4000")
def scan_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What a capped scan saw and kept: the caps are its feature."""
    from scoreloom.operators import alignment

    rows = alignment.row_ids(accepted(spark, sf).select(ID, "loan_status"), ID, "_ord")
    done = F.col("loan_status").isin("Fully Paid", "Charged Off")
    _, capped = cleaning.capped_scan(rows, "_ord", done, 1500, 4, 1000)
    _, whole = cleaning.capped_scan(rows, "_ord", done, None, 4, 1000)
    return spark.createDataFrame([(capped["rows_seen"], whole["rows_kept"], capped["rows_kept"])], "rows_seen long, finished long, rows_kept long")


@query("SELECT count(*) FILTER (desc_clean IS NULL OR trim(desc_clean) = '') AS filled, count(*) FILTER (desc_clean IS NULL OR trim(desc_clean) = '' OR desc_clean = 'missing') AS missing FROM shared_split")
def blank_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows, n = cleaning.fill_blank(split_rows(spark, sf), "desc_clean")
    return rows.agg(F.lit(n).cast("long").alias("filled"), F.count_if(F.col("desc_clean") == "missing").alias("missing"))


@query(f"{_PROFILE} SELECT feature, bucket, n, round(bad / n, 6) AS bad_rate, round(risk, 6) AS risk, round(weight, 6) AS weight, row_number() OVER (ORDER BY weight DESC, risk DESC, n DESC, feature, bucket) AS place FROM prof")
def profile_export(spark: SparkSession, sf: str) -> DataFrame:
    """Profile rows in the order of export: weight, risk and rows, falling."""
    from scoreloom.operators import profiles

    rows = profiles.export(_profile(spark, sf)[1])
    return rows.select("feature", "bucket", "n", F.round("bad_rate", 6).alias("bad_rate"), F.round("risk", 6).alias("risk"), F.round("weight", 6).alias("weight"), "place")


@query(
    f"""WITH {LOANS}, raw AS (SELECT 'target_by_year' AS part, coalesce(issue_year::VARCHAR, '') AS item, 'target_rate' AS measure, avg(target) AS value FROM loans GROUP BY 2
    UNION ALL SELECT 'target_by_grade', coalesce(grade, ''), 'target_rate', avg(target) FROM loans GROUP BY 2
    UNION ALL SELECT 'value_counts', 'purpose=' || coalesce(purpose, ''), 'n', count(*) FROM loans GROUP BY 2 UNION ALL SELECT 'value_counts', 'home_ownership=' || coalesce(home_ownership, ''), 'n', count(*) FROM loans GROUP BY 2
    """
    + " ".join(f"UNION ALL SELECT 'numbers', '{c}', u.m, CASE u.m WHEN 'mean' THEN avg(v) WHEN 'min' THEN min(v) WHEN 'p50' THEN quantile_cont(v, 0.5) ELSE max(v) END FROM (SELECT {clean_sql(c)} AS v FROM loans), (SELECT unnest(['mean', 'min', 'p50', 'max']) AS m) u GROUP BY u.m UNION ALL SELECT 'missing', '{c}', 'missing_ratio', count(*) FILTER ({c} IS NULL OR isnan({c})) / count(*) FROM loans" for c in ("loan_amnt", "dti"))
    + ") SELECT part, item, measure, round(value, 6) AS value FROM raw"
)
def eda_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The exploration report as one long table."""
    from scoreloom.operators import summaries

    return summaries.bundle(loans(spark, sf), "target", ["issue_year", "grade"], ["purpose", "home_ownership"], ["loan_amnt", "dti"]).withColumn("value", F.round("value", 6))


# --- responses and generation --------------------------------------------------------------------------------------

_OBJ = "CASE WHEN json_valid(trim(raw)) AND left(trim(raw), 1) = '{' THEN trim(raw) END"


def _parse_sql(source: str) -> str:
    """SQL of action, label, reason and status of responses whose object is the whole text."""
    return f"""o AS (SELECT *, {_OBJ} AS obj FROM {source}), a AS (SELECT *, lower(trim(coalesce(json_extract_string(obj, '$.action'), ''))) AS act, CASE WHEN contains(lower(coalesce(raw, '')), 'reject') THEN 'reject' WHEN contains(lower(coalesce(raw, '')), 'approve') THEN 'approve' END AS said FROM o),
p AS (SELECT *, CASE WHEN act IN ('reject', 'approve') THEN act ELSE coalesce(said, 'approve') END AS action, coalesce(trim(json_extract_string(obj, '$.reason')), '') AS reason,
CASE WHEN act IN ('reject', 'approve') THEN 'ok_json' WHEN said IS NULL THEN 'fallback_default_approve' WHEN obj IS NULL THEN 'fallback_from_text_no_json' ELSE 'fallback_from_text_bad_json_action' END AS status FROM a)"""


def _parsed(df: DataFrame) -> DataFrame:
    return df.withColumn("obj", texts.last_json(F.col("raw"))).withColumn("p", texts.parsed_response(F.col("raw"), F.col("obj"))).drop("obj")


@query(f"WITH {_RESPONSES}, {_parse_sql('r')} SELECT sample_id, pos, action, CASE action WHEN 'reject' THEN 1 ELSE 0 END AS label, status FROM p")
def parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of the chat samples, read as a model's responses."""
    return _parsed(_responses(spark, sf)).select("sample_id", "pos", "p.action", "p.label", "p.status")


_ANSWER = """h AS (SELECT _shared_row_id, target, md5({text}) AS h FROM shared_split WHERE split = 'test'), g AS (SELECT _shared_row_id, target, h, CASE WHEN h[1] < '8' THEN 'reject' ELSE 'approve' END AS said_ FROM h),
r AS (SELECT _shared_row_id, target, CASE WHEN h[2] <= '9' THEN '{{"reason": "Sign ' || h[3:6] || '.", "action": "' || said_ || '"}}' WHEN h[2] = 'a' THEN '{{"action": "hold"}} then ' || said_ WHEN h[2] = 'b' THEN '{{"action": "hold"}}' WHEN h[2] = 'c' THEN upper(said_) || ' it' WHEN h[2] = 'd' THEN 'I would ' || said_ || '.' WHEN h[2] = 'e' THEN '' ELSE 'unsure' END AS raw FROM g)"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_text(spark, sf).where("split = 'test'").select(ID, "target", "input")
    return rows.join(scorers.generate(rows, scorers.StubGenerator("mixed"), "input", ID, "raw"), ID)


# An object before other text is found too; here it is the action 'hold', which counts as a bad action.
_ANSWERED = "WITH " + _ANSWER.format(text=_TEXT) + ", " + _parse_sql("r").replace(_OBJ, "CASE WHEN left(raw, 1) = '{' THEN split_part(raw, '}', 1) || '}' END")


@query(f"{_ANSWERED} SELECT _shared_row_id, action, CASE action WHEN 'reject' THEN 1 ELSE 0 END AS label, reason, status FROM p")
def generated_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts rendered from rows, answered in batches by a generator, and parsed."""
    return _parsed(_answers(spark, sf)).select(ID, "p.action", "p.label", "p.reason", "p.status")


@query(f"{_ANSWERED} SELECT status, count(*) AS n FROM p GROUP BY 1")
def parse_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(_answers(spark, sf)).groupBy(F.col("p.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ANSWERED}, c AS (SELECT count(*) FILTER (action = 'reject' AND target = 1) AS tp, count(*) FILTER (action = 'reject' AND target = 0) AS fp, count(*) FILTER (action <> 'reject' AND target = 0) AS tn, count(*) FILTER (action <> 'reject' AND target = 1) AS fn FROM p) SELECT tp, fp, tn, fn, round({_P}, 9) AS precision, round({_R}, 9) AS recall, round({_Q}, 9) AS reject_rate FROM c")
def llm_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of a language model's decisions, its label taken as the score."""
    rows = _parsed(_answers(spark, sf)).withColumn("pred", F.col("p.label"))
    c = scores.confusion(rows, "target", "pred").withColumns(scores.business_columns())
    return c.select("tp", "fp", "tn", "fn", F.round("bad_rate_in_reject_precision", 9).alias("precision"), F.round("default_capture_recall", 9).alias("recall"), F.round("reject_rate", 9).alias("reject_rate"))


_TWO = f"""WITH s AS (SELECT _shared_row_id, {_TEXT} AS input FROM shared_split WHERE split = 'test'), one AS (SELECT *, 'Sign ' || md5(input)[3:6] || '.' AS reason FROM s), two AS (SELECT *, md5(input || chr(10) || chr(10) || '[Reason]' || chr(10) || reason) AS h FROM one)
SELECT _shared_row_id, reason, CASE WHEN h[1] < '8' THEN 'reject' ELSE 'approve' END AS action, 'ok_json' AS status FROM two"""


@query(_TWO)
def two_stage_inference(spark: SparkSession, sf: str) -> DataFrame:
    """Stage one gives a reason; stage two decides with the reason in its prompt."""
    rows = _feature_text(spark, sf).where("split = 'test'").select(ID, "input")
    first = scorers.generate(rows, scorers.StubGenerator("reason"), "input", ID, "r1")
    reasoned = rows.join(first, ID).withColumn("reason", texts.reason_text(F.col("r1"), texts.last_json(F.col("r1")))).withColumn("prompt", F.concat("input", F.lit("\n\n[Reason]\n"), "reason"))
    second = scorers.generate(reasoned, scorers.StubGenerator("action"), "prompt", ID, "raw")
    return _parsed(reasoned.join(second, ID)).select(ID, "reason", "p.action", "p.status")


_TEACH = f"""WITH s AS (SELECT _shared_row_id, target, desc_clean, {_TEXT} AS input FROM shared_split WHERE split = 'train_fit'), h AS (SELECT *, md5('[Known Label]' || chr(10) || 'action=' || CASE target WHEN 1 THEN 'reject' ELSE 'approve' END || chr(10) || chr(10) || '[Input]' || chr(10) || input) AS h FROM s)
SELECT _shared_row_id, CASE WHEN desc_clean IS NULL OR trim(desc_clean) = '' THEN 'dropped' WHEN (h[1] < '8') = (target = 1) THEN 'kept' ELSE 'dropped' END AS status,
CASE WHEN desc_clean IS NULL OR trim(desc_clean) = '' THEN 'no_text' WHEN (h[1] < '8') = (target = 1) THEN 'ok' ELSE 'label_mismatch' END AS reason FROM h"""


@query(_TEACH)
def teacher_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Teacher responses to labelled prompts, kept where they hold the label; every row with its reason."""
    label = texts.label_action(F.col("target"))
    rows = _feature_text(spark, sf).where("split = 'train_fit'").select(ID, "target", "desc_clean", F.concat(F.lit("[Known Label]\naction="), label, F.lit("\n\n[Input]\n"), "input").alias("prompt"))
    asked = _parsed(rows.join(scorers.generate(rows, scorers.StubGenerator("reason"), "prompt", ID, "raw"), ID))
    blank = F.coalesce(parsing.strip(F.col("desc_clean")) == "", F.lit(True))
    why = F.when(blank, "no_text").when(F.col("p.status") != "ok_json", "bad_json").when(F.col("p.label") != F.col("target"), "label_mismatch").otherwise("ok")
    return asked.select(ID, F.when(why == "ok", "kept").otherwise("dropped").alias("status"), why.alias("reason"))


@query("SELECT _shared_row_id, 'logprob(reject)=' || printf('%.6f', a) || '; logprob(approve)=' || printf('%.6f', b) || '; delta=' || printf('%.6f', a - b) || '; threshold=0.500000' AS audit, CASE WHEN a - b >= 0.5 THEN 'reject' ELSE 'approve' END AS action FROM (SELECT _shared_row_id, -int_rate / 8 AS a, -dti / 8 AS b FROM shared_split WHERE isfinite(int_rate) AND isfinite(dti))")
def logprob_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate log-probabilities (here from two columns), the decision and its audit line."""
    rows = split_rows(spark, sf).where("abs(int_rate) < 1e300 AND abs(dti) < 1e300").select(ID, (-F.col("int_rate") / 8).alias("logprob_reject"), (-F.col("dti") / 8).alias("logprob_approve"))
    return scorers.decide(rows, 0.5).select(ID, texts.logprob_audit(F.col("logprob_reject"), F.col("logprob_approve"), 0.5).alias("audit"), F.col("pred_action").alias("action"))


@query(f"SELECT _shared_row_id, round(1 / (1 + exp(-((('0x' || md5({_WORD.format('desc_clean')})[1:4])::BIGINT - 32768) / 8192.0))), 9) AS prob FROM shared_split WHERE split = 'test'")
def classifier_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax scores of a fine-tuned text classifier; a stub stands where one would be loaded."""
    rows = split_rows(spark, sf).where("split = 'test'").select(ID, texts.value_text(F.col("desc_clean"), False).alias("t"))
    return scorers.classify(rows, scorers.StubClassifier(), "t", ID).select(ID, F.round("prob", 9).alias("prob"))
