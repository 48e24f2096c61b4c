"""Queries of profiles, measures, thresholds, reports, texts, features and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom import scorers
from scoreloom.functions import parsing, registry, texts
from scoreloom.operators import features, profiles, reports, scores, splits, thresholds
from scoreloom.plans.data_queries import CLEAN
from scoreloom.plans.tables import CATEGORICAL, NUMERIC, SCORED, accepted, clean_sql, scored, split_rows, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ID = "_shared_row_id"
PROFILED = ["int_rate", "dti", "annual_inc", "pub_rec"]
GROUPED = ["grade", "purpose", "home_ownership"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- risk profiles ---------------------------------------------------------------------------------


def _edges_sql(c: str) -> str:
    q = f"(SELECT least(8, count(DISTINCT v)) FROM v_{c})"
    return f"SELECT '{c}' AS feature, list(DISTINCT e ORDER BY e) AS e FROM (SELECT quantile_cont(v, k / {q}) AS e FROM v_{c}, range(0, 9) u(k) WHERE k <= {q} GROUP BY k)"


_VALUES = ", ".join(f"v_{c} AS (SELECT {clean_sql(c)} AS v FROM shared_split WHERE split = 'train_fit' AND {clean_sql(c)} IS NOT NULL)" for c in PROFILED)


# DuckDB needs a constant quantile, so edges come from ranks.
def _edges_by_rank(c: str) -> str:
    return f"""e_{c} AS (SELECT '{c}' AS feature, list_sort(list_distinct(list(e))) AS e FROM (
      SELECT k, max(CASE WHEN rn = floor(pos) THEN v END) + (max(CASE WHEN rn = ceil(pos) THEN v END) - max(CASE WHEN rn = floor(pos) THEN v END)) * (max(pos) - floor(max(pos))) AS e FROM (
        SELECT s.v, s.rn, u.k, u.k / q.q * (q.n - 1) AS pos FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rn FROM v_{c}) s,
          (SELECT least(8, count(DISTINCT v))::DOUBLE AS q, count(*)::DOUBLE AS n FROM v_{c}) q, range(0, 9) u(k) WHERE u.k <= q.q) WHERE rn IN (floor(pos), ceil(pos)) GROUP BY k))"""


_EDGES = f"{_VALUES}, " + ", ".join(map(_edges_by_rank, PROFILED)) + ", edges AS (" + " UNION ALL ".join(f"SELECT feature, e[2:len(e) - 1] AS edges FROM e_{c}" for c in PROFILED) + ")"


@query(f"WITH {_EDGES} SELECT feature, list_transform(edges, lambda x: round(x, 6)) AS edges FROM edges")
def quantile_edges(spark: SparkSession, sf: str) -> DataFrame:
    found = profiles.quantile_edges(split_rows(spark, sf).where("split = 'train_fit'"), PROFILED)
    return found.select("feature", F.transform("edges", lambda x: F.round(x, 6)).alias("edges"))


def _bucket_sql(c: str) -> str:
    if c in PROFILED:
        return f"CASE WHEN {clean_sql(c)} IS NULL THEN '__MISSING__' ELSE len(list_filter((SELECT edges FROM edges WHERE feature = '{c}'), lambda x: x < {c}))::VARCHAR END"
    return f"CASE WHEN {c} IS NULL OR {c} IN ('', 'nan') THEN '__MISSING__' ELSE {c} END"


_LONG = " UNION ALL ".join(f"SELECT _shared_row_id, split, target, '{c}' AS feature, '{'numeric' if c in PROFILED else 'categorical'}' AS feature_type, {_bucket_sql(c)} AS bucket FROM shared_split" for c in [*PROFILED, *GROUPED])
_PROFILE = f"""WITH {_EDGES}, long AS ({_LONG}), g AS (SELECT avg(target) AS rate FROM shared_split WHERE split = 'train_fit'),
counts AS (SELECT feature, feature_type, bucket, count(*) AS n, sum(target) AS bad FROM long WHERE split = 'train_fit' GROUP BY 1, 2, 3),
folded AS (SELECT feature, feature_type, CASE WHEN n < 30 THEN '__OTHER__' ELSE bucket END AS bucket, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM counts GROUP BY 1, 2, 3),
risks AS (SELECT *, (bad + 20 * rate) / (n + 20) AS risk, rate FROM folded, g),
prof AS (SELECT feature, feature_type, bucket, n, bad, risk, greatest(max(risk) OVER w - min(risk) OVER w, 1e-6) AS weight, coalesce(max(CASE WHEN bucket = '__OTHER__' THEN risk END) OVER w, rate) AS default_risk FROM risks WINDOW w AS (PARTITION BY feature))"""
_ROUNDED = "feature, feature_type, bucket, n, bad, round(risk, 6) AS risk, round(weight, 6) AS weight, round(default_risk, 6) AS default_risk"


def _profile(spark: SparkSession, sf: str):
    train = split_rows(spark, sf).where("split = 'train_fit'")
    edges = profiles.edges_of(train, PROFILED)
    return edges, profiles.build(train, "target", edges, GROUPED, least=30)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"{_PROFILE} SELECT {_ROUNDED} FROM prof WHERE feature_type = 'numeric'")
def numeric_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_profile(spark, sf)[1].where("feature_type = 'numeric'"), "risk", "weight", "default_risk")


@query(f"{_PROFILE} SELECT {_ROUNDED} FROM prof WHERE feature_type = 'categorical'")
def categorical_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_profile(spark, sf)[1].where("feature_type = 'categorical'"), "risk", "weight", "default_risk")


_SCORE = f"""{_PROFILE}, weights AS (SELECT DISTINCT feature, weight, default_risk FROM prof),
cells AS (SELECT l._shared_row_id, l.feature, w.weight, coalesce(p.risk, w.default_risk) AS risk FROM long l JOIN weights w USING (feature) LEFT JOIN prof p ON p.feature = l.feature AND p.bucket = l.bucket WHERE l.split IN ('validation', 'test')),
profiled AS (SELECT _shared_row_id, sum(weight * risk) / sum(weight) AS score FROM cells GROUP BY 1)"""


def _scored_by_profile(spark: SparkSession, sf: str, contributions: bool = False) -> DataFrame:
    edges, prof = _profile(spark, sf)
    return profiles.score(split_rows(spark, sf).where("split IN ('validation', 'test')"), prof, edges, GROUPED, contributions=contributions)


@query(f"{_SCORE} SELECT _shared_row_id, round(score, 6) AS score FROM profiled")
def profile_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored_by_profile(spark, sf).select(ID, F.round("score", 6).alias("score"))


@query(f"{_SCORE} SELECT _shared_row_id, " + ", ".join(f"round(max(CASE WHEN feature = '{c}' THEN risk END), 6) AS risk_{c}" for c in [*PROFILED, *GROUPED]) + " FROM cells GROUP BY 1")
def profile_contrib(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"risk_{c}" for c in [*PROFILED, *GROUPED]]
    return _scored_by_profile(spark, sf, True).select(ID, *[F.round(n, 6).alias(n) for n in names])


def _curve(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


def _curve_sql(source: str, with_: str, rates: list[float]) -> str:
    q = " UNION ALL ".join(f"SELECT {r} AS rr, quantile_cont(score, {1 - r!r}) AS t FROM {source} WHERE split = 'validation'" for r in rates)
    m = lambda s: f"count(*) FILTER (split = '{s}' AND score >= t) AS {s}_rej, count(*) FILTER (split = '{s}' AND score >= t AND target = 1) AS {s}_tp, count(*) FILTER (split = '{s}') AS {s}_n, count(*) FILTER (split = '{s}' AND target = 1) AS {s}_p"
    z = lambda a, b: f"round(coalesce(({a}) / nullif({b}, 0), 0), 6)"
    return f"""{with_}, q AS ({q}), c AS (SELECT rr, t, {m('validation')}, {m('test')} FROM {source}, q GROUP BY rr, t)
SELECT round(rr, 6) AS target_reject_rate, round(t, 6) AS threshold_from_validation, {z('validation_rej', 'validation_n')} AS validation_reject_rate, {z('validation_tp', 'validation_rej')} AS validation_precision, {z('validation_tp', 'validation_p')} AS validation_recall,
{z('test_rej', 'test_n')} AS test_reject_rate, {z('test_tp', 'test_rej')} AS test_precision, {z('test_tp', 'test_p')} AS test_recall, {z('test_p - test_tp', 'test_n - test_rej')} AS test_approval_bad_rate, round(coalesce(test_tp / nullif(test_rej, 0), 0) / rr, 6) AS test_lift FROM c"""


RATES = [i / 100 for i in range(5, 51, 5)]


@query(_curve_sql("both_", f"{_SCORE}, both_ AS (SELECT s.split, s.target, round(p.score, 9) AS score FROM profiled p JOIN shared_split s USING (_shared_row_id))", RATES))
def gains_curve(spark: SparkSession, sf: str) -> DataFrame:
    rows = _scored_by_profile(spark, sf).withColumn("score", F.round("score", 9))
    return _curve(scores.gains_curve(rows, "score", "target", "split", RATES))


@query(_curve_sql("scored", f"WITH {SCORED}", [0.1, 0.2, 0.35, 0.5]))
def rr_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _curve(scores.gains_curve(scored(spark, sf), "score", "target", "split", [0.1, 0.2, 0.35, 0.5]))


# --- measures ---------------------------------------------------------------------------------------

_CONFUSION = f"WITH {SCORED}, c AS (SELECT split, count(*) FILTER (target = 1 AND score >= 0.5) AS tp, count(*) FILTER (target = 0 AND score >= 0.5) AS fp, count(*) FILTER (target = 0 AND score < 0.5) AS tn, count(*) FILTER (target = 1 AND score < 0.5) AS fn FROM scored GROUP BY 1)"


def _confusion(spark: SparkSession, sf: str) -> DataFrame:
    return scores.confusion(scored(spark, sf).withColumn("pred", (F.col("score") >= 0.5).cast("int")), "target", "pred", ["split"])


@query(f"{_CONFUSION} SELECT *, coalesce((tp + fp) / nullif(tp + fp + tn + fn, 0), 0) AS reject_rate, coalesce((tn + fn) / nullif(tp + fp + tn + fn, 0), 0) AS approve_rate, coalesce(tp / nullif(tp + fn, 0), 0) AS default_capture_recall, coalesce(tp / nullif(tp + fp, 0), 0) AS bad_rate_in_reject_precision, coalesce(fn / nullif(tn + fn, 0), 0) AS bad_rate_in_approve FROM c")
def business_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _confusion(spark, sf).withColumns(scores.business_columns())


@query(f"{_CONFUSION} SELECT split, round((tp + tn) / (tp + fp + tn + fn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)), 9) AS balanced_accuracy FROM c")
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = _confusion(spark, sf).select("split", *[v.alias(k) for k, v in scores.classification_columns().items()])
    return c.select("split", *[F.round(k, 9).alias(k) for k in scores.classification_columns()])


_RANKED = f"""WITH {SCORED}, g AS (SELECT split, score, count(*) AS n, sum(target) AS pos FROM scored GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY split ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY split ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY split) AS nn, sum(pos) OVER (PARTITION BY split) AS pp FROM g)"""


@query(f"{_RANKED} SELECT split, round(sum(pos * cp / cn) / max(pp), 6) AS pr_auc FROM r GROUP BY 1")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    m = scores.ranking_metrics(scores.score_table(scored(spark, sf), "score", "target", ["split"]), ["split"])
    return m.select("split", F.round("pr_auc", 6).alias("pr_auc"))


@query(f"{_RANKED} SELECT split, round(sum((n - pos) * (cp - pos / 2)) / (max(pp) * (max(nn) - max(pp))), 6) AS roc_auc FROM r GROUP BY 1")
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    m = scores.ranking_metrics(scores.score_table(scored(spark, sf), "score", "target", ["split"]), ["split"])
    return m.select("split", F.round("roc_auc", 6).alias("roc_auc"))


@query(f"WITH {SCORED} SELECT _shared_row_id, round(1 / (1 + exp(-(score * 4 - 1))), 6) AS prob FROM scored")
def prob_range(spark: SparkSession, sf: str) -> DataFrame:
    wide = scored(spark, sf).withColumn("raw", F.col("score") * 4 - 1)
    return scores.in_unit_range(wide, "raw", "prob").select(ID, F.round("prob", 6).alias("prob"))


# --- thresholds -------------------------------------------------------------------------------------


def _validation(spark: SparkSession, sf: str) -> DataFrame:
    return scores.score_table(scored(spark, sf).where("split = 'validation'"), "score", "target")


@query(f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT {r} AS target_reject_rate, round(t, 9) AS threshold, (SELECT count(*) FILTER (score >= t) / count(*) FROM scored WHERE split = 'validation') AS actual_reject_rate FROM (SELECT quantile_cont(score, {1 - r!r}) AS t FROM scored WHERE split = 'validation')" for r in (0.1, 0.35)))
def threshold_fixed_rr(spark: SparkSession, sf: str) -> DataFrame:
    t = _validation(spark, sf)
    cuts = scores.reject_thresholds(t, [0.1, 0.35])
    at = {r.threshold: (r.tp + r.fp) / max(r.tp + r.fp + r.tn + r.fn, 1) for r in scores.at_thresholds(t, list(cuts.values())).collect()}
    return spark.createDataFrame([(r, round(c, 9), at[c]) for r, c in cuts.items()], "target_reject_rate double, threshold double, actual_reject_rate double")


@query(f"""WITH {SCORED}, q AS (SELECT quantile_cont(score, 0.65) AS t FROM scored WHERE split = 'validation'), c AS (SELECT count(*) FILTER (score >= t AND target = 1) AS tp, count(*) FILTER (score >= t) AS rej, count(*) FILTER (target = 1) AS p, count(*) AS n FROM scored, q WHERE split = 'test')
SELECT round(rej / n, 6) AS actual_reject_rate, round(tp / rej, 6) AS precision_at_target, round(tp / p, 6) AS recall_at_target, round((p - tp) / (n - rej), 6) AS approval_bad_rate, round(tp / rej / 0.35, 6) AS lift_vs_target_rr, round(tp / rej / (p / n), 6) AS lift_vs_base_rate FROM c""")
def evaluate_fixed_rr(spark: SparkSession, sf: str) -> DataFrame:
    return _curve(reports.fixed_rate(scored(spark, sf), "score", "target", "split", 0.35))


@query(f"WITH {SCORED} SELECT round(t, 9) AS threshold, count(*) FILTER (score >= t AND target = 1) AS tp, count(*) FILTER (score >= t AND target = 0) AS fp, count(*) FILTER (score < t AND target = 0) AS tn, count(*) FILTER (score < t AND target = 1) AS fn FROM scored, (SELECT 0.01 + i * (0.98 / 196) AS t FROM range(0, 197) u(i)) WHERE split = 'validation' GROUP BY t")
def threshold_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scores.at_thresholds(_validation(spark, sf), thresholds.FINE).withColumn("threshold", F.round("threshold", 9))


_SCAN = f"""WITH {SCORED}, c AS (SELECT t, count(*) FILTER (score >= t AND target = 1) AS tp, count(*) FILTER (score >= t AND target = 0) AS fp, count(*) FILTER (score < t AND target = 0) AS tn, count(*) FILTER (score < t AND target = 1) AS fn FROM scored, (SELECT 0.05 + i * (0.90 / 180) AS t FROM range(0, 181) u(i)) WHERE split = 'validation' GROUP BY t)"""


@query(f"{_SCAN} SELECT round(t, 9) AS threshold, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS score FROM c ORDER BY coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) DESC, t LIMIT 1")
def threshold_f1(spark: SparkSession, sf: str) -> DataFrame:
    best = thresholds.best_by(thresholds.points(_validation(spark, sf), thresholds.SCAN), "f1")
    return spark.createDataFrame([(round(best["threshold"], 9), round(best["score"], 6))], "threshold double, score double")


@query(f"{_SCAN} SELECT round(t, 9) AS threshold, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS score FROM c ORDER BY (tp / (tp + fn) + tn / (tn + fp)) / 2 DESC, t LIMIT 1")
def threshold_balanced(spark: SparkSession, sf: str) -> DataFrame:
    best = thresholds.best_by(thresholds.points(_validation(spark, sf), thresholds.SCAN))
    return spark.createDataFrame([(round(best["threshold"], 9), round(best["score"], 6))], "threshold double, score double")


_PERCENTILES = "[" + ", ".join(repr(0.01 + i * (0.98 / 98)) for i in range(99)) + "]"
_BUSINESS = f"""WITH {SCORED}, v AS (SELECT * FROM scored WHERE split = 'validation'), cuts AS (SELECT 0.01 + i * (0.98 / 196) AS t FROM range(0, 197) u(i) UNION SELECT unnest(quantile_cont(score, {_PERCENTILES})) FROM v),
c AS (SELECT t, count(*) FILTER (score >= t AND target = 1) AS tp, count(*) FILTER (score >= t) AS rej, count(*) FILTER (target = 1) AS pos, count(*) AS n FROM v, cuts GROUP BY t),
p AS (SELECT t, coalesce(tp / nullif(rej, 0), 0) AS p, coalesce(tp / nullif(pos, 0), 0) AS r, rej / n AS rr FROM c WHERE rej / n BETWEEN 0.2 AND 0.5)"""


@query(f"""{_BUSINESS} SELECT * FROM (SELECT 'band' AS policy, round(t, 9) AS threshold, round(p, 9) AS score, true AS satisfied, NULL AS fallback FROM p ORDER BY p DESC, r DESC, abs(rr - 0.35), rr, t DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'floor_unmet', round(t, 9), round(p, 9), false, 'without_precision_floor' FROM p ORDER BY p DESC, r DESC, abs(rr - 0.35), rr, t DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'recall', round(t, 9), round(r, 9), true, NULL FROM p WHERE p >= 0.2 ORDER BY r DESC, p DESC, abs(rr - 0.35), rr, t DESC LIMIT 1)""")
def threshold_business(spark: SparkSession, sf: str) -> DataFrame:
    t = _validation(spark, sf)
    found, scan = thresholds.points(t, thresholds.business_grid(t)), thresholds.points(t, thresholds.SCAN)
    rows = []
    for name, args in {"band": {}, "floor_unmet": {"precision_floor": 0.99}, "recall": {"objective": "recall_at_precision_floor", "precision_floor": 0.2}}.items():
        b = thresholds.best_business(found, scan, low=0.2, high=0.5, target=0.35, **args)
        rows.append((name, round(float(b["threshold"]), 9), round(float(b["score"]), 9), bool(b["satisfied"]), b["fallback"]))
    return spark.createDataFrame(rows, "policy string, threshold double, score double, satisfied boolean, fallback string")


@query(f"""WITH {SCORED}, v AS (SELECT * FROM scored WHERE split = 'test'), m AS (SELECT *, row_number() OVER (ORDER BY round(abs(score - 0.45), 12), _shared_row_id) <= floor(count(*) OVER () * 0.1) AS manual FROM v)
SELECT count(*) FILTER (manual) AS n_manual, count(*) FILTER (NOT manual) AS n_auto, count(*) FILTER (NOT manual AND score >= 0.45 AND target = 1) AS tp_auto, count(*) FILTER (NOT manual AND score >= 0.45 AND target = 0) AS fp_auto, count(*) FILTER (NOT manual AND score < 0.45 AND target = 1) AS fn_auto, count(*) FILTER (target = 1) AS positives FROM m""")
def manual_policy(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores.uncertain(scored(spark, sf).where("split = 'test'"), "score", ID, 0.45, 0.1)
    auto, over, bad = ~F.col("manual"), F.col("score") >= 0.45, F.col("target") == 1
    return rows.agg(F.count_if("manual").alias("n_manual"), F.count_if(auto).alias("n_auto"), F.count_if(auto & over & bad).alias("tp_auto"), F.count_if(auto & over & ~bad).alias("fp_auto"), F.count_if(auto & ~over & bad).alias("fn_auto"), F.count_if(bad).alias("positives"))


@query(f"WITH {SCORED}, v AS (SELECT * FROM scored WHERE split = 'test') SELECT _shared_row_id, row_number() OVER (ORDER BY score DESC, _shared_row_id) <= floor(count(*) OVER () * 0.35) AS rejected FROM v")
def exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return scores.exact_top(scored(spark, sf).where("split = 'test'"), "score", ID, 0.35).select(ID, "rejected")


# --- reports ----------------------------------------------------------------------------------------

_GAP = f"WITH {SCORED}, g AS (SELECT issue_year, count(*) FILTER (score >= 0.45) / count(*) AS actual_reject_rate, count(*) AS n FROM scored GROUP BY 1)"


@query(f"{_GAP} SELECT issue_year, n, round(actual_reject_rate, 9) AS actual_reject_rate, round(actual_reject_rate - 0.35, 9) AS gap, CASE WHEN round(abs(actual_reject_rate - 0.35), 9) <= 0.01 THEN 'stable' WHEN round(abs(actual_reject_rate - 0.35), 9) <= 0.03 THEN 'warn' ELSE 'recalibrate' END AS state FROM g")
def rr_gap_monitor(spark: SparkSession, sf: str) -> DataFrame:
    return reports.rate_gaps(scored(spark, sf), "score", "issue_year", 0.45, 0.35)


@query(f"{_CONFUSION} SELECT split, tp * 1000 / (tp + fp + tn + fn) AS tp_per_1000, fn * 1000 / (tp + fp + tn + fn) AS fn_per_1000, fp * 1000 / (tp + fp + tn + fn) AS fp_per_1000 FROM c")
def per_1000(spark: SparkSession, sf: str) -> DataFrame:
    return reports.per_thousand(_confusion(spark, sf)).select("split", "tp_per_1000", "fn_per_1000", "fp_per_1000")


def _board(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).select("split", "target", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(s, 4).alias("score")) for m, s in (("plain", F.col("score")), ("sharp", F.col("score") * F.col("score")), ("flat", F.floor(F.col("score") * 10) / 10))])).alias("m")).select("split", "target", "m.*")
    return reports.leaderboard(rows, "model", "score", "target", "split", 0.35)


_MODELS = f"""WITH {SCORED}, m AS (SELECT split, target, 'plain' AS model, round(score, 4) AS score FROM scored UNION ALL SELECT split, target, 'sharp', round(score * score, 4) FROM scored UNION ALL SELECT split, target, 'flat', round(floor(score * 10) / 10, 4) FROM scored),
q AS (SELECT model, quantile_cont(score, 0.65) AS t FROM m WHERE split = 'validation' GROUP BY 1),
c AS (SELECT model, t, count(*) AS n, count(*) FILTER (score >= t) AS rej, count(*) FILTER (score >= t AND target = 1) AS tp, count(*) FILTER (target = 1) AS p FROM m JOIN q USING (model) WHERE split = 'test' GROUP BY 1, 2),
b AS (SELECT model, round(t, 9) AS threshold, round(rej / n, 9) AS reject_rate, round(tp / rej, 9) AS precision, round(tp / p, 9) AS recall, round(abs(rej / n - 0.35), 9) AS rr_gap FROM c)"""


@query(f"{_MODELS} SELECT model, threshold, reject_rate, precision, recall, rr_gap, row_number() OVER (ORDER BY precision DESC, recall DESC, rr_gap, model) AS place FROM b")
def model_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return _board(spark, sf)


@query(f"{_MODELS} SELECT model, rr_gap, CASE WHEN rr_gap <= 0.03 THEN 'main' ELSE 'extended' END AS board FROM b")
def board_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    return reports.boards(_board(spark, sf)).select("model", "rr_gap", "board")


@query(None)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).where("split = 'test'").withColumn("pred", (F.col("score") >= 0.45).cast("int"))
    return reports.confidence(rows, "target", "pred", 1000)


# --- texts --------------------------------------------------------------------------------------------


def _fields(df: DataFrame, names: list[str]):
    return [(n, F.coalesce(F.col(n).cast("bigint").cast("string"), F.lit("missing")) if n in NUMERIC else texts.value_text(F.col(n), False)) for n in names]


_WORD = "CASE WHEN {0} IS NULL OR trim({0}) = '' THEN 'missing' ELSE trim({0}) END"
_INT = "coalesce(trunc({0})::BIGINT::VARCHAR, 'missing')"
_TEXT = "'[Structured Risk Features]' || chr(10) || 'loan_amnt: ' || {a} || chr(10) || 'total_acc: ' || {b} || chr(10) || 'grade: ' || {c} || chr(10) || 'purpose: ' || {d} || chr(10) || chr(10) || '[Borrower Description]' || chr(10) || {e}".format(a=_INT.format("loan_amnt"), b=_INT.format("total_acc"), c=_WORD.format("grade"), d=_WORD.format("purpose"), e=_WORD.format("desc_clean"))


def _feature_text(spark: SparkSession, sf: str) -> DataFrame:
    df = split_rows(spark, sf)
    return df.select(ID, "target", "split", "loan_amnt", "grade", "purpose", "desc_clean", texts.feature_text(_fields(df, ["loan_amnt", "total_acc", "grade", "purpose"]), F.col("desc_clean")).alias("input"))


@query(f"SELECT _shared_row_id, {_TEXT} AS input FROM shared_split WHERE total_acc IS NULL OR NOT isnan(total_acc)")
def feature_text(spark: SparkSession, sf: str) -> DataFrame:
    return _feature_text(spark, sf).select(ID, "input")


@query(f"SELECT _shared_row_id, {_INT.format('loan_amnt')} AS loan_amnt, {_WORD.format('grade')} AS grade, {_WORD.format('purpose')} AS purpose, CASE WHEN {_WORD.format('desc_clean')} = 'null' THEN '' ELSE {_WORD.format('desc_clean')} END AS description FROM shared_split")
def parse_feature_text(spark: SparkSession, sf: str) -> DataFrame:
    back = _feature_text(spark, sf).withColumn("p", texts.parse_feature_text(F.col("input")))
    return back.select(ID, *[F.col("p.features")[k].alias(k) for k in ("loan_amnt", "grade", "purpose")], F.col("p.description").alias("description"))


_TRIMMED = r"regexp_replace({0}, '^[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{3000}}\x{{0085}}]+|[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{3000}}\x{{0085}}]+$', '', 'g')"
_SAID = lambda c: f"coalesce(nullif({_TRIMMED.format(c)}, ''), 'missing')"
_NUMBER = lambda c, style: f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 'missing' ELSE format('{{:{style}}}', {c}) END"


@query("SELECT _shared_row_id, '[Structured Risk Features]' || chr(10) || " + " || chr(10) || ".join([f"'{c}: ' || {_NUMBER(c, '.6g')}" for c in NUMERIC] + [f"'{c}: ' || {_SAID(c)}" for c in CATEGORICAL]) + f" || chr(10) || chr(10) || '[Borrower Description]' || chr(10) || {_SAID('desc_clean')} AS input FROM shared_split")
def feature_text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    df = split_rows(spark, sf)
    cells = [(n, texts.value_text(F.col(n), True)) for n in NUMERIC] + [(n, texts.value_text(F.col(n), False)) for n in CATEGORICAL]
    return df.select(ID, texts.feature_text(cells, F.col("desc_clean")).alias("input"))


# Sections and labels of the profile text: its format, word for word (fixed values).
SECTIONS = [
    ("Loan Application Profile", [("Loan amount", "loan_amnt"), ("Term", "term"), ("Interest rate", "int_rate"), ("Installment", "installment"), ("Purpose", "purpose"), ("Application type", "application_type")]),
    ("Borrower Background", [("Annual income", "annual_inc"), ("Employment length", "emp_length"), ("Home ownership", "home_ownership"), ("Income verification", "verification_status"), ("State", "addr_state")]),
    ("Credit And Liability Snapshot", [("DTI", "dti"), ("FICO low", "fico_range_low"), ("FICO high", "fico_range_high"), ("Revolving balance", "revol_bal"), ("Revolving utilization", "revol_util"), ("Open accounts", "open_acc"), ("Public records", "pub_rec"), ("Total accounts", "total_acc"), ("Grade", "grade"), ("Sub grade", "sub_grade")]),
]
_WORDED = ["term", "purpose", "application_type", "emp_length", "home_ownership", "verification_status", "addr_state", "grade", "sub_grade"]
_SECTION_SQL = " || ".join(f"'[{title}]' || chr(10) || " + " || ".join(f"'{label}: ' || {_SAID(c) if c in _WORDED else _NUMBER(c, '.4f')} || chr(10)" for label, c in fields) + " || chr(10)" for title, fields in SECTIONS)


@query(f"WITH d AS (SELECT *, coalesce({CLEAN}, '') AS cleaned FROM accepted_2007_to_2018q4) SELECT _shared_row_id, {_SECTION_SQL} || '[Borrower Description]' || chr(10) || CASE WHEN cleaned IN ('', 'nan') THEN 'missing' ELSE cleaned END || chr(10) AS profile FROM d")
def profile_text(spark: SparkSession, sf: str) -> DataFrame:
    sections = [(title, [(label, texts.value_text(F.col(c), c not in _WORDED, "f")) for label, c in fields]) for title, fields in SECTIONS]
    return accepted(spark, sf).select(ID, texts.profile_text(sections, texts.clean_text(F.col("`desc`"))).alias("profile"))


@query("SELECT _shared_row_id, CASE WHEN int_rate IS NULL OR isnan(int_rate) THEN 'N/A' ELSE format('{:.1f}', int_rate) || '%' END AS rate, CASE WHEN dti IS NULL OR isnan(dti) THEN 'N/A' WHEN dti = floor(dti) THEN format('{:.0f}', dti) ELSE format('{:.2f}', dti) END AS dti FROM shared_split")
def number_texts(spark: SparkSession, sf: str) -> DataFrame:
    df = split_rows(spark, sf)
    return df.select(ID, texts.percent_text(parsing.null_if_nan(F.col("int_rate"))).alias("rate"), texts.number_text(parsing.null_if_nan(F.col("dti"))).alias("dti"))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers of the chat samples, with the label their row has."""
    chat = table(spark, sf, "credit_teacher_action_0_1pct").select("sample_id", ID, F.posexplode("conversations").alias("pos", "turn"))
    return chat.where("lower(turn.from) IN ('gpt', 'assistant')").select("sample_id", "pos", F.col("turn.value").alias("raw"))


_RESPONSES = """r AS (SELECT sample_id, i - 1 AS pos, conversations[i].value AS raw FROM credit_teacher_action_0_1pct, range(1, 50) u(i) WHERE i <= len(conversations) AND lower(conversations[i]['from']) IN ('gpt', 'assistant'))"""


@query(f"WITH {_RESPONSES} SELECT sample_id, pos, nullif(trim(regexp_extract(raw, '(?is)<think>(.*?)</think>', 1), ' \n\t\r'), '') AS think FROM r")
def think_block(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(spark, sf).select("sample_id", "pos", texts.think_block(F.col("raw")).alias("think"))


_ACTION = "CASE WHEN ja IN ('reject', 'approve') THEN {j} WHEN rp > 0 AND ap > 0 AND rp <= ap THEN {a} WHEN rp > 0 AND ap > 0 THEN {b} WHEN rp > 0 THEN {c} WHEN ap > 0 THEN {d} ELSE {e} END"


@query(
    f"WITH {_RESPONSES}, j AS (SELECT *, coalesce(lower(trim(CASE WHEN json_valid(trim(raw)) AND left(trim(raw), 1) = '{{' THEN json_extract_string(raw, '$.action') END)), '') AS ja, coalesce(position('reject' IN lower(raw)), 0) AS rp, coalesce(position('approve' IN lower(raw)), 0) AS ap FROM r) SELECT sample_id, pos, "
    + _ACTION.format(j="ja", a="'reject'", b="'approve'", c="'reject'", d="'approve'", e="'approve'")
    + " AS action, "
    + _ACTION.format(j="'json_action'", a="'text_both_first_reject'", b="'text_both_first_approve'", c="'text_reject'", d="'text_approve'", e="'fallback_default_approve'")
    + " AS status FROM j"
)
def extract_action(spark: SparkSession, sf: str) -> DataFrame:
    r = _responses(spark, sf).withColumn("obj", texts.last_json(F.col("raw")))
    return r.select("sample_id", "pos", texts.action_and_status(F.col("raw"), F.col("obj")).alias("a")).select("sample_id", "pos", "a.action", "a.status")


@query("SELECT _shared_row_id, CASE WHEN int_rate >= 18.5 THEN 'high' WHEN int_rate < 11 THEN 'low' ELSE 'unknown' END AS level FROM shared_split WHERE int_rate IS NOT NULL AND NOT isnan(int_rate)")
def risk_level(spark: SparkSession, sf: str) -> DataFrame:
    """Levels read from a sentence about each row, with its description before it."""
    rate = F.col("int_rate")
    said = F.when(rate >= 18.5, F.when(F.col("target") == 1, "Risk: HIGH at this rate").otherwise("a high risk")).when(rate < 11, F.when(F.col("target") == 1, '{"risk": "low"}').otherwise("Low risk.")).otherwise("no word of it")
    rows = split_rows(spark, sf).where("int_rate IS NOT NULL AND NOT isnan(int_rate)")
    return rows.select(ID, texts.risk_level(F.concat_ws(" ", "desc_clean", said)).alias("level"))


_TAUGHT = """h AS (SELECT _shared_row_id, target, trim(coalesce(desc_clean, '')) AS d, md5(coalesce(desc_clean, ''))[1] AS k FROM shared_split)"""


def _teacher(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with the row's description as their thinking; its md5 says how they go on."""
    d = F.coalesce("desc_clean", F.lit(""))
    k, think = F.substring(F.md5(d), 1, 1), F.concat(F.lit("<think> "), d, F.lit("</think>"))
    answer = (
        F.when(k < "2", '{"decision":"reject","reasons":["x"]}')
        .when(k == "2", F.concat(think, F.lit(" no object")))
        .when(k == "3", F.concat(think, F.lit('{"decision":"hold"}')))
        .when(k < "8", F.concat(think, F.lit('{"decision":"reject","reasons":["a"]}')))
        .when(k < "a", F.concat(think, F.lit('{"decision":"approve","reasons":[]}')))
        .otherwise(F.concat(think, F.lit('```json\n{"decision":"approve","reasons":["b"],"n":{"m":1}}\n```')))
    )
    return split_rows(spark, sf).select(ID, "target", answer.alias("raw")).withColumn("obj", texts.last_json(F.col("raw")))


@query(f"""WITH {_TAUGHT} SELECT _shared_row_id, CASE WHEN k < '2' OR d = '' THEN 'missing_think' WHEN k = '2' THEN 'missing_or_bad_json' WHEN k = '3' THEN 'bad_decision' WHEN (k < '8') <> (target = 1) THEN 'label_mismatch' WHEN k IN ('8', '9') THEN 'missing_reasons' ELSE 'ok' END AS reason,
CASE WHEN k >= '2' THEN nullif(d, '') END AS think FROM h""")
def validate_teacher(spark: SparkSession, sf: str) -> DataFrame:
    return _teacher(spark, sf).select(ID, texts.teacher_check(F.col("raw"), F.col("obj"), F.col("target")).alias("c"), texts.think_block(F.col("raw")).alias("think")).select(ID, "c.reason", "think")


@query(f"WITH {_TAUGHT} SELECT _shared_row_id, CASE WHEN k < '2' OR k BETWEEN '4' AND '7' THEN 1 WHEN k IN ('2', '3') AND regexp_matches(lower(d), 'risk: high|high risk') THEN 1 ELSE 0 END AS label FROM h")
def decision_label(spark: SparkSession, sf: str) -> DataFrame:
    return _teacher(spark, sf).select(ID, texts.decision_label(F.col("raw"), F.col("obj")).alias("label"))


@query(
    r"""WITH t AS (SELECT doc_id, replace(regexp_replace(text, '```json\s*', '', 'gi'), '```', '') AS x FROM documents WHERE contains(text, '{') AND contains(text, '}')), e AS (SELECT doc_id, left(x, length(x) - position('}' IN reverse(x)) + 1) AS x FROM t),
c AS (SELECT doc_id, x, length(x) - position('{' IN reverse(x)) + 1 AS a FROM e WHERE contains(x, '{')), d AS (SELECT *, length(left(x, a - 1)) - position('{' IN reverse(left(x, a - 1))) + 1 AS b FROM c),
o AS (SELECT doc_id, CASE WHEN json_valid(substr(x, a)) THEN substr(x, a) WHEN contains(left(x, a - 1), '{') AND json_valid(substr(x, b)) THEN substr(x, b) END AS obj FROM d)
SELECT doc_id, json_extract_string(obj, '$.action') AS action, json_extract_string(obj, '$.status') AS status FROM o WHERE obj IS NOT NULL"""
)
def last_json(spark: SparkSession, sf: str) -> DataFrame:
    """The last JSON object in each document that has one."""
    found = table(spark, sf, "documents").select("doc_id", texts.last_json(F.col("text")).alias("obj")).where("obj IS NOT NULL")
    return found.select("doc_id", F.get_json_object("obj", "$.action").alias("action"), F.get_json_object("obj", "$.status").alias("status"))


def _sft(spark: SparkSession, sf: str) -> DataFrame:
    rows = _feature_text(spark, sf).where("split = 'train_fit' AND trim(desc_clean) <> ''")
    return rows.withColumn("action", F.when(F.col("target") == 1, "reject").otherwise("approve"))


_SYSTEM = "Read the application and answer with one word, reject or approve."


@query(f"SELECT _shared_row_id, '{_SYSTEM}' AS system, CASE target WHEN 1 THEN 'reject' ELSE 'approve' END AS answer, length({_TEXT}) AS n_input FROM shared_split WHERE split = 'train_fit' AND trim(desc_clean) <> ''")
def sft_one_stage(spark: SparkSession, sf: str) -> DataFrame:
    chat = _sft(spark, sf).select(ID, scorers.chat(F.lit(_SYSTEM), F.col("input"), F.col("action")).alias("s"))
    return chat.select(ID, F.col("s.system").alias("system"), F.col("s.conversations")[1]["value"].alias("answer"), F.length(F.col("s.conversations")[0]["value"]).alias("n_input"))


@query(f"""WITH t AS (SELECT _shared_row_id, CASE target WHEN 1 THEN 'reject' ELSE 'approve' END AS action, 'Grade ' || {_WORD.format('grade')} || ', purpose ' || {_WORD.format('purpose')} || '.' AS reason FROM shared_split WHERE split = 'train_fit' AND trim(desc_clean) <> '')
SELECT _shared_row_id, 'reason' AS stage, reason AS answer FROM t UNION ALL SELECT _shared_row_id, 'action', action FROM t""")
def sft_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sft(spark, sf)
    reason = F.concat(F.lit("Grade "), texts.value_text(F.col("grade"), False), F.lit(", purpose "), texts.value_text(F.col("purpose"), False), F.lit("."))
    both = F.explode(F.array(F.struct(F.lit("reason").alias("stage"), scorers.chat(F.lit(_SYSTEM), F.col("input"), reason).alias("s")), F.struct(F.lit("action").alias("stage"), scorers.chat(F.lit(_SYSTEM), F.concat(F.col("input"), F.lit("\n\n[Reason]\n"), reason), F.col("action")).alias("s"))))
    return rows.select(ID, both.alias("b")).select(ID, "b.stage", F.col("b.s.conversations")[1]["value"].alias("answer"))


@query("""SELECT _shared_row_id, target, CASE target WHEN 1 THEN 'reject' ELSE 'approve' END AS expected_action, CASE WHEN desc_clean IS NULL OR trim(desc_clean) = '' THEN 'dropped' ELSE 'kept' END AS status,
  CASE WHEN desc_clean IS NULL OR trim(desc_clean) = '' THEN 'no_text' ELSE 'ok' END AS reason FROM shared_split WHERE split = 'train_fit'""")
def sft_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every row that training samples were made from, kept or dropped, and why."""
    empty = F.coalesce(parsing.strip(F.col("desc_clean")) == "", F.lit(True))
    rows = split_rows(spark, sf).where("split = 'train_fit'")
    return rows.select(ID, "target", F.when(F.col("target") == 1, "reject").otherwise("approve").alias("expected_action"), F.when(empty, "dropped").otherwise("kept").alias("status"), F.when(empty, "no_text").otherwise("ok").alias("reason"))


@query("SELECT s._shared_row_id, CASE WHEN lower(a.emp_length) LIKE '%< 1%' THEN 0.5 ELSE try_cast(nullif(regexp_extract(a.emp_length, '([0-9]+)', 1), '') AS DOUBLE) END AS emp_years, try_cast(nullif(regexp_extract(a.issue_d, '((19|20)[0-9]{2})', 1), '') AS INTEGER) AS year FROM shared_split s JOIN accepted_2007_to_2018q4 a USING (_shared_row_id)")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The registered functions, called from SQL."""
    registry.register(spark)
    accepted(spark, sf).createOrReplaceTempView("scoreloom_accepted")
    split_rows(spark, sf).createOrReplaceTempView("scoreloom_split")
    return spark.sql(f"SELECT s.{ID}, emp_length_years(a.emp_length) AS emp_years, issue_year(a.issue_d) AS year FROM scoreloom_split s JOIN scoreloom_accepted a USING ({ID})")


@query("SELECT _shared_row_id, round((dti - int_rate) / 8, 6) AS delta, round(1 / (1 + exp(-(dti - int_rate) / 8)), 6) AS prob, CASE WHEN dti - int_rate >= 0 THEN 'reject' ELSE 'approve' END AS action FROM shared_split WHERE abs(dti) < 1000 AND abs(int_rate) < 1000")
def logprob_decision(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_rows(spark, sf).where("abs(dti) < 1000 AND abs(int_rate) < 1000").select(ID, (-F.col("int_rate") / 8).alias("logprob_reject"), (-F.col("dti") / 8).alias("logprob_approve"))
    return scorers.decide(rows).select(ID, F.round("logprob_delta", 6).alias("delta"), F.round("prob", 6).alias("prob"), F.col("pred_action").alias("action"))


@query(f"""WITH u AS (SELECT _shared_row_id, (('0x' || md5({_TEXT})[1:12])::BIGINT + 0.5) / 281474976710656.0 AS u FROM shared_split WHERE split = 'test')
SELECT _shared_row_id, CASE WHEN u >= 0.5 THEN 'reject' ELSE 'approve' END AS pred_action, round(u, 6) AS prob FROM u""")
def scorer_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Log-probabilities of both actions from a batch scorer, and the decision."""
    rows = _feature_text(spark, sf).where("split = 'test'").select(ID, "input")
    found = scorers.apply(rows, scorers.StubScorer(), "input", ID)
    return scorers.decide(found).select(ID, "pred_action", F.round("prob", 6).alias("prob"))


# --- features and models -------------------------------------------------------------------------


# Words of two or more letters, digits, marks and joiners of any script, as Java's Unicode word class has them.
_WORDS = r"[\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}]{2,}"


@query(f"""WITH w AS (SELECT _shared_row_id, regexp_extract_all(lower(desc_clean), '{_WORDS}') AS w FROM shared_split), t AS (SELECT _shared_row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w WHERE len(w) > 0),
tf AS (SELECT _shared_row_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 5), n AS (SELECT count(*) AS n FROM shared_split),
x AS (SELECT tf.*, df.df, ln((1 + n) / (1 + df.df)) + 1 AS idf FROM tf JOIN df USING (term), n)
SELECT term, df, round(any_value(idf), 6) AS idf, sum(tf)::BIGINT AS tf FROM x GROUP BY 1, 2""")
def tfidf_terms(spark: SparkSession, sf: str) -> DataFrame:
    """All terms in at least 5 texts, whatever their letters."""
    return features.term_table(split_rows(spark, sf), ID, "desc_clean", 5).select("term", "df", F.round("idf", 6).alias("idf"), "tf")


def _z_sql(c: str) -> str:
    v = clean_sql(c)
    return f"round((coalesce({v}, med_{c}) - avg(coalesce({v}, med_{c})) OVER ()) / coalesce(nullif(stddev_pop(coalesce({v}, med_{c})) OVER (), 0), 1), 5) AS z_{c}"


@query("WITH m AS (SELECT " + ", ".join(f"median({clean_sql(c)}) AS med_{c}" for c in ("loan_amnt", "dti", "emp_length_years")) + " FROM shared_split) SELECT _shared_row_id, " + ", ".join(map(_z_sql, ("loan_amnt", "dti", "emp_length_years"))) + " FROM shared_split, m")
def standardized(spark: SparkSession, sf: str) -> DataFrame:
    z = features.standardised(split_rows(spark, sf), ["loan_amnt", "dti", "emp_length_years"])
    return z.select(ID, *[F.round(f"z_{c}", 5).alias(f"z_{c}") for c in ("loan_amnt", "dti", "emp_length_years")])


@query("WITH mode_ AS (SELECT home_ownership AS m FROM shared_split WHERE home_ownership IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT coalesce(home_ownership, m) AS category, count(*)::DOUBLE AS n FROM shared_split, mode_ GROUP BY 1")
def one_hot_counts(spark: SparkSession, sf: str) -> DataFrame:
    wide, names = features.one_hot(split_rows(spark, sf), ["home_ownership"])
    row = wide.agg(*[F.sum(c).alias(c) for c in names])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.col(c).alias("n")) for c, (_, k) in names.items()])).alias("x")).select("x.*")


@query("SELECT target, count(*) AS n, round((SELECT count(*) FROM shared_split) / (2.0 * count(*)), 9) AS weight FROM shared_split GROUP BY 1")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    df = split_rows(spark, sf)
    return features.weighted(df, "target").groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 9).alias("weight"))


#: Terms of the text features, as in the reference.
TERMS = 30_000


def _model(spark: SparkSession, sf: str, numeric, categorical, text=None, boosted=False) -> DataFrame:
    rows = split_rows(spark, sf)
    train = rows.where("split = 'train_fit'")
    prep = features.Tabular(numeric, categorical, text, 5, TERMS).fit(train)
    fitted = prep.transform(train)
    model = features.boosted(rounds=260, depth=6, step=0.05).fit(features.weighted(fitted, "target")) if boosted else features.fit_logistic(fitted, "features", "target")
    return features.probability(model, prep.transform(rows.where("split IN ('validation', 'test')"))).select(ID, "split", "target", "score")


@query(None)
def logistic_tabular(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, NUMERIC, CATEGORICAL)


@query(None)
def logistic_text_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, NUMERIC, CATEGORICAL, "desc_clean")


@query(None)
def gbt_tabular(spark: SparkSession, sf: str) -> DataFrame:
    return _model(spark, sf, NUMERIC, CATEGORICAL, boosted=True)


@query(None)
def stacked_text_score(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold text scores as a feature of a tabular model."""
    rows = split_rows(spark, sf)
    train = splits.folds(rows.where("split = 'train_fit'"), ID, "target", 3)
    prep = features.Tabular([], [], "desc_clean", 3, TERMS).fit(train)
    text = prep.transform(train, "text_features")
    folded = features.out_of_fold(text, "fold", 3, "text_features", "target", "text_score").drop("text_features")
    whole = features.fit_logistic(text, "text_features", "target")
    test = features.probability(whole, prep.transform(rows.where("split = 'test'"), "text_features"), "text_score").drop("text_features")
    last = features.Tabular([*NUMERIC, "text_score"], CATEGORICAL).fit(folded)
    model = features.fit_logistic(last.transform(folded), "features", "target")
    return features.probability(model, last.transform(test)).select(ID, "target", "text_score", "score")


@query(None)
def embedding_logistic(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", (F.col("label") % 2).cast("int").alias("target"), features.embedding_vector(F.col("embedding")).alias("features"))
    halves = splits.folds(rows, "vec_id", "target", 2)
    model = features.fit_logistic(halves.where("fold = 0"), "features", "target")
    return features.probability(model, halves.where("fold = 1")).select("vec_id", "target", "score")


@query(f"{_GAP} SELECT issue_year, n, round(actual_reject_rate, 9) AS actual_reject_rate, round(actual_reject_rate - 0.35, 9) AS gap, CASE WHEN round(abs(actual_reject_rate - 0.35), 9) <= 0.01 THEN 'stable' WHEN round(abs(actual_reject_rate - 0.35), 9) <= 0.03 THEN 'warn' ELSE 'recalibrate' END AS state FROM g")
def stream_rr_gap(spark: SparkSession, sf: str) -> DataFrame:
    from scoreloom.streaming import monitor

    return monitor.rate_gaps_by_stream(spark, f"{sf}/shared_split.parquet")


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS w, count(*) AS n, count(*) FILTER (value >= 50) / count(*) AS r FROM events WHERE ts IS NOT NULL GROUP BY 1)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, n, round(r, 9) AS actual_reject_rate, round(r - 0.35, 9) AS gap, CASE WHEN round(abs(r - 0.35), 9) <= 0.01 THEN 'stable' WHEN round(abs(r - 0.35), 9) <= 0.03 THEN 'warn' ELSE 'recalibrate' END AS state
FROM w WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps of the hours of a stream of scored events, as far as its watermark has closed them."""
    from scoreloom.streaming import monitor

    found = monitor.windows_by_stream(spark, f"{sf}/events.parquet", "ts", "value", 50.0, 0.35)
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", F.round("actual_reject_rate", 9).alias("actual_reject_rate"), F.round("gap", 9).alias("gap"), "state")
