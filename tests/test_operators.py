import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.operators import alignment, cleaning, features, profiles, scores, splits, summaries, thresholds


@pytest.mark.parametrize(("counts", "test", "val"), [({0: 4620, 1: 2488}, {0: 924, 1: 498}, {0: 740, 1: 398}), ({0: 104318, 1: 18884}, {0: 20864, 1: 3777}, {0: 16691, 1: 3022})])
def test_split_sizes(counts, test, val):
    assert splits.split_quotas(counts) == (test, val)


@given(st.dictionaries(st.integers(0, 5), st.integers(0, 500), min_size=1), st.integers(0, 300))
@settings(max_examples=60, deadline=None)
def test_proportional(counts, total):
    total = min(total, sum(counts.values()))
    out = splits.proportional(counts, total)
    assert sum(out.values()) == total and all(0 <= out[k] <= counts[k] for k in counts)


def frame(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, round(r.random(), 2), int(r.random() < 0.3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, score double, target int"), rows


def brute(rows, t):
    return sum(s >= t and y for _, s, y in rows), sum(s >= t and not y for _, s, y in rows)


def test_thresholds_equal_brute_force(spark):
    df, rows = frame(spark)
    table = scores.score_table(df, "score", "target")
    for grid in (thresholds.FINE, [0.1, 0.5, 0.5, 0.9]):
        for p in thresholds.points(table, grid):
            assert (p.tp, p.fp) == brute(rows, p.threshold)
            assert p.tp + p.fp + p.tn + p.fn == len(rows)


def test_ranking_equals_brute_force(spark):
    df, rows = frame(spark, 150)
    m = scores.ranking_metrics(scores.score_table(df, "score", "target")).first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    ap = sum(sum(a == s for a in pos) * sum(a >= s for a in pos) / sum(x >= s for _, x, _ in rows) for s in {s for _, s, _ in rows}) / len(pos)
    assert m.roc_auc == pytest.approx(auc) and m.pr_auc == pytest.approx(ap)
    none = scores.ranking_metrics(scores.score_table(df.where("target = 0"), "score", "target")).first()
    assert none.roc_auc is None and none.pr_auc is None


def test_quantiles(spark):
    import numpy as np

    df, rows = frame(spark, 101)
    got = {r.prob: r.value for r in scores.quantiles(scores.score_table(df, "score", "target"), [0.0, 0.05, 0.5, 0.9, 1.0]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile([s for _, s, _ in rows], p))


def test_reject_rate_ends(spark):
    df, _ = frame(spark, 50)
    t = scores.score_table(df, "score", "target")
    cuts = scores.reject_thresholds(t, [0.0, 0.35, 1.0])
    assert cuts[0.0] > 0.99 * max(r.score for r in t.collect()) and cuts[1.0] < min(r.score for r in t.collect())
    assert scores.reject_thresholds(t.limit(0), [0.35]) == {0.35: 0.5}


def test_tied_scores_overshoot_and_exact_top(spark):
    df = spark.createDataFrame([(i, 0.5, i % 2) for i in range(10)], "id long, score double, target int")
    cut = scores.reject_thresholds(scores.score_table(df, "score", "target"), [0.35])[0.35]
    assert df.where(F.col("score") >= cut).count() == 10
    assert sorted(r.id for r in scores.exact_top(df, "score", "id", 0.35).where("rejected").collect()) == [0, 1, 2]


def test_business_relaxes_in_turn():
    P = thresholds.Point
    pts = [P(0.2, 30, 50, 10, 10), P(0.5, 20, 20, 40, 20), P(0.8, 5, 1, 59, 35)]
    assert thresholds.best_business(pts, pts, low=0.3, high=0.5)["threshold"] == 0.5
    assert thresholds.best_business(pts, pts, precision_floor=0.9, low=0.3, high=0.5)["fallback"] == "without_precision_floor"
    assert thresholds.best_business(pts, pts, recall_floor=0.9, low=0.3, high=0.5)["fallback"] == "without_floors"
    assert thresholds.best_business(pts, pts, low=0.45, high=0.46)["fallback"] == "no_threshold_in_band"
    with pytest.raises(ValueError):
        thresholds.best_business(pts, pts, objective="x")


def test_precision_floor_ties():
    P = thresholds.Point
    pts = [P(0.3, 10, 5, 80, 5), P(0.4, 10, 5, 80, 5), P(0.6, 4, 0, 85, 11)]
    assert thresholds.best_by(pts, "recall_at_precision_floor", 0.5)["threshold"] == 0.4
    assert thresholds.best_by(pts, "recall_at_precision_floor", 1.1)["fallback"] == "f1"
    assert thresholds.best_by([])["threshold"] == 0.5


def test_profile_counts_and_golden_smoothing(spark):
    rows = [(i, float(i % 50) if i % 7 else None, "ab"[i % 2] if i % 11 else None, int(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x double, c string, target int")
    edges = profiles.edges_of(df, ["x"])
    prof = profiles.build(df, "target", edges, ["c"], least=30).collect()
    for f in ("x", "c"):
        assert sum(r.n for r in prof if r.feature == f) == 600 and sum(r.bad for r in prof if r.feature == f) == 200
    for r in prof:
        assert r.risk == pytest.approx((r.bad + 20 / 3) / (r.n + 20))
    s = profiles.score(df, profiles.build(df, "target", edges, ["c"], least=30), edges, ["c"])
    assert s.agg(F.min("score")).first()[0] >= min(r.risk for r in prof) - 1e-12


def test_two_valued_numbers_have_one_bin(spark):
    df = spark.createDataFrame([(float(i % 3 == 0), i % 2) for i in range(102)], "x double, target int")
    edges = profiles.edges_of(df, ["x"])
    assert edges == {"x": []}
    assert {r.weight for r in profiles.build(df, "target", edges, [], least=1).collect()} == {1e-6}


def test_samples(spark):
    df, rows = frame(spark, 300)
    n1 = sum(y for *_, y in rows)
    assert splits.equal_classes(df, "id", "target").groupBy("target").count().select("count").distinct().count() == 1
    assert splits.ratio_sample(df, "id", "target", 0.001).count() == 2
    over = splits.oversample_positives(df, "id", "target")
    assert over.where("target = 1").count() == over.where("target = 0").count() == 300 - n1
    with pytest.raises(ValueError):
        splits.ratio_sample(df, "id", "target", 0)
    with pytest.raises(ValueError):
        splits.downsample_negatives(df.where("target = 1"), "id", "target")
    once = sorted(r.id for r in splits.equal_classes(df, "id", "target").collect())
    assert once == sorted(r.id for r in splits.equal_classes(df.repartition(7), "id", "target").collect())


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "a", None, 1.0, "k"), (2, " ", None, math.nan, "k"), (3, "c", "z", 2.0, "k")], "id long, s string, m string, x double, k string")
    out, report = cleaning.clean(df, ["s", "x", "absent"], ["none"], True, 0.4, ["id"])
    assert report["rows_before"] == 3 and report["rows_after"] == 2
    assert report["dropped_missing"] == ["m"] and report["dropped_constant"] == ["k"] and out.columns == ["id", "s", "x"]
    with pytest.raises(ValueError):
        cleaning.require(df, ["id", "gone"])
    assert {r.column_name for r in cleaning.constants(df.limit(0)).collect() if r.is_constant} == set(df.columns)


def test_alignment(spark):
    base = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "id long, o long, v string")
    split = spark.createDataFrame([(1, "x"), (2, "y")], "id long, part string")
    assert sorted((r.id, r.v) for r in alignment.realign(split, base, "id", "o").collect()) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        alignment.realign(spark.createDataFrame([(9, "x")], "id long, part string"), base, "id", "o")


def test_correlation_and_pruning(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 5.0, float(i % 3), i % 2) for i in range(30)], "a double, b double, c double, d double, target int")
    found = {(r.a, r.b): r.r for r in summaries.correlations(df, ["a", "b", "c", "d"], "target").collect()}
    assert found["a", "b"] == pytest.approx(1.0) and found["a", "c"] is None
    assert summaries.prune(["a", "b", "c", "d"], found, {}, {"b": 0.1}) == ["b"]


def test_logistic_close_to_newton(spark):
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(300, 2))
    y = (r.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.3)))).astype(int)
    df = spark.createDataFrame([(int(t), [float(v) for v in row]) for t, row in zip(y, x)], "target int, e array<double>")
    from pyspark.ml.functions import array_to_vector

    fitted = df.withColumn("features", array_to_vector("e"))
    model = features.fit_logistic(fitted, "features", "target")
    w = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (300 - y.sum())))
    a, beta = np.c_[np.ones(300), x], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        pen = np.array([0, 1.0, 1.0])
        beta += np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(pen), a.T @ (w * (y - p)) - pen * beta)
    assert model.intercept == pytest.approx(beta[0], abs=1e-2) and list(model.coefficients) == pytest.approx(list(beta[1:]), abs=1e-2)


def test_uncertain_edges(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "id long, score double, target int")
    assert not scores.uncertain(df, "score", "id", 0.5, 0.9).first().manual
    assert not scores.uncertain(df, "score", "id", 0.5, 0.0).first().manual


def test_models_are_registered_with_the_reference_parameters(spark, data, monkeypatch):
    from scoreloom.plans import model_queries
    from scoreloom.plans.tables import CATEGORICAL

    class Seen(Exception):
        pass

    def tabular(numeric, categorical, text=None, *rest):
        raise Seen(categorical, rest)

    monkeypatch.setattr(features, "Tabular", tabular)
    for name, want in (("gbt_tabular", (CATEGORICAL, (5, 30_000))), ("logistic_text_fusion", (CATEGORICAL, (5, 30_000))), ("stacked_text_score", ([], (3, 30_000)))):
        with pytest.raises(Seen) as seen:
            getattr(model_queries, name)(spark, data)
        assert seen.value.args == want
    model = features.boosted(rounds=260, depth=6, step=0.05)
    assert (model.getMaxIter(), model.getMaxDepth(), model.getStepSize()) == (260, 6, 0.05)


def test_term_table_has_rare_and_accented_terms(spark, monkeypatch):
    import re
    from collections import Counter

    from scoreloom.plans import model_queries

    lines = ["Préstamo para el café nuevo", "贷款 申请 préstamo", "A plain loan, a plain letter", None, ""] * 5 + ["seen once only"]
    df = spark.createDataFrame(list(enumerate(lines)), "_shared_row_id long, desc_clean string")
    monkeypatch.setattr(model_queries, "split_rows", lambda *_: df)
    tf, docs = Counter(), Counter()
    for line in lines:
        w = re.findall(r"\b\w\w+\b", (line or "").lower())
        terms = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        tf.update(terms)
        docs.update(set(terms))
    want = {(k, n, round(math.log((1 + len(lines)) / (1 + n)) + 1, 6), tf[k]) for k, n in docs.items() if n >= 5}
    got = [tuple(x) for x in model_queries.QUERIES["tfidf_terms"](spark, "").collect()]
    assert set(got) == want and len(got) == len(want) and any(x[0] == "贷款 申请" for x in got)


def test_term_table_meets_no_text_again(spark, monkeypatch):
    """No join of terms, whose vocabulary the driver would collect to send it; rows of one key are one text."""
    from scoreloom.plans import model_queries

    df = spark.createDataFrame([(i // 2, "loan for a car loan" if i % 2 else "the car") for i in range(12)] + [(None, "null key car")], "_shared_row_id long, desc_clean string")
    monkeypatch.setattr(model_queries, "split_rows", lambda *_: df)
    found = model_queries.QUERIES["tfidf_terms"](spark, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Join Cross" in plan and plan.count("Generate explode") == 1
    got = {x.term: (x.df, x.tf, x.idf) for x in found.collect()}
    idf = round(math.log(14 / 7) + 1, 6)
    assert got["car"] == (7, 13, round(math.log(14 / 8) + 1, 6)) and got["loan"] == (6, 12, idf) and got["for car"] == (6, 6, idf)
    weights = features.term_weights(df, "_shared_row_id", "desc_clean", 5)
    assert {(x.term, x.df) for x in weights.collect()} == {(k, v[0]) for k, v in got.items()}
