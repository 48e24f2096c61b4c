"""Policies, review, samples, runs and plugins against brute force and definite cases."""

import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom import scorers, workflows
from scoreloom.functions import texts
from scoreloom.operators import alignment, cleaning, policies, scores, splits
from scoreloom.operators.policies import BAND, FIXED, FLOOR, REVIEW, Policy
from scoreloom.sources import files


def brute_review(rows, rate, t):
    """(tp, fp, tn, fn) of the rows that are not among the nearest to t."""
    k = min(math.floor(len(rows) * rate + 1e-9), len(rows) - 1)
    kept = sorted(rows, key=lambda r: (round(abs(r[1] - t), 12), r[0]))[k:]
    count = lambda over, y: sum((r[1] >= t) == over and r[2] == y for r in kept)
    return count(True, 1), count(True, 0), count(False, 0), count(False, 1)


@pytest.mark.parametrize(("digits", "rate"), [(1, 0.1), (2, 0.3), (6, 0.1), (2, 0.0), (1, 1.0)])
def test_review_equals_brute_force(spark, digits, rate):
    r = random.Random(digits)
    rows = [(i, round(r.random(), digits), int(r.random() < 0.3)) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, 1), (901, 0.5, None)], "id long, score double, target int")
    grid = [0.0, 0.25, 0.5, 0.505, 0.9, 1.0]
    for p in policies.review_points(df, "score", "target", "id", rate, grid):
        assert (p.tp, p.fp, p.tn, p.fn) == brute_review(rows, rate, p.threshold), p
    assert policies.review_points(df.limit(0), "score", "target", "id", rate) == []


def test_every_score_alike(spark):
    rows = [(i, 0.5, i % 2) for i in range(40)]
    (p,) = policies.review_points(spark.createDataFrame(rows, "id long, score double, target int"), "score", "target", "id", 0.25, [0.5])
    assert (p.tp, p.fp, p.tn, p.fn) == brute_review(rows, 0.25, 0.5) and p.measures["manual_rate"] == 0.25


def test_policies_choose(spark):
    r = random.Random(3)
    rows = [(i, s := round(r.random(), 3), int(r.random() < s)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, score double, target int")
    picks = {k: policies.choose(df, "score", "target", "id", Policy(k, low=0.1, high=0.6, precision_floor=0.3, least_auto=0.5)) for k in (FIXED, BAND, FLOOR, REVIEW)}
    assert all(p["satisfied"] and p["fallback"] is None for p in picks.values())
    share = sum(s >= picks[FIXED]["threshold"] for _, s, _ in rows) / 400
    assert abs(share - 0.35) < 0.01
    none = policies.choose(df, "score", "target", "id", Policy(REVIEW, precision_floor=1.1))
    assert not none["satisfied"] and none["fallback"] == FLOOR
    with pytest.raises(ValueError):
        policies.choose(df, "score", "target", "id", Policy("guess"))


def test_summary_selects_the_first_of_equals():
    row = {"precision_reject_validation": 0.5, "recall_default_validation": 0.5, "reject_rate_validation": 0.3}
    got = policies.summary([row | {"model_name": n} for n in "ab"] + [row | {"model_name": "c", "precision_reject_validation": 0.6}], Policy())
    assert [(r["model_name"], r["place"], r["selected"]) for r in got] == [("c", 1, True), ("a", 2, False), ("b", 3, False)]


@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=2, max_size=40))
@settings(max_examples=5, deadline=None)
def test_buckets_keep_the_order(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", scores.bucket_of(F.col("v"))).collect()
    ordered = sorted(rows, key=lambda r: (r.v, r.b))
    assert all(a.b <= b.b for a, b in zip(ordered, ordered[1:]))


def test_quantiles_of_any_numbers(spark):
    r = random.Random(9)
    values = [r.uniform(-1e6, 1e6) for _ in range(301)]
    table = scores.score_table(spark.createDataFrame([(v, 1) for v in values], "s double, y int"), "s", "y")
    got = {x.prob: x.value for x in scores.quantiles(table, [0.0, 0.25, 0.5, 1.0]).collect()}
    values.sort()
    assert got == {0.0: values[0], 0.25: values[75], 0.5: values[150], 1.0: values[300]}


def test_first_rows(spark):
    df = spark.createDataFrame([(2, None, "b"), (1, None, "a"), (5, 7, "x"), (4, 7, "y")], "o long, k long, v string")
    assert sorted(r.v for r in alignment.keep_first(df, "k", "o").collect()) == ["a", "y"]


def test_bootstrap_counts_add_up(spark):
    df = spark.range(100)
    got = splits.bootstrap(df, {"a": F.col("id") < 30, "b": F.col("id") >= 30}, 200).collect()
    assert len(got) == 200 and all(r.a + r.b == 100 for r in got) and 25 < sum(r.a for r in got) / 200 < 35
    assert splits.bootstrap(df.limit(0), {"a": F.lit(True)}, 3).count() == 3


def test_checked_split(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "id long, target int")
    rows, report = splits.checked_split(df, "id", "target")
    assert report["rate_match_satisfied"] and report["test"]["rows"] == 200 and rows.where("split = 'test'").count() == 200
    tiny = spark.createDataFrame([(i, int(i == 0)) for i in range(7)], "id long, target int")
    with pytest.raises(ValueError):
        splits.checked_split(tiny, "id", "target")
    assert not splits.checked_split(tiny, "id", "target", strict=False)[1]["rate_match_satisfied"]
    assert splits.two_way_split(df, "id", "target", 0.3).where("split = 'test' AND target = 1").count() == 30


def test_samples(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0), 2007 + i % 10) for i in range(500)], "id long, target int, y int")
    assert splits.preserve_ratio(df, "id", "target", 100).groupBy("target").count().collect().__len__() == 2
    assert splits.preserve_ratio(df, "id", "target", None).count() == splits.preserve_ratio(df, "id", "target", 900).count() == 500
    assert splits.first_by_hash(df, "id", 7).count() == 7
    with pytest.raises(ValueError):
        splits.balanced_time_split(df, "id", "target", "y", (1990, 1991), (2014, 2016))


def test_rows_and_roles(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else " ", "Jan-2015", float(i)) for i in range(10)], "o long, t string, issue_d string, v double")
    kept, seen = cleaning.capped_scan(df, "o", F.col("t") == "x", 3, 1, 8)
    assert seen == {"rows_seen": 8, "rows_kept": 3} and [r.o for r in kept.orderBy("o").collect()] == [1, 3, 5]
    filled, n = cleaning.fill_blank(df, "t")
    assert n == 5 and filled.where("t = 'missing'").count() == 5
    assert cleaning.with_year(df).first().issue_year == 2015 and cleaning.with_year(df.withColumn("issue_year", F.lit(1))).first().issue_year == 1
    assert cleaning.roles(cleaning.without_leakage(df.withColumn("recoveries", F.lit(1.0)))) == {"numeric": ["o", "v"], "categorical": ["t"]}
    assert cleaning.ordered_unique(df, ["v", "no", "o", "v"]).columns == ["v", "o"]


def test_parsed_responses(spark):
    raw = ['{"action": " Reject ", "reason": "r"}', '{"action": "hold"} so approve', "REJECT or approve", "", None, '```json\n{"action":"approve"}\n```']
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").withColumn("p", texts.parsed_response(F.col("raw"), texts.last_json(F.col("raw"))))
    got = [(r.p.action, r.p.label, r.p.reason, r.p.status) for r in df.orderBy("i").collect()]
    assert got == [("reject", 1, "r", "ok_json"), ("approve", 0, "", "fallback_from_text_bad_json_action"), ("reject", 1, "", "fallback_from_text_no_json"), ("approve", 0, "", "fallback_default_approve"), ("approve", 0, "", "fallback_default_approve"), ("approve", 0, "", "ok_json")]
    assert spark.range(1).select(texts.action_label(F.lit("hold")).alias("a"), texts.action_label(F.lit("hold"), 0).alias("b")).first() == (None, 0)


def test_model_settings():
    assert scorers.effective_max_length(512, 1e30) == 512 and scorers.effective_max_length(2048, 512) == 512 and scorers.effective_max_length(64, None) == 64
    assert scorers.model_settings("org/Some-Model_1.5b") == {"model_name_or_path": "org/Some-Model_1.5b", "model_tag": "some_model_1_5b", "template": "default"}


class Service(BaseHTTPRequestHandler):
    answers: list[tuple[int, str]] = []
    seen: list[dict] = []

    def do_POST(self):
        Service.seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        status, text = Service.answers.pop(0)
        body = json.dumps({"choices": [{"message": {"content": text}}]}).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_http_scorer_retries():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    scorer = scorers.HttpScorer(base_url=f"http://127.0.0.1:{server.server_port}/v1", model="m", per_second=1000, pause=0.01)
    scorer.load()
    Service.answers = [(503, ""), (200, "I approve"), (429, ""), (200, "reject, not approve")]
    assert scorer.score(["a", "b"]) == [(-14.0, -1e-6), (-1e-6, -14.0)] and len(Service.seen) == 4
    Service.answers = [(400, "")]
    with pytest.raises(ConnectionError):
        scorer.generate(["c"])
    server.shutdown()
    with pytest.raises(ValueError):
        scorers.HttpScorer(base_url="").load()


def test_run_writes_everything(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, ["train_fit", "validation", "test"][i % 3], int(r.random() < 0.3), r.random(), r.choice("AB")) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, split string, target int, x double, g string")
    report = workflows.run(df, str(tmp_path / "run"), "id", workflows.variants(["x"], ["g"], None, ["logistic_tabular", "risk_profiles"]), Policy(REVIEW, precision_floor=0.0, least_auto=0.5), folds=2)
    assert report["selected_model"] in ("logistic_tabular", "risk_profiles") and json.loads((tmp_path / "run/report.json").read_text())["models"][0]["place"] == 1
    assert spark.read.parquet(str(tmp_path / "run/predictions")).where("y_pred_with_manual = -1").count() == 40
    assert spark.read.csv(str(tmp_path / "run/summary"), header=True).count() == 2 and spark.read.parquet(str(tmp_path / "run/gains")).count() == 20
    with pytest.raises(ValueError):
        workflows.variants(["x"], [], None, ["guess"])


def test_training_job_copies_the_data(spark, tmp_path):
    chat = spark.createDataFrame([("s", "u", "a")] * 3, "s string, u string, a string").select(scorers.chat(F.col("s"), F.col("u"), F.col("a")).alias("c"))
    files.write_chat(chat.repartition(2), "c", str(tmp_path / "chat"))
    made = files.write_training_job(str(tmp_path / "job"), "n", str(tmp_path / "chat"), "m", num_train_epochs=2.0)
    assert len(made) == 4 and len((tmp_path / "job/n.jsonl").read_text().splitlines()) == 3
    assert json.loads((tmp_path / "job/dataset_info.json").read_text())["n"]["file_name"] == "n.jsonl" and "num_train_epochs: 2.0" in (tmp_path / "job/n.yaml").read_text()


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from scoreloom import session

    conf = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        session.shared_folder(SimpleNamespace(sparkContext=context, conf=conf))


def test_commands_end_to_end(spark, tmp_path, monkeypatch, capsys):
    from scoreloom import cli

    monkeypatch.setattr(cli, "get_session", lambda: spark)
    r = random.Random(4)
    rows = [(i, ["train_fit", "validation", "test"][i % 3], int(r.random() < 0.3), float(i), "AB"[i % 2], "words" if i % 10 else " ") for i in range(300)]
    source = str(tmp_path / "rows")
    spark.createDataFrame(rows, "_shared_row_id long, split string, target int, loan_amnt double, grade string, desc_clean string").withColumn("issue_year", F.lit(2012)).write.parquet(source)
    at = lambda name: str(tmp_path / name)

    def call(*args):
        assert cli.main(list(args)) == 0, capsys.readouterr().err
        return json.loads(capsys.readouterr().out)

    assert call("sample", "--source", source, "--out", at("s"), "--size", "50")["rows"] == 50
    assert call("prepare-texts", "--source", source, "--out", at("t"))["rows"] == 300
    kept = call("generate-sft", "--source", at("t"), "--out", at("sft"), "--stages", "2")
    assert sum(kept.values()) == 300 and kept["no_text"] == 30 and kept["ok"] > 0
    assert files.read_chat(spark, at("sft/reason")).count() == files.read_chat(spark, at("sft/action")).count() == kept["ok"]
    assert sum(call("infer", "--source", at("t"), "--out", at("i"), "--stages", "2").values()) == 300
    assert len(call("write-job", "--folder", at("j"), "--name", "n", "--dataset", at("sft/action"), "--model", "m")["files"]) == 4
    assert call("explore", "--source", source, "--out", at("e"))["numeric"] == ["loan_amnt"]
    report = call("run", "--split", source, "--out", at("r"), "--models", "risk_profiles", "--policy", "precision_in_band")
    assert report["selected_model"] == "risk_profiles"
    assert cli.main(["sample", "--source", source, "--out", at("x"), "--strategy", "guess"]) == 2
