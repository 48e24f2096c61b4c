import json
import math

import pytest
from pyspark.sql import functions as F

from scoreloom import cli, scorers
from scoreloom.sources import files


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('loan_status,int_rate,desc,other\nFully Paid,12.5,"two\nlines, ""quoted""",1\nCharged Off,12d,n/a,2\n')
    df = files.ingest(spark, str(tmp_path / "a.csv"), str(tmp_path / "p"))
    rows = df.orderBy("_ord").collect()
    assert "other" not in df.columns and rows[0].desc == 'two\nlines, "quoted"' and rows[0].int_rate == 12.5
    assert rows[1].int_rate is None and rows[1].desc is None


def test_report_is_valid_json(tmp_path):
    files.write_report(str(tmp_path / "r/x.json"), {"a": math.nan, "b": [math.inf, 1]})
    assert json.loads((tmp_path / "r/x.json").read_text()) == {"a": None, "b": [None, 1]}


def test_chat_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", "u", "é")], "s string, u string, a string").select(scorers.chat(F.col("s"), F.col("u"), F.col("a")).alias("c"))
    files.write_chat(df, "c", str(tmp_path / "c"))
    assert files.read_chat(spark, str(tmp_path / "c")).first().conversations[1].value == "é"


def test_split_directory(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(100)], "id long, target int")
    path = str(tmp_path / "s")
    first = files.split_directory(df, path, "id", "target", seed="1").where("split = 'test'").count()
    assert first == files.split_directory(df, path, "id", "target", seed="1").where("split = 'test'").count() == 20
    with pytest.raises(ValueError):
        files.split_directory(df, path, "id", "target", seed="2")


def test_job_and_features(tmp_path):
    made = files.write_training_job(str(tmp_path / "j"), "n", "d.jsonl", "m")
    assert "lora_rank: 8" in open(made[0]).read() and "n" in json.load(open(made[1]))
    (tmp_path / "f.json").write_text('{"selected_numeric_columns": ["a", "z"], "selected_categorical_columns": null}')
    assert files.read_features(str(tmp_path / "f.json"), ["a"]) == ["a"]


def test_stub_scorer(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, p string")
    out = scorers.decide(scorers.apply(df, scorers.StubScorer(), "p", "id"))
    assert out.count() == 2 and out.where("prob BETWEEN 0 AND 1").count() == 2


def test_cli_errors(capsys):
    assert cli.main(["split", "--source", "/none", "--out", "/tmp/none"]) == 2
    assert "split" not in (err := capsys.readouterr().err) and err.strip()


def test_windowed_stream(spark, tmp_path):
    from scoreloom.streaming import monitor

    spark.createDataFrame([("2020-01-01 10:00:00", 0.9), ("2020-01-01 11:00:00", 0.1), ("2020-01-05 10:00:00", 0.9), ("2020-01-09 10:00:00", 0.9)], "t string, score double").select(F.to_timestamp("t").alias("t"), "score").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, score double").parquet(str(tmp_path / "in"))
    run = monitor.windowed_gaps(stream, "t", "score", 0.5, 0.5).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.table("w").orderBy("window_start").collect()
    assert (rows[0].n, rows[0].actual_reject_rate, rows[0].state) == (2, 0.5, "stable")
