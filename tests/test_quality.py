import math

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import chained_imputation, column_profile

BASE = "column_name string, value_type string, valid_min double, valid_max double, valid_values array<string>, absent_share double, cut_points array<double>, cut_shares array<double>, value_shares map<string,double>"


def baseline(spark):
    return spark.createDataFrame([("x", "double", 0.0, 10.0, None, 0.0, [5.0], [0.5], None), ("w", "string", None, None, ["a", "b"], 0.0, None, None, {"a": 0.5, "b": 0.5}), ("gone", "double", 0.0, 1.0, None, 0.0, [], [], None)], BASE)


def test_departures(spark):
    good = [(1, float(i % 10) + 0.5, "ab"[i % 2]) for i in range(100)]
    bad = [(2, [None, math.nan, 99.0, 1.0][i % 4], ["a", "zz", " N/A ", "a"][i % 4]) for i in range(100)]
    df = spark.createDataFrame(good + bad, "load int, x double, w string").withColumn("group", F.lit("clash")).withColumn("value", F.lit(1))
    got = {(r.column_name, r.load, r.issue) for r in column_profile.departures(df, "load", baseline(spark)).collect()}
    assert got == {("x", 2, "absent"), ("x", 2, "invalid"), ("x", 2, "shift"), ("w", 2, "absent"), ("w", 2, "invalid"), ("w", 2, "shift")}
    assert column_profile.departures(df.limit(0), "load", baseline(spark)).count() == 0
    assert column_profile.departures(df, "load", baseline(spark).limit(0)).count() == 0


def test_all_absent_has_no_shift(spark):
    df = spark.createDataFrame([(1, None, "")] * 5, "load int, x double, w string")
    assert {r.issue for r in column_profile.departures(df, "load", baseline(spark)).collect()} == {"absent"}


def test_profile(spark):
    rows = [(1, 1.5, "A1"), (1, math.inf, "bad"), (1, math.nan, None), (1, 1.5, "A1"), (None, 2.0, "x" * 100_000), (2, 3.5, "B2")]
    df = spark.createDataFrame(rows, "load int, x double, s string")
    got = {(r.load, r.column_name): r for r in column_profile.profile(df, "load", patterns={"s": "[A-G][1-5]"}).collect()}
    one = got[1, "x"]
    assert (one.n_rows, one.n_absent, one.n_distinct, one.n_not_finite, float(one.s1)) == (4, 1, 2, 1, 3.0)
    assert got[1, "s"].n_violations == 1 and got[None, "s"].n_violations == 1 and got[2, "s"].n_violations == 0
    assert column_profile.profile(df.limit(0), "load").count() == 0


def test_profile_sums_merge(spark):
    df = spark.createDataFrame([(i % 2, i / 100) for i in range(1000)], "load int, x double")
    parts = [r.s1 for r in column_profile.profile(df, "load", ["x"]).collect()]
    whole = column_profile.profile(df.withColumn("load", F.lit(0)), "load", ["x"]).first().s1
    assert sum(parts) == whole


def fill(spark, df, cycles=2):
    ok = F.coalesce(F.col("x").between(0, 100), F.lit(False))
    return chained_imputation.impute(
        df, "id", [F.col("load"), F.upper(F.trim("grade"))], {"x": (0.0, 100.0)}, {"e": ["lo", "hi"]}, {"x": ~ok, "e": F.col("e").isNull()}, {"x": ok, "e": F.col("e").isin("lo", "hi")}, ["h"], cycles
    )


KIND = "id long, load int, grade string, h double, x double, e string, g0 string, key string"


def test_imputation_keeps_what_is_known_and_uses_the_group(spark):
    rows = [(i, 1, " a" if i % 2 else "A ", float(i % 20), None if i % 5 == 0 else 2.0 * (i % 20) + 1, None if i % 7 == 0 else ("hi" if i % 20 > 10 else "lo"), "clash", "clash") for i in range(600)]
    rows += [(1000, 1, None, 1.0, None, None, "", ""), (1001, 2, "B", 1.0, None, "odd", "", ""), (1002, 1, "A", None, math.nan, None, None, None), (1002, 1, "A", None, math.nan, None, None, None)]
    df = spark.createDataFrame(rows, KIND)
    out = fill(spark, df).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.id, r)
    for i, _, _, h, x, e, *_ in rows[:600]:
        r = by[i]
        assert r.x_filled == (x is None) and r.e_filled == (e is None)
        assert r.x == x if x is not None else abs(r.x - (2 * h + 1)) < 3
        assert r.e == e if e is not None else r.e in ("lo", "hi")
    right = [by[i].e == ("hi" if h > 10 else "lo") for i, _, _, h, _, e, *_ in rows[:600] if e is None]
    assert sum(right) > 0.9 * len(right)
    assert not by[1000].x_filled and not by[1001].x_filled and by[1001].e == "odd" and by[1002].x_filled
    assert sorted(r.x for r in out if r.id == 1002) == [by[1002].x] * 2
    again = {r.id: r.x for r in fill(spark, df.repartition(5)).collect()}
    assert all(again[r.id] == pytest.approx(r.x, rel=1e-6) for r in out if r.x is not None and r.id != 1002)


def test_imputation_of_nothing(spark):
    assert fill(spark, spark.createDataFrame([], KIND)).count() == 0
