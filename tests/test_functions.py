import math

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import parsing as p
from scoreloom.functions import texts as t


def values(spark, expr, inputs, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (p.emp_length_years, {"10+ years": 10.0, "< 1 year": 0.5, "1 year": 1.0, "n/a": None, "": None, None: None}),
        (p.term_months, {" 36 months": 36.0, "abc": None, None: None}),
        (p.issue_year, {"Dec-2015": 2015, "1998-01-01": 1998, "Jan-15": None, None: None}),
        (p.safe_float, {"24.08%": 24.08, "1,200": 1200.0, "null": None, "x": None, " ": None, None: None}),
        (p.number, {"12d": None, " 12.5 ": 12.5, "1e3": 1000.0, "-.5": -0.5, "inf": math.inf, "": None, None: None}),
        (p.csv_missing_to_null, {"NA": None, "n/a": None, "x": "x", "": None, None: None}),
        (lambda c: p.non_missing(c, True), {"a": True, " ": False, "NaN": False, " ": False, None: False}),
        (t.clean_text, {" <b>Hi</b>&amp;  there ": "hi & there", None: "", "": "", "NaN": "", "a&lt;b&gt;c": "a c", "x  y": "x y"}),
        (t.risk_level, {'{"risk":"high"}': "high", "risk: low": "low", "high risk and low risk": "high", "none": "unknown"}),
        (t.last_json, {'x {"a":1} y {"b":{"c":2}}': '{"b": {"c": 2}}', "[1]": None, '{"a":1': None, '```json\n{"a": 2}\n```': '{"a": 2}', "": None, None: None}),
        (t.think_block, {"<THINK> a\nb </think>": "a\nb", "<think> </think>": None, "x": None, None: None}),
    ],
)
def test_cases(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_numbers_as_text(spark):
    assert values(spark, t.number_text, [75000.0, 13.78, None], "double") == ["75000", "13.78", "N/A"]
    assert values(spark, t.percent_text, [24.08, 21.15, None], "double") == ["24.1%", "21.1%", "N/A"]
    assert values(spark, lambda c: t.value_text(c, True), [28997.0, 1234567.0, None, math.nan], "double") == ["28997", "1.23457e+06", "missing", "missing"]
    assert values(spark, lambda c: t.value_text(c, True, "f"), [0.5], "double") == ["0.5000"]


def test_actions(spark):
    raw = ['{"action":"Reject"}', "approve then reject", "reject, not approve", "?", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").withColumn("o", t.last_json(F.col("x"))).withColumn("a", t.action_and_status(F.col("x"), F.col("o"))).orderBy("i")
    assert [(r.a.action, r.a.status) for r in df.collect()] == [("reject", "json_action"), ("approve", "text_both_first_approve"), ("reject", "text_both_first_reject"), ("approve", "fallback_default_approve"), ("approve", "fallback_default_approve")]


def test_feature_text_round_trip(spark):
    df = spark.createDataFrame([("a: b", 5.0, "two\nlines\nnull"), (None, None, None)], "g string, n double, d string")
    text = t.feature_text([("g", t.value_text(F.col("g"), False)), ("n", t.value_text(F.col("n"), True))], F.col("d"))
    rows = df.withColumn("x", text).withColumn("p", t.parse_feature_text(F.col("x"))).collect()
    assert dict(rows[0].p.features) == {"g": "a: b", "n": "5"} and rows[0].p.description == "two lines"
    assert dict(rows[1].p.features) == {"g": "missing", "n": "missing"} and rows[1].p.description == "missing"


def test_tags():
    assert [p.ratio_tag(x) for x in (1, 0.05, 0.001)] == ["full", "5pct", "0_1pct"]
    assert [p.slug(x) for x in ("Model3-0.6B", "--")] == ["model3_0_6b", "custom_model"]


def test_registered_functions(spark):
    from scoreloom.functions import registry

    assert "issue_year" in registry.register(spark)
    row = spark.sql("SELECT issue_year('Dec-2015') a, emp_length_years('< 1 year') b, last_json('x {\"k\": 1}') c, format_fixed1(21.15D) d, strip_text(' x ') e, gap_state(0.36D, 0.35D) f, think_block('<think> </think>') g").first()
    assert tuple(row) == (2015, 0.5, '{"k": 1}', "21.1", "x", "stable", None)
