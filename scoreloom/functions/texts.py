"""Text rendering and response parsing.

Everything that Spark can say stays an expression.  Arrow functions are left for three things it
cannot: HTML entities, C-style rounding of the exact binary value, and scanning for the last JSON
object of a response.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.parsing import strip


def _each(s: pd.Series, f) -> pd.Series:
    """f of every value, as objects; missing stays missing, also where a batch holds nothing else."""
    return pd.Series([None if x is None or x != x else f(x) for x in s], dtype=object, index=s.index)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return _each(s, html.unescape)


def clean_text(c: Column, entities: bool = True) -> Column:
    """Entities resolved, then tags dropped, white space collapsed, lower case; missing is ''.

    Only texts with an ampersand go through the Arrow function; the others never leave the JVM
    columns as a changed value.
    """
    raw = F.when(c.isNull() | (F.lower(strip(c)) == "nan"), F.lit("")).otherwise(c)
    plain = F.when(raw.contains("&"), _unescape(raw)).otherwise(raw) if entities else raw
    return F.lower(strip(F.regexp_replace(F.regexp_replace(plain, "<[^>]+>", " "), r"(?U)\s+", " ")))


def fixed(digits: int):
    """Arrow function: a number with ``digits`` decimals as C would round it; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return _each(s, lambda x: f"{x:.{digits}f}")

    return run


@F.pandas_udf(T.StringType())
def significant(s: pd.Series) -> pd.Series:
    """Six significant digits, exponents as in C."""
    return _each(s, lambda x: f"{x:.6g}")


fixed1, fixed2, fixed4 = fixed(1), fixed(2), fixed(4)


def value_text(c: Column, numeric: bool, style: str = "g") -> Column:
    """A value for a prompt: rendered number or stripped text, 'missing' for none."""
    if not numeric:
        s = strip(c.cast("string"))
        return F.when(s.isNull() | (s == ""), "missing").otherwise(s)
    known = F.when(~F.isnan(c), c)
    return F.coalesce(significant(known) if style == "g" else fixed4(known), F.lit("missing"))


def percent_text(c: Column) -> Column:
    return F.coalesce(F.concat(fixed1(c), F.lit("%")), F.lit("N/A"))


def number_text(c: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    return F.coalesce(F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(fixed2(c)), F.lit("N/A"))


FEATURES, DESCRIPTION = "[Structured Risk Features]", "[Borrower Description]"


def feature_text(columns: list[tuple[str, Column]], description: Column | None = None) -> Column:
    """Lines 'name: value' under a heading, then the description under its own."""
    parts = [F.lit(FEATURES), *[F.concat(F.lit(f"{n}: "), v) for n, v in columns]]
    if description is not None:
        d = strip(description)
        parts += [F.lit(""), F.lit(DESCRIPTION), F.when(d.isNull() | (d == ""), "missing").otherwise(d)]
    return F.concat_ws("\n", *parts)


def profile_text(sections: list[tuple[str, list[tuple[str, Column]]]], description: Column) -> Column:
    """Titled sections of labelled values, parted by blank lines, with the description last."""
    parts = []
    for title, fields in sections:
        parts += [F.lit(f"[{title}]"), *[F.concat(F.lit(f"{label}: "), v) for label, v in fields], F.lit("")]
    d = strip(description)
    parts += [F.lit(DESCRIPTION), F.when(d.isNull() | (d == "") | (F.lower(d) == "nan"), "missing").otherwise(d), F.lit("")]
    return F.concat_ws("\n", *parts)


def parse_feature_text(c: Column) -> Column:
    """struct<features: map, description>: the inverse of ``feature_text``.

    Lines before any heading are ignored; of repeated names the last counts; 'null' lines of the
    description are dropped.
    """
    lines = F.transform(F.split(c, r"\r\n|[\n\r]"), strip)
    state = F.aggregate(
        lines,
        F.struct(F.lit("").alias("at"), F.array().cast("array<struct<k:string,v:string>>").alias("f"), F.array().cast("array<string>").alias("d")),
        lambda acc, x: F.when((x == FEATURES) | (x == DESCRIPTION), F.struct(x.alias("at"), acc["f"].alias("f"), acc["d"].alias("d")))
        .when(
            (acc["at"] == FEATURES) & x.contains(":"),
            F.struct(acc["at"].alias("at"), F.array_append(acc["f"], F.struct(strip(F.regexp_extract(x, r"^([^:]*):", 1)).alias("k"), strip(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v"))).alias("f"), acc["d"].alias("d")),
        )
        .when((acc["at"] == DESCRIPTION) & (x != "") & (F.lower(x) != "null"), F.struct(acc["at"].alias("at"), acc["f"].alias("f"), F.array_append(acc["d"], x).alias("d")))
        .otherwise(acc),
    )
    # Later entries win: keep those whose name does not come again.
    n = F.size(state["f"])
    last = F.filter(state["f"], lambda e, i: ~F.exists(F.slice(state["f"], i + 2, F.greatest(n - i - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    return F.when(c.isNotNull(), F.struct(F.map_from_entries(last).alias("features"), strip(F.array_join(state["d"], " ")).alias("description")))


def _last_object(text: str) -> str | None:
    text = re.sub(r"```json\s*", "", text.strip(), flags=re.I).replace("```", "")
    end = text.rfind("}")
    at = text.rfind("{", 0, end + 1) if end >= 0 else -1
    while at >= 0:
        try:
            found = json.loads(text[at : end + 1])
        except ValueError:
            at = text.rfind("{", 0, at) if at else -1
            continue
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None
    return None


@F.pandas_udf(T.StringType())
def last_json(s: pd.Series) -> pd.Series:
    """The last JSON object of a response, rendered anew; null if there is none."""
    return _each(s, _last_object)


def think_block(c: Column) -> Column:
    """What stands between the first pair of think tags, stripped; null if nothing does."""
    inner = strip(F.regexp_extract(c, r"(?is)<think>(.*?)</think>", 1))
    return F.when(inner != "", inner)


def risk_level(c: Column) -> Column:
    """'high' or 'low' by the words of a risk statement; high wins, else 'unknown'."""
    t = F.lower(c)
    says = lambda level: t.rlike(rf'"risk": ?"{level}"|risk: {level}|{level} risk')
    high, low = says("high"), says("low")
    return F.when(high, "high").when(low, "low").otherwise("unknown")


def _field(obj: Column, name: str) -> Column:
    return F.coalesce(F.lower(strip(F.get_json_object(obj, f"$.{name}"))), F.lit(""))


def decision_label(raw: Column, obj: Column) -> Column:
    """1 for reject: by decision, then risk_level, then risk, then the words of the text."""
    decision, level, risk = _field(obj, "decision"), _field(obj, "risk_level"), _field(obj, "risk")
    return (
        F.when(decision == "reject", 1).when(decision == "approve", 0).when(level == "high", 1).when(level == "low", 0).when(risk == "high", 1).when(risk == "low", 0).when(risk_level(raw) == "high", 1).otherwise(0)
    )


def action_and_status(raw: Column, obj: Column) -> Column:
    """struct<action, status>: the JSON action, else the first keyword, else approve."""
    action, low = _field(obj, "action"), F.lower(strip(F.coalesce(raw, F.lit(""))))
    r, a = F.locate("reject", low), F.locate("approve", low)
    pick = lambda act, status: F.struct(F.lit(act).alias("action"), F.lit(status).alias("status"))
    return (
        F.when(action.isin("reject", "approve"), F.struct(action.alias("action"), F.lit("json_action").alias("status")))
        .when((r > 0) & (a > 0) & (r <= a), pick("reject", "text_both_first_reject"))
        .when((r > 0) & (a > 0), pick("approve", "text_both_first_approve"))
        .when(r > 0, pick("reject", "text_reject"))
        .when(a > 0, pick("approve", "text_approve"))
        .otherwise(pick("approve", "fallback_default_approve"))
    )


def parsed_response(raw: Column, obj: Column) -> Column:
    """struct<action, label, reason, status> of a response that should be JSON with reason and action.

    status: ok_json, fallback_from_text_no_json, fallback_from_text_bad_json_action or
    fallback_default_approve.  In the text, reject is looked for first.
    """
    action, low = _field(obj, "action"), F.lower(F.coalesce(raw, F.lit("")))
    sound = action.isin("reject", "approve")
    said = F.when(low.contains("reject"), "reject").when(low.contains("approve"), "approve")
    chosen = F.when(sound, action).otherwise(F.coalesce(said, F.lit("approve")))
    status = F.when(sound, "ok_json").when(said.isNull(), "fallback_default_approve").when(obj.isNull(), "fallback_from_text_no_json").otherwise("fallback_from_text_bad_json_action")
    reason = F.coalesce(strip(F.get_json_object(obj, "$.reason")), F.lit(""))
    return F.struct(chosen.alias("action"), action_label(chosen).alias("label"), reason.alias("reason"), status.alias("status"))


def action_label(action: Column, unknown: int | None = None) -> Column:
    """1 for reject, 0 for approve, ``unknown`` for anything else (none, or 0 in the tolerant variant)."""
    word = F.lower(strip(action))
    return F.when(word == "reject", 1).when(word == "approve", 0).otherwise(F.lit(unknown).cast("int"))


def label_action(label: Column) -> Column:
    return F.when(label == 1, "reject").otherwise("approve")


def logprob_audit(reject: Column, approve: Column, threshold: float) -> Column:
    """The two candidates' log-probabilities, their difference and the threshold in one line."""
    six = fixed(6)
    return F.concat(F.lit("logprob(reject)="), six(reject), F.lit("; logprob(approve)="), six(approve), F.lit("; delta="), six(reject - approve), F.lit(f"; threshold={threshold:.6f}"))


def teacher_check(raw: Column, obj: Column, label: Column) -> Column:
    """struct<ok, reason, normalized>: whether a teacher response can be used for a label."""
    think, decision = think_block(raw), _field(obj, "decision")
    n = F.coalesce(F.json_array_length(F.get_json_object(obj, "$.reasons")), F.lit(0))
    bad = (
        F.when(think.isNull(), "missing_think")
        .when(obj.isNull(), "missing_or_bad_json")
        .when(~decision.isin("approve", "reject"), "bad_decision")
        .when((label == 1) & (decision != "reject") | (label == 0) & (decision != "approve"), "label_mismatch")
        .when(n == 0, "missing_reasons")
    )
    return F.struct(bad.isNull().alias("ok"), F.coalesce(bad, F.lit("ok")).alias("reason"), F.when(bad.isNull(), F.concat(F.lit("<think>\n"), think, F.lit("\n</think>\n\n"), obj)).otherwise("").alias("normalized"))


def reason_text(raw: Column, obj: Column) -> Column:
    """The 'reason' of a JSON response, else the text without code fences."""
    reason = strip(F.get_json_object(obj, "$.reason"))
    bare = strip(F.regexp_replace(raw, r"(?i)```(?:json)?", ""))
    return F.when(reason != "", reason).otherwise(bare)
