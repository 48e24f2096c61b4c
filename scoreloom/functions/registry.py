"""The value functions for SQL users.

``register(spark)`` makes temporary SQL functions: expressions that Catalyst inlines like any other,
and the few Arrow functions that have no expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from scoreloom.functions import texts

EXPRESSIONS = {
    "strip_text(x STRING) RETURNS STRING": r"regexp_replace(x, '(?U)^\\s+|\\s+$', '')",
    "first_integer(x STRING) RETURNS DOUBLE": r"try_cast(nullif(regexp_extract(x, '(\\d+)', 1), '') AS DOUBLE)",
    "emp_length_years(x STRING) RETURNS DOUBLE": r"CASE WHEN lower(x) LIKE '%< 1%' THEN 0.5D ELSE try_cast(nullif(regexp_extract(x, '(\\d+)', 1), '') AS DOUBLE) END",
    "issue_year(x STRING) RETURNS INT": r"try_cast(nullif(regexp_extract(x, '((19|20)\\d{2})', 1), '') AS INT)",
    "gap_state(actual DOUBLE, target DOUBLE) RETURNS STRING": "CASE WHEN round(abs(actual - target), 9) <= 0.01 THEN 'stable' WHEN round(abs(actual - target), 9) <= 0.03 THEN 'warn' ELSE 'recalibrate' END",
    "think_block(x STRING) RETURNS STRING": r"nullif(regexp_replace(regexp_extract(x, '(?is)<think>(.*?)</think>', 1), '(?U)^\\s+|\\s+$', ''), '')",
}


def register(spark: SparkSession) -> list[str]:
    """Names of the functions that a session then has."""
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    arrow = {"last_json": texts.last_json, "format_fixed1": texts.fixed1, "format_fixed2": texts.fixed2, "format_fixed4": texts.fixed4, "format_significant": texts.significant}
    for name, f in arrow.items():
        spark.udf.register(name, f)
    return [*(h.split("(")[0] for h in EXPRESSIONS), *arrow]
