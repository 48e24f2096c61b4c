"""The tables behind the queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.parsing import issue_year, null_if_nan
from scoreloom.operators.cleaning import finished

# Inputs of models by type (fixed values).
NUMERIC = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc", "emp_length_years", "term_months", "fico_mean"]
CATEGORICAL = ["grade", "home_ownership", "verification_status", "purpose", "addr_state"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "accepted_2007_to_2018q4")


def loans(spark: SparkSession, sf: str) -> DataFrame:
    """Finished loans with target and issue year."""
    return finished(accepted(spark, sf)).withColumn("issue_year", issue_year(F.col("issue_d")))


LOANS = """loans AS (SELECT *, CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS target, try_cast(nullif(regexp_extract(issue_d, '((19|20)[0-9]{2})', 1), '') AS INTEGER) AS issue_year
  FROM accepted_2007_to_2018q4 WHERE loan_status IN ('Fully Paid', 'Charged Off'))"""


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "shared_split")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Split rows with a plain score in [0, 1], for measures that only need some score."""
    v = lambda c: F.coalesce(null_if_nan(F.col(c)), F.lit(0.0))
    s = (2 * v("int_rate") + 0.5 * v("dti") + 0.1 * v("revol_util")) / 100.0
    return split_rows(spark, sf).select("_shared_row_id", "load_no", "split", "target", "issue_year", F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), 6).alias("score"))


SCORED = """scored AS (SELECT _shared_row_id, load_no, split, target, issue_year, round(least(greatest((2 * coalesce(CASE WHEN NOT isnan(int_rate) THEN int_rate END, 0)
    + 0.5 * coalesce(CASE WHEN NOT isnan(dti) THEN dti END, 0) + 0.1 * coalesce(CASE WHEN NOT isnan(revol_util) THEN revol_util END, 0)) / 100.0, 0.0), 1.0), 6) AS score FROM shared_split)"""


def clean_sql(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN {c} END"
