"""Queries of the operators for text and for training data, with SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import bpe, leakage, overlap, pii, quota_sample, residue

#: Folder of the public tokenizers' vocabulary files; a setting, as the files are not part of the repository.
TOKENIZERS = os.environ.get("SCORELOOM_TOKENIZERS", "/opt/tokenizers")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    desc = pii.texts_of(_table(spark, sf, "accepted_2007_to_2018q4"), "accepted_2007_to_2018q4", "_shared_row_id", "desc")
    turns = pii.turns_of(_table(spark, sf, "credit_teacher_action_0_1pct"), "credit_teacher_action_0_1pct", "sample_id", "conversations", "value")
    return desc.unionByName(turns)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_items(_texts(spark, sf)).select("table_name", "record_id", "turn_no", "pii_type", "item_no")


def p1_masked(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_items(_texts(spark, sf), with_text=True)


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    """Finished loans of each load, each in its last delivery there."""
    raw = _table(spark, sf, "accepted_2007_to_2018q4").where("loan_id IS NOT NULL")
    last = raw.groupBy("load_no", "loan_id").agg(F.max_by(F.struct("loan_status", "grade", "_shared_row_id"), "_shared_row_id").alias("r"))
    target = F.when(F.col("r.loan_status") == "Fully Paid", "0").when(F.col("r.loan_status") == "Charged Off", "1")
    return last.select("load_no", "loan_id", F.col("r._shared_row_id").alias("_shared_row_id"), F.upper(F.trim("r.grade")).alias("grade"), target.alias("target")).where("target IS NOT NULL")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Categories that the drawn sample lacks because there are too few eligible loans."""
    return p4_report(spark, sf).where("short_by > 1e-9 AND NOT attainable").select("load_no", "dimension", "category")


P4_FOUND = """
WITH last AS (
  SELECT load_no, loan_id, arg_max(struct_pack(s := loan_status, g := grade), _shared_row_id) AS r
  FROM accepted_2007_to_2018q4 WHERE loan_id IS NOT NULL GROUP BY load_no, loan_id),
eligible AS (
  SELECT load_no, upper(trim(r.g)) AS grade, CASE r.s WHEN 'Fully Paid' THEN '0' ELSE '1' END AS target
  FROM last WHERE r.s IN ('Fully Paid', 'Charged Off')),
have AS (
  SELECT load_no, 'grade' AS dimension, grade AS category, count(*) AS n FROM eligible GROUP BY 1, 3
  UNION ALL SELECT load_no, 'target', target, count(*) FROM eligible GROUP BY 1, 3)
SELECT t.load_no, t.dimension, t.category FROM sample_targets t
LEFT JOIN have h ON h.load_no = t.load_no AND h.dimension = t.dimension AND h.category = t.category
WHERE coalesce(h.n, 0) < greatest(t.min_rows, t.target_share * t.sample_rows) - 1e-9
"""


def p4_sample(spark: SparkSession, sf: str) -> DataFrame:
    eligible = overlap.kept(_eligible(spark, sf))
    quota, _ = quota_sample.plan(eligible, _table(spark, sf, "sample_targets"), "load_no", ("grade", "target"))
    return quota_sample.draw(eligible, overlap.kept(quota), "load_no", ("grade", "target"), "loan_id")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    eligible, dims = overlap.kept(_eligible(spark, sf)), ("grade", "target")
    quota, report = quota_sample.plan(eligible, _table(spark, sf, "sample_targets"), "load_no", dims)
    quota = overlap.kept(quota)
    return quota_sample.judged(report, quota, quota_sample.draw(eligible, quota, "load_no", dims, "loan_id"), "load_no", dims)


P4_ASKED = P4_FOUND.replace("SELECT t.load_no, t.dimension, t.category FROM", "SELECT t.load_no, t.dimension, t.category, coalesce(h.n, 0) AS eligible, round(greatest(t.min_rows, t.target_share * t.sample_rows), 6) AS asked, coalesce(h.n, 0) >= greatest(t.min_rows, t.target_share * t.sample_rows) - 1e-9 AS attainable FROM").split("WHERE coalesce(h.n, 0) <")[0]


def p4_asked(spark: SparkSession, sf: str) -> DataFrame:
    """What the report says that does not depend on the draw."""
    return p4_report(spark, sf).select("load_no", "dimension", "category", "eligible", F.round("asked", 6).alias("asked"), "attainable")


P4_SIZES = P4_FOUND.split("SELECT t.load_no")[0] + """, wish AS (SELECT load_no, min(sample_rows) AS n FROM sample_targets GROUP BY 1), totals AS (SELECT t.load_no, t.dimension, sum(least(coalesce(h.n, 0), greatest(t.min_rows, t.target_share * w.n))) AS most
  FROM sample_targets t JOIN wish w USING (load_no) LEFT JOIN have h ON h.load_no = t.load_no AND h.dimension = t.dimension AND h.category = t.category GROUP BY 1, 2)
SELECT load_no, true AS within, true AS distinct_loans FROM (SELECT load_no, min(most) AS most FROM totals GROUP BY 1) WHERE most >= 1"""


def p4_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each load's sample is no larger than either dimension's targets and supply allow, and has no loan twice."""
    sample, report = p4_sample(spark, sf), p4_report(spark, sf)
    most = report.groupBy("load_no", "dimension").agg(F.sum(F.least("eligible", F.ceil("asked"))).alias("most")).groupBy("load_no").agg(F.min("most").alias("most"))
    drawn = sample.groupBy("load_no").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("loan_id").alias("d"))
    return drawn.join(most, "load_no").select("load_no", (F.col("n") <= F.col("most")).alias("within"), (F.col("n") == F.col("d")).alias("distinct_loans"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.cross_split_overlaps(_table(spark, sf, "shared_split"), "_shared_row_id", "desc_clean", "split", "train_fit")


def p5_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each split and source that tell a train_fit story, beside the reported train_fit rows of their loads."""
    rows = _table(spark, sf, "shared_split").select("_shared_row_id", "split", F.lower(F.trim("source")).alias("source"), "load_no")
    pairs = p5_found(spark, sf)
    held = pairs.select(F.explode(F.array("row_id_a", "row_id_b")).alias("_shared_row_id")).distinct()
    summary = _table(spark, sf, "split_summary")
    current = summary.groupBy("load_no").agg(F.max_by("train_fit", "written_at").alias("t")).select("load_no", F.col("t.rows").alias("train_fit_rows"))
    return rows.join(held, "_shared_row_id").where("split <> 'train_fit'").groupBy("split", "source", "load_no").agg(F.count(F.lit(1)).alias("overlapping_rows")).join(current, "load_no", "left")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(_table(spark, sf, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p6_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(_table(spark, sf, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", offsets=True)


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, sf, "documents"), "doc_id", "text", _table(spark, sf, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold test items, without the stretches that hold them."""
    spans = _leaks(spark, sf).groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans"), F.count(F.lit(1)).alias("n_items"))

    @F.pandas_udf("string")
    def clean(text, spans):  # noqa: ANN001, ANN202
        return text.combine(spans, lambda t, s: leakage.without_leaks(t, [(x["first_word"], x["end_word"]) for x in s]))

    return _table(spark, sf, "documents").select("doc_id", "text").join(spans, "doc_id").select("doc_id", "n_items", clean("text", "spans").alias("text_cleaned"))


def _residue(spark: SparkSession, sf: str) -> DataFrame:
    return residue.find_residue(_table(spark, sf, "documents"), "doc_id", "text", "source")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _residue(spark, sf).select("doc_id")


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus without the documents that are or hold residue."""
    return _table(spark, sf, "documents").join(_residue(spark, sf).select("doc_id"), "doc_id", "left_anti")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_masked, p4_found, p4_sample, p4_report, p4_asked, p4_sizes, p5_found, p5_by_source, p6_ids, p6_offsets, p7_found, p7_cleaned, p8_found, p8_kept)
}
ORACLES = {"p4_found": P4_FOUND, "p4_asked": P4_ASKED, "p4_sizes": P4_SIZES}
