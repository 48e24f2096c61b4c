"""Row and column filters of ingest, and the report of what they dropped."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.parsing import issue_year, non_missing, null_if_nan, strip

PAID, CHARGED_OFF = "Fully Paid", "Charged Off"
# Presets of the published subset rules (fixed values).
PRESETS = {
    "default": {"grades": ["D", "E", "F", "G"], "least_rate": 16.0, "most_income": 50_000.0},
    "published": {"grades": ["E", "F", "G"], "least_rate": 18.5, "most_income": 92_500.0},
}


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """An error naming the columns that are missing."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")


def first_present(df: DataFrame, candidates: Iterable[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


def ordered_unique(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns that exist, each once, in the order given."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


def finished(df: DataFrame, status: str = "loan_status", text: str | None = None) -> DataFrame:
    """Paid and charged-off rows with ``target``; with ``text``, only rows that have one."""
    out = df.where(F.col(status).isin(PAID, CHARGED_OFF))
    if text:
        out = out.where(F.coalesce(F.length(strip(F.col(f"`{text}`"))) > 0, F.lit(False)))
    return out.withColumn("target", (F.col(status) == CHARGED_OFF).cast("int"))


def present(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    text = isinstance(kind, T.StringType)
    numeric = isinstance(kind, T.NumericType)
    c = F.col(f"`{column}`")
    return non_missing(c, text) if text or numeric else c.isNotNull()


def required(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows in which every named column that exists has a value."""
    for c in columns:
        if c in df.columns:
            df = df.where(present(df, c))
    return df


def missing_ratios(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_rows, n_missing, missing_ratio), one aggregate for all columns."""
    columns = columns or df.columns
    n = F.count(F.lit(1)).alias("n_rows")
    sums = df.agg(n, *[F.count_if(~present(df, c)).alias(f"m{i}") for i, c in enumerate(columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(columns)]))
    return sums.select("n_rows", rows.alias("x")).select("x.column_name", "n_rows", "x.n_missing", F.try_divide("x.n_missing", "n_rows").alias("missing_ratio"))


def constants(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, is_constant): whether a column has at most one value, null counting as one.

    Least and greatest value and the null count tell; no distinct values are gathered.
    """
    columns = columns or df.columns
    clean = {c: null_if_nan(F.col(f"`{c}`")) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{c}`") for c in columns}
    n = F.count(F.lit(1))
    tests = [((F.count(v) == 0) | ((F.count(v) == n) & (F.min(v) == F.max(v)))).alias(f"c{i}") for i, v in enumerate(clean.values())]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(f"c{i}"), F.lit(True)).alias("is_constant")) for i, c in enumerate(columns)]))
    return df.agg(*tests).select(rows.alias("x")).select("x.*")


def clean(df: DataFrame, required_columns: Iterable[str] = (), drop: Iterable[str] = (), drop_constant: bool = True, most_missing: float | None = None, protect: Iterable[str] = ()) -> tuple[DataFrame, dict]:
    """(rows, report): required values, then named, then mostly missing, then constant columns.

    Data-dependent drops take one aggregate each; protected columns stay.
    """
    protect = set(protect)
    rows = required(df, required_columns)
    counts = df.agg(F.count(F.lit(1)).alias("n")).first().n, rows.agg(F.count(F.lit(1)).alias("n")).first().n
    gone = {"named": [c for c in dict.fromkeys(drop) if c in rows.columns and c not in protect]}
    rows = rows.drop(*gone["named"])
    if most_missing is not None:
        gone["missing"] = sorted(r.column_name for r in missing_ratios(rows).collect() if (r.missing_ratio or 0) > most_missing and r.column_name not in protect)
        rows = rows.drop(*gone["missing"])
    if drop_constant:
        gone["constant"] = sorted(r.column_name for r in constants(rows).collect() if r.is_constant and r.column_name not in protect)
        rows = rows.drop(*gone["constant"])
    return rows, {"rows_before": counts[0], "rows_after": counts[1], "rows_dropped": counts[0] - counts[1], **{f"dropped_{k}": v for k, v in gone.items()}}


def subset(df: DataFrame, grades: list[str], least_rate: float, most_income: float) -> DataFrame:
    """Rows of the grades (upper case, trimmed) with at least the rate and at most the income."""
    return df.where(F.upper(F.trim("grade")).isin(grades) & (null_if_nan(F.col("int_rate")) >= least_rate) & (null_if_nan(F.col("annual_inc")) <= most_income))


def years(df: DataFrame, column: str, first: int, last: int) -> DataFrame:
    return df.where(F.col(column).between(first, last))


def head(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows by an order column; all if n is not given."""
    return df.orderBy(order).limit(n) if n else df


def fill_blank(df: DataFrame, column: str, word: str = "missing") -> tuple[DataFrame, int]:
    """(rows with blank texts replaced by a word, how many were)."""
    c = F.col(f"`{column}`")
    blank = F.coalesce(strip(c) == "", F.lit(True))
    filled = df.agg(F.count_if(blank).alias("n")).first().n
    return df.withColumn(column, F.when(blank, word).otherwise(c)), filled


def capped_scan(df: DataFrame, order: str, keep: Column, most: int | None = None, chunks: int | None = None, chunk: int = 120_000) -> tuple[DataFrame, dict]:
    """(kept rows, counters): the first ``most`` kept rows in order, of at most ``chunks`` chunks of the table.

    order must number the rows from 0.  rows_seen counts what was scanned, rows_kept what is left.
    """
    seen = df.where(F.col(order) < chunks * chunk) if chunks else df
    kept = seen.where(keep)
    if most:
        kept = kept.orderBy(order).limit(most)
    return kept, {"rows_seen": seen.count(), "rows_kept": kept.count()}


def with_year(df: DataFrame, column: str = "issue_year", source: str = "issue_d") -> DataFrame:
    """The rows with the year, derived from the date text where the column is absent."""
    return df if column in df.columns else df.withColumn(column, issue_year(F.col(source)))


#: Columns that say how a loan ended or only name it, which a model must not read (fixed values).
LEAKAGE = ["loan_status", "target", "total_pymnt", "recoveries", "last_pymnt_d", "last_pymnt_amnt", "out_prncp"]
RESERVED = ["_shared_row_id", "loan_id", "load_no", "loaded_at", "partner_ref", "source", "split", "target", "desc", "desc_clean", "issue_d", "issue_year"]


def without_leakage(df: DataFrame, more: Iterable[str] = ()) -> DataFrame:
    return df.drop(*[c for c in [*LEAKAGE, *more] if c in df.columns])


def roles(df: DataFrame, reserved: Iterable[str] = RESERVED) -> dict[str, list[str]]:
    """Numeric and categorical inputs by type, in the order of the columns; reserved ones are neither."""
    reserved = set(reserved)
    numeric = [f.name for f in df.schema if f.name not in reserved and isinstance(f.dataType, T.NumericType)]
    return {"numeric": numeric, "categorical": [f.name for f in df.schema if f.name not in reserved and isinstance(f.dataType, (T.StringType, T.BooleanType))]}
