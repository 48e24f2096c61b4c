"""Column expressions that read messy values: missing marks, numbers, terms, years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|infinity)\s*$"
# What a CSV round trip turns into a missing value (fixed values).
CSV_MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def strip(c: Column) -> Column:
    """The text without white space of any script at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def non_missing(c: Column, text: bool) -> Column:
    """True for a value; blank texts and the word 'nan' are none, nor is a NaN number."""
    if text:
        return F.coalesce((strip(c) != "") & (F.lower(strip(c)) != "nan"), F.lit(False))
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def csv_missing_to_null(c: Column) -> Column:
    """Null for the words that a CSV reader takes as missing."""
    return F.when(~c.isin(CSV_MISSING), c)


def number(c: Column) -> Column:
    """The whole text as a number, or null ('12d' is no number); NaN is null."""
    return F.when(F.lower(c).rlike(NUMBER), strip(c).try_cast("double"))


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_float(c: Column) -> Column:
    """A number with percent signs and thousands commas taken out; none, null, nan and blank are null."""
    word = F.lower(strip(c))
    return F.when(~word.isin("", "none", "null", "nan"), number(F.translate(strip(c), "%,", "")))


def first_integer(c: Column) -> Column:
    return F.when(c.rlike(r"\d"), F.regexp_extract(c, r"(\d+)", 1)).try_cast("double")


def emp_length_years(c: Column) -> Column:
    """'< 1 year' is 0.5, else the first integer."""
    return F.when(F.lower(c).contains("< 1"), F.lit(0.5)).otherwise(first_integer(c))


def term_months(c: Column) -> Column:
    return first_integer(c)


def issue_year(c: Column) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.when(c.rlike(r"(19|20)\d{2}"), F.regexp_extract(c, r"((19|20)\d{2})", 1)).try_cast("int")


def fico_mean(low: Column, high: Column) -> Column:
    return (low.cast("double") + high.cast("double")) / 2


def ratio_tag(ratio: float) -> str:
    """Name part of a sampled file: full, 5pct, 0_1pct."""
    r = min(1.0, max(0.0, float(ratio)))
    return "full" if abs(r - 1) < 1e-9 else f"{r * 100:g}pct".replace(".", "_")


def slug(name: str) -> str:
    """Lower-case letters and digits joined by single underscores; 'custom_model' if none is left."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "custom_model"
