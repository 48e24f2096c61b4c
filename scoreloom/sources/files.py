"""Sources and sinks."""

from __future__ import annotations

import hashlib
import json
import math
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.parsing import csv_missing_to_null, number
from scoreloom.operators import splits

# Columns of the raw table by type (fixed values).
RAW_NUMBERS = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "fico_range_low", "fico_range_high", "revol_bal", "revol_util", "open_acc", "pub_rec", "total_acc"]
RAW_TEXTS = ["term", "grade", "sub_grade", "emp_length", "home_ownership", "verification_status", "purpose", "addr_state", "application_type"]
RAW_COLUMNS = sorted([*RAW_NUMBERS, *RAW_TEXTS, "desc", "loan_status", "issue_d"])


def read_raw_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The known columns of a raw CSV, typed; unknown columns are not parsed, absent ones are left out.

    Quoted line breaks make such a file unsplittable, so it should be read once and kept as Parquet
    (``ingest``).  Words that a CSV round trip takes as missing are null.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    keep = [c for c in (columns or RAW_COLUMNS) if c in raw.columns]
    typed = [number(F.col(f"`{c}`")).alias(c) if c in RAW_NUMBERS else csv_missing_to_null(F.col(f"`{c}`")).alias(c) for c in keep]
    return raw.select(*typed)


def ingest(spark: SparkSession, csv: str, parquet: str) -> DataFrame:
    """A raw CSV as Parquet with an order column, written once."""
    read_raw_csv(spark, csv).withColumn("_ord", F.monotonically_increasing_id()).write.mode("overwrite").parquet(parquet)
    return spark.read.parquet(parquet)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """One atomic write in place of what was there."""
    w = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        w = w.option("header", True).option("escape", '"')
    (w.partitionBy(*by) if by else w).save(path)


def write_chat(df: DataFrame, sample: str, path: str) -> None:
    """Chat samples as JSON lines."""
    df.select(F.to_json(sample).alias("value")).write.mode("overwrite").text(path)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    turn = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
    return spark.read.schema(T.StructType([T.StructField("system", T.StringType()), T.StructField("conversations", T.ArrayType(turn))])).json(path)


def plain(value):
    """A report value as valid JSON: numbers that JSON lacks become null."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def write_report(path: str, report: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain(report), indent=2, ensure_ascii=False), encoding="utf-8")


def read_features(path: str, columns: list[str]) -> list[str]:
    """Selected features of a report that are among the columns."""
    report = json.loads(Path(path).read_text(encoding="utf-8"))
    names = [*(report.get("selected_numeric_columns") or []), *(report.get("selected_categorical_columns") or [])]
    return [n for n in names if n in columns]


def fingerprint(df: DataFrame, key: str, **settings) -> str:
    """Digest of the rows' ids and of the settings, by a sum of hashes in any order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.blake2b(json.dumps([row.n, str(row.s), sorted(settings.items())], default=str).encode(), digest_size=12).hexdigest()


def split_directory(df: DataFrame, path: str, key: str, target: str, **settings) -> DataFrame:
    """The split written to a path by ``split``, or read if it is there and of the same rows and settings."""
    spark = df.sparkSession
    mark = fingerprint(df, key, target=target, **settings)
    note = os.path.join(path, "_split.json")
    if os.path.exists(note):
        if json.loads(Path(note).read_text())["fingerprint"] != mark:
            raise ValueError(f"{path} holds a split of other rows or settings")
        return spark.read.parquet(path)
    splits.stratified_split(df, key, target, **settings).write.mode("overwrite").partitionBy("split").parquet(path)
    write_report(note, {"fingerprint": mark, "settings": settings})
    return spark.read.parquet(path)


# Settings of a fine-tuning job (fixed values).
JOB = {"stage": "sft", "finetuning_type": "lora", "lora_rank": 8, "quantization_bit": 4, "lr_scheduler_type": "cosine", "warmup_ratio": 0.1}


def write_training_job(folder: str, name: str, dataset: str, model: str, command: str = "python -m trainer", **settings) -> list[str]:
    """A fine-tuning job: a copy of the data set and its entry, settings as YAML, a launch script; returns the files.

    dataset: a JSON lines file, or the folder that ``write_chat`` wrote, whose parts are joined.
    """
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    source, copy = Path(dataset), at / f"{name}.jsonl"
    if source.exists() and source.resolve() != copy.resolve():
        with copy.open("wb") as out:
            for part in sorted(source.glob("part-*")) if source.is_dir() else [source]:
                with part.open("rb") as piece:
                    shutil.copyfileobj(piece, out)
    job = {"model_name_or_path": model, "dataset": name, "dataset_dir": str(at)} | JOB | settings
    yaml, info, script = at / f"{name}.yaml", at / "dataset_info.json", at / f"{name}.sh"
    yaml.write_text("".join(f"{k}: {str(v).lower() if isinstance(v, bool) else v}\n" for k, v in job.items()), encoding="utf-8")
    known = json.loads(info.read_text(encoding="utf-8")) if info.exists() else {}
    known[name] = {"file_name": copy.name if copy.exists() else dataset, "formatting": "sharegpt", "columns": {"messages": "conversations", "system": "system"}}
    info.write_text(json.dumps(known, indent=2), encoding="utf-8")
    script.write_text(f"#!/bin/sh\nset -e\nexec {command} {yaml.name}\n", encoding="utf-8")
    script.chmod(0o755)
    return [str(yaml), str(info), str(script), *([str(copy)] if copy.exists() else [])]
