"""Joins by row identity, and unions by column name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import checkpointed


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the one first in order; rows with a null key are one key.

    An aggregate with map-side combine, so a key of any number of rows is no one task's.
    """
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), order).alias("_row")).select("_row.*")


def missing_ids(split: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Keys of the split that the base lacks."""
    return split.select(key).join(base.select(key), key, "left_anti")


def realign(split: DataFrame, base: DataFrame, key: str, order: str, strict: bool = True) -> DataFrame:
    """The base's columns in the rows of the split; an error if an id is missing and ``strict``."""
    first = keep_first(base, key, order)
    if strict and missing_ids(split, first, key).limit(1).count():
        raise ValueError("ids of the split are missing in the base")
    own = [c for c in split.columns if c not in base.columns]
    return split.select(key, *own).join(first, key)


def with_predictions(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Labels with their predictions and a mark where there is none."""
    p = predictions.withColumn("_has", F.lit(True))
    return labels.join(p, key, "left").withColumn("missing_prediction", F.col("_has").isNull()).drop("_has")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def row_ids(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """Rows numbered from 0 in order, range by range, so that no task orders all rows.

    The order column must be unique.  Ranges come from a sorted shuffle; the counts of the ranges,
    a short list, are added up.
    """
    ranged = df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()).sortWithinPartitions(order)
    ranged = checkpointed(ranged)
    sizes = ranged.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("_p")) - F.col("count")).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return ranged.withColumn("_i", inside).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i") - 1).drop("_p", "_i", "_b")
