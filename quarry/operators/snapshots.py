"""Differences between snapshots and keyed rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame, key: str = "file_path", value: str = "file_hash") -> DataFrame:
    """(key, status) with status added, modified, deleted or unchanged."""
    a, b = previous.select(key, F.col(value).alias("old")), current.select(key, F.col(value).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def changed(previous: DataFrame, current: DataFrame, key: str = "file_path", value: str = "file_hash") -> DataFrame:
    """Rows of current that are new or differ."""
    old = previous.select(key, F.col(value).alias("old"))
    return current.join(old, key, "left").where(F.col("old").isNull() | (F.col("old") != F.col(value))).drop("old")


def deleted(previous: DataFrame, current: DataFrame, key: str = "file_path") -> DataFrame:
    """Rows of previous whose key is gone."""
    return previous.join(current.select(key), key, "left_anti")


def last_wins(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key, the one with the highest order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """table with rows put in place of those with their keys."""
    return table.join(rows.select(*key).distinct(), list(key), "left_anti").unionByName(last_wins(rows.withColumn("seq_", F.monotonically_increasing_id()), key, "seq_").drop("seq_"))


def without_keys(table: DataFrame, gone: DataFrame, key: str = "file_path") -> DataFrame:
    """table without the rows of the given keys."""
    return table.join(gone.select(key).distinct(), key, "left_anti")
