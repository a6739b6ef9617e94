"""What changed between two snapshots of files (path, digest)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(current: DataFrame, old: DataFrame) -> DataFrame:
    """Files that are new or have another digest."""
    before = old.select(F.col("path").alias("path_"), F.col("digest").alias("digest_"))
    return current.join(before, F.col("path") == F.col("path_"), "left").where(~F.col("digest").eqNullSafe(F.col("digest_"))).select(*current.columns)


def deleted(current: DataFrame, old: DataFrame) -> DataFrame:
    """Files that are gone."""
    return old.join(current.select("path"), "path", "left_anti").select(*old.columns)


def affected(old: DataFrame, only: list[str]) -> DataFrame:
    """Files that are one of the paths or lie under one; the paths are a request's, at most 100."""
    if len(only) > 100:
        raise ValueError("a request names at most 100 paths")
    test = F.lit(False)
    for p in only:
        test = test | (F.col("path") == p) | F.col("path").startswith(f"{p}/")
    return old.where(test)


def survivors(rows: DataFrame, gone: DataFrame, key: str = "file") -> DataFrame:
    """Rows of files that neither changed nor went."""
    return rows.join(gone.select(F.col("path").alias(key)).distinct(), key, "left_anti").select(*rows.columns)
