"""Immutable snapshots: one folder for each generation, current once its marker is there.

Tables are written first and the marker last, so readers see the old generation until the new one is whole, and a
failed refresh leaves the old one in place. Only Spark's file systems are used.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MARKER = "_COMMITTED"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def generations(spark: SparkSession, home: str) -> list[int]:
    """Whole generations, in order."""
    fs, p = _fs(spark, f"{home}/gen=*/{MARKER}")
    found = fs.globStatus(p) or []
    return sorted(int(re.search(r"gen=(\d+)", s.getPath().toString())[1]) for s in found)


Table = DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]


def publish(spark: SparkSession, home: str, tables: dict[str, Table], generation: int) -> int:
    """Writes the tables as a generation and makes it current. A table may be a function of the reader of those written before it."""
    base = f"{home}/gen={generation:09d}"
    fs, p = _fs(spark, base)
    if generation in generations(spark, home):
        raise ValueError(f"generation {generation} is there")
    fs.delete(p, True)  # what a failed attempt has left
    for name, table in tables.items():
        df = table if isinstance(table, DataFrame) else table(lambda written: spark.read.parquet(f"{base}/{written}"))
        df.write.parquet(f"{base}/{name}")
    fs.create(_fs(spark, f"{base}/{MARKER}")[1]).close()
    return generation


def read(spark: SparkSession, home: str, name: str, generation: int | None = None) -> DataFrame | None:
    """A table of the current (or a given) generation; None if there is none."""
    found = generations(spark, home)
    at = generation if generation is not None else found[-1] if found else None
    return None if at is None else spark.read.parquet(f"{home}/gen={at:09d}/{name}")


def expire(spark: SparkSession, home: str, keep: int = 2) -> None:
    """Deletes all generations but the last ones."""
    for g in generations(spark, home)[:-keep]:
        fs, p = _fs(spark, f"{home}/gen={g:09d}")
        fs.delete(p, True)
