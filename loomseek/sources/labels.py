"""Label sets: queries with expected spans, and the digests of the files they were made on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """source_snapshot struct<files: map<string, string>>, queries array<struct<id: string, query: string, split: string, category: string,
expected: array<struct<file: string, symbol: string, qualified_symbol: string, start: int, end: int, evidence_start: int, evidence_end: int, source_sha256: string>>>>"""


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a label file."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).head()["d"]


def seal(spark: SparkSession, path: str) -> str | None:
    """What the seal beside a label file says; None if there is none."""
    beside = spark._jvm.org.apache.hadoop.fs.Path(path.rsplit(".", 1)[0] + ".sha256")
    if not beside.getFileSystem(spark._jsc.hadoopConfiguration()).exists(beside):
        return None
    row = spark.read.text(beside.toString(), wholetext=True).head()
    return row["value"].strip() if row else ""


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """queries (qid, query, split, category), targets (qid, file, ...), manifest (path, digest)."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    q = raw.select(F.explode("queries").alias("q")).select("q.*")
    targets = q.select(F.col("id").alias("qid"), F.explode("expected").alias("t")).select("qid", "t.*")
    manifest = raw.select(F.explode("source_snapshot.files").alias("path", "digest"))
    return q.select(F.col("id").alias("qid"), "query", "split", "category"), targets, manifest
