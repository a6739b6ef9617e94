"""What the training-data operators share: the shared folder, words, and ordered running sums.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``; it is visible
to the driver and to every executor, so a lost executor costs a re-read and never a result.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek import session

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in one Arrow batch. A batch of texts stays at some megabytes; very long texts have a byte bound besides.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


#: The folder that all machines share.
shared_dir = session.workspace


def small_batches(spark: SparkSession) -> None:
    """Ships the package to Python workers and bounds the Arrow batches that they get, unless the session has lower bounds already."""
    session.ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


_scopes = threading.local()


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and fixes what was computed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomseek/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if open_ := getattr(_scopes, "open", None):
        open_[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path_ = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables staged within, but for those given to the function it yields: those that a result still reads."""
    open_ = _scopes.open = getattr(_scopes, "open", [])
    open_.append([])
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.staged_path_)
        return df

    try:
        yield keep
    finally:
        mine = open_.pop()
        if open_:
            open_[-1].extend(p for p in mine if p in kept)
        for path in mine:
            if path not in kept:
                _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again."""
    _delete(df.sparkSession, df.staged_path_)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: What names a row of a Parquet table, whatever columns are read and however files are split.
FILE, PLACE = "__file", "__place"


def located(docs: DataFrame) -> DataFrame:
    """docs with FILE and PLACE, which are the same in every scan. What is not a plain Parquet table is written first."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in plan.toString().split("\n")[0]:
        docs = staged(docs, "input")
    place = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(place["file_path"]).alias(FILE), place["row_index"].alias(PLACE))


def quoted(name: str) -> str:
    """A column's name as a reference to it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """A 256-bit key that equal texts share; null is a text of its own, apart from the empty one."""
    return F.unhex(F.sha2(F.concat(F.when(text.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(text, F.lit(""))), 256))


def crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


#: 64-bit words of a sieve: a bitmap of fixed size, so what is broadcast is bounded however much is wanted.
SIEVE_WORDS = 1 << 18


def sieve(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key is not in wanted (one column), before a join shuffles them.

    A bitmap of hashes, of at most SIEVE_WORDS rows, is broadcast; rows that pass by chance are left to the join.
    """
    place = lambda k: (F.pmod(F.shiftrightunsigned(F.xxhash64(k), 6), F.lit(SIEVE_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(k), F.lit(64)).cast("int")))
    word, bit = place(F.col(wanted.columns[0]))
    words = wanted.select(word.alias("word_"), bit.alias("bit_")).groupBy("word_").agg(F.bit_or("bit_").alias("bits_"))
    word, bit = place(key)
    return rows.join(F.broadcast(words), (word == F.col("word_")) & (F.col("bits_").bitwiseAND(bit) != 0), "left_semi")


def texts_at(docs: DataFrame, wanted: DataFrame, *carry: str) -> DataFrame:
    """(row_, text_) of the located docs' rows in wanted (row_, file_, place_), with its columns ``carry``: texts in UTF-8, null as empty."""
    texts = docs.select(F.col(FILE).alias("of_file_"), F.col(PLACE).alias("of_place_"), F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text_"))
    key = wanted.select(F.xxhash64("file_", "place_").alias("key_"))
    some = sieve(texts, F.xxhash64("of_file_", "of_place_"), key)
    return some.join(wanted, (F.col("of_file_") == F.col("file_")) & (F.col("of_place_") == F.col("place_"))).select("row_", *carry, "text_")


def in_order(df: DataFrame, order: Sequence[str], sums: Sequence[str], within: str | None = None) -> DataFrame:
    """Adds, by the global order of the columns ``order``, inclusive running sums ``run_<c>`` of the columns ``sums``.

    Rows are dealt by ranges of the order, so no key needs to fit in one task; each task sums its own range
    in a stream of batches, and the totals of the ranges (one row for each, and for each value of ``within``
    in it) are added afterwards. With ``within``, the first column of the order, sums start anew for each of its values.
    ``order`` should end in a column that differs between rows, or a large group of ties lands in one task.
    """
    small_batches(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*df.schema.fields, T.StructField("part_", T.IntegerType()), *(T.StructField(f"run_{c}", T.LongType()) for c in sums)])
    local = staged(ranged.mapInArrow(_running(list(sums), within), schema), "ordered")
    by = [within] if within else []
    totals = local.groupBy("part_", *by).agg(*(F.max(f"run_{c}").alias(f"sum_{c}") for c in sums))
    offsets = _offsets(totals, sums, within)
    same = local["part_"] == offsets["at_"]
    if within:
        same &= local[within].eqNullSafe(offsets["of_"])
    out = local.join(offsets, same)
    return out.select(*(local[c] for c in df.columns), *((local[f"run_{c}"] + offsets[f"off_{c}"]).alias(f"run_{c}") for c in sums))


def _offsets(totals: DataFrame, sums: Sequence[str], within: str | None) -> DataFrame:
    """What stands before each range: by a window over the ranges, of each value of ``within`` apart."""
    before = Window.partitionBy(*([within] if within else [])).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("part_").alias("at_"), *([F.col(within).alias("of_")] if within else []), *(F.coalesce(F.sum(f"sum_{c}").over(before), F.lit(0).cast("long")).alias(f"off_{c}") for c in sums))


def _running(sums: list[str], within: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry, last = TaskContext.get().partitionId(), dict.fromkeys(sums, 0), object()
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            if within:
                keys = b.column(b.schema.get_field_index(within)).to_pylist()
                starts = np.fromiter((k != p for k, p in zip(keys, [last, *keys[:-1]], strict=True)), bool, n)
                last = keys[-1]
            else:
                starts = np.zeros(n, bool)
            at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            cols = []
            for c in sums:
                total = np.cumsum(b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64))
                base = np.where(at > 0, total[np.maximum(at - 1, 0)], np.where(at == 0, 0, -carry[c]))
                got = total - base
                carry[c] = int(got[-1])
                cols.append(pa.array(got))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), *cols], names=[*b.schema.names, "part_", *(f"run_{c}" for c in sums)])

    return run
