"""Filters, exact symbols, dense vectors, fusion, deduplication, regular expressions and spans."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek import session
from loomseek.functions import text
from loomseek.operators.records import LOOSE_KINDS

#: The constant of reciprocal rank fusion, and limits of regular expressions and spans.
RRF_K = 60
#: Blocks of queries that one plan may hold.
FEW_BLOCKS = 8
RECORD_SECONDS, TASK_SECONDS = 0.02, 2.0
MAX_PATTERN, MAX_SPAN_LINES, DEFAULT_SPAN_LINES, MAX_SPAN_CHARS = 1000, 200, 40, 32_000


def eligible(records: DataFrame, path: str | None = None, include_docs: bool = False) -> DataFrame:
    """Records under a path prefix (by characters); documents only if asked for. Both conditions reach the Parquet scan."""
    if path:
        records = records.where(F.col("file").startswith(path))
    return records if include_docs else records.where("kind <> 'document'")


def exact_symbol(records: DataFrame, query: str) -> DataFrame:
    """Records of the symbol or qualified symbol, those with a body first."""
    name = query.strip().removesuffix("()")
    found = records.where((F.col("symbol") == name) | (F.col("qualified_symbol") == name))
    return found.withColumns({"score": F.lit(1.0), "matched_by": F.lit("exact_symbol")}).orderBy(F.col("body_start").isNull(), "file", "start", "id")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def sound(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Fails on vectors with a null, a number that is not finite, or no length."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | (norm(F.col(column)) == 0)
    return vectors.withColumn(column, F.when(bad, F.raise_error(F.lit("a vector is not finite or has no length")).cast("array<float>")).otherwise(F.col(column)))


def dense(vectors: DataFrame, query: Sequence[float], cut: int = 50, key: str = "id", column: str = "embedding") -> DataFrame:
    """Exact cosine of one query with all vectors; the best ``cut``, ties by key."""
    q = F.array(*(F.lit(float(v)) for v in query))
    score = dot(F.col(column), q) / (norm(F.col(column)) * norm(q))
    return vectors.withColumns({"score": score, "matched_by": F.lit("dense")}).orderBy(F.desc("score"), key).limit(cut)


def dense_batch(vectors: DataFrame, queries: DataFrame, cut: int = 10, key: str = "id", column: str = "embedding", block: int = 1024) -> DataFrame:
    """Exact cosine of many queries with all vectors: (qid, key, score, rank).

    Queries are cut into blocks of about ``block``; each pair of a block and a batch of vectors is one matrix product, of
    which a task passes on its best ``cut`` of each query. A window then ranks what the tasks passed on. One block at a
    time is on the driver; beyond a few, each block's result is written to the shared folder, so the plan does not grow with the queries.
    """
    session.ship(vectors.sparkSession)
    blocks = -(-queries.count() // block)
    parts = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", column).collect()
        if not rows:
            continue
        m = np.array([r[column] for r in rows], np.float64)
        found = vectors.select(key, column).mapInArrow(_best([r["qid"] for r in rows], m / np.linalg.norm(m, axis=1, keepdims=True), cut), f"qid long, {key} long, score double")
        if blocks > FEW_BLOCKS:
            path = f"{session.workspace(vectors.sparkSession)}/loomseek/dense-{uuid.uuid4().hex}"
            found.write.parquet(path)
            found = vectors.sparkSession.read.parquet(path)
        parts = found if parts is None else parts.unionAll(found)
    if parts is None:
        parts = vectors.select(F.col(key).alias("qid"), key, F.lit(0.0).alias("score")).where("false")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), key))
    return parts.withColumn("rank", rank).where(F.col("rank") <= cut)


def _best(ids: list[int], queries: np.ndarray, cut: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, scores = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))
        for b in batches:
            if not b.num_rows:
                continue
            m = np.array(b.column(1).to_pylist(), np.float64)
            new = queries @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
            own = np.broadcast_to(b.column(0).to_numpy().astype(np.int64), new.shape)
            keys, scores = np.hstack([keys, own]), np.hstack([scores, new])
            order = np.lexsort((keys, -np.round(scores, 9)), axis=1)[:, :cut]
            keys, scores = np.take_along_axis(keys, order, 1), np.take_along_axis(scores, order, 1)
        q = np.repeat(np.array(ids, np.int64), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(keys.ravel()), pa.array(scores.ravel())], names=["qid", "key", "score"])

    return run


def vector_misses(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row for each content that has no vector yet: the last record with it."""
    last = rows.groupBy("content_hash").agg(F.max_by(F.struct(*rows.columns), "id").alias("r_")).select("r_.*")
    return last.join(vectors.select("content_hash"), "content_hash", "left_anti")


def fuse(lists: dict[str, DataFrame], key: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists with a column ``rank``: score, ranks by list, and, of the columns that all lists have, those of the first list with the key."""
    parts = []
    shared = set.intersection(*(set(rows.columns) for rows in lists.values())) - {key, "rank", "score", "matched_by"}
    payload = sorted(shared)
    for number, (label, rows) in enumerate(lists.items()):
        parts.append(rows.select(key, F.col("rank").cast("int").alias("rank"), F.lit(label).alias("label_"), F.lit(number).alias("list_"), F.struct(*payload).alias("payload_") if payload else F.lit(None).alias("payload_")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionAll(p)
    out = both.groupBy(key).agg(
        F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label_", "rank")))).alias("ranks"),
        F.min_by("payload_", "list_").alias("payload_"),
    )
    held = [f.name for f in out.schema["payload_"].dataType.fields] if out.schema["payload_"].dataType.typeName() == "struct" else []
    return out.select(key, *(F.col(f"payload_.{c}").alias(c) for c in held), "score", "ranks", F.lit("rrf").alias("matched_by"))


def ranked(rows: DataFrame, key: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` by score, ties by key. Rows are a cut list, or one for each value of ``by``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key)))


def select(rows: DataFrame, limit: int, order: Sequence[Column | str]) -> DataFrame:
    """The first row of each symbol of a file (windows: of each start), then the first ``limit`` of those; ``order`` ascends.

    Tasks keep the first row of their own before anything is shuffled, so a frequent symbol is no load.
    """
    place = F.when(F.col("kind").isin(*LOOSE_KINDS), F.col("start"))
    first = rows.groupBy("file", "qualified_symbol", place.alias("place_")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("first_"))
    return first.select("first_.*").orderBy(*order).limit(limit)


def present(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Adds preview_start and preview."""
    return rows.withColumn("p_", text.preview(F.col("raw"), F.col("start"), terms)).withColumns({"preview_start": F.col("p_.preview_start"), "preview": F.col("p_.preview")}).drop("p_")


def regex_scan(records: DataFrame, pattern: str, limit: int) -> DataFrame:
    """The first ``limit`` records by id in which the pattern is found, previewed from the line of the match.

    The dialect is the common part of Java's, RE2's and Python's.
    """
    if not pattern or len(pattern) > MAX_PATTERN:
        raise ValueError(f"a pattern has 1 to {MAX_PATTERN} characters")
    re.compile(pattern)
    found = records.where(F.col("raw").rlike(pattern)).orderBy("id").limit(limit)
    before = F.substring("raw", F.lit(1), F.regexp_instr("raw", F.lit(pattern)) - 1)
    offset = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    window = F.array_join(F.slice(text.lines(F.col("raw")), offset + 1, F.lit(12)), "\n")
    return found.withColumns({"score": F.lit(1.0), "matched_by": F.lit("regex"), "preview_start": (F.col("start") + offset).cast("int"), "preview": window})


def regex_search(records: DataFrame, pattern: str, limit: int) -> DataFrame:
    """``regex_scan`` in Python's dialect and with a time for each record and for each task; TimeoutError beyond them.

    A task passes on its first ``limit`` matches by id and no more.
    """
    if not pattern or len(pattern) > MAX_PATTERN:
        raise ValueError(f"a pattern has 1 to {MAX_PATTERN} characters")
    regex.compile(pattern)
    session.ship(records.sparkSession)
    columns = records.columns
    schema = T.StructType([*records.schema.fields, T.StructField("offset_", T.IntegerType())])
    found = records.sortWithinPartitions("id").mapInArrow(_matching(pattern, columns.index("raw"), limit), schema).orderBy("id").limit(limit)
    window = F.array_join(F.slice(text.lines(F.col("raw")), F.col("offset_") + 1, F.lit(12)), "\n")
    shown = found.withColumns({"score": F.lit(1.0), "matched_by": F.lit("regex"), "preview_start": (F.col("start") + F.col("offset_")).cast("int"), "preview": window})
    return shown.drop("offset_")


def _matching(pattern: str, raw: int, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, spent, kept = regex.compile(pattern), 0.0, 0
        for b in batches:
            at, offsets = [], []
            began = time.monotonic()
            for i, body in enumerate(b.column(raw).to_pylist()):
                if kept == limit:
                    break
                if spent + time.monotonic() - began > TASK_SECONDS:
                    raise TimeoutError("the pattern takes too long")
                if match := asked.search(body or "", timeout=RECORD_SECONDS):
                    at.append(i)
                    offsets.append(body[: match.start()].count("\n"))
                    kept += 1
            spent += time.monotonic() - began
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(at, pa.int64())).columns, pa.array(offsets, pa.int32())], names=[*b.schema.names, "offset_"])

    return run


def read_span(files: DataFrame, path: str | None = None, start: int = 1, end: int | None = None) -> DataFrame:
    """Lines start to end of a file (all files without a path), within the bounds; truncated says if they cut something."""
    if start < 1 or (end is not None and end < start):
        raise ValueError("a span starts at line 1 or later and ends where it starts or later")
    last = start + DEFAULT_SPAN_LINES - 1 if end is None else end
    height = min(last - start + 1, MAX_SPAN_LINES)
    rows = files if path is None else files.where(F.col("path") == path)
    whole = F.array_join(F.slice(text.lines(F.col("text")), start, height), "\n")
    cut = (F.length("span_") > MAX_SPAN_CHARS) | (F.lit(last - start + 1) > height)
    return rows.withColumn("span_", whole).select("path", F.lit(start).alias("start"), F.least(F.lit(start + height - 1), F.size(text.lines(F.col("text")))).alias("end"), F.substring("span_", 1, MAX_SPAN_CHARS).alias("text"), cut.alias("truncated"), text.digest(F.col("text").cast("binary")).alias("source_hash"))
