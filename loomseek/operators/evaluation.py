"""Retrieval metrics against labelled spans.

results: (qid, rank, file, symbol, qualified_symbol, start, end, preview_start, preview_lines);
targets: (qid, file, symbol, qualified_symbol, start, end, evidence_start, evidence_end).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP_EVIDENCE = 5


def matches(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of a result and a target of its query: same file and symbols, overlapping spans."""
    r, t = results.alias("r"), targets.alias("t")
    named = F.col("t.qualified_symbol").isNull() | (F.col("r.qualified_symbol") == F.col("t.qualified_symbol"))
    overlap = (F.col("r.start") <= F.col("t.end")) & (F.col("r.end") >= F.col("t.start"))
    keys = (F.col("r.qid") == F.col("t.qid")) & (F.col("r.file") == F.col("t.file")) & (F.col("r.symbol") == F.col("t.symbol"))
    return r.join(t, keys & named & overlap).select("r.qid", "r.rank", "t.file", F.col("t.start").alias("target_start"), F.col("t.end").alias("target_end"), F.col("t.symbol").alias("target_symbol"), "t.evidence_start", "t.evidence_end", "r.preview_start", "r.preview_lines")


def metrics(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Per query: rank of the first hit, hit1, hit5, reciprocal_rank50, target_recall50, evidence_coverage5."""
    found = matches(results, targets)
    n = targets.groupBy("qid").agg(F.count("*").alias("n_"))
    first = found.groupBy("qid").agg(F.min("rank").alias("rank"), F.count_distinct("file", "target_symbol", "target_start", "target_end").alias("found_"))
    needed = targets.select("qid", "file", F.explode(F.sequence("evidence_start", "evidence_end")).alias("line")).distinct()
    low, high = F.greatest("evidence_start", "preview_start"), F.least(F.col("evidence_end"), F.col("preview_start") + F.col("preview_lines") - 1)
    seen = found.where(F.col("rank") <= TOP_EVIDENCE).where(low <= high).select("qid", "file", F.explode(F.sequence(low, high)).alias("line")).distinct()
    lines = needed.groupBy("qid").agg(F.count("*").alias("need_")).join(seen.groupBy("qid").agg(F.count("*").alias("seen_")), "qid", "left")
    out = n.join(first, "qid", "left").join(lines, "qid", "left")
    return out.select(
        "qid",
        "rank",
        F.coalesce(F.col("rank") == 1, F.lit(False)).alias("hit1"),
        F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("hit5"),
        F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank50"),
        (F.coalesce("found_", F.lit(0)) / F.col("n_")).alias("target_recall50"),
        F.coalesce(F.coalesce("seen_", F.lit(0)) / F.col("need_"), F.lit(0.0)).alias("evidence_coverage5"),
    )


def summary(scored: DataFrame) -> DataFrame:
    """By mode and split, and over all splits (split ``all``): scored has split, mode, query_ms, preview_chars5 and the metrics."""
    sets = scored.groupingSets([["split", "mode"], ["mode"]], "split", "mode")
    out = sets.agg(
        F.grouping("split").alias("every_"),
        F.count("*").alias("questions"),
        F.count_if("hit1").alias("hit1"),
        F.count_if("hit5").alias("hit5"),
        F.round(F.avg("reciprocal_rank50"), 4).alias("mrr50"),
        F.round(F.avg("target_recall50"), 4).alias("target_recall50"),
        F.round(F.avg("evidence_coverage5"), 4).alias("evidence_coverage5"),
        F.round(F.expr("percentile(query_ms, 0.5)"), 2).alias("median_query_ms"),
        F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY query_ms)"), 2).alias("p95_query_ms"),
        F.round(F.avg("preview_chars5"), 0).alias("mean_preview_chars5"),
    )
    return out.withColumn("split", F.when(F.col("every_") == 1, "all").otherwise(F.col("split"))).drop("every_")


def fingerprint(records: DataFrame) -> DataFrame:
    """One SHA-256 of all (id, content_hash, start, end) in order of id: a tree of hashes, of which no node has many children."""
    level = records.select(F.col("id").alias("at_"), F.sha2(F.to_json(F.struct("id", "content_hash", "start", "end")), 256).alias("h_"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at_", "h_"))), lambda x: x["h_"]), ""), 256)
    for _ in range(5):
        level = level.groupBy(F.floor(F.col("at_") / 1000).alias("up_")).agg(whole.alias("h_")).withColumnRenamed("up_", "at_")
    return level.agg(whole.alias("fingerprint"))


def stale_labels(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Labelled files that are missing or have another digest now."""
    now = files.select(F.col("path").alias("path_"), F.col("digest").alias("now"))
    return manifest.join(now, F.col("path") == F.col("path_"), "left").where(~F.col("digest").eqNullSafe(F.col("now"))).select("path", "digest", "now")
