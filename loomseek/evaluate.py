"""Runs a label set over an engine: every query by bm25, dense and hybrid on the same records, then the metrics."""

from __future__ import annotations

import hashlib
import json
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import functions as F

from loomseek.engine import Engine
from loomseek.functions import text
from loomseek.operators import evaluation
from loomseek.sources import labels

MODES, DEPTH, SHOWN = ("bm25", "dense", "hybrid"), 50, 5
RESULT = "qid string, mode string, rank int, file string, symbol string, qualified_symbol string, start int, end int, preview_start int, preview_lines int"


class StaleLabels(ValueError):
    """Labels, their seal or labelled files are not what they were when they were made."""


def _fresh(engine: Engine, manifest) -> None:
    stale = [r["path"] for r in evaluation.stale_labels(manifest, engine.table("files")).limit(5).collect()]
    if stale:
        raise StaleLabels(", ".join(stale))


def implementation() -> str:
    """One digest of this package's sources."""
    root = Path(__file__).resolve().parent
    return hashlib.sha256("".join(f"{f.relative_to(root)} {hashlib.sha256(f.read_bytes()).hexdigest()}\n" for f in sorted(root.rglob("*.py"))).encode()).hexdigest()


def run(engine: Engine, path: str, report: str | Path | None = None, sealed: bool = False) -> dict:
    """The report: summaries by split and mode, single metrics, fingerprints. Label sets are small: queries run one after another.

    A seal, the label file's SHA-256 beside it under the suffix .sha256, must agree if it is there; with ``sealed`` it must be there.
    """
    spark = engine.spark
    dataset = labels.digest(spark, path)
    seal = labels.seal(spark, path)
    if (sealed and seal is None) or seal not in (None, dataset):
        raise StaleLabels("the seal of the labels is missing or differs")
    queries, targets, manifest = labels.load(spark, path)
    bad = [r["qid"] for r in targets.where("NOT coalesce(start <= evidence_start AND evidence_start <= evidence_end AND evidence_end <= end, false)").select("qid").limit(5).collect()]
    if bad:
        raise ValueError(f"evidence outside of its span: {', '.join(bad)}")
    _fresh(engine, manifest)
    generation = engine.generation
    rows, timing, splits = [], [], {}
    for q in queries.collect():
        splits[q["qid"]] = q["split"]
        for mode in MODES:
            began = time.perf_counter()
            found = engine.query(q["query"], "symbol" if q["category"] == "symbol" else mode, limit=DEPTH).results.orderBy("rank").collect()
            taken = 1000 * (time.perf_counter() - began)
            rows += [(q["qid"], mode, r["rank"], r["file"], r["symbol"], r["qualified_symbol"], r["start"], r["end"], r["preview_start"], len(r["preview"].splitlines())) for r in found]
            timing.append((q["qid"], mode, taken, sum(len(r["preview"]) for r in found[:SHOWN])))
    results = spark.createDataFrame(rows, RESULT)
    times = spark.createDataFrame([(*t, splits[t[0]]) for t in timing], "qid string, mode string, query_ms double, preview_chars5 long, split string")
    scored = None
    for mode in MODES:
        one = evaluation.metrics(results.where(F.col("mode") == mode), targets).withColumn("mode", F.lit(mode))
        scored = one if scored is None else scored.unionAll(one)
    scored = scored.join(times, ["qid", "mode"])
    _fresh(engine, manifest)
    if engine.generation != generation or labels.digest(spark, path) != dataset:
        raise StaleLabels("the index or the labels changed during the run")
    sources = engine.table("files").select(F.xxhash64("path").alias("id"), F.concat_ws(" ", "path", "digest").alias("content_hash"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    out = {
        "dataset_sha256": dataset,
        "source_manifest": evaluation.fingerprint(sources).head()["fingerprint"],
        "implementation_sha256": implementation(),
        "run_at_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "summary": [r.asDict() for r in evaluation.summary(scored).orderBy("split", "mode").collect()],
        "queries": [r.asDict() for r in scored.orderBy("qid", "mode").collect()],
        "records": evaluation.fingerprint(engine.table("records")).head()["fingerprint"],
        "generation": engine.generation,
        "stop_words": len(text.STOP_WORDS),
    }
    if report:
        Path(report).write_text(json.dumps(out, indent=1, sort_keys=True) + "\n")
    return out
