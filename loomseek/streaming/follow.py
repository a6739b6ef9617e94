"""Change events to refreshed snapshots by Structured Streaming.

Events are rows (path, kind, seq) of an append-only log. A micro-batch names each path once; a batch that
touches what decides about other files is a full reconcile, and so is one that comes every half minute whatever happened.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomseek.engine import Engine, IndexFailure
from loomseek.operators import discovery
from loomseek.sources.tree import IGNORE_FILE

SCHEMA = "seq long, path string, kind string, is_dir boolean"
#: Kinds that count, names that decide about other files, and paths of git that do.
KINDS = ("modified", "created", "deleted", "moved")
DECIDING = (IGNORE_FILE, ".gitignore", "tsconfig.json")
GIT_STATE = r"(^|/)\.git/(HEAD|index|packed-refs|info/exclude|config|refs/.*)$"
#: Paths beyond which a batch is reconciled as a whole.
MAX_PATHS = 100
#: Seconds between whole refreshes.
RECONCILE_SECONDS = 30.0


def relevant(events: DataFrame) -> DataFrame:
    """Events of the four kinds, but modified directories and skipped directories; of git's own files only those with state."""
    parts = F.split("path", "/")
    git = F.col("path").rlike(GIT_STATE)
    skipped = F.arrays_overlap(parts, F.array(*map(F.lit, discovery.SKIP_DIRS)))
    loud = F.col("kind").isin(*KINDS) & ~(F.coalesce("is_dir", F.lit(False)) & (F.col("kind") == "modified"))
    return events.where(loud & (git | ~skipped)).withColumn("full", git | F.element_at(parts, -1).isin(*DECIDING))


def coalesced(events: DataFrame) -> DataFrame:
    """Each path once: the last event's number, and whether any asks for a full reconcile."""
    return relevant(events).groupBy("path").agg(F.max("seq").alias("seq"), F.max("full").alias("full"))


def batch(engine: Engine, files: Callable[[], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """The function of one micro-batch. A parse failure keeps the old snapshot and stays on the engine until a later batch mends it."""

    def run(events: DataFrame, _: int) -> None:
        rows = coalesced(events).orderBy("path").limit(MAX_PATHS + 1).collect()
        if not rows:
            return
        whole = len(rows) > MAX_PATHS or any(r["full"] for r in rows) or engine.error is not None
        try:
            engine.refresh(None if whole else [r["path"] for r in rows], files() if files else None)
        except IndexFailure:
            pass  # kept in engine.error: queries raise it

    return run


def reconcile(query: StreamingQuery, engine: Engine, files: Callable[[], DataFrame] | None, every: float) -> None:
    """Refreshes everything from time to time while the query runs, for changes whose events were lost."""
    while not query.awaitTermination(every):
        try:
            engine.refresh(None, files() if files else None)
        except Exception:  # noqa: BLE001 - kept in engine.error, as a batch's failure is: queries raise it
            continue


def follow(spark: SparkSession, log: str, engine: Engine, checkpoint: str, files: Callable[[], DataFrame] | None = None, trigger: dict | None = None, every: float | None = RECONCILE_SECONDS) -> StreamingQuery:
    """Follows a folder of JSON event files, with a whole refresh every ``every`` seconds beside it."""
    stream = spark.readStream.schema(SCHEMA).json(log)
    query = _started(stream, engine, checkpoint, files, trigger)
    if every:
        threading.Thread(target=_until_the_end, args=(query, engine, files, every), daemon=True).start()
    return query


def _until_the_end(query: StreamingQuery, engine: Engine, files: Callable[[], DataFrame] | None, every: float) -> None:
    try:
        reconcile(query, engine, files, every)
    except StreamingQueryException:
        return  # the query has failed and says so itself


def _started(stream: DataFrame, engine: Engine, checkpoint: str, files: Callable[[], DataFrame] | None, trigger: dict | None) -> StreamingQuery:
    return stream.writeStream.foreachBatch(batch(engine, files)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "50 milliseconds"})).start()


def flush(query: StreamingQuery) -> None:
    """Returns when all events that were in the log at the call are in the index."""
    query.processAllAvailable()
    if query.exception():
        raise query.exception()
