"""The engine: a refreshed index of a source tree (or of any table of files) and all query modes over it."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseek import session
from loomseek.functions import encoder, text
from loomseek.operators import changes, graph, lexical, records, retrieval
from loomseek.sources import snapshot, tree

FORMAT = "2"
#: A text whose vector tells encoders apart.
PROBE = "def probe(value):\n    return value + 1"
#: The tables of the code graph.
GRAPH = ("definitions", "imports", "occurrences", "calls")
MODES = ("auto", "symbol", "bm25", "dense", "hybrid", "regex", "definitions", "references", "imports", "calls", "callers")
PREFIXES = {"re": "regex", "regex": "regex", "def": "definitions", "refs": "references", "imports": "imports", "calls": "calls", "callers": "callers"}
#: Limits of requests and of a request's context.
MAX_QUERY, MAX_LIMIT, DEFAULT_LIMIT = 8_000, 50, 5
MAX_SELECTION, MAX_SELECTION_LINES, MAX_DIAGNOSTICS, MAX_MESSAGE, MAX_SEVERITY, SELECTION_QUERY = 16_000, 200, 50, 2_000, 30, 2_000


class IndexFailure(RuntimeError):
    """A file could not be parsed; the snapshot before it stays current."""


@dataclass
class Answer:
    """A query's route and rows."""

    mode: str
    reason: str
    results: DataFrame
    generation: int
    elapsed_ms: float
    context: dict = field(default_factory=dict)


class Engine:
    """One root, one home folder for its snapshots. ``encode`` makes vectors of texts (column to column), ``encode_query`` those of queries.

    Vectors are kept by content and by the encoder's signature: its name, or what ``signature`` says, and its vector of a fixed text.
    ``parsers`` adds parsers of further languages: (extractor, function from a source to records) by suffix.
    """

    def __init__(self, spark: SparkSession, home: str, root: str | Path | None = None, encode: Callable[[Column], Column] | None = None, ignore_file: str = tree.IGNORE_FILE, encode_query: Callable[[Column], Column] | None = None, signature: str | None = None, parsers: dict[str, tuple[str, records.Parser]] | None = None) -> None:
        session.ship(spark)
        self.spark, self.root, self.error, self.scans = spark, root, None, 0
        self.home = tree.cache_dir(home, root) if root is not None else home.rstrip("/")
        self.encode, self.ignore_file, self.parsers = encode or encoder.hashed, ignore_file, parsers
        self.encode_query, self.has_encoder = encode_query or self.encode, encode is not None
        self._signature, self._name, self._lock = None, signature, threading.RLock()

    # Index

    @property
    def generation(self) -> int:
        found = snapshot.generations(self.spark, self.home)
        return found[-1] if found else 0

    def table(self, name: str) -> DataFrame:
        found = snapshot.read(self.spark, self.home, name)
        if found is None:
            raise LookupError("nothing is indexed yet")
        return found

    @property
    def signature(self) -> str:
        """What tells this encoder's vectors from others'."""
        if self._signature is None:
            vector = self.spark.range(1).select(self.encode(F.lit(PROBE)).alias("v")).head()["v"]
            name = self._name or f"{getattr(self.encode, '__module__', '')}.{getattr(self.encode, '__qualname__', type(self.encode).__name__)}"
            self._signature = hashlib.sha256(f"{name} {[round(float(x), 4) for x in vector]}".encode()).hexdigest()
        return self._signature

    def refresh(self, only: Sequence[str] | None = None, files: DataFrame | None = None) -> dict:
        """Indexes what changed (below the paths ``only``, or everywhere) and publishes a generation if anything did."""
        with self._lock:
            try:
                out = self._refresh(only, files)
            except Exception as error:
                self.error = str(error)
                raise
            self.error = None
            return out

    def _refresh(self, only: Sequence[str] | None, files: DataFrame | None) -> dict:
        only = None if only is None or "." in only else [tree.confined(self.root, p) if self.root is not None else p for p in only]
        if only is not None and not only:
            return {"updated": 0, "deleted": 0, "generation": self.generation}
        self.scans += only is None
        now = files if files is not None else tree.files(self.spark, self.root, only, self.ignore_file)
        if files is not None and only is not None:
            now = changes.affected(now, only)
        meta, old = snapshot.read(self.spark, self.home, "meta"), snapshot.read(self.spark, self.home, "files")
        known = meta.head() if meta is not None else None
        rebuilt = known is None or known["format"] != FORMAT
        recoded = not rebuilt and known["encoder"] != self.signature
        if rebuilt:
            old = None
        before = (old if only is None else changes.affected(old, only)) if old is not None else now.limit(0)
        changed = changes.changed(now, before).persist()
        gone = changes.deleted(now, before).select("path").persist()
        n_changed, n_gone = changed.count(), gone.count()
        try:
            if not (n_changed or n_gone or rebuilt or recoded):
                return {"updated": 0, "deleted": 0, "generation": self.generation}
            parsed = records.parse(changed, self.parsers).persist()
            broken = parsed.where("error IS NOT NULL").select("file", "error").limit(5).collect()
            if broken:
                raise IndexFailure("; ".join(f"{r['file']}: {r['error']}" for r in broken))
            stale = changed.select("path").unionAll(gone)
            fresh = parsed.drop("error")
            held = snapshot.read(self.spark, self.home, "records") if old is not None else None
            every = fresh if held is None else changes.survivors(held.drop("id"), stale).unionByName(fresh)
            all_files = changed if old is None else changes.survivors(old, stale, "path").unionByName(changed)
            facts = graph.facts(changed) if old is None else changes.survivors(snapshot.read(self.spark, self.home, "facts"), stale).unionByName(graph.facts(changed))
            cached = None if rebuilt else snapshot.read(self.spark, self.home, "vectors")
            edges = {name: lambda w, name=name: getattr(graph.resolved(w("facts"), w("files")), name).repartitionByRange("file").sortWithinPartitions("file", "ordinal") for name in GRAPH}
            tables = {
                "files": all_files,
                "records": records.with_ids(every),
                "vectors": lambda w: self._vectors(w("records"), cached),
                "postings": lambda w: lexical.stored(records.posting_fields(w("records"), F.col("file"), F.col("qualified_symbol"), F.col("raw"))),
                "facts": facts,
                **edges,
                "meta": lambda w: self._meta(w("postings"), w("records")),
            }
            at = snapshot.publish(self.spark, self.home, tables, self.generation + 1)
            snapshot.expire(self.spark, self.home)
            parsed.unpersist()
            return {"updated": n_changed, "deleted": n_gone, "generation": at, "rebuilt": rebuilt}
        finally:
            changed.unpersist()
            gone.unpersist()

    def _meta(self, posts: DataFrame, rows: DataFrame) -> DataFrame:
        """One row: the format, the root, the encoder, and the statistics that BM25 needs; a record without tokens has no posting."""
        total = posts.agg(F.sum(F.col("tf_path") + F.col("tf_symbol") + F.col("tf_body"))).head()[0] or 0
        return self.spark.createDataFrame([(FORMAT, str(self.root), self.signature, rows.count(), total)], "format string, root string, encoder string, n_records long, n_tokens long")

    def _vectors(self, rows: DataFrame, cached: DataFrame | None) -> DataFrame:
        """Vectors by content and encoder: those of the last generation, and new ones for contents without any."""
        of = F.lit(self.signature)
        wanted = rows.groupBy("content_hash").agg(F.min(F.concat_ws("\n", "file", "qualified_symbol", "raw")).alias("input_"))
        held = cached.where((F.col("encoder") == of) & (F.size("embedding") == F.col("dim"))) if cached is not None else None
        missing = wanted if held is None else wanted.join(held.select("content_hash"), "content_hash", "left_anti")
        made = retrieval.sound(missing.select("content_hash", self.encode(F.col("input_")).alias("embedding")))
        made = made.select(of.alias("encoder"), "content_hash", F.size("embedding").alias("dim"), "embedding")
        return made if held is None else held.join(wanted.select("content_hash"), "content_hash", "left_semi").select(*made.columns).unionByName(made)

    def status(self) -> dict:
        at = self.generation
        stats = self.table("records").agg(F.count("*").alias("records"), F.count_distinct("file").alias("files")).head().asDict() if at else {}
        more = {"extractors": {r["extractor"]: r["count"] for r in self.table("records").groupBy("extractor").count().collect()}, "encoder": self.table("meta").head()["encoder"]} if at else {}
        return {"root": str(self.root), "generation": at, "full_scans": self.scans, "error": self.error, **stats, **more}

    def graph(self) -> graph.Graph:
        """The graph that was written with the current generation."""
        return graph.Graph(*(self.table(name) for name in GRAPH))

    def close(self) -> None:
        """Nothing is held between queries but what is written."""

    # Queries

    def read(self, file: str, start: int = 1, end: int | None = None) -> DataFrame:
        return retrieval.read_span(self.table("files"), file, start, end)

    def query(self, query: str = "", mode: str = "auto", limit: int = DEFAULT_LIMIT, path: str | None = None, include_docs: bool = False, context: dict | None = None, file: str | None = None, line: int | None = None, column: int = 0) -> Answer:
        """Routes a request to its mode. Results come in the order of the column ``rank``."""
        began = time.monotonic()
        if mode not in MODES or len(query) > MAX_QUERY or not 1 <= limit <= MAX_LIMIT:
            raise ValueError("an unknown mode, too long a query, or a limit outside of 1 to 50")
        if self.error:
            raise IndexFailure(self.error)
        context = checked_context(context or {})
        if self.root is not None:
            inside = lambda p: tree.confined(self.root, p) if p else p
            path, file = inside(path), inside(file)
            path = None if path == "." else path
            context = context | {k: inside(context[k]) for k in ("active_file",) if k in context}
        if not query and context.get("selection"):
            query = context["selection"]["text"][:SELECTION_QUERY]
        reason = "asked for"
        if mode == "auto":
            query, mode, reason = self.route(query, path, include_docs)
        if mode in ("definitions", "references", "imports", "calls", "callers"):
            rows = self.navigate(mode, query, limit, file, line, column)
        elif mode == "regex":
            rows = retrieval.ranked(retrieval.regex_search(self._eligible(path, include_docs), query, limit))
        else:
            rows = self._search(query, mode, limit, path, include_docs, context.get("active_file"))
        if context.get("include_git_diff") and self.root is not None:
            context = context | {"git": tree.git_diff(self.root, self.table("files"))}
        return Answer(mode, reason, rows, self.generation, 1000 * (time.monotonic() - began), context)

    def route(self, query: str, path: str | None = None, include_docs: bool = False) -> tuple[str, str, str]:
        """(query, mode, reason) of an automatic request."""
        head, colon, rest = query.partition(":")
        if colon and head.strip().lower() in PREFIXES:
            return rest.strip(), PREFIXES[head.strip().lower()], f"prefix {head.strip().lower()}"
        exact = retrieval.exact_symbol(self._eligible(path, include_docs), query).where(~F.col("kind").isin(*records.LOOSE_KINDS))
        if query.strip() and not exact.isEmpty():
            return query, "symbol", "a declaration has this name"
        if self.has_encoder:
            return query, "hybrid", "no declaration has this name, and an encoder is given"
        return query, "bm25", "no declaration has this name"

    def _eligible(self, path: str | None, include_docs: bool) -> DataFrame:
        return retrieval.eligible(self.table("records"), path, include_docs)

    def _candidates(self, query: str, mode: str, path: str | None, include_docs: bool) -> DataFrame:
        """Ranked candidates, at most a hundred."""
        rows = self.table("records")
        if mode == "symbol":
            found = retrieval.exact_symbol(self._eligible(path, include_docs), query)
            order = [F.col("body_start").isNull(), "file", "start", "id"]
            # A shortlist needs no more than the first record of each symbol of a file, of which the first MAX_LIMIT are looked at.
            first = retrieval.select(found, MAX_LIMIT, order)
            return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        keep = F.lit(True) if not path else F.col("file").startswith(path)
        keep = keep if include_docs else keep & (F.col("kind") != "document")
        terms = text.query_terms(query)

        def worded() -> DataFrame:
            """By stems for the score, by tokens for coverage. At most lexical.PRE_CUT rows are broadcast."""
            stats = self.table("meta").head()
            among = rows.where(keep) if path or not include_docs else None
            best = lexical.bm25_stored(self.table("postings"), stats["n_records"], stats["n_tokens"], lexical.stems_of(terms), among)
            return retrieval.ranked(lexical.rerank(rows.join(F.broadcast(best), "id"), terms).drop("lexical"))

        if mode == "bm25":
            return worded()
        vector = self.spark.range(1).select(self.encode_query(F.lit(query)).alias("v")).head()["v"]
        known = self.table("vectors").where((F.col("encoder") == self.signature) & (F.col("dim") == len(vector)))
        held = rows.where(keep).join(known.select("content_hash", "embedding"), "content_hash")
        near = retrieval.ranked(retrieval.dense(held, vector).drop("embedding"))
        return near if mode == "dense" else retrieval.ranked(retrieval.fuse({"bm25": worded(), "dense": near}))

    def _search(self, query: str, mode: str, limit: int, path: str | None, include_docs: bool, active: str | None) -> DataFrame:
        rows = self._candidates(query, mode, path, include_docs)
        short = retrieval.select(rows, min(MAX_LIMIT, 3 * limit), [F.col("rank")])
        shown = retrieval.present(short, text.query_terms(query))
        best = [F.desc("score"), F.col("file") != F.lit(active), F.col("rank")] if active else [F.col("rank")]
        out = shown.withColumn("rank", F.row_number().over(Window.orderBy(*best))).where(F.col("rank") <= limit)
        if "ranks" not in out.columns:
            out = out.withColumn("ranks", F.create_map().cast("map<string,int>"))
        return out.select("rank", "id", "file", "symbol", "qualified_symbol", "kind", "start", "end", "score", "matched_by", "preview_start", "preview", "content_hash", "ranks")

    def navigate(self, mode: str, query: str = "", limit: int = 20, file: str | None = None, line: int | None = None, column: int = 0) -> DataFrame:
        g = self.graph()
        key = ["file", "ordinal"]
        if mode == "imports":
            wanted = file or query
            rows = g.imports if not wanted else g.imports.where(F.col("file") == wanted)
            return rows.orderBy(*key).limit(limit)
        found = self._definitions(g, query, file, line, column)
        if mode == "definitions":
            return found.orderBy(*key).limit(limit)
        if mode == "references":
            return graph.pointing_at(g.occurrences, found, key).orderBy(*key).limit(limit)
        edges = graph.calls_of(g.calls, found) if mode == "calls" else graph.pointing_at(g.calls, found, key)
        return graph.with_targets(edges.orderBy(*key).limit(limit), g.definitions, key).orderBy(*key)

    def _definitions(self, g: graph.Graph, query: str, file: str | None, line: int | None, column: int) -> DataFrame:
        """By position, the targets of the innermost use, else the innermost declaration; else by name."""
        if file is not None and line is not None:
            point = self.spark.createDataFrame([(0, file, line, column)], "pid int, file string, line int, column int")
            uses = g.occurrences.withColumn("id", F.struct("ordinal", "targets"))
            hit = graph.innermost(uses.where(F.col("file") == file), point).head()
            if hit:
                return g.definitions.where(F.col("id").isin(hit["id"]["targets"]))
            hit = graph.innermost(g.definitions.where(F.col("file") == file), point).head()
            if hit:
                return g.definitions.where(F.col("id") == hit["id"])
        return graph.by_name(g.definitions, query, file if line is None else None)


def checked_context(context: dict) -> dict:
    """The editor's context within its bounds; ValueError beyond them."""
    extra = set(context) - {"active_file", "selection", "diagnostics", "include_git_diff"}
    selection, found = context.get("selection") or {}, context.get("diagnostics") or []
    words = selection.get("text", "")
    too_long = len(words) > MAX_SELECTION or words.count("\n") >= MAX_SELECTION_LINES or len(found) > MAX_DIAGNOSTICS
    if extra or too_long or any(len(d.get("message", "")) > MAX_MESSAGE or len(d.get("severity", "")) > MAX_SEVERITY for d in found):
        raise ValueError("the context has unknown parts or is too long")
    return context
