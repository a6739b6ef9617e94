"""The library's own queries over the driver's tables, each with its plan and, where SQL can say it, its SQL.

Documents stand for files (source/lang/doc_id.src) and for records; suppliers give small Python modules; line items and orders
give edges and spans; events are change events.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomseek import session
from loomseek.functions import text
from loomseek.operators import changes, discovery, evaluation, graph, lexical, records, retrieval
from loomseek.plans import sql
from loomseek.streaming import follow

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
ASKED = "Where is the thin erth of stupid src1 en"
PATTERN = r'token = "[0-9a-f]+"'


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def file_path() -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".src"))


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", file_path().alias("path"), "text", text.digest(F.col("text").cast("binary")).alias("digest"))


def recs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "function").when(F.col("lang") == "fr", "class").when(F.col("lang") == "es", "document").otherwise("window")
    body = F.when(F.col("doc_id") % 3 != 0, F.lit(1))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), file_path().alias("file"), F.col("source").alias("symbol"), F.concat("source", F.lit("."), "lang").alias("qualified_symbol"), kind.alias("kind"), F.lit(1).alias("start"), body.alias("body_start"), F.col("text").alias("raw"))


def fields(spark: SparkSession, d: str) -> DataFrame:
    return records.posting_fields(recs(spark, d), F.col("file"), F.col("qualified_symbol"), F.col("raw"))


_indexes: dict[tuple[str, str, str], tuple[DataFrame, int, int]] = {}


def index(spark: SparkSession, d: str, stems: bool = False) -> tuple[DataFrame, int, int]:
    """Stored postings of a table's documents, by token or by stem, and the numbers of records and tokens; written at the first call of a session."""
    key = (spark.sparkContext.applicationId, d, "stems" if stems else "tokens")
    if key not in _indexes:
        session.ship(spark)
        path = f"{session.workspace(spark)}/loomseek/index-{uuid.uuid4().hex}"
        lexical.stored(fields(spark, d), stems).write.parquet(path)
        posts = spark.read.parquet(path)
        total = posts.agg(F.sum(F.col("tf_path") + F.col("tf_symbol") + F.col("tf_body"))).head()[0] or 0
        _indexes[key] = posts, table(spark, d, "documents").count(), total
    return _indexes[key]


TERMS = text.query_terms(ASKED)
r6 = lambda c: F.round(c, 6)


# Text and discovery


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql.tok('text')}) AS term FROM documents) GROUP BY ALL")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"""WITH {sql.FILES} SELECT doc_id, path FROM files
WHERE NOT regexp_matches(path, '(^|/)(node_modules|\\.git|\\.hg|\\.svn|\\.index|\\.venv|venv|__pycache__|dist|build|coverage|vendor|\\.pytest_cache)(/|$)')
  AND NOT regexp_full_match(path, '.*/de/[^/]*7\\.src') AND NOT starts_with(path, 'src3/') AND strlen(text) <= 20000""")
def discover_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = files(spark, d).where(discovery.admissible(F.col("path"), F.octet_length("text"), 20_000) & ~discovery.ignored(F.col("path"), ["*/de/*7.src", "src3/"]))
    return kept.select("doc_id", "path")


@query(f"WITH {sql.RECORDS} SELECT id, sha256(file || chr(10) || qualified_symbol || chr(10) || raw) AS content_hash FROM rec")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return recs(spark, d).select("id", text.content_hash(F.col("file"), F.col("qualified_symbol"), F.col("raw")).alias("content_hash"))


_LINE = r"[^\n\r\x0B\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


@query(rf"""WITH RECURSIVE ls AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM (SELECT doc_id, regexp_extract_all(text, '{_LINE}*(?:\r\n|[\n\r\x0B\f\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}])|{_LINE}+') AS l FROM documents)),
cuts AS (SELECT doc_id, no, unnest(range(0, CAST(length(line) AS BIGINT), 1800)) AS o, line FROM ls),
ps AS (SELECT doc_id, no, substr(line, o + 1, 1800) AS piece, row_number() OVER (PARTITION BY doc_id ORDER BY no, o) AS k FROM cuts),
go AS (
  SELECT doc_id, k, 0 AS chunk, no AS start, length(piece) AS chars FROM ps WHERE k = 1
  UNION ALL
  SELECT p.doc_id, p.k, CASE WHEN g.chars + length(p.piece) > 1800 OR p.no - g.start >= 40 THEN g.chunk + 1 ELSE g.chunk END,
    CASE WHEN g.chars + length(p.piece) > 1800 OR p.no - g.start >= 40 THEN p.no ELSE g.start END,
    CASE WHEN g.chars + length(p.piece) > 1800 OR p.no - g.start >= 40 THEN length(p.piece) ELSE g.chars + length(p.piece) END
  FROM go g JOIN ps p ON p.doc_id = g.doc_id AND p.k = g.k + 1),
c AS (SELECT doc_id, chunk, min(start) AS start, max(no) AS "end", regexp_replace(string_agg(piece, '' ORDER BY k), '\s+$', '') AS raw, max(chunk) OVER (PARTITION BY doc_id) AS last FROM go JOIN ps USING (doc_id, k) GROUP BY doc_id, chunk)
SELECT doc_id, CAST(chunk AS INTEGER) AS piece, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", sha256(raw) AS raw_sha256 FROM c WHERE NOT (chunk = last AND raw = '')""")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    made = records.parse(files(spark, d).select("path", "text"))
    doc = F.regexp_extract("file", r"/(\d+)\.src$", 1).cast("long")
    return made.select(doc.alias("doc_id"), F.col("piece_ord").alias("piece"), "start", "end", F.sha2("raw", 256).alias("raw_sha256"))


@query(f"""WITH {sql.RECORDS}, {sql.FIELDS}, u AS (SELECT id, unnest(pt) AS term, 0 AS k FROM f UNION ALL SELECT id, unnest(st), 1 FROM f UNION ALL SELECT id, unnest(bt), 2 FROM f)
SELECT id, term, count(*) FILTER (k = 0) AS tf_path, count(*) FILTER (k = 1) AS tf_symbol, count(*) FILTER (k = 2) AS tf_body FROM u GROUP BY ALL""")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(fields(spark, d))


@query(f"WITH {sql.RECORDS}, {sql.FIELDS} SELECT id, len(pt) + len(st) + len(bt) AS len FROM f")
def doc_len(spark: SparkSession, d: str) -> DataFrame:
    return lexical.lengths(fields(spark, d))


@query(f"WITH {sql.RECORDS}, {sql.FIELDS}, u AS (SELECT id, unnest(list_concat(list_concat(pt, st), bt)) AS term FROM f) SELECT term, count(DISTINCT id) AS n FROM u GROUP BY term")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_counts(lexical.postings(fields(spark, d)))


# Lexical retrieval


@query(f"WITH {sql.bm25(TERMS)} SELECT id, round(lexical, 6) AS lexical FROM best")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25_stored(*index(spark, d), TERMS).select("id", r6("lexical").alias("lexical"))


def _reranked(spark: SparkSession, d: str, where: Column | None = None) -> DataFrame:
    rows = recs(spark, d)
    best = lexical.bm25_stored(*index(spark, d), TERMS, None if where is None else rows.where(where))
    return lexical.rerank(rows.join(F.broadcast(best), "id"), TERMS)


_COVERED = sql.tok("file || ' ' || symbol || ' ' || raw")
_RERANK = f"SELECT *, lexical * ({sql.boost(TERMS, 'pt')}) * (0.5 + {sql.coverage(TERMS, _COVERED)}) AS score FROM best ORDER BY score DESC, id LIMIT 50"


@query(f"WITH {sql.bm25(TERMS)} SELECT id, file, kind, round(score, 6) AS score FROM ({_RERANK})")
def bm25_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("id", "file", "kind", r6("score").alias("score"))


_FILTER = "starts_with(file, 'src1') AND kind <> 'document'"


@query(f"WITH {sql.bm25(TERMS, _FILTER)} SELECT id, round(score, 6) AS score FROM ({_RERANK})")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, F.col("file").startswith("src1") & (F.col("kind") != "document")).select("id", r6("score").alias("score"))


@query()
def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    best = retrieval.ranked(lexical.bm25_stored(*index(spark, d, stems=True), lexical.stems_of(TERMS)).withColumnRenamed("lexical", "score"))
    return best.select(F.lit(0).alias("qid"), "id", r6("score").alias("lexical"), "rank")


_BATCH = f"""WITH {sql.RECORDS}, {sql.FIELDS}, u AS (SELECT id, unnest(pt) AS term, 3.0 AS w FROM f UNION ALL SELECT id, unnest(st), 5.0 FROM f UNION ALL SELECT id, unnest(bt), 1.0 FROM f),
p AS (SELECT id, term, sum(w) AS tf FROM u GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
z AS (SELECT id, len(pt) + len(st) + len(bt) AS d FROM f), s AS (SELECT count(*) AS n, avg(d) AS mean FROM z),
q AS (SELECT item_id AS qid, unnest({sql.tok('text')}) AS term FROM benchmark),
qt AS (SELECT qid, term, count(*) AS times FROM q GROUP BY ALL),
sc AS (SELECT qid, id, sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * d / mean))) AS lexical
  FROM qt JOIN df USING (term) JOIN p USING (term) JOIN z USING (id), s GROUP BY qid, id)
SELECT qid, id, round(lexical, 6) AS lexical FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(lexical, 9) DESC, id) AS rank FROM sc) WHERE rank <= 10"""


@query(_BATCH)
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    posts, _, _ = index(spark, d)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(text.tokens(F.col("text"))).alias("term"))
    sizes = lexical.lengths(fields(spark, d))
    return lexical.bm25_from_postings(posts.drop("len"), sizes, asked, cut=10).select("qid", "id", r6("lexical").alias("lexical"))


@query(f"WITH {sql.RECORDS} SELECT id, round({sql.coverage(TERMS, _COVERED)}, 6) AS coverage FROM rec")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    seen = text.tokens(F.concat_ws(" ", "file", "symbol", "raw"))
    return recs(spark, d).select("id", r6(lexical.coverage(TERMS, seen)).alias("coverage"))


@query(f"WITH {sql.RECORDS} SELECT id, CAST({sql.boost(TERMS, sql.tok('file'))} AS DOUBLE) AS boost FROM rec")
def path_boost(spark: SparkSession, d: str) -> DataFrame:
    return recs(spark, d).select("id", lexical.path_boost(TERMS, text.tokens(F.col("file"))).alias("boost"))


# Symbols, vectors, fusion


@query(f"WITH {sql.RECORDS} SELECT id, CAST(row_number() OVER (ORDER BY body_start IS NULL, file, start, id) AS INTEGER) AS rank FROM rec WHERE symbol = 'src1.en' OR qualified_symbol = 'src1.en'")
def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.exact_symbol(recs(spark, d), " src1.en() ").select("id", "file", "start", "body_start")
    # The rows of one symbol are what the query returns, so numbering them in one task adds no bound.
    return found.select("id", F.row_number().over(Window.orderBy(F.col("body_start").isNull(), "file", "start", "id")).alias("rank"))


@query(f"WITH {sql.RECORDS} SELECT id, file FROM rec WHERE starts_with(file, 'src1') AND kind <> 'document'")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.eligible(recs(spark, d), "src1").select("id", "file")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_COSINE = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_DENSE = f"SELECT e.vec_id AS id, {_COSINE.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round(score, 9) DESC, id LIMIT 50"


def _dense(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    first = vectors.where("id = 0").head()
    return retrieval.dense(vectors, first["embedding"] if first else [1.0])


@query(f"SELECT id, round(score, 6) AS score FROM ({_DENSE})")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("id", r6("score").alias("score"))


@query(f"""SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS qid, e.vec_id AS id, {_COSINE.format('e.embedding', 'q.embedding')} AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COSINE.format('e.embedding', 'q.embedding')}, 9) DESC, e.vec_id) AS rank
  FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 10""")
def dense_batch(spark: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(spark, d)
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    return retrieval.dense_batch(vectors, asked).select("qid", "id", r6("score").alias("score"), "rank")


@query("""WITH r AS (SELECT doc_id AS id, sha256(text) AS content_hash FROM documents), v AS (SELECT sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0)
SELECT max(id) AS id, content_hash FROM r WHERE content_hash NOT IN (SELECT content_hash FROM v) GROUP BY content_hash""")
def vector_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    return retrieval.vector_misses(rows, rows.where("id % 3 = 0").select("content_hash"))


@query(f"""WITH {sql.bm25(TERMS)}, b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_RERANK})),
v AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM ({_DENSE})), u AS (SELECT 'bm25' AS label, * FROM b UNION ALL SELECT 'dense', * FROM v)
SELECT id, round(sum(1.0 / (60 + rank)), 6) AS score, max(rank) FILTER (label = 'bm25') AS bm25_rank, max(rank) FILTER (label = 'dense') AS dense_rank FROM u GROUP BY id""")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    lists = {"bm25": retrieval.ranked(_reranked(spark, d).select("id", "score")), "dense": retrieval.ranked(_dense(spark, d).select("id", F.round("score", 9).alias("score")))}
    return retrieval.fuse(lists).select("id", r6("score").alias("score"), F.col("ranks")["bm25"].cast("long").alias("bm25_rank"), F.col("ranks")["dense"].cast("long").alias("dense_rank"))


_CANDIDATE = "SELECT id, symbol AS file, qualified_symbol, kind, CAST(id % 5 AS INTEGER) AS start, CAST(length(raw) AS DOUBLE) AS score FROM rec"


@query(f"""WITH {sql.RECORDS}, c AS ({_CANDIDATE}), k AS (SELECT *, row_number() OVER (PARTITION BY file, qualified_symbol, CASE WHEN kind IN ('window', 'document', 'statement') THEN start END ORDER BY score DESC, id) AS n FROM c)
SELECT id, file, qualified_symbol, start FROM k WHERE n = 1 ORDER BY score DESC, id LIMIT 50""")
def select_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = recs(spark, d).select("id", F.col("symbol").alias("file"), "qualified_symbol", "kind", (F.col("id") % 5).cast("int").alias("start"), F.length("raw").cast("double").alias("score"))
    return retrieval.select(rows, 50, [-F.col("score"), F.col("id")]).select("id", "file", "qualified_symbol", "start")


@query(f"""WITH {sql.RECORDS}, l AS (SELECT id, start, {sql.split_lines('raw')} AS ls FROM rec),
h AS (SELECT *, list_transform(ls, lambda x: len(list_intersect(list_distinct({sql.tok('x')}), {sql.strings(TERMS)}))) AS hits FROM l),
o AS (SELECT *, greatest(0, coalesce(list_position(hits, list_max(hits)), 1) - 4) AS o FROM h)
SELECT id, CAST(start + o AS INTEGER) AS preview_start, array_to_string(ls[o + 1:o + 12], chr(10)) AS preview FROM o""")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.present(recs(spark, d), TERMS).select("id", "preview_start", "preview")


@query(f"""WITH {sql.RECORDS}, m AS (SELECT id, raw, {sql.split_lines('raw')} AS ls, substr(raw, 1, strpos(raw, regexp_extract(raw, '{PATTERN}')) - 1) AS before FROM rec WHERE regexp_matches(raw, '{PATTERN}') ORDER BY id LIMIT 20),
o AS (SELECT *, length(before) - length(replace(before, chr(10), '')) AS o FROM m)
SELECT id, CAST(1 + o AS INTEGER) AS preview_start, array_to_string(ls[o + 1:o + 12], chr(10)) AS preview FROM o""")
def regex_scan(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.regex_scan(recs(spark, d), PATTERN, 20).select("id", "preview_start", "preview")


@query(f"""WITH {sql.FILES}, l AS (SELECT path, digest, {sql.split_lines('text')} AS ls FROM files)
SELECT path, CAST(3 AS INTEGER) AS start, CAST(least(42, len(ls)) AS INTEGER) AS "end", substr(array_to_string(ls[3:42], chr(10)), 1, 32000) AS text,
  length(array_to_string(ls[3:42], chr(10))) > 32000 AS truncated, digest AS source_hash FROM l""")
def read_span(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.read_span(files(spark, d), start=3)


# Snapshots


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    every = files(spark, d)
    now = every.where("doc_id % 11 <> 5").withColumn("digest", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.col("digest")))
    return now.select("path", "digest"), every.where("doc_id % 10 <> 3").select("path", "digest")


_SNAPSHOTS = f"{sql.FILES}, cur AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE digest END AS digest FROM files WHERE doc_id % 11 <> 5), old AS (SELECT path, digest FROM files WHERE doc_id % 10 <> 3)"


@query(f"WITH {_SNAPSHOTS} SELECT cur.path, cur.digest FROM cur LEFT JOIN old USING (path) WHERE cur.digest IS DISTINCT FROM old.digest")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    return changes.changed(*_snapshots(spark, d))


@query(f"WITH {_SNAPSHOTS} SELECT path, digest FROM old WHERE path NOT IN (SELECT path FROM cur)")
def deleted_files(spark: SparkSession, d: str) -> DataFrame:
    return changes.deleted(*_snapshots(spark, d))


@query(f"WITH {sql.FILES} SELECT path FROM files WHERE path IN ('src2', 'src1/en/1.src') OR starts_with(path, 'src2/') OR starts_with(path, 'src1/en/1.src/')")
def affected_files(spark: SparkSession, d: str) -> DataFrame:
    return changes.affected(files(spark, d).select("path"), ["src2", "src1/en/1.src"])


@query("SELECT count(*) AS files, count(DISTINCT source) AS sources, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("files"), F.count_distinct("source").alias("sources"), F.sum(F.length("text")).alias("chars"))


@query("SELECT 'text' AS extractor UNION ALL SELECT 'python-ast'")
def extractors(spark: SparkSession, d: str) -> DataFrame:
    made = records.parse(files(spark, d).select("path", "text").unionAll(modules(spark, d)))
    return made.where("extractor IS NOT NULL").select("extractor").distinct()


@query()
def record_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    held = recs(spark, d).withColumns({"content_hash": text.content_hash(F.col("file"), F.col("qualified_symbol"), F.col("raw")), "end": F.lit(1)})
    return evaluation.fingerprint(held)


@query(f"""WITH {_SNAPSHOTS} SELECT old.path, old.digest, cur.digest AS now FROM old LEFT JOIN cur USING (path) WHERE cur.digest IS DISTINCT FROM old.digest""")
def label_manifest(spark: SparkSession, d: str) -> DataFrame:
    now, old = _snapshots(spark, d)
    return evaluation.stale_labels(old, now)


# Evaluation


def _results(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rank = F.row_number().over(Window.partitionBy(F.col("doc_id") % 50).orderBy(F.desc("n_chars"), "doc_id"))
    start = (F.col("doc_id") % 100 + 1).cast("int")
    rows = docs.select((F.col("doc_id") % 50).alias("qid"), rank.alias("rank"), F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string")).alias("file"), F.col("lang").alias("symbol"), F.lit(None).cast("string").alias("qualified_symbol"), start.alias("start"), (start + 20).alias("end"), (start + 3).alias("preview_start"), F.lit(12).alias("preview_lines"))
    return rows.where("rank <= 50")


def _targets(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("doc_id") % 90 + 1).cast("int")
    return table(spark, d, "labels").select((F.col("doc_id") % 50).alias("qid"), F.concat(F.lit("f"), (F.col("doc_id") % 5).cast("string")).alias("file"), F.lit("en").alias("symbol"), F.lit(None).cast("string").alias("qualified_symbol"), at.alias("start"), (at + 5).alias("end"), at.alias("evidence_start"), (at + 3).alias("evidence_end")).distinct()


_EVAL = """res AS (SELECT doc_id % 50 AS qid, CAST(row_number() OVER (PARTITION BY doc_id % 50 ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank, 'f' || doc_id % 5 AS file, lang AS symbol,
    CAST(doc_id % 100 + 1 AS INTEGER) AS start, CAST(doc_id % 100 + 21 AS INTEGER) AS "end", CAST(doc_id % 100 + 4 AS INTEGER) AS preview_start FROM documents QUALIFY rank <= 50),
  tar AS (SELECT DISTINCT doc_id % 50 AS qid, 'f' || doc_id % 5 AS file, 'en' AS symbol, CAST(doc_id % 90 + 1 AS INTEGER) AS start, CAST(doc_id % 90 + 6 AS INTEGER) AS "end" FROM labels),
  hit AS (SELECT res.qid, res.rank, tar.file, tar.start, tar."end", preview_start FROM res JOIN tar ON res.qid = tar.qid AND res.file = tar.file AND res.symbol = tar.symbol AND res.start <= tar."end" AND res."end" >= tar.start),
  need AS (SELECT DISTINCT qid, file, unnest(range(start, start + 4)) AS line FROM tar),
  seen AS (SELECT DISTINCT qid, file, unnest(range(greatest(start, preview_start), least(start + 3, preview_start + 11) + 1)) AS line FROM hit WHERE rank <= 5),
  per AS (SELECT qid, count(*) AS n FROM tar GROUP BY qid), one AS (SELECT qid, min(rank) AS rank, count(DISTINCT (file, start, "end")) AS found FROM hit GROUP BY qid),
  met AS (SELECT per.qid, one.rank, coalesce(one.rank = 1, false) AS hit1, coalesce(one.rank <= 5, false) AS hit5, coalesce(1.0 / one.rank, 0) AS reciprocal_rank50, coalesce(found, 0) / CAST(n AS DOUBLE) AS target_recall50,
    coalesce((SELECT count(*) FROM seen WHERE seen.qid = per.qid), 0) / CAST((SELECT count(*) FROM need WHERE need.qid = per.qid) AS DOUBLE) AS evidence_coverage5 FROM per LEFT JOIN one USING (qid))"""


@query(f'WITH {_EVAL} SELECT qid, rank, file, start AS target_start, "end" AS target_end FROM hit')
def overlap_match(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.matches(_results(spark, d), _targets(spark, d)).select("qid", "rank", "file", "target_start", "target_end")


_ROUNDED = ("reciprocal_rank50", "target_recall50", "evidence_coverage5")


@query(f"WITH {_EVAL} SELECT qid, rank, hit1, hit5, {', '.join(f'CAST(round({c}, 6) AS DOUBLE) AS {c}' for c in _ROUNDED)} FROM met")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_results(spark, d), _targets(spark, d)).withColumns({c: r6(c) for c in _ROUNDED})


@query(f"""WITH {_EVAL}, s AS (SELECT *, CASE WHEN qid % 3 = 0 THEN 'development' ELSE 'evaluation' END AS split, CASE WHEN qid % 2 = 0 THEN 'bm25' ELSE 'dense' END AS mode, CAST(qid AS DOUBLE) AS query_ms, qid * 10 AS preview_chars5 FROM met)
SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, mode, count(*) AS questions, count(*) FILTER (hit1) AS hit1, count(*) FILTER (hit5) AS hit5, CAST(round(avg(reciprocal_rank50), 4) AS DOUBLE) AS mrr50, round(avg(target_recall50), 4) AS target_recall50,
  round(avg(evidence_coverage5), 4) AS evidence_coverage5, round(quantile_cont(query_ms, 0.5), 2) AS median_query_ms, round(quantile_disc(query_ms, 0.95), 2) AS p95_query_ms, round(avg(preview_chars5), 0) AS mean_preview_chars5
FROM s GROUP BY GROUPING SETS ((split, mode), (mode))""")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("qid")
    scored = evaluation.metrics(_results(spark, d), _targets(spark, d)).withColumns({"split": F.when(q % 3 == 0, "development").otherwise("evaluation"), "mode": F.when(q % 2 == 0, "bm25").otherwise("dense"), "query_ms": q.cast("double"), "preview_chars5": q * 10})
    return evaluation.summary(scored)


# Code graph


def modules(spark: SparkSession, d: str) -> DataFrame:
    """A Python module for each supplier, which imports the next one's."""
    k = F.col("s_suppkey")
    code = F.concat(F.lit("from m"), (k + 1).cast("string"), F.lit(" import f as g\n\n# runs\nclass C:\n    def run(self):\n        return g(self.go())\n\n    def go(self):\n        return 1\n\n\ndef f(x):\n    return g(x)\n\n\nLIMIT = "), k.cast("string"), F.lit("\n"))
    return table(spark, d, "supplier").select(F.concat(F.lit("m"), k.cast("string"), F.lit(".py")).alias("path"), code.alias("text"))


def _graph(spark: SparkSession, d: str) -> graph.Graph:
    return graph.build(modules(spark, d))


_DEFS = """(VALUES ('C', 'C', 'ClassDef', 4, 0, 9, 16), ('run', 'C.run', 'FunctionDef', 5, 4, 6, 27), ('go', 'C.go', 'FunctionDef', 8, 4, 9, 16), ('f', 'f', 'FunctionDef', 12, 0, 13, 15)) AS v(symbol, qualified_symbol, kind, line, "column", end_line, end_column)"""
_M = "m AS (SELECT s_suppkey AS k, 'm' || s_suppkey || '.py' AS file, EXISTS (SELECT 1 FROM supplier n WHERE n.s_suppkey = supplier.s_suppkey + 1) AS next FROM supplier)"


@query("""SELECT 'm' || s_suppkey || '.py' AS file, v.* FROM supplier, (VALUES ('C', 'C', 'class', 3, 4, NULL), ('run', 'C.run', 'method', 5, 6, 5), ('go', 'C.go', 'method', 8, 9, 8), ('f', 'f', 'function', 12, 13, 12), ('LIMIT', 'LIMIT', 'variable', 16, 16, NULL)) AS v(symbol, qualified_symbol, kind, start, "end", body_start)""")
def python_records(spark: SparkSession, d: str) -> DataFrame:
    return records.parse(modules(spark, d)).select("file", "symbol", "qualified_symbol", "kind", "start", "end", "body_start")


@query(f"""SELECT 'm' || s_suppkey || '.py#' || qualified_symbol AS id, 'm' || s_suppkey || '.py' AS file, v.* FROM supplier, {_DEFS}""")
def graph_definitions(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).definitions.drop("confidence", "ordinal")


@query(f"WITH {_M} SELECT file, 'm' || (k + 1) AS module, CASE WHEN next THEN 'm' || (k + 1) || '.py' END AS target_file, CASE WHEN next THEN 'scope' ELSE 'unresolved' END AS confidence FROM m")
def graph_imports(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).imports.select("file", "module", "target_file", "confidence")


@query(f"""WITH {_M}, c AS (SELECT k, file, next, v.* FROM m, (VALUES ('C.run', 'g', 6), ('C.run', 'self.go', 6), ('f', 'g', 13)) AS v(owner, expression, line))
SELECT file, line, file || '#' || owner AS source, expression, CASE WHEN expression = 'self.go' THEN file || '#C.go' WHEN next THEN 'm' || (k + 1) || '.py#f' ELSE '' END AS target FROM c""")
def graph_calls(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).calls.select("file", "line", "source", "expression", F.array_join("targets", ",").alias("target"))


@query(f"""WITH {_M} SELECT file, line FROM m, (VALUES (6), (13)) AS v(line) WHERE k = 4""")
def graph_references(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    found = graph.pointing_at(g.occurrences, graph.by_name(g.definitions, "f", "m5.py"), ["file", "ordinal"])
    return found.select("file", "line")


@query(f"""WITH {_M} SELECT file, line, source, target_kind FROM (SELECT file, 6 AS line, file || '#C.run' AS source, 'FunctionDef' AS target_kind, k FROM m UNION ALL SELECT file, 13, file || '#f', 'FunctionDef', k FROM m) WHERE k = 8""")
def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    found = graph.pointing_at(g.calls, graph.by_name(g.definitions, "f()", "m9.py"), ["file", "ordinal"])
    return graph.with_targets(found, g.definitions, ["file", "ordinal"]).select("file", "line", "source", F.col("resolved_targets")[0]["kind"].alias("target_kind"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders as edges, with their suppliers as targets."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("edge")).agg(F.array_sort(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))).alias("targets"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").where("s_nationkey % 5 = 1").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("symbol"), F.lit(0).alias("ordinal"))


@query("SELECT DISTINCT l_orderkey AS edge FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 5 = 1")
def semi_refs(spark: SparkSession, d: str) -> DataFrame:
    return graph.pointing_at(_edges(spark, d), _nodes(spark, d), ["edge"]).select("edge")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS edge, 's' || l_suppkey AS id FROM lineitem), n AS (SELECT 's' || s_suppkey AS id, s_name AS symbol FROM supplier WHERE s_nationkey % 5 = 1)
SELECT edge, coalesce(string_agg(symbol, ',' ORDER BY id) FILTER (symbol IS NOT NULL), '') AS symbols FROM e LEFT JOIN n USING (id) GROUP BY edge""")
def resolved_targets(spark: SparkSession, d: str) -> DataFrame:
    found = graph.with_targets(_edges(spark, d), _nodes(spark, d), ["edge"])
    return found.select("edge", F.array_join(F.transform("resolved_targets", lambda t: t["symbol"]), ",").alias("symbols"))


@query("""WITH s AS (SELECT c_custkey AS id, c_nationkey AS file, c_custkey % 40 AS line, c_custkey % 7 AS col, c_custkey % 40 + c_custkey % 13 AS end_line, c_custkey % 9 + 3 AS end_col FROM customer),
p AS (SELECT s_suppkey AS pid, s_nationkey AS file, s_suppkey % 50 AS line, s_suppkey % 8 AS col FROM supplier)
SELECT pid, id FROM p JOIN s ON p.file = s.file AND (s.line < p.line OR (s.line = p.line AND s.col <= p.col)) AND (p.line < s.end_line OR (p.line = s.end_line AND p.col < s.end_col))
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY s.end_line - s.line, s.end_col - s.col, id) = 1""")
def point_in_span(spark: SparkSession, d: str) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    spans = table(spark, d, "customer").select(c.alias("id"), F.col("c_nationkey").alias("file"), (c % 40).alias("line"), (c % 7).alias("column"), (c % 40 + c % 13).alias("end_line"), (c % 9 + 3).alias("end_column"))
    points = table(spark, d, "supplier").select(s.alias("pid"), F.col("s_nationkey").alias("file"), (s % 50).alias("line"), (s % 8).alias("column"))
    return graph.innermost(spans, points)


# Pages and events

_TAGS = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]+>"


@query(rf"SELECT page_id, sha256(t) AS text_sha256, len({sql.tok('t')}) AS n_tokens FROM (SELECT page_id, regexp_replace(html, '{_TAGS}', ' ', 'g') AS t FROM pages)")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    plain = table(spark, d, "pages").select("page_id", F.regexp_replace("html", _TAGS, " ").alias("t"))
    return plain.select("page_id", F.sha2("t", 256).alias("text_sha256"), F.size(text.tokens(F.col("t"))).cast("long").alias("n_tokens"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS batch, user_id, count(*) AS events, max(event_id) AS last_event FROM events GROUP BY ALL")
def event_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("batch"), "user_id").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))


#: Events as changes of files, in the part of SQL that both engines share.
_CHANGES = (
    "event_id AS seq",
    "CASE user_id % 50 WHEN 0 THEN '.git/HEAD' WHEN 1 THEN 'node_modules/x.js' WHEN 2 THEN 'a/.gitignore' ELSE concat('src/u', user_id, '.py') END AS path",
    "CASE event_id % 5 WHEN 0 THEN 'modified' WHEN 1 THEN 'created' WHEN 2 THEN 'deleted' WHEN 3 THEN 'moved' ELSE 'opened' END AS kind",
    "event_id % 7 = 0 AS is_dir",
)


@query(f"""WITH e AS (SELECT {', '.join(_CHANGES)} FROM events)
SELECT path, max(seq) AS seq, bool_or(path IN ('.git/HEAD', 'a/.gitignore')) AS "full" FROM e
WHERE kind <> 'opened' AND NOT (is_dir AND kind = 'modified') AND path <> 'node_modules/x.js' GROUP BY path""")
def coalesced_changes(spark: SparkSession, d: str) -> DataFrame:
    return follow.coalesced(table(spark, d, "events").selectExpr(*_CHANGES))
