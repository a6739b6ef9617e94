"""The engine, its parts and the stream on small source trees."""

import json
import math
import sqlite3
import subprocess

import pytest
from loomseek.engine import Engine, IndexFailure, checked_context
from loomseek.functions import encoder, porter, text
from loomseek.operators import changes, evaluation, graph, lexical, records, retrieval
from loomseek.sources import labels, snapshot, tree
from loomseek.streaming import follow
from pyspark.sql import functions as F

CACHE = '''import time
from helpers import clock as now


# Keeps values
# for a while.
@decorated
class Cache(Base):
    """Doc."""

    limit: int = 3

    # Reads a value.
    @property
    def read(self, key):
        return self.lookup(key) or now()

    async def lookup(self, now):
        return now()


def build():
    return Cache(time.time())


DEFAULT = build()
'''
HELPERS = "def clock():\n    return 1\n"


@pytest.fixture
def root(tmp_path):
    (tmp_path / "tree" / "pkg").mkdir(parents=True)
    base = tmp_path / "tree"
    (base / "cache.py").write_text(CACHE)
    (base / "helpers.py").write_text(HELPERS)
    (base / "pkg" / "__init__.py").write_text("")
    (base / "pkg" / "queue.ts").write_text("export class RetryQueue {\n  pushJob() { return 1 }\n}\n")
    (base / "README.md").write_text("# Retry queue\nHow retries work.\n")
    (base / "dist").mkdir()
    (base / "dist" / "x.py").write_text("x = 1\n")
    (base / ".env.local").write_text("A=1\n")
    (base / "bad.bin").write_bytes(b"a\x00b")
    (base / "latin.txt").write_bytes(b"caf\xe9")
    (base / "skip.min.js").write_text("x")
    (base / ".loomseekignore").write_text("# generated\n*.min.js\n")
    return base


@pytest.fixture
def engine(spark, root, tmp_path):
    made = Engine(spark, f"file://{tmp_path}/home", root)
    made.refresh()
    return made


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_discovery(spark, root):
    assert paths(tree.files(spark, root)) == ["README.md", "cache.py", "helpers.py", "pkg/__init__.py", "pkg/queue.ts"]
    assert paths(tree.files(spark, root, ["pkg", "helpers.py"])) == ["helpers.py", "pkg/__init__.py", "pkg/queue.ts"]
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / ".gitignore").write_text("helpers.py\n")
    assert "helpers.py" not in paths(tree.files(spark, root))
    with pytest.raises(ValueError):
        tree.confined(root, "../up")


def test_python_records():
    got = {(r["qualified_symbol"], r["kind"], r["start"], r["body_start"]) for r in records.file_records("cache.py", CACHE)}
    assert got == {("Cache", "class", 5, None), ("Cache.limit", "variable", 11, None), ("Cache.read", "method", 13, 15), ("Cache.lookup", "method", 18, 18), ("build", "function", 22, 22), ("DEFAULT", "variable", 26, None)}
    assert records.file_records("x.md", "t")[0]["kind"] == "document" and records.file_records("x.py", "import a\n")[0]["kind"] == "window"
    with pytest.raises(SyntaxError):
        records.file_records("x.py", "def (")


def test_chunk_bounds():
    got = records.bounded("x" * 4000 + "\nshort\n", 3)
    assert [(s, e) for s, e, _ in got] == [(3, 3), (3, 3), (3, 4)] and all(len(t) <= 1800 for *_, t in got)
    assert [(s, e) for s, e, _ in records.bounded("a\n" * 95)] == [(1, 40), (41, 80), (81, 95)]
    assert records.bounded(" \n\n") == [] and records.bounded("") == []


def test_tokens_agree_between_driver_and_columns(spark):
    samples = ["parseHTTPServer x2Y", "naïve_straße ÉCOLE", "áb 東京 x_y-z", "", "ΣΑΣ ﬁt", "fooBAR9Baz"]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").select("i", text.tokens(F.col("s")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: text.words(s) for i, s in enumerate(samples)}
    assert text.query_terms("How do I find the code") == []


def test_lines_agree_with_python(spark):
    samples = ["", "a", "a\n", "a\r\nb\rc\n\nd", "a\x0bb\x1cc\x85d e", "\n"]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string").select("i", text.lines(F.col("s")).alias("l")).collect()
    assert {r["i"]: r["l"] for r in got} == {i: s.splitlines() for i, s in enumerate(samples)}


WORDS = ["running", "runs", "cache", "caching", "café", "relational", "queue", "retry", "retries", "happily", "the", "ties", "vector", "vectors", "hopping"]


def fields_of(spark, n=120):
    import random

    rnd = random.Random(1)
    pick = lambda k: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, k)))
    rows = [(i, pick(3), pick(4), pick(40)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, file string, qualified_symbol string, raw string")
    return rows, records.posting_fields(df, F.col("file"), F.col("qualified_symbol"), F.col("raw"))


def fts(rows, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, c, tokenize='porter unicode61')")
    for i, *texts in rows:
        con.execute("INSERT INTO t(rowid, a, b, c) VALUES (?, ?, ?, ?)", (i + 1, *(" ".join(text.words(x)) for x in texts)))
    match = " OR ".join(f'"{q}"' for q in query)
    return {r[0] - 1: -r[1] for r in con.execute("SELECT rowid, bm25(t, 3.0, 5.0, 1.0) FROM t WHERE t MATCH ?", (match,))}


def test_stemmed_bm25_agrees_with_fts5(spark):
    rows, fields = fields_of(spark)
    query = ["running", "retries", "cafe", "vector"]
    asked = spark.createDataFrame([(0, s) for s in lexical.stems_of(query)], "qid int, term string")
    got = {r["id"]: r["lexical"] for r in lexical.bm25_from_postings(lexical.stemmed(fields), lexical.lengths(fields), asked, cut=1000).collect()}
    want = fts(rows, query)
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_single_and_batch_bm25_agree(spark):
    _, fields = fields_of(spark)
    terms = ["cache", "queue", "ties"]
    one = {r["id"]: round(r["lexical"], 9) for r in lexical.bm25(fields, terms).collect()}
    asked = spark.createDataFrame([(0, t) for t in terms], "qid int, term string")
    many = {r["id"]: round(r["lexical"], 9) for r in lexical.bm25_from_postings(lexical.postings(fields), lexical.lengths(fields), asked).collect()}
    assert one == many and lexical.bm25(fields, []).count() == 0


def test_porter_agrees_with_fts5():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    for w in [*WORDS, "conditional", "vietnamization", "formalize", "triplicate", "sky", "hissing", "controlling", "agreed", "naïve", "at", "adoption", "probate", "cease"]:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        assert con.execute("SELECT term FROM v").fetchone()[0] == porter.stem(w)


def test_fusion(spark):
    make = lambda ids: spark.createDataFrame([(i, k + 1, f"p{i}") for k, i in enumerate(ids)], "id long, rank int, payload string")
    got = retrieval.fuse({"bm25": make([1, 2]), "dense": make([2, 3])}).orderBy(F.desc("score"), "id").collect()
    assert [r["id"] for r in got] == [2, 1, 3] and got[0]["ranks"] == {"bm25": 2, "dense": 1} and got[0]["payload"] == "p2"
    assert math.isclose(got[0]["score"], 1 / 62 + 1 / 61)


def test_dense_batch_agrees_with_single(spark):
    df = spark.range(200).select("id", F.array(*(F.sin(F.col("id") * k + 1) for k in range(1, 9))).cast("array<float>").alias("embedding"))
    asked = df.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    got = {}
    for r in retrieval.dense_batch(df, asked, cut=5, block=3).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for q in (0, 50, 100, 150):
        v = df.where(F.col("id") == q).head()["embedding"]
        assert [i for _, i in sorted(got[q])] == [r["id"] for r in retrieval.dense(df, v, 5).collect()]
    with pytest.raises(Exception, match="not finite"):
        retrieval.sound(spark.createDataFrame([(1, [0.0, 0.0])], "id long, embedding array<float>")).collect()


def test_encoder_gives_unit_vectors(spark):
    got = spark.createDataFrame([("a b c",), ("",), (None,)], "s string").select(encoder.hashed(F.col("s")).alias("v")).collect()
    assert all(len(r["v"]) == encoder.DIMENSIONS and math.isclose(sum(x * x for x in r["v"]), 1, rel_tol=1e-5) for r in got)


def test_modes(engine):
    ids = lambda a: [(r["file"], r["qualified_symbol"]) for r in a.results.orderBy("rank").collect()]
    assert ids(engine.query("build()", "symbol")) == [("cache.py", "build")]
    auto = engine.query("Cache.lookup")
    assert auto.mode == "symbol" and ids(auto) == [("cache.py", "Cache.lookup")]
    assert ids(engine.query("lookup key reads", "bm25"))[0][1] in ("Cache.read", "Cache.lookup")
    assert ids(engine.query("what is the", "bm25")) == [] and ids(engine.query('"; DROP TABLE -- *', "bm25", include_docs=True)) == []
    assert engine.query("push job of the queue", "hybrid", include_docs=True).results.count() == 5
    assert all(f != "README.md" for f, _ in ids(engine.query("retry queue", "dense", limit=50)))
    assert ("README.md", "file") in ids(engine.query("retry queue works", "bm25", include_docs=True))
    assert ids(engine.query("retry", "bm25", path="pkg/", include_docs=True)) == [("pkg/queue.ts", "file")]
    found = engine.query("re: push[A-Z]\\w+").results.collect()
    assert [(r["file"], r["preview_start"]) for r in found] == [("pkg/queue.ts", 2)]
    for bad in ({"mode": "x"}, {"limit": 0}, {"limit": 51}, {"query": "x" * 8001}):
        with pytest.raises(ValueError):
            engine.query(**bad)
    assert engine.query(context={"selection": {"text": "build"}}).mode == "symbol"
    with pytest.raises(ValueError):
        checked_context({"selection": {"text": "x" * 16_001}})


def test_read(engine):
    row = engine.read("helpers.py", 2, 9).head()
    assert (row["text"], row["end"], row["truncated"]) == ("    return 1", 2, False)


def test_navigation(engine):
    rows = lambda df: [(r["file"], r["line"]) for r in df.collect()]
    assert rows(engine.navigate("definitions", "Cache.read")) == [("cache.py", 15)]
    assert rows(engine.navigate("references", "clock")) == [("cache.py", 16)]  # not in lookup, where a parameter hides it
    assert rows(engine.navigate("callers", "clock")) == [("cache.py", 16)]
    called = engine.navigate("calls", "Cache.read").collect()
    assert [(r["expression"], [t["id"] for t in r["resolved_targets"]]) for r in called] == [("self.lookup", ["cache.py#Cache.lookup"]), ("now", ["helpers.py#clock"])]
    assert [(r["module"], r["target_file"]) for r in engine.navigate("imports", "cache.py").collect()] == [("time", None), ("helpers", "helpers.py")]
    assert [r["id"] for r in engine.navigate("definitions", file="cache.py", line=16, column=36).collect()] == ["helpers.py#clock"]
    assert [r["id"] for r in engine.navigate("definitions", file="cache.py", line=14, column=4).collect()] == ["cache.py#Cache"]
    assert engine.query("refs: clock").results.count() == 1


def test_incremental_refresh(spark, engine, root):
    before = engine.generation
    assert engine.refresh() == {"updated": 0, "deleted": 0, "generation": before}
    (root / "helpers.py").write_text(HELPERS + "\n\ndef fresh():\n    return 2\n")
    (root / "pkg" / "queue.ts").rename(root / "pkg" / "jobs.ts")
    assert engine.refresh(["helpers.py"])["updated"] == 1 and engine.query("fresh", "symbol").results.count() == 1
    assert engine.query("RetryQueue", "bm25").results.head()["file"] == "pkg/queue.ts"
    got = engine.refresh(["pkg"])
    assert (got["updated"], got["deleted"]) == (1, 1) and engine.query("RetryQueue", "bm25").results.head()["file"] == "pkg/jobs.ts"
    assert engine.generation == before + 2 and snapshot.generations(spark, engine.home) == [before + 1, before + 2]
    assert engine.status()["files"] == 4  # the empty file has no records


def test_a_parse_failure_keeps_the_snapshot(engine, root):
    at = engine.generation
    (root / "helpers.py").write_text("def broken(:\n")
    with pytest.raises(IndexFailure):
        engine.refresh()
    assert engine.generation == at and engine.table("records").where("qualified_symbol = 'clock'").count() == 1
    with pytest.raises(IndexFailure):
        engine.query("clock", "symbol")
    (root / "helpers.py").write_text(HELPERS)
    engine.refresh()
    assert engine.query("clock", "symbol").results.count() == 1


def test_stream_of_changes(spark, engine, root, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    query = follow.follow(spark, f"file://{log}", engine, f"file://{tmp_path}/checkpoint")
    try:
        (root / "helpers.py").write_text(HELPERS + "\n\ndef streamed():\n    return 3\n")
        events = [{"seq": 1, "path": "helpers.py", "kind": "modified", "is_dir": False}] * 3 + [{"seq": 2, "path": "dist/x.py", "kind": "modified", "is_dir": False}]
        (log / "1.json").write_text("\n".join(map(json.dumps, events)))
        follow.flush(query)
        assert engine.query("streamed", "symbol").results.count() == 1
        (root / "helpers.py").write_text("def (")
        (log / "2.json").write_text(json.dumps({"seq": 3, "path": "helpers.py", "kind": "modified", "is_dir": False}))
        follow.flush(query)
        assert engine.error
        (root / "helpers.py").unlink()
        (log / "3.json").write_text(json.dumps({"seq": 4, "path": "helpers.py", "kind": "deleted", "is_dir": False}))
        follow.flush(query)
        assert engine.error is None and engine.query("streamed", "symbol").results.count() == 0
    finally:
        query.stop()


def test_coalesced_events(spark):
    rows = [(1, "a.py", "modified", False), (2, "a.py", "created", False), (3, "src", "modified", True), (4, ".git/HEAD", "modified", False), (5, ".git/x", "modified", False), (6, "b/.gitignore", "moved", False), (7, "c.py", "opened", False)]
    got = {r["path"]: (r["seq"], r["full"]) for r in follow.coalesced(spark.createDataFrame(rows, follow.SCHEMA)).collect()}
    assert got == {"a.py": (2, False), ".git/HEAD": (4, True), "b/.gitignore": (6, True)}


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("d/x", "1"), ("dx", "1")], "path string, digest string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "path string, digest string")
    assert paths(changes.changed(now, old)) == ["b", "c"] and paths(changes.deleted(now, old)) == ["d/x", "dx"] and paths(changes.affected(old, ["d"])) == ["d/x"]


def test_evaluation_counts_no_neighbour(spark):
    results = [(1, 1, "a", "f", None, 1, 4, 1, 4), (1, 2, "a", "f", None, 10, 20, 10, 3)]
    targets = [(1, "a", "f", None, 12, 18, 12, 15)]
    r = spark.createDataFrame(results, "qid long, rank int, file string, symbol string, qualified_symbol string, start int, end int, preview_start int, preview_lines int")
    t = spark.createDataFrame(targets, "qid long, file string, symbol string, qualified_symbol string, start int, end int, evidence_start int, evidence_end int")
    m = evaluation.metrics(r, t).head()
    assert (m["rank"], m["hit1"], m["hit5"], m["reciprocal_rank50"], m["evidence_coverage5"]) == (2, False, True, 0.5, 0.25)


def test_labels(spark, tmp_path):
    data = {"source_snapshot": {"files": {"a.py": "x"}}, "queries": [{"id": "q", "query": "find", "split": "development", "category": "symbol", "expected": [{"file": "a.py", "symbol": "f", "start": 1, "end": 2, "evidence_start": 1, "evidence_end": 1}]}]}
    (tmp_path / "l.json").write_text(json.dumps(data, indent=1))
    q, t, m = labels.load(spark, f"file://{tmp_path}/l.json")
    assert q.count() == t.count() == 1 and m.head()["digest"] == "x"
    assert evaluation.stale_labels(m, spark.createDataFrame([("a.py", "y")], "path string, digest string")).count() == 1


def test_git_diff(spark, root):
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    (root / "helpers.py").write_text(HELPERS + "# more\n")
    (root / "latin.txt").write_bytes(b"x")
    got = tree.git_diff(root, tree.files(spark, root).where("path = 'helpers.py'"))
    assert got["files"] == ["helpers.py"] and "+# more" in got["diff"]


def test_duplicate_ids_keep_the_last_definition(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n\n\ndef f():\n    pass\n\n\nf()\n")], "path string, text string")
    g = graph.build(files)
    call = graph.with_targets(g.calls, g.definitions, ["file", "ordinal"]).head()
    assert [t["line"] for t in call["resolved_targets"]] == [5]


def test_label_run_and_commands(spark, engine, root, tmp_path, capsys):
    from loomseek import cli, evaluate

    digest = engine.table("files").where("path = 'helpers.py'").head()["digest"]
    expected = {"file": "helpers.py", "symbol": "clock", "qualified_symbol": "clock", "start": 1, "end": 2, "evidence_start": 1, "evidence_end": 2}
    data = {"source_snapshot": {"files": {"helpers.py": digest}}, "queries": [{"id": "q", "query": "clock returns", "split": "development", "category": "text", "expected": [expected]}]}
    (tmp_path / "l.json").write_text(json.dumps(data))
    out = evaluate.run(engine, f"file://{tmp_path}/l.json", tmp_path / "report.json")
    assert {(r["split"], r["mode"]) for r in out["summary"]} == {(s, m) for s in ("development", "all") for m in evaluate.MODES}
    assert all(r["hit5"] and r["evidence_coverage5"] == 1 for r in out["queries"]) and json.loads((tmp_path / "report.json").read_text())["records"] == out["records"]
    data["source_snapshot"]["files"]["helpers.py"] = "0"
    (tmp_path / "l.json").write_text(json.dumps(data))
    with pytest.raises(evaluate.StaleLabels):
        evaluate.run(engine, f"file://{tmp_path}/l.json")
    asked = lambda *a: cli.answer(engine, cli.parser().parse_args(["--root", str(root), *a]))
    assert asked("callers", "clock")["results"][0]["source"] == "cache.py#Cache.read"
    assert asked("search", "build")["route"]["mode"] == "symbol" and asked("read", "helpers.py")[0]["end"] == 2
    assert asked("sync", "pkg")["updated"] == 0 and asked("status")["generation"] == engine.generation
