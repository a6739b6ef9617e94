"""What an index has written, and what its queries read of it: stems, vectors by encoder, the graph, budgets, seals."""

import hashlib
import json
import sqlite3
import subprocess
import time

import pytest
from loomseek import evaluate
from loomseek.engine import Engine
from loomseek.functions import encoder, porter, text
from loomseek.operators import graph, lexical, records, retrieval
from loomseek.sources import tree
from loomseek.streaming import follow
from pyspark.sql import functions as F

POOL = '''class Pool:
    def connections(self):
        """Opens connections and counts them."""
        return 1


def caller(pool):
    return pool.connections()
'''


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    (base / "pool.py").write_text(POOL)
    (base / "notes.txt").write_text("Counting of connected pools.\nNothing else.\n")
    (base / "view.tsx").write_text("export function view() {}\nexport function other() {}\n")
    return base


@pytest.fixture(scope="module")
def engine(spark, root, tmp_path_factory):
    def by_lines(source):
        """A parser of one record for each line."""
        names = [line.split()[2].rstrip("()") for line in source.splitlines()]
        return [{"symbol": n, "qualified_symbol": n, "kind": "function", "declaration_start": i, "body_start": i, "body_end": i, "start": i, "text": line} for i, (n, line) in enumerate(zip(names, source.splitlines(), strict=True), 1)]

    made = Engine(spark, f"file://{tmp_path_factory.mktemp('home')}", root, parsers={".tsx": ("by-lines", by_lines)})
    made.refresh()
    return made


def test_the_engine_searches_by_stems(engine):
    found = engine.query("connection", "bm25", include_docs=True).results.orderBy("rank").collect()
    assert {(r["file"], r["qualified_symbol"]) for r in found} == {("pool.py", "Pool.connections"), ("pool.py", "caller"), ("notes.txt", "file")}
    fts = sqlite3.connect(":memory:")
    fts.execute("CREATE VIRTUAL TABLE p USING fts5(a, b, c, tokenize='porter unicode61')")
    join = lambda x: " ".join(text.words(x))
    for r in engine.table("records").orderBy("id").collect():
        fts.execute("INSERT INTO p(rowid, a, b, c) VALUES (?, ?, ?, ?)", (r["id"], join(r["file"]), join(r["qualified_symbol"]), join(r["raw"])))
    for asked in ("connection", "counting pools", "view other nothing"):
        terms, stats = text.query_terms(asked), engine.table("meta").head()
        got = {r["id"]: r["lexical"] for r in lexical.bm25_stored(engine.table("postings"), stats["n_records"], stats["n_tokens"], lexical.stems_of(terms)).collect()}
        want = dict(fts.execute("SELECT rowid, -bm25(p, 3.0, 5.0, 1.0) FROM p WHERE p MATCH ?", (" OR ".join(terms),)).fetchall())
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in got)


def test_stored_and_computed_scores_agree(spark):
    rows = spark.createDataFrame([(i, f"p/{i}.txt", f"s{i % 3}", "one two " * (i % 5) + f"three word{i % 4}") for i in range(40)], "id long, file string, symbol string, raw string")
    fields = records.posting_fields(rows, F.col("file"), F.col("symbol"), F.col("raw"))
    posts = lexical.stored(fields, stems=False).cache()
    n, total = rows.count(), posts.agg(F.sum(F.col("tf_path") + F.col("tf_symbol") + F.col("tf_body"))).head()[0]
    scores = lambda df: {r["id"]: round(r["lexical"], 9) for r in df.collect()}
    for terms in (["two", "word1"], ["absent"], ["p", "three", "s2"]):
        assert scores(lexical.bm25_stored(posts, n, total, terms)) == scores(lexical.bm25(fields, terms))
    some = rows.where("id % 2 = 0")
    assert scores(lexical.bm25_stored(posts, n, total, ["two"], some)) == scores(lexical.bm25(fields, ["two"], F.col("id") % 2 == 0))
    assert lexical.bm25_stored(posts, n, total, []).count() == 0
    assert porter.stem("connections") == "connect"


def test_another_encoder_makes_other_vectors(spark, root, tmp_path):
    home = f"file://{tmp_path}/home"
    first = Engine(spark, home, root)
    first.refresh()
    assert first.route("no such symbol here")[1] == "bm25"
    narrow = Engine(spark, home, root, encode=lambda c: encoder.hashed(c, 8))
    assert narrow.signature != first.signature and narrow.refresh()["updated"] == 0
    assert {r["dim"] for r in narrow.table("vectors").select("dim").distinct().collect()} == {8}
    scores = [r["score"] for r in narrow.query("count connections", "dense", include_docs=True).results.collect()]
    assert scores and all(s is not None and -1.001 <= s <= 1.001 for s in scores)
    assert narrow.route("no such symbol here")[1] == "hybrid" and narrow.refresh()["generation"] == narrow.generation == 2


def test_parsers_and_the_graph_are_published(engine):
    assert [r["qualified_symbol"] for r in engine.table("records").where("extractor = 'by-lines'").orderBy("start").collect()] == ["view", "other"]
    assert engine.status()["extractors"] == {"python-ast": 3, "by-lines": 2, "text": 1}
    built, read = graph.build(engine.table("files")), engine.graph()
    for name in ("definitions", "imports", "occurrences", "calls"):
        assert sorted(map(str, getattr(built, name).collect())) == sorted(map(str, getattr(read, name).collect()))


def test_lines_end_as_the_parser_says(spark):
    source = "import os\r\rdef f(x):\r    return os.path.join(x, 'é😀', f(x))\r"
    files = spark.createDataFrame([("m.py", source)], "path string, text string")
    calls = {r["expression"]: (r["line"], r["column"]) for r in graph.build(files).calls.collect()}
    assert calls == {"os.path.join": (4, 11), "f": (4, 34)}
    assert [(r["qualified_symbol"], r["start"], r["end"] if "end" in r else None) for r in records.file_records("m.py", source)] == [("f", 3, None)]


def test_regular_expressions_have_a_budget(spark, engine):
    assert [r["preview_start"] for r in engine.query(r"re: counts\s+them").results.collect()] == [3]
    slow = spark.createDataFrame([(1, "f", 1, "a" * 40 + "!")], "id long, file string, start int, raw string")
    began = time.monotonic()
    with pytest.raises(Exception, match=r"(?i)time"):
        retrieval.regex_search(slow, r"(a|aa|a?)+$", 5).collect()
    assert time.monotonic() - began < 20


def test_paths_stay_inside_and_the_diff_is_attached(engine, root):
    for bad in ({"path": "../up"}, {"file": "/etc/passwd"}, {"context": {"active_file": "../x"}}):
        with pytest.raises(ValueError):
            engine.query("pool", "bm25", **bad)
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    (root / "notes.txt").write_text("Counting of connected pools.\nSomething else.\n")
    got = engine.query("pools", "bm25", include_docs=True, context={"include_git_diff": True}).context["git"]
    (root / "notes.txt").write_text("Counting of connected pools.\nNothing else.\n")
    assert got["files"] == ["notes.txt"] and "+Something else." in got["diff"]


def test_a_change_without_an_event_is_found(spark, root, tmp_path):
    made = Engine(spark, f"file://{tmp_path}/home", root)
    made.refresh()
    (tmp_path / "log").mkdir()
    query = follow.follow(spark, f"file://{tmp_path}/log", made, f"file://{tmp_path}/checkpoint", every=0.5)
    try:
        (root / "late.py").write_text("def late():\n    return 1\n")
        until = time.monotonic() + 120
        while made.generation < 2 and time.monotonic() < until:
            time.sleep(0.5)
        assert made.query("late", "symbol").results.count() == 1
    finally:
        query.stop()
        (root / "late.py").unlink()


def test_points_meet_the_spans_of_their_block(spark):
    spans = spark.createDataFrame([("all", "f", 1, 0, 900, 0), ("in", "f", 100, 4, 140, 9), ("near", "f", 120, 0, 121, 0), ("other", "g", 1, 0, 500, 0)], "id string, file string, line int, column int, end_line int, end_column int")
    points = spark.createDataFrame([(1, "f", 120, 5), (2, "f", 130, 0), (3, "f", 899, 3), (4, "f", 901, 0), (5, "g", 120, 0), (6, "f", 140, 8), (7, "f", 140, 9)], "pid int, file string, line int, column int")
    got = {r["pid"]: r["id"] for r in graph.innermost(spans, points).collect()}
    assert got == {1: "near", 2: "in", 3: "all", 5: "other", 6: "in", 7: "all"}


def test_a_seal_and_spans_are_checked(engine, tmp_path):
    digest = engine.table("files").where("path = 'pool.py'").head()["digest"]
    target = {"file": "pool.py", "symbol": "caller", "qualified_symbol": "caller", "start": 7, "end": 8, "evidence_start": 7, "evidence_end": 8}
    data = {"source_snapshot": {"files": {"pool.py": digest}}, "queries": [{"id": "q", "query": "caller pool", "split": "development", "category": "text", "expected": [target]}]}
    path = tmp_path / "l.json"
    path.write_text(json.dumps(data))
    (tmp_path / "l.sha256").write_text("0\n")
    with pytest.raises(evaluate.StaleLabels):
        evaluate.run(engine, f"file://{path}")
    (tmp_path / "l.sha256").write_text(hashlib.sha256(path.read_bytes()).hexdigest() + "\n")
    out = evaluate.run(engine, f"file://{path}", sealed=True)
    assert out["dataset_sha256"] == hashlib.sha256(path.read_bytes()).hexdigest() and out["implementation_sha256"] == evaluate.implementation()
    target["evidence_end"] = 9
    path.write_text(json.dumps(data))
    (tmp_path / "l.sha256").unlink()
    with pytest.raises(ValueError, match="evidence"):
        evaluate.run(engine, f"file://{path}")


def test_a_tree_without_git_is_walked(tmp_path):
    for name in ("a/b/c.txt", "a/_x.py", "node_modules/m.js", "a/dist/y.py", "z.md", ".hidden/h.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "link").symlink_to(tmp_path / "a", target_is_directory=True)
    assert tree.listed(tmp_path) == [".hidden/h.txt", "a/_x.py", "a/b/c.txt", "z.md"]
    assert tree.listed(tmp_path, ["a/b", "z.md", "absent"]) == ["a/b/c.txt", "z.md"]


def test_dense_batches_beyond_a_few_blocks_are_written(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "id long, embedding array<float>")
    asked = rows.where("id < 12").withColumnRenamed("id", "qid")
    plain = sorted(map(tuple, retrieval.dense_batch(rows, asked, cut=3).collect()))
    monkeypatch.setattr(retrieval, "FEW_BLOCKS", 1)
    assert sorted(map(tuple, retrieval.dense_batch(rows, asked, cut=3, block=3).collect())) == plain and len(plain) == 36
