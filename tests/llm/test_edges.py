"""What every operator does with clashing columns, empty tables, nulls and repeated rows, and methods against brute force."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from loomseek.llm import chat, common, decontamination, media, minhash, mixing, passages, secrets, sharding, toxicity, warc
from pyspark.sql import functions as F
from test_operators import DOCS, entropies, frame, shingles, words

#: Names that operators use themselves, in results or on the way.
CLASH = ("row_", "text_", "size", "Shard", "slot", "law", "text_crc32", "copies", "taken", "target", "score", "predicted", "component_id", "kept", "file_", "place_", "h_", "key_", "seed", "p", "a", "b", "media", "payload", "digest", "_metadata", "c0_", "of_file_", "rank_", "dotted.name")


def strings(n):
    return " ".join(f"w{n}x{i}" for i in range(60))


ROWS = [(1, strings(1), "en", "a", 1), (2, strings(1), "en", "a", 1), (2, strings(1), "en", "a", 1), (3, strings(2) + " password=abcdefgh1", "en", None, None), (None, strings(3), None, "b", None), (None, None, None, None, None), (7, "", "en", "b", 0), (8, "short", "en", "b", 0)]


def clashing(df):
    return df.select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASH))


OPERATORS = {
    "op1": passages.shared_passages,
    "op3": lambda df: sharding.minimax_shards(df, 4),
    "op5": minhash.near_duplicates,
    "op5 one of each": minhash.one_of_each,
    "op8": secrets.find_secrets,
    "op9": media.fingerprints,
    "op10": mixing.mix,
    "op10 rows": mixing.mixed_rows,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents_with_clashing_columns_and_none_at_all(spark, name):
    made, docs = OPERATORS[name], frame(spark, ROWS)
    common.small_batches(spark)
    plain = made(docs)
    wide = made(clashing(docs)).select(*(common.quoted(c) for c in plain.columns))
    assert Counter(map(str, plain.collect())) == Counter(map(str, wide.collect()))
    empty = made(clashing(docs).limit(0))
    assert empty.count() == 0 and set(plain.columns) <= set(empty.columns)


def test_pages_items_turns_and_labels_with_clashing_columns(spark, monkeypatch):
    docs, items = frame(spark, ROWS), spark.createDataFrame([(1, strings(1)), (2, strings(9)), (None, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(clashing(docs), clashing(items)).collect()}
    assert found == {(1, 1), (2, 1)}
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)  # the other way, by shuffle
    assert found == {(r["doc_id"], r["item_id"]) for r in decontamination.contained_items(clashing(docs), clashing(items)).collect()}
    assert decontamination.contained_items(clashing(docs).limit(0), items).count() == decontamination.contained_items(docs, clashing(items).limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert chat.prefix_targets(clashing(turns)).count() == 1
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (1, "v", "y"), (None, None, None), (None, None, None)], "page_id long, url string, html string")
    heads = [bytes(r["header"]).decode() for r in warc.restore(warc.write_archive(clashing(pages))).collect()]
    ids = [next(line for line in h.split("\r\n") if line.startswith("WARC-Record-ID")) for h in heads]
    assert len(set(ids)) == len(ids) == 5 and "WARC-Record-ID: <urn:page:1>" in ids
    model = toxicity.Model({("idiot", True): 4.0})
    assert toxicity.score(clashing(docs), model).count() == len(ROWS)


def test_the_pipeline_carries_clashing_columns(spark, tmp_path):
    d = f"file://{tmp_path}"
    docs = frame(spark, [r for r in ROWS if r[0] != 3] + [(20 + i, strings(20 + i), "en", "a", 1) for i in range(5)])
    docs.withColumns({c: F.lit(c) for c in ("size", "shard", "law", "Copies", "row_", "dotted.name")}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "nothing of this is there at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = corpus_pipeline.run(spark, d)
    assert {"document_size", "document_shard", "document_law", "Copies", "row_", "dotted.name", "size", "shard"} <= set(out.columns)
    assert {r["document_size"] for r in out.collect()} == {"size"}


def test_short_media_have_fingerprints_and_are_read_back(spark):
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(["one short text", "another short text", "a third"])])
    held = media.store(docs)
    assert held.columns == ["doc_id", "n_bytes", "media"] and all(bytes(r["media"])[:4] == b"RIFF" for r in held.collect())
    got = media.describe_media(held).collect()
    assert len({r["feature"] for r in got}) == 3 and all(r["fingerprint_time"] for r in got)
    assert Counter(map(str, got)) == Counter(map(str, media.fingerprints(docs).collect()))


def test_joined_entropy_spans_by_brute_force():
    rnd = random.Random(12)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    _, width, least = secrets.CLASSES["base64"][0], *secrets.CLASSES["base64"][1:]
    for _ in range(60):
        run = "".join(rnd.choice(alphabet[: rnd.choice([4, 20, 64])]) for _ in range(rnd.randint(20, 40))) + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) + "aA" * rnd.randint(0, 30)
        covered = [False] * len(run)
        for i, e in enumerate(entropies(run, width)):
            if e >= least - 1e-9:
                covered[i : i + width] = [True] * width
        want = [(i, j) for i in range(len(run)) for j in range(i + 1, len(run) + 1) if all(covered[i:j]) and (i == 0 or not covered[i - 1]) and (j == len(run) or not covered[j])]
        if any(p.match(run) for p in secrets.ALLOWED) or secrets.CLASSES["hex"][0].fullmatch(run):
            continue
        got = [(a, b) for a, b, kind in secrets.entropy_spans(f"x. {run} .") if kind == "entropy_base64"]
        merged = []
        for a, b in got:  # spans that touch are one stretch of covered characters
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        assert [(a - 3, b - 3) for a, b in merged] == want


def drawn_by_brute_force(rows, seed, most=3):
    """copies by id, as the docstring of mixing says; rows: (id, words, source)."""
    import hashlib

    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    sums = [sum(n for _, n, s in rows if s == name) for name in names]
    out = {}
    for name, total, aim in zip(names, sums, mixing.targets(sums, [mixing.WEIGHTS[i % 3] for i in range(len(names))], most), strict=True):
        mine = [(i, n) for i, n, s in rows if s == name]
        whole = min(int(aim / total + 1e-9), most) if total else 0
        out |= {i: whole for i, _ in mine}
        missing = max(0.0, aim - whole * total)
        sizes = sorted({n for _, n in mine if n}, reverse=True)
        for top in sizes:
            left = missing - sum(n for _, n in mine if n > top)
            squares = sum(n * n for _, n in mine if n <= top)
            if left * top <= squares:
                break
        if not missing or not sizes:
            continue
        pool = sum(n for _, n in mine if n <= top)
        draws = int(np.floor(left / squares * pool + 0.5))
        u = lambda i: (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        odds = lambda p: p / (1 - p)
        order = sorted(((odds(u(i)) / odds(min(draws * n / pool, mixing.ALMOST)), i, n) for i, n in mine if 0 < n <= top), key=lambda x: (x[0], x[1])) if draws else []
        taken, rest = order[:draws], order[draws:]
        short = left - sum(n for *_, n in taken)
        for k in range(min(mixing.CLOSING, len(taken), len(rest))):
            more = rest[k][2] - taken[-1 - k][2]
            if abs(short - more) < abs(short):
                short -= more
                taken[-1 - k], rest[k] = rest[k], taken[-1 - k]
        for i in [i for _, i, _ in taken] + [i for i, n in mine if n > top]:
            out[i] += 1
    return out


def test_mix_matches_brute_force_and_inclusion_follows_words(spark):
    rnd = random.Random(31)
    sizes = [(i, rnd.choice([0, 1, 3, 10, 20, 30, 40, 300]) if i % 10 else rnd.randint(1, 900), rnd.choice(["a", "b", "b", "b", None])) for i in range(150)]
    docs = frame(spark, [(i, " ".join(["w"] * n), None, s, None) for i, n, s in sizes])
    for seed in (20, 21):
        assert {r["doc_id"]: r["copies"] for r in mixing.mix(docs, seed=seed).collect()} == drawn_by_brute_force(sizes, seed)
    # Over many seeds, documents of a source are drawn in proportion to their words, and always as many.
    rows = [(i, 10 + 10 * (i % 4), "a") for i in range(80)] + [(100 + i, 25, "b") for i in range(80)]
    taken, counts, n = Counter(), set(), 400
    for seed in range(n):
        got = drawn_by_brute_force(rows, seed)
        counts.add(sum(got[i] for i in range(80)))
        taken.update({10 + 10 * (i % 4): got[i] - 1 for i in range(80)})
    assert len(counts) == 1
    share = [taken[s] / (n * 20) for s in (10, 20, 30, 40)]
    expected = sum(share) / 100
    assert all(abs(x - expected * s) < 0.25 * expected * s for x, s in zip(share, (10, 20, 30, 40), strict=True)), share


def test_shared_windows_are_covered_by_brute_force(spark):
    rnd = random.Random(41)
    make = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 9000)}" for _ in range(k)]
    pool = [make(rnd.randint(12, 140)) for _ in range(12)]
    rows = [(i, " ".join(sum((rnd.choice(pool) if rnd.random() < 0.6 else make(rnd.randint(5, 60)) for _ in range(rnd.randint(1, 7))), [])), None, None, None) for i in range(70)]
    texts = {r[0]: words(r[1]) for r in rows}
    where = {}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add((i, k))
    covers = {}
    for r in passages.shared_passages(frame(spark, rows)).collect():
        mine, other = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["partner_id"]][r["partner_start"] : r["partner_end"]]
        equal = sum(n for *_, n in passages.common_blocks(mine, other))
        assert min(len(mine), len(other)) >= 50 and equal >= 0.75 * max(len(mine), len(other))
        covers.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    shared = {(i, k) for places in where.values() if len({i for i, _ in places}) > 1 for i, k in places}
    missed = [(i, k) for i, k in shared if not any(a <= k and k + 50 <= b for a, b in covers.get(i, []))]
    assert shared and not missed, (len(missed), len(shared))


def test_a_passage_that_a_document_has_twice_is_found_twice(spark):
    rnd = random.Random(45)
    make = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 90000)}" for _ in range(k)]
    one = make(60)
    twice, once = make(10) + one + make(90) + one + make(10), make(30) + one + make(30)
    for texts in ((twice, once), (once, twice)):
        rows = [(i, " ".join(w), None, None, None) for i, w in enumerate(texts)]
        got = {(r["doc_id"], r["start"], r["end"]) for r in passages.shared_passages(frame(spark, rows).coalesce(1)).collect()}
        i = texts.index(twice)
        assert got == {(i, 10, 70), (i, 160, 220), (1 - i, 30, 90)}


def test_two_long_runs_with_unequal_words_between(spark):
    rnd = random.Random(42)
    make = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 90000)}" for _ in range(k)]
    rows = []
    for i, (n, k) in enumerate([(200, 150), (1000, 1500)]):
        one, two = make(n), make(n)
        rows += [(2 * i + j, " ".join(make(20) + one + make(k) + two + make(20)), None, None, None) for j in (0, 1)]
    got = {(r["doc_id"], r["start"], r["end"]) for r in passages.shared_passages(frame(spark, rows)).collect()}
    assert got == {(i, s, s + n) for i, n, k in ((0, 200, 150), (1, 200, 150), (2, 1000, 1500), (3, 1000, 1500)) for s in (20, 20 + n + k)}


def lcs(x, y):
    rows = [[0] * (len(y) + 1)]
    for a in x:
        rows.append([0])
        for j, b in enumerate(y):
            rows[-1].append(rows[-2][j] + 1 if a == b else max(rows[-2][j + 1], rows[-1][j]))
    return rows[-1][-1]


def test_bits_give_the_longest_common_subsequence():
    rnd = random.Random(43)
    for _ in range(150):
        x, y = ([rnd.choice("abcdefg") for _ in range(rnd.randint(0, 45))] for _ in range(2))
        found = passages.common_blocks(x, y)
        assert sum(n for *_, n in found) == lcs(x, y) and all(x[p : p + n] == y[q : q + n] for p, q, n in found)
        assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(found, found[1:], strict=False))
    codes = np.random.default_rng(1).integers(0, 6, (2, 60, 50)).astype(np.uint8)
    got = passages.common_lengths(*codes)
    for i in range(60):
        x, y = ([v or (k, j) for j, v in enumerate(codes[k, i].tolist())] for k in (0, 1))
        assert lcs(x, y) == got[i]


def test_word_hashes_agree_with_words(spark):
    rnd = random.Random(44)
    for _ in range(60):
        text = "".join(rnd.choice(["a", "B", "ß", "É", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\xa0", "😀", "zz"]) for _ in range(rnd.randint(0, 90)))
        data = text.encode()
        h, (starts, ends) = minhash.word_hashes(data), minhash.word_spans(data)
        got = [data[i:j].decode() for i, j in zip(starts, ends, strict=True)]
        low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in got]
        assert low == words(text) and len(set(h.tolist())) == len(set(low))
        assert len(minhash.shingle_hashes(data)) == len(shingles(text))
    long = ("word " * 300_000 + "x" * 3_000_000 + " end").encode()
    h, (starts, ends) = minhash.word_hashes(long), minhash.word_spans(long)
    assert len(h) == 300_002 and len(set(h.tolist())) == 3 and ends[-1] == len(long)


def test_members_that_may_be_linked():
    rnd = np.random.default_rng(5)
    sets = [rnd.integers(0, 1 << 63, 300).astype(np.uint64) for _ in range(3)]
    near = np.concatenate([sets[0][:280], sets[1][:20]])
    members = [(i % 2, i, i, 300, minhash.pack(minhash.minima(s)).tolist()) for i, s in enumerate([*sets, near])]
    assert minhash.likely_members(members, True) == [0, 3] and minhash.likely_members(members, False) == [0, 3]
    assert minhash.likely_members([(m[0], m[1], 1, *m[3:]) for m in members], True) == []


def test_toxicity_learns_from_every_labelled_row(spark):
    line = "one line that all of them share"
    rows = [(i, f"{line} {'grob' if i % 2 else 'fein'}{i % 7} tail", None, None, None) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    docs = frame(spark, rows)
    kept = toxicity.training_rows(docs, labels)
    held = docs.where(toxicity.held_out(docs["doc_id"])).count()
    assert kept.count() == 60 - held
    assert toxicity.learn(docs, labels) == toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert DOCS


def test_running_sums_over_batches_of_one_row(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        df = spark.createDataFrame([(i, "ab"[i % 2], i) for i in range(30)], "i long, g string, v long")
        assert {r["i"]: r["run_v"] for r in common.in_order(df, ["i"], ["v"]).collect()} == {i: i * (i + 1) // 2 for i in range(30)}
        got = {r["i"]: r["run_v"] for r in common.in_order(df, ["g", "i"], ["v"], within="g").collect()}
        assert got == {i: sum(range(i % 2, i + 1, 2)) for i in range(30)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
