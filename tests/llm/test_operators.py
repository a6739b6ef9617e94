"""Each operator against brute force or an exact round trip, on small tables with awkward rows."""

import base64
import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from loomseek.llm import chat, common, components, decontamination, media, minhash, mixing, passages, secrets, sharding, toxicity, warc
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(n=60, seed=3):
    """Unrelated texts, copies, near copies, chains of near copies, and awkward texts."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    make = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    texts = [" ".join(make(rnd.randint(1, 160))) for _ in range(n)]
    base = make(150)
    for _ in range(20):
        new = list(base)
        for _ in range(rnd.randint(0, 6)):
            new[rnd.randrange(len(new))] = rnd.choice(vocabulary)
        texts.append(" ".join(new))
    step = list(base)
    for _ in range(8):  # each one resembles the one before only
        step = list(step)
        for _ in range(4):
            step[rnd.randrange(len(step))] = rnd.choice(vocabulary)
        texts.append("\n".join(step).upper())
    texts += [texts[0]] * 7 + ["", None, "   ", "one", "One", "a b c d", "ß ÉÈ  x", "y" * 5000, "z " * 3000]
    return [(i, t, "en", rnd.choice(["b", "a", None, "ä"]), None) for i, t in enumerate(texts)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def linked(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in linked(rows).items()}


def test_near_duplicates_of_repeated_ids_nulls_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, None, None, None), (5, text, None, None, None), (None, text, None, None, None), (None, None, None, None, None), (7, "", None, None, None)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [("5", 26, "5", True), ("5", 26, "5", True), ("7", 0, "7", True), ("None", 0, "None", False), ("None", 26, "5", False)]
    assert minhash.one_of_each(frame(spark, rows)).count() == 3
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_families_find_links_that_no_star_shows():
    h = lambda *x: np.array(sorted(x), np.uint64)
    members = [(1, 1, 0, h(1, 2, 3, 4)), (2, 1, 0, h(1, 2, 3, 5)), (3, 3, 0, h(6, 7, 8, 9)), (4, 4, 0, h(6, 7, 8, 9, 10)), (5, 5, 0, h(20))]
    assert minhash.block_links(members, True) == [(3, 4)] or minhash.block_links(members, True) == [(4, 3)]
    assert minhash.block_links(members[:2], True) == []


def test_families_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = corpus(n=10, seed=8)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in linked(rows).items()}


def test_bit_estimate_is_corrected_for_collisions(spark):
    rnd = np.random.default_rng(1)
    h = rnd.integers(0, 1 << 63, 4000).astype(np.uint64)
    for share in (0.3, 0.75, 0.95):
        a, b = h[:1000], np.concatenate([h[: int(2000 * share / (1 + share))], h[2000 : 3000 - int(2000 * share / (1 + share)) + 0]])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        rows = [(minhash.pack(minhash.minima(a)).tolist(), minhash.pack(minhash.minima(b)).tolist())]
        got = spark.createDataFrame(rows, "x array<long>, y array<long>").select(minhash.estimate("x", "y")).head()[0]
        assert abs(got - true) < 0.17


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_passages_are_found_and_clean_documents_left_alone(spark):
    rnd = random.Random(5)
    make = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 3000)}" for _ in range(k)]
    shared, fuzzy = make(60), make(90)
    rows = [(i, " ".join(make(200)), None, None, None) for i in range(20)]
    for i in range(20, 26):
        rows.append((i, " ".join(make(40) + shared + make(rnd.randint(0, 80))), None, None, None))
    for i in range(26, 30):
        edited = list(fuzzy)
        for k in (11, 37, 64, 80):
            edited[k] = make(1)[0]
        rows.append((i, " ".join(make(30) + edited[:50] + make(2) + edited[50:] + make(20)), None, None, None))
    copy = " ".join(make(70))
    rows += [(30, copy, None, None, None), (31, copy, None, None, None), (32, "short copy", None, None, None), (33, "short copy", None, None, None), (34, None, None, None, None), (35, "", None, None, None), (36, " ".join(shared[:30]), None, None, None)]
    found = passages.shared_passages(frame(spark, rows)).collect()
    assert {r["doc_id"] for r in found} == set(range(20, 32))
    texts = {r[0]: words(r[1]) for r in rows}
    for r in found:
        mine, other = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["partner_id"]][r["partner_start"] : r["partner_end"]]
        assert len(mine) >= 50 and len(other) >= 50 and r["identity"] >= 0.75
        if 20 <= r["doc_id"] < 26:
            assert " ".join(shared) in " ".join(mine)
    assert passages.shared_passages(frame(spark, [])).count() == 0


def test_passages_on_both_sides_of_an_inserted_block(spark):
    rnd = random.Random(21)
    make = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 30000)}" for _ in range(k)]
    rows, halves = [], {}
    for i, (n, k) in enumerate([(60, 60), (60, 100), (60, 150), (500, 400), (500, 1000)]):
        one, two = make(n), make(n)
        for j in (2 * i, 2 * i + 1):
            rows.append((j, " ".join(make(20) + one + make(k if j % 2 else 0) + two + make(20)), None, None, None))
            halves[j] = " ".join(one), " ".join(two)
    found = passages.shared_passages(frame(spark, rows)).collect()
    texts = {r[0]: words(r[1]) for r in rows}
    for i, both in halves.items():
        mine = [" ".join(texts[i][r["start"] : r["end"]]) for r in found if r["doc_id"] == i and r["partner_id"] == i ^ 1]
        assert all(any(h in m for m in mine) for h in both)
    assert all(r["partner_id"] == r["doc_id"] ^ 1 and r["identity"] >= 0.75 for r in found)


def test_passages_of_lines_that_were_first_in_other_documents(spark):
    rnd = random.Random(22)
    make = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 30000)}" for _ in range(k)]
    rows, n = [], 20
    for i in range(n):
        lines = [make(18) for _ in range(3)]
        rows += [(100 * i + j, " ".join(make(60) + line + make(60)), None, None, None) for j, line in enumerate(lines)]
        rows += [(100 * i + j, " ".join(make(40) + sum(lines, []) + make(40)), None, None, None) for j in (50, 51)]
    spark_rows = frame(spark, rows).coalesce(1)
    found = passages.shared_passages(spark_rows).collect()
    assert {(r["doc_id"], r["partner_id"]) for r in found} == {(100 * i + j, 100 * i + k) for i in range(n) for j, k in ((50, 51), (51, 50))}
    assert all(r["end"] - r["start"] >= 54 and r["identity"] == 1 for r in found)


def test_edited_passages_are_found(spark):
    rnd = random.Random(23)
    make = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 300000)}" for _ in range(k)]
    rows, n, kinds = [], 40, [(k, percent) for k in (55, 80) for percent in (5, 10, 15, 20)]
    for i, (k, percent) in enumerate(kind for kind in kinds for _ in range(n)):
        one = make(k)
        two = [make(1)[0] if rnd.random() < percent / 100 else w for w in one]
        rows += [(2 * i + j, " ".join(make(40) + w + make(40)), None, None, None) for j, w in enumerate((one, two))]
    found = passages.shared_passages(frame(spark, rows)).collect()
    assert all(r["partner_id"] == r["doc_id"] ^ 1 and r["identity"] >= 0.75 for r in found)
    got = Counter(kinds[i // 2 // n] for i in {r["doc_id"] for r in found})
    recall = {kind: got[kind] / 2 / n for kind in kinds}
    print(recall)
    assert min(recall[k, percent] for k in (55, 80) for percent in (5, 10)) >= 0.9 and recall[80, 15] >= 0.9, recall


def test_all_documents_with_a_passage_are_paired(spark):
    rnd = random.Random(24)
    make = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 300000)}" for _ in range(k)]
    shared = make(60)
    rows = [(i, " ".join(make(30) + shared + make(30)), None, None, None) for i in range(6)]
    # Edited passages of lines that were first in other documents: no seed over the edits at the lines' ends survives.
    lines = [make(18) for _ in range(4)]
    rows += [(10 + j, " ".join(make(60) + line + make(60)), None, None, None) for j, line in enumerate(lines)]
    rows += [(20 + j, " ".join(make(40) + sum((line[:-1] + make(1) for line in lines), []) + make(40)), None, None, None) for j in range(3)]
    found = passages.shared_passages(frame(spark, rows).coalesce(1)).collect()
    got = {(r["doc_id"], r["partner_id"]) for r in found}
    assert got == {(i, j) for some in (range(6), range(20, 23)) for i in some for j in some if i != j}
    assert all(r["end"] - r["start"] >= 50 and r["identity"] >= 0.75 for r in found)


def test_links_of_a_passage_in_very_many_documents(spark):
    rnd = random.Random(25)
    make = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 300000)}" for _ in range(k)]
    shared, line, n = make(70), make(12), 3 * passages.ALL_PAIRS
    rows = [(i, " ".join(make(60) + shared + make(60)), None, None, None) for i in range(n)]
    edited = [w for k, w in enumerate(shared) if k % 16 != 15]
    rows += [(1000 + i, " ".join(make(60) + edited + make(60)), None, None, None) for i in range(2)]
    # A frequent line, and an edited passage around it in two documents that are not the first with the line.
    rows += [(2000 + i, " ".join(make(60) + line + make(60)), None, None, None) for i in range(n)]
    one, two = make(25), make(25)
    replaced = [[w if k % 5 else make(1)[0] for k, w in enumerate(part)] for part in (one, two)]
    rows += [(3000, " ".join(make(60) + one + line + two + make(60)), None, None, None), (3001, " ".join(make(60) + replaced[0] + line + replaced[1] + make(60)), None, None, None)]
    found = passages.shared_passages(frame(spark, rows).coalesce(1)).collect()
    # A pair is there, or its documents have 50 words of first ones, which are the same or a pair.
    of, pairs = defaultdict(set), {(r["doc_id"], r["partner_id"]) for r in found}
    for r in found:
        if r["partner_end"] - r["partner_start"] >= 50 and r["identity"] == 1:
            of[r["doc_id"]].add(r["partner_id"])
    linked = lambda i, j: any(x == y or (x, y) in pairs for x in of[i] | {i} for y in of[j] | {j})
    every = [*range(n), 1000, 1001]
    assert [(i, j) for i in every for j in every if i < j and not linked(i, j)] == []
    assert len(pairs) < n * n / 2
    assert {(i, j) for i, j in pairs if i >= 2000} == {(3000, 3001), (3001, 3000)}


def test_rows_of_near_copies_grow_with_their_number_and_no_link_is_lost(spark, tmp_path):
    rnd = random.Random(27)
    make = lambda k: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 300000)}" for _ in range(k)]
    base, line = make(150), make(12)
    near = lambda: [w if rnd.random() > 0.04 else make(1)[0] for w in base]
    rows = [(i, " ".join(make(20) + near() + make(20)), None, None, None) for i in range(64)]
    # An edited passage around a frequent line; what its two documents have in common, the first ones with the line have not.
    rows += [(100 + i, " ".join(make(60) + line + make(60)), None, None, None) for i in range(20)]
    one, two = make(25), make(25)
    replaced = [[w if k % 5 else make(1)[0] for k, w in enumerate(part)] for part in (one, two)]
    rows += [(200, " ".join(make(60) + one + line + two + make(60)), None, None, None), (201, " ".join(make(60) + replaced[0] + line + replaced[1] + make(60)), None, None, None)]
    sizes = []
    for n in (16, 64):
        frame(spark, rows[:n] + rows[64:]).coalesce(1).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        found = passages.op1(spark, f"{tmp_path}/{n}").collect()
        pairs = {(r["doc_id"], r["partner_id"]) for r in found}
        sizes.append(len(pairs))
        links = spark.createDataFrame(list(pairs), "a long, b long")
        assert {r["node"]: r["component"] for r in components.components(links).collect()} == {**dict.fromkeys(range(n), 0), 200: 200, 201: 200}
    assert sizes[1] <= 6 * sizes[0] < 6 * 16 * 15, sizes


def test_links_join_what_all_plausible_pairs_join():
    rnd = np.random.default_rng(28)
    for n, all_pairs, block in ((12, 12, 1000), (90, 12, 1000), (90, 4, 16)):
        base = rnd.integers(1, 256, (6, 2 * passages.CONTEXT)).astype(np.uint8)
        c = base[rnd.integers(0, 6, n)]
        for row in c:
            row[rnd.choice(100, rnd.integers(0, 45), replace=False)] = rnd.integers(1, 256)
        rows, ps = np.sort(rnd.integers(0, 70, n)), np.arange(n, dtype=np.int32)
        i, j = np.triu_indices(n, 1)
        good = passages.plausible(c, i, j) & (rows[i] != rows[j])
        every = passages.forest(np.arange(n), i[good], j[good])[1]

        def batch(failed, rows=rows, ps=ps, c=c, n=n):
            k = len(failed)
            cols = [np.full(n + k, 7), [*rows.tolist(), *(int(rows[y]) for x, y in failed)], [*ps.tolist(), *(y for x, y in failed)]]
            cols = [pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
            more = [[None] * n + [int(rows[x]) for x, y in failed], [None] * n + [x for x, y in failed], [None] * n + [False] * k]
            cols += [pa.array([*(x.tobytes() for x in c), *[None] * k], pa.binary()), *(pa.array(x, t) for x, t in zip(more, (pa.int64(), pa.int32(), pa.bool_()), strict=True))]
            return pa.RecordBatch.from_arrays(cols, names=["seed", "row_", "p", "context", "b", "q", "holds"])

        def links(failed, few, all_pairs=all_pairs, block=block):
            out = [x for b in passages._linked(few, bool(failed), all_pairs, block)([batch(failed)]) for x in b.to_pylist()]
            left = [x for x in out if x["b"] is None]
            numbers = range(len(left) // block + 1)
            dealt = [(x["context"], x["a"], x["p"], 7, u, v, x["i"] // block, x["label"]) for u in numbers for v in numbers if u <= v for x in left if x["i"] // block in (u, v)]
            if dealt:
                cols = [pa.array(k) for k in zip(*dealt, strict=True)]
                cols[0] = cols[0].cast(pa.binary())
                out += [x for b in passages._block_links(few)([pa.RecordBatch.from_arrays(cols, names=list("abcdefgh"))]) for x in b.to_pylist()]
            return {(min(x["p"], x["q"]), max(x["p"], x["q"])) for x in out if x["b"] is not None}

        first = links([], True)
        assert first <= set(zip(i[good].tolist(), j[good].tolist(), strict=True))
        assert np.array_equal(passages.forest(np.arange(n), *np.array(sorted(first)).T)[1], every)
        assert len(first) < good.sum() / 2 if n > 12 else len(first) == n - len(set(every.tolist()))
        if n == 12:  # all that were tried have failed: the others are tried
            assert links(sorted(first), False) == set(zip(i[good].tolist(), j[good].tolist(), strict=True)) - first


def test_places_of_a_seed_are_compared_by_brute_force():
    rnd = np.random.default_rng(26)
    base = rnd.integers(1, 256, (6, 2 * passages.CONTEXT)).astype(np.uint8)
    c = base[rnd.integers(0, 6, 90)]
    for row in c:
        row[rnd.choice(100, rnd.integers(0, 45), replace=False)] = rnd.integers(1, 256)
        row[: rnd.integers(0, 12)] = 0
    rows, ps = np.sort(rnd.integers(0, 70, 90)), np.arange(90, dtype=np.int32)
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(np.full(len(some), 7)), pa.array(rows[some]), pa.array(ps[some]), pa.array([c[k].tobytes() for k in some], pa.binary())], names=["seed", "row_", "p", "context"])
    pairs = lambda made: {(x["p"], x["q"]) for b in made for x in b.to_pylist() if x["b"] is not None}
    i, j = np.triu_indices(90, 1)
    equal = passages.common_lengths(c[i, :50], c[j, :50]) + passages.common_lengths(c[i, 50:], c[j, 50:]) + 5
    same = (c[i] == c[j]) & (c[i] > 0)
    passage = np.max([same[:, k : k + 45].sum(axis=1) for k in range(5, 51)], axis=0) >= 33  # 38 of 50 words with the seed's
    may, wanted = ({(int(y), int(x)) for x, y, k in zip(i, j, test, strict=True) if k and rows[x] != rows[y]} for test in (equal >= 36, passage))
    got = pairs(passages._matched(90, 1000)([batch(range(40)), batch(range(40, 90))]))
    assert len(wanted) > 20 and wanted <= got <= may < {(int(y), int(x)) for x, y in zip(i, j, strict=True)}
    first, second = passages.near_pairs(c)
    assert {(int(y), int(x)) for x, y in zip(first, second, strict=True)} >= wanted
    # With fewer pairs at once: what is not compared has 50 words of a first place.
    out = list(passages._matched(4, 16)([batch(range(90))]))
    places = [x for b in out for x in b.to_pylist() if x["b"] is None]
    assert len(places) > 16
    order = [(x["context"], x["a"], x["p"], 7, u, v, x["i"] // 16) for u in range(9) for v in range(u, 9) for x in places if x["i"] // 16 in (u, v)]
    cols = [pa.array(k) for k in zip(*order, strict=True)]
    cols[0], cols[2] = cols[0].cast(pa.binary()), cols[2].cast(pa.int32())
    more = pairs(passages._block_pairs([pa.RecordBatch.from_arrays(cols, names=list("abcdefg"))]))
    left = {x["p"] for x in places}
    assert {(x, y) for x, y in wanted if x in left and y in left} <= more <= got
    assert all(x in left or x in {y for y, _ in pairs(out)} or list(rows).count(rows[x]) > 1 for x in range(90))


def test_chain_agrees_with_the_quadratic_recurrence():
    rnd = random.Random(2)
    for _ in range(40):
        matches = sorted((rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(25))
        value = []
        for j, (p, q) in enumerate(matches):
            gains = [value[i] - passages.GAP_COST * ((p - x) + (q - y)) for i, (x, y) in enumerate(matches[:j]) if x < p and y < q]
            value.append(passages.SEED_WORDS + max([0.0, *gains]))
        best = passages.chain(matches)[0]
        cost = sum(passages.GAP_COST * ((b[0] - a[0]) + (b[1] - a[1])) for a, b in zip(best, best[1:], strict=False))
        assert abs(len(best) * passages.SEED_WORDS - cost - max(value)) < 1e-9
        assert Counter(m for c in passages.chain(matches) for m in c) == Counter(matches)


def test_chat_round_trip_and_loss(spark):
    odd = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "be\\kind"), (1, 1, "user", None), (1, 2, "assistant", odd), (1, 3, "user", "<turn user>\n</turn>\n"), (1, 4, "assistant", "😀 é"), (1, 5, "user", "bye"), (2, 0, "user", "only"), (None, 0, None, "x"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat.prefix_targets(conversations).collect()
    by = defaultdict(list)
    for e in examples:
        by[e["conv_id"]].append(e)
    for key, es in by.items():
        turns = [(r or "", t or "") for c, _, r, t in rows if c == key]
        es.sort(key=lambda e: e["example"])
        assert chat.read_turns(es[-1]["formatted"]) == turns
        targets = [chat.unescape(e["formatted"][e["target_start"] : e["target_end"]]) for e in es if e["target_start"] is not None]
        assert targets == [t for r, t in turns if r == "assistant"]
        for e in es:
            read = chat.read_turns(e["formatted"])
            assert read == turns[: len(read)] and e["context_turns"] == len(read) - (e["target_start"] is not None)
    got = {r["conv_id"]: r for r in chat.read_back(chat.prefix_targets(conversations)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256((odd + "😀 é").encode()).hexdigest() and got[1]["loss_chars"] == len(odd) + 3
    assert got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1 and got[3]["n_turns"] == 2
    assert chat.prefix_targets(conversations.limit(0)).count() == 0


def test_shards_are_minimal_and_gapless(spark):
    rnd = random.Random(7)
    rows = [(i, "x" * rnd.randint(0, 300), None, None, None) for i in rnd.sample(range(5000), 300)]
    rows += [(6000 + i, "copy" * 40, None, None, None) for i in range(30)] + [(7000, None, None, None, None), (None, "é", None, None, None), (6000, "copy" * 40, None, None, None)]
    k = 7
    got = sharding.minimax_shards(frame(spark, rows), k).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    shard_of = defaultdict(set)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        shard_of[(r["text_crc32"], r["size"])].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t].append((i is not None, i or 0))
    order = sorted(groups, key=lambda t: (min((x for x in groups[t] if x[0]), default=(False, 0)), common.text_key and ""))
    ordered = [len(groups[t]) * (len((t or "").encode()) + 16) for t in order]

    def feasible(c):
        n, left = 1, c
        for x in ordered:
            if x > c:
                return False
            n, left = (n, left - x) if x <= left else (n + 1, c - x)
        return n <= k

    low = next(c for c in range(max(ordered), sum(ordered) + 1) if feasible(c))
    assert max(sizes.values()) == low
    assert sharding.minimax_shards(frame(spark, []), k).count() == 0


def test_capacity_is_exact_with_few_buckets(spark):
    rnd = random.Random(1)
    sizes = [rnd.choice([1, 2, 3, 50, 400]) for _ in range(500)]
    ends = np.cumsum(sizes).tolist()
    bounds = spark.createDataFrame([(int(e),) for e in ends], "end_ long")

    def need(c):
        n, left = 1, c
        for x in sizes:
            n, left = (n, left - x) if x <= left else (n + 1, c - x)
        return n

    for k in (1, 3, 12):
        capacity, cuts = sharding.minimax_cuts(bounds, ends[-1], k, buckets=16)
        low = next(c for c in range(max(sizes), ends[-1] + 1) if need(c) <= k)
        assert capacity == low and len(cuts) == k - 1 and set(cuts) <= {0, *ends}
        assert max(b - a for a, b in zip([0, *cuts], [*cuts, ends[-1]], strict=True)) == low


def test_archive_gives_back_every_record(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "http://d", ""), (5, "u", "é\x00\n"), (5, "u", "é\x00\n"), (None, "n", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    archive = warc.write_archive(pages)
    assert archive.payloads.count() == 3
    got = warc.restore(archive).collect()
    assert sorted(bytes(r["payload"]) for r in got) == sorted((h or "").encode() for *_, h in rows)
    for r in got:
        head = bytes(r["header"]).decode()
        digest = base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode()
        assert head.startswith("WARC/1.1\r\n") and head.endswith("\r\n\r\n") and f"WARC-Payload-Digest: sha1:{digest}\r\n" in head and "\r\nX: y" not in head
        body = b"" if "WARC-Type: revisit" in head else bytes(r["payload"])
        assert bytes(r["record"]) == head.encode() + body + b"\r\n\r\n" and f"Content-Length: {len(body)}\r\n" in head
    kinds = sorted((str(r["page_id"]), "revisit" in bytes(r["header"]).decode()) for r in got)
    assert kinds == [("1", True), ("2", False), ("3", True), ("4", False), ("5", False), ("5", False), ("None", True)]
    assert warc.restore(warc.write_archive(pages.limit(0))).count() == 0


def test_containment_matches_brute_force(spark):
    rnd = random.Random(11)
    make = lambda k: [rnd.choice(["in", "the", "of"]) + str(rnd.randint(0, 40)) for _ in range(k)]
    items = [make(rnd.randint(1, 60)) for _ in range(30)]
    rows = []
    for i in range(80):
        w = make(rnd.randint(0, 400))
        if i % 3 == 0:
            item = list(rnd.choice(items))
            for _ in range(rnd.randint(0, 3)):
                item[rnd.randrange(len(item))] = "edited"
            w[len(w) // 2 : len(w) // 2] = item
        rows.append((i, " \n".join(w).title(), None, None, None))
    rows += [(80, None, None, None, None), (81, "", None, None, None), (82, " ".join(items[0]), None, None, None), (82, "other", None, None, None), (None, " ".join(items[1]), None, None, None)]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(100, None), (101, " "), (102, " ".join(items[0]))]
    got = {(r["doc_id"], r["item_id"]): (r["n_common"], r["n_item"]) for r in decontamination.contained_items(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = {}
    for d, t, *_ in rows:
        for i, b in bench:
            x = shingles(b)
            both = len(x & shingles(t))
            if x and 100 * both >= 75 * len(x):
                want[d, i] = (both, len(x))
    assert got == want and want
    plan = decontamination.contained_items(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_toxicity_on_held_out_rows(spark):
    rnd = random.Random(4)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(clean) for _ in range(60)]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w[rnd.randrange(60)] = rnd.choice(["grobzig", "grobzor", "ST0OPH", "blarf"])
        rows.append((i, " ".join(w), None, None, None))
        labels.append((i, int(toxic)))
    labels += [(3, None), (None, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = frame(spark, rows + [(1000, None, None, None, None), (None, "", None, None, None)]).withColumn("score", F.lit("clash"))
    model = toxicity.learn(docs, lab)
    got = [r for r in toxicity.score(docs, model).collect()]
    assert len(got) == 902 and all(0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert out and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = [(r["predicted"] == 1) == (r["doc_id"] < 900 and r["doc_id"] % 4 == 0) for r in out if r["doc_id"] is not None]
    assert sum(right) / len(right) > 0.95
    none = toxicity.learn(docs.limit(0), lab.limit(0))
    assert none.curve == toxicity.CURVE


def test_folding_and_exceptions():
    model = toxicity.Model({("idiot", True): 4.0, ("clown", True): 4.0, ("grob", False): 2.0})
    ac = toxicity.automaton(model)
    rate = lambda t: toxicity.rate(t, ac) * (len(t.split()) + toxicity.SHRINK)
    assert rate("an 1d10t") == rate("an іdіоt") == rate("an IDIOT!") == 4.0
    assert rate("idiotic unidiot") == 0 and rate("a clown fish swims") == 0 and rate("a clown, a fish") == 4.0
    assert rate("grobian grob") == 4.0 and toxicity.rate(None, ac) == 0.0


def entropies(run, width):
    for i in range(len(run) - width + 1):
        c = Counter(run[i : i + width])
        yield -sum(n / width * np.log2(n / width) for n in c.values())


def test_secrets_against_plain_rules(spark):
    rnd = random.Random(9)
    pick = lambda s, k: "".join(rnd.choice(s) for _ in range(k))
    run = pick("abcdef0123456789ABCXYZ+/", 60)
    assert np.allclose(list(secrets.window_entropies(run, 20)), list(entropies(run, 20)))
    key = "AKIA" + pick("ABCDEFGH0123", 16)
    texts = [f'say password = "{pick("abcXYZ019_", 12)}" and {key}.', "token: short token=longenough1", "AKIA123", pick("0123456789abcdef", 40), "deadbeef" * 4, None, "", "é" * 50 + " API_KEY='" + pick("abcdefgh", 9) + "'", "x" * 10000, "123e4567-e89b-12d3-a456-426614174000", pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 44)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    for r in secrets.find_secrets(frame(spark, rows)).collect():
        t = texts[r["doc_id"]] or ""
        base = [(*m.span(), "assign") for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        base += [(*m.span(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        base += [(*m.span(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        base.sort(key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(r["spans"].split(",")) | {""}
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[2] == k for s in base) for k in ("assign", "access", "hex"))
    assert secrets.entropy_spans(texts[-1])[0][2] == "entropy_base64" and not secrets.entropy_spans(texts[9]) and not secrets.entropy_spans(texts[8])


def test_media_round_trip(spark):
    rnd = random.Random(6)
    texts = ["", None, "a", "x" * 192, "é" * 100, " ".join(str(rnd.random()) for _ in range(3000))]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(9, texts[5], None, None, None)]
    got = {r["doc_id"]: r for r in media.fingerprints(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        data = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(data)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(buffer.getvalue()), hashlib.sha256(buffer.getvalue()).hexdigest())
        assert len(r["fingerprint_time"]) == len(r["fingerprint_hash"])
    assert got[5]["feature"] == got[9]["feature"] and got[5]["fingerprint_time"] and got[0]["feature"] == got[1]["feature"] != got[5]["feature"]


def test_a_tone_is_a_peak():
    at = np.arange(192 * 40)
    tone = np.where((at // 1920) % 2 == 0, np.sin(2 * np.pi * at * 10 / 192), np.sin(2 * np.pi * at * 20 / 192))
    frame_, bin_ = media.peaks((128 + 100 * tone).astype(np.uint8))
    low = bin_[bin_ < 24]
    assert set(low.tolist()) <= {9, 10, 11, 19, 20, 21} and len(low)


def test_targets_and_mix(spark):
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [pytest.approx(187.5), pytest.approx(75), pytest.approx(37.5)]
    assert mixing.targets([10, 1000], [5, 2]) == [30.0, pytest.approx(980)]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), "en", rnd.choice(["a", "a", "a", "b", "Z", None, "é"]), None) for i in range(800)] + [(None, "x y", None, "b", None), (5, None, None, "b", None)]
    docs = frame(spark, rows).withColumn("copies", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["target"], r["source_size"]] += r["taken"]
        size[r["source_size"]] += r["size"]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sums = [sum(len((t or "").split()) for _, t, _, s, _ in rows if s == n) for n in names]
    want = mixing.targets(sums, [[5, 2, 1][i % 3] for i in range(len(sums))])
    assert sorted({(r["source_size"], r["target"]) for r in got}) == sorted(zip(sums, want, strict=True))
    assert all(abs(t - key[0]) <= 21 for key, t in taken.items())
    assert mixing.mixed_rows(docs).columns == docs.columns and mixing.mixed_rows(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_inclusion_is_even_over_seeds(spark):
    docs = frame(spark, [(i, "w " * 10, "en", "a" if i < 40 else "b", None) for i in range(80)])
    taken = Counter()
    for seed in range(6):
        for r in mixing.mix(docs, seed=seed).where("doc_id < 40").collect():
            taken[r["doc_id"]] += r["copies"]
    assert len(set(taken.values())) > 1 and abs(sum(taken.values()) / 240 - 10 / 7) < 0.05


def test_running_sums_over_ranges(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abc"), rnd.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, v long").repartition(7)
    got = {r["i"]: r["run_v"] for r in common.in_order(df, ["g", "i"], ["v"], within="g").collect()}
    total = Counter()
    for i, g, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total[g] += v
        assert got[i] == total[g]


def test_sieve_keeps_what_is_wanted(spark):
    rows = spark.range(5000)
    wanted = spark.range(0, 5000, 100).withColumnRenamed("id", "w")
    kept = {r["id"] for r in common.sieve(rows, F.col("id"), wanted).collect()}
    assert set(range(0, 5000, 100)) <= kept and len(kept) < 200


def test_scratch_tables_go_and_results_still_read(spark):
    with common.scratch(spark) as keep:
        gone = common.staged(spark.range(3), "gone")
        kept = keep(common.staged(gone.where("id > 0"), "kept"))
    assert kept.count() == 2
    with pytest.raises(Exception, match=r"(?i)not exist|not found|No such file"):
        spark.read.parquet(gone.staged_path_).count()


def test_places_do_not_depend_on_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 50)).repartition(3).write.parquet(path)
    plain = spark.read.parquet(path)
    one = {(r[common.FILE], r[common.PLACE]): r["id"] for r in common.located(plain).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        two = {(r[common.FILE], r[common.PLACE]): r["id"] for r in common.located(plain).select("id", common.FILE, common.PLACE).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert one == two and len(one) == 1000
    assert common.located(plain.where("id < 10")).count() == 10
