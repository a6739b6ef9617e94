"""Near-duplicates by b-bit MinHash.

A document's set is its distinct shingles of five lower-case words (fewer words: the whole sequence is the only
shingle; no words: the empty set, linked with nothing). Documents with Jaccard similarity of 0.75 or more are
linked, and linked documents form components.

1. One pass over the texts makes, for each document, the number of shingles, 160 minima, of which 40 band
   keys (four full minima each) and the two low bits of each minimum are kept: 40 bytes of signature.
2. Equal texts form classes; one representative of each goes on.
3. Representatives that share a band key meet at one hub of the bucket, the one whose bands are shared most (a star,
   not all pairs). The collision-corrected estimate from the signatures' bit counts and the set sizes drop hopeless candidates (the
   cut lies more than five standard errors below the threshold); the rest is verified on the full sets.
4. The texts that resemble a hub at all form its family. Where a family has members of different components, links
   between them are looked for in pairs of blocks of bounded size: first the signatures are compared, and members without a partner of
   another component that is not hopeless leave; the texts of the others are compared by exact counts of common shingles; no pair
   is passed on but links. Two similar texts share a dozen bands on average; for the two to meet in no
   family, each of those buckets would need a hub that resembles neither.

A pair at the threshold shares no band with probability (1 - 0.75^4)^40 = 2.5e-7.

Nulls: a null text has the empty set; a null id is a document that never gives a component its name, and
is its own (null) component if nothing else is in it. Repeated rows are copies of each other. An empty table gives no rows;
other columns, whatever their names, are not read, and ``one_of_each`` returns them as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.llm import common
from loomseek.llm.components import components

SHINGLE, BANDS, ROWS, BITS = 5, 40, 4, 2
MINIMA = BANDS * ROWS
WORDS_64 = MINIMA * BITS // 64
#: Link at 100 * common >= PERCENT * union; estimates below LEAST_ESTIMATE are hopeless (standard error 0.041 at 0.75).
PERCENT, LEAST_ESTIMATE = 75, 0.52
#: Estimated similarity to a hub from which a text belongs to its family, and about how many texts and shingles a block of a family has.
FAMILY_ESTIMATE, BLOCK, BLOCK_SHINGLES = 0.35, 1000, 1_000_000
_LOW_BITS = 0x5555555555555555
_LOWER = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())
_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * MINIMA + SHINGLE + BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACES = _SEEDS[:SHINGLE] | np.uint64(1)
_FACTORS, _TERMS = _SEEDS[SHINGLE : SHINGLE + MINIMA] | np.uint64(1), _SEEDS[SHINGLE + MINIMA : SHINGLE + 2 * MINIMA]
_BAND_SEEDS = _SEEDS[SHINGLE + 2 * MINIMA :]


#: Bytes of a text that are hashed at a time; a random number for each byte (capitals as their small letters); powers of an odd number and of its inverse.
PIECE = 1 << 16
_BYTES = _mix(np.frombuffer(bytes(range(256)).translate(_LOWER), np.uint8).astype(np.uint64) + np.uint64(1 << 32))
_POWERS, _INVERSES = (np.multiply.accumulate(np.full(2 * PIECE, b, np.uint64)) for b in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_END = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a text that end where a word does: their place, their bytes, and where words start and end in them."""
    at = 0
    while at < len(data):
        end = _END.search(data, at + PIECE) if len(data) - at > PIECE else None
        end = end.start() if end else len(data)
        x = np.frombuffer(data, np.uint8, end - at, at)
        blank = np.ones(len(x) + 2, bool)
        np.take(_BLANK, x, out=blank[1:-1])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        yield at, x, edges[::2], edges[1::2]
        at = end


def word_spans(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text in UTF-8 start and end in bytes; six ASCII blanks part words."""
    found = [(at + starts, at + ends) for at, _, starts, ends in _pieces(data or b"")]
    none = np.empty(0, np.int64)
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (none, none)


def word_hashes(data: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A to Z lowered: sums of a number for each byte times a power for its place in the word."""
    found = [_hashed(x, starts, ends) for _, x, starts, ends in _pieces(data or b"")]
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def batch_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """word_hashes of each text. They are hashed as one, a blank between them, which costs far less than one after another."""
    parts = [t or b"" for t in texts]
    whole = b" ".join(parts)
    ends = np.cumsum([len(t) + 1 for t in parts])
    starts, _ = word_spans(whole)
    return np.split(word_hashes(whole), np.searchsorted(starts, ends[:-1])) if parts else []


def _hashed(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if len(x) > len(_POWERS):  # a very long word is in it: what it has beyond the table repeats the powers, and counts in another number too
        return np.array([_long(x[i:j]) for i, j in zip(starts, ends, strict=True)], np.uint64)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_BYTES[x] * _POWERS[: len(x)], out=sums[1:])
    # A sum starts with the power of the word's place in the piece, which is taken out again.
    return _mix((sums[ends] - sums[starts]) * _INVERSES[starts] + (ends - starts).astype(np.uint64))


def _long(word: np.ndarray) -> np.uint64:
    if len(word) <= len(_POWERS):
        return _hashed(word, np.array([0]), np.array([len(word)]))[0]
    h = np.zeros(1, np.uint64)
    for i in range(0, len(word), PIECE):
        h = _mix(h * _POWERS[:1] + _long(word[i : i + PIECE]))
    return h[0]


def mixed(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k words in a row."""
    h = np.full(len(w) - k + 1, (k * 0x9E3779B97F4A7C15) & _M, np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _PLACES[i]
    return _mix(h)


def shingles(w: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text whose words have the hashes w."""
    return np.unique(mixed(w, min(len(w), SHINGLE))) if len(w) else w


def shingle_hashes(data: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return shingles(word_hashes(data))


def minima(h: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, _M, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(out, (h[at : at + 1024, None] * _FACTORS + _TERMS).min(axis=0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m.reshape(BANDS, ROWS)
    key = _BAND_SEEDS.copy()
    for i in range(ROWS):
        key = _mix(key ^ rows[:, i])
    return key.view(np.int64)


def pack(m: np.ndarray) -> np.ndarray:
    """The low bits of each (well mixed) minimum, two in each pair of bits."""
    low = (_mix(m) & np.uint64(3)).reshape(WORDS_64, 32)
    return np.bitwise_or.reduce(low << np.arange(0, 64, BITS, dtype=np.uint64), axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, sigs, bands = [], [], []
        at = b.schema.get_field_index("text_")
        for w in batch_hashes(b.column(at).to_pylist()):
            h = shingles(w)
            m = minima(h)
            sizes.append(len(h))
            sigs.append(pack(m))
            bands.append(band_keys(m))
        cols = [pa.array(sizes, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]
        rest = [i for i in range(b.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), *cols], names=[*(b.schema.names[i] for i in rest), "n_shingles", "sig_", "bands_"])


def signatures(base: DataFrame) -> DataFrame:
    """Puts n_shingles, the packed signature sig_ and the band keys bands_ in the place of the binary column text_."""
    more = [T.StructField("n_shingles", T.LongType()), T.StructField("sig_", T.ArrayType(T.LongType())), T.StructField("bands_", T.ArrayType(T.LongType()))]
    return base.mapInArrow(_signatures, T.StructType([*(f for f in base.schema.fields if f.name != "text_"), *more]))


def estimate(x: str, y: str) -> Column:
    """Jaccard similarity by the share of equal low bits, corrected for the quarter that is equal by chance."""
    other = F.lit(0)
    for i in range(WORDS_64):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        other = other + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(_LOW_BITS)))
    chance = 1 / (1 << BITS)
    return (F.lit(1.0) - other / MINIMA - chance) / (1 - chance)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose full sets are similar. Rows come with equal b mostly together: its set is made once."""
    last, mine = object(), None
    for b in batches:
        keep = []
        for i, (key, x, y) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
            if key != last:
                last, mine = key, shingle_hashes(y)
            other = shingle_hashes(x)
            both = len(np.intersect1d(other, mine, assume_unique=True))
            if both and 100 * both >= PERCENT * (len(other) + len(mine) - both):
                keep.append(i)
        yield b.select([0, 1]).take(pa.array(keep, pa.int64()))


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of row numbers with both set sizes and the estimated similarity."""
    sig = reps.select(F.col("row_"), "n_shingles", "sig_")
    left = sig.select(F.col("row_").alias("a"), F.col("n_shingles").alias("na_"), F.col("sig_").alias("sa_"))
    right = sig.select(F.col("row_").alias("b"), F.col("n_shingles").alias("nb_"), F.col("sig_").alias("sb_"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na_", "nb_", estimate("sa_", "sb_").alias("estimate_"))


def _families(stars: DataFrame, reps: DataFrame, texts: DataFrame, found: DataFrame) -> DataFrame | None:
    """Links between members of one hub that are in different components so far; None if no hub has such members.

    A hub's members are dealt to blocks, and each pair of blocks is one group of about 2 * BLOCK texts or 2 * BLOCK_SHINGLES
    shingles at most, which a task compares by counting common shingles; of several links between two components it passes on one.
    """
    members = stars.select(F.col("b").alias("hub_"), F.col("a").alias("row_"), F.col("na_").alias("size_")).unionAll(stars.select(F.col("b").alias("hub_"), F.col("b").alias("row_"), F.col("nb_").alias("size_")).distinct())
    at = members.join(found.select(F.col("node").alias("row_"), "component"), "row_", "left").withColumn("component", F.coalesce("component", "row_"))
    at = common.staged(at, "family-members")
    mixed = at.groupBy("hub_").agg(F.min("component").alias("low_"), F.max("component").alias("high_"), F.greatest(F.count("*") / BLOCK, F.sum("size_") / BLOCK_SHINGLES).alias("n_")).where("low_ < high_").select("hub_", F.ceil("n_").cast("int").alias("blocks_"))
    mixed = common.staged(mixed, "mixed-families")
    if mixed.isEmpty():
        return None
    keys = ["hub_", "i_", "j_"]

    def dealt(members: DataFrame) -> DataFrame:
        each = members.withColumn("mine_", F.pmod(F.xxhash64("row_"), F.col("blocks_")).cast("int")).withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
        return each.select("hub_", F.least("mine_", "other_").alias("i_"), F.greatest("mine_", "other_").alias("j_"), "mine_", "row_", "component")

    in_order = lambda df: df.repartition(*keys).sortWithinPartitions(*keys, "row_")
    signed = dealt(at.join(mixed, "hub_")).join(reps.select("row_", "n_shingles", "sig_"), "row_").select(*keys, "mine_", "row_", "component", "n_shingles", "sig_")
    likely = common.staged(in_order(signed).mapInArrow(_compare_signatures, "hub_ long, row_ long").distinct(), "family-likely")
    # Both are written, so that a family of very many members can be split where they meet.
    left = common.staged(at.join(likely, ["hub_", "row_"]), "family-left")
    fewer = common.staged(left.groupBy("hub_").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size_") / BLOCK_SHINGLES)).cast("int").alias("blocks_")), "family-blocks")
    written = dealt(left.join(fewer, "hub_")).join(texts, "row_").select(*keys, "mine_", "row_", "component", "text_")
    return common.staged(in_order(written).mapInArrow(_compare, "a long, b long"), "family-links")


def _compare_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub_, row_) of the members of a pair of blocks that may be linked with a member of another component."""
    key, held = None, []

    def close() -> pa.RecordBatch:
        rows = likely_members(held, key[1] == key[2])
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(rows), pa.int64()), pa.array(rows, pa.int64())], names=["hub_", "row_"])

    for b in batches:
        for hub, i, j, *member in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (hub, i, j) != key:
                if held:
                    yield close()
                key, held = (hub, i, j), []
            held.append(member)
    if held:
        yield close()


def likely_members(members: list, one_block: bool) -> list[int]:
    """Rows of (block, row, component, size, signature) with a partner of another component (and block, unless there is one only) that is not hopeless."""
    block, row, group, size = (np.array([m[i] for m in members], np.int64) for i in range(4))
    sig = np.array([m[4] for m in members], np.int64).view(np.uint64).reshape(-1, WORDS_64)
    found = np.zeros(len(members), bool)
    chance = 1 / (1 << BITS)
    most = (1 - chance - LEAST_ESTIMATE * (1 - chance)) * MINIMA  # unequal minima at the least estimate
    for i in range(len(members)):
        fits = (group != group[i]) & (100 * np.minimum(size, size[i]) >= PERCENT * np.maximum(size, size[i]))
        if not one_block:
            fits &= block != block[i]
        at = np.flatnonzero(fits)
        d = sig[at] ^ sig[i]
        other = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(_LOW_BITS)).sum(axis=1)
        if (other <= most).any():
            found[i] = True
    return row[found].tolist()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, []

    def close() -> pa.RecordBatch:
        found = block_links(held, key is not None and key[1] == key[2])
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    for b in batches:
        for hub, i, j, mine, row, component, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (hub, i, j) != key:
                if held:
                    yield close()
                key, held = (hub, i, j), []
            held.append((row, component, mine, shingle_hashes(text)))
    if held:
        yield close()


def block_links(members: list[tuple[int, int, int, np.ndarray]], one_block: bool) -> list[tuple[int, int]]:
    """Links between the components of (row, component, block, shingles): one for each pair of components that have any.

    Pairs within a component need no test, and with ``one_block`` false neither do those within a block.
    """
    rows, groups, blocks = ([m[i] for m in members] for i in range(3))
    group = np.unique(np.array(groups), return_inverse=True)[1]
    if group.max(initial=0) == 0:
        return []
    block, sizes = np.array(blocks), np.array([len(m[3]) for m in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    _, term = np.unique(np.concatenate([m[3] for m in members]), return_inverse=True)
    order = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[order], np.arange(term.max() + 2))
    posted = owner[order]
    most = np.bincount(group).argmax()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for x in np.nonzero(group != most)[0]:
        terms = term[ends[x] : ends[x + 1]]
        both = np.bincount(np.concatenate([posted[starts[t] : starts[t + 1]] for t in terms]), minlength=len(members))
        hit = (100 * both >= PERCENT * (sizes + sizes[x] - both)) & (group != group[x]) & (both > 0)
        if not one_block:
            hit &= block != block[x]
        for y in np.nonzero(hit)[0]:
            pair = (min(group[x], group[y]), max(group[x], group[y]))
            out.setdefault(pair, (rows[x], rows[y]))
    return sorted(out.values())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept."""
    rows, names = _grouped(common.located(docs))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return rows.join(names, "group_").select("doc_id", "n_shingles", "component_id", kept)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest id, the first one if rows repeat it."""
    names, docs = docs.columns, common.located(docs)
    rows, _ = _grouped(docs)
    first = F.min_by(F.struct("file_", "place_"), F.struct(F.col("doc_id").isNull(), "doc_id", "row_"))
    one = rows.groupBy("group_").agg(first.alias("at_")).select(F.col("at_.file_").alias("of_file_"), F.col("at_.place_").alias("of_place_"))
    safe = docs.toDF(*(f"c{i}_" for i in range(len(names))), common.FILE, common.PLACE)
    kept = safe.join(one, (F.col(common.FILE) == F.col("of_file_")) & (F.col(common.PLACE) == F.col("of_place_")), "left_semi")
    return kept.drop(common.FILE, common.PLACE).toDF(*names)


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row_, file_, place_, doc_id, n_shingles, group_) of the located docs, and each group's component_id."""
    spark = docs.sparkSession
    common.small_batches(spark)
    text = F.coalesce(docs["text"], F.lit(""))
    with common.scratch(spark) as keep:
        base = docs.select(F.monotonically_increasing_id().alias("row_"), docs["doc_id"].cast("long").alias("doc_id"), F.col(common.FILE).alias("file_"), F.col(common.PLACE).alias("place_"), text.cast("binary").alias("text_"), common.text_key(text).alias("class_"))
        base = common.staged(signatures(base), "signatures")
        first = common.staged(base.where("n_shingles > 0").groupBy("class_").agg(F.min("row_").alias("rep_")), "classes")
        reps = base.select("row_", "n_shingles", "sig_", "bands_").join(first.select(F.col("rep_").alias("row_")), "row_", "left_semi")
        found = _found(docs, base, common.staged(reps, "representatives"))
        group = first.join(found, F.col("rep_") == F.col("node"), "left").select("class_", F.coalesce("component", "rep_").alias("group_"))
        rows = base.select("row_", "file_", "place_", "doc_id", "n_shingles", "class_").join(common.staged(group, "groups"), "class_", "left")
        rows = keep(common.staged(rows.withColumn("group_", F.coalesce("group_", F.col("row_"))).drop("class_"), "grouped"))
        names = keep(common.staged(rows.groupBy("group_").agg(F.min("doc_id").alias("component_id")), "names"))
    return rows, names


def _found(docs: DataFrame, base: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, component) of the linked representatives."""
    bands = reps.select("row_", F.explode("bands_").alias("key_"))
    shared = common.staged(bands.groupBy("key_").agg(F.count("*").alias("n_")).where("n_ > 1"), "shared-bands")
    members = common.staged(bands.join(shared, "key_"), "members")
    # The text that others were made from has the most popular bands: as the hub it shows most links at once.
    fame = members.groupBy("row_").agg(F.sum("n_").alias("fame_"))
    hubs = members.select("key_", "row_").join(fame, "row_").groupBy("key_").agg(F.max_by("row_", F.struct(F.col("fame_"), -F.col("row_"))).alias("b"))
    pairs = members.select("key_", F.col("row_").alias("a")).join(common.staged(hubs, "hubs"), "key_").where("a <> b").select("a", "b").distinct()
    stars = common.staged(_estimated(pairs, reps).where(F.col("estimate_") >= FAMILY_ESTIMATE), "stars")
    asked = stars.select(F.col("a").alias("row_")).unionAll(stars.select(F.col("b").alias("row_"))).distinct()
    asked = common.staged(base.select("row_", "file_", "place_").join(asked, "row_", "left_semi"), "asked")
    texts = common.staged(common.texts_at(docs, asked), "candidate-texts")
    near = stars.where((100 * F.least("na_", "nb_") >= PERCENT * F.greatest("na_", "nb_")) & (F.col("estimate_") >= LEAST_ESTIMATE)).select("a", "b")
    whole = near.join(texts.select(F.col("row_").alias("a"), F.col("text_").alias("ta_")), "a").join(texts.select(F.col("row_").alias("b"), F.col("text_").alias("tb_")), "b")
    links = common.staged(whole.select("a", "b", "ta_", "tb_").mapInArrow(_verify, "a long, b long"), "links")
    found = components(links)
    more_links = _families(stars, reps, texts, found)
    if more_links is not None and not more_links.isEmpty():
        found = components(links.unionAll(more_links))
    return found


def op5(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays."""
    return one_of_each(docs)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
common_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c
  FROM rows_ x JOIN rows_ y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), half AS (SELECT a, b FROM common_ WHERE 100 * c >= 75 * (na + nb - c)),
links AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a),
lowest AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest USING (doc_id)
"""
