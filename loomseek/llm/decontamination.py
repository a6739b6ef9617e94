"""Benchmark decontamination: size-partitioned MinHash containment search, by DataFrame functions only.

An item is contained in a document if the document has at least three quarters of the item's distinct shingles
of five lower-case words (fewer words: the whole sequence is the only shingle, of items and documents alike).

A signature of fixed length says little about a short item in a long document, so the sketch is a bottom-k MinHash
whose length follows from the sizes: of an item with q shingles, at least ceil(3q/4) must be in the document,
so of its q - ceil(3q/4) + 1 shingles with the smallest hashes at least one is. Items are partitioned by
the power of two of their size. Each class has a bound on the hashes in its sketches and a least document
size; a document probes with those of its hashes that the classes open to its size can hold, so its sketch is
proportional to its size. No contained item is missed, and candidates are verified by exact shingle containment.

Sketches, candidates and the items' shingles are broadcast only if they have at most ``BROADCAST_BYTES``, which is measured, else joined by
shuffle; before that, a bitmap of fixed size (``common.sieve``) takes out what has no partner, so neither all shingles nor all texts move.
The rows are the same either way. Other columns of the tables, whatever their names, are not read, and empty tables give no rows. Nulls: a null or empty text has no shingles, contains nothing and is contained nowhere. Rows with
one doc_id, null included, are one document as to the result of op6: an item is in it if one row has it. The pipeline's
stage decides for each row by itself. Items with equal texts are searched once and reported under each id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseek.llm import common

SHINGLE, PERCENT = 5, 75
#: Size up to which a side is broadcast, and what a row of numbers and keys counts.
BROADCAST_BYTES, ROW_BYTES = 16 << 20, 100
_BLANKS = " \t\n\x0b\f\r"


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row: a lambda's argument is never computed anew, as a merged projection would."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The lower-case words; null and blank texts have none."""
    none = F.array().cast("array<string>")
    split = let(F.trim(common.ascii_lower(text), F.lit(_BLANKS)), lambda bare: F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(none))
    return F.coalesce(split, none)


def _over_shingles(w: Column, make) -> Column:
    """make(words of a shingle) for each place in the array w; null without words."""

    def made(ws: Column) -> Column:
        n = F.size(ws)
        long = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: make([F.get(ws, i + k) for k in range(SHINGLE)]))
        return F.when(n >= SHINGLE, long).when(n > 0, F.array(make([F.array_join(ws, " ")])))

    return let(w, made)


def shingles(w: Column) -> Column:
    return F.array_distinct(_over_shingles(w, lambda ws: F.concat_ws(" ", *ws)))


def hashes(w: Column) -> Column:
    return _over_shingles(w, lambda ws: F.xxhash64(*ws))


def _met(rows: DataFrame, key: Column, side: DataFrame, n_bytes: int, on) -> DataFrame:
    """rows joined with side, whose first column is what key must equal: by broadcast if side is small, else what can have no partner goes first."""
    return rows.join(F.broadcast(side), on) if n_bytes <= BROADCAST_BYTES else common.sieve(rows, key, side.select(side.columns[0])).join(side, on)


def item_sets(items: DataFrame) -> DataFrame:
    """One row for each different text of items: item_key_, its shingles and sketch, their number and size class."""
    w = items.select(common.text_key(items["text"]).alias("item_key_"), words(items["text"]).alias("w_")).dropDuplicates(["item_key_"])
    sets = w.select("item_key_", shingles(F.col("w_")).alias("shingles_"), F.array_distinct(hashes(F.col("w_"))).alias("h_")).where("shingles_ IS NOT NULL")
    q = F.size("shingles_")
    need = F.ceil(q * PERCENT / F.lit(100)).cast("int")
    return sets.select("item_key_", "shingles_", q.alias("q_"), need.alias("need_"), F.floor(F.log2(q)).cast("int").alias("size_class_"), F.slice(F.array_sort("h_"), F.lit(1), q - need + 1).alias("sketch_"))


def _checked(docs: DataFrame, items: DataFrame, key: Column) -> DataFrame:
    """One row for each row of docs and text of items in it, and its key: key_, item_key_, n_common, q_. Rows of one key probe as one."""
    sets = common.staged(item_sets(items), "item-sets")
    sketch = sets.select(F.explode("sketch_").alias("h_"), "item_key_", "need_")
    # One row for each power of two of item sizes.
    classes = sets.groupBy("size_class_").agg(F.min("need_").alias("least"), F.max(F.array_max("sketch_")).alias("most")).collect()
    sizes = sets.agg(F.sum(F.size("sketch_") * ROW_BYTES), F.sum(F.octet_length(F.array_join("shingles_", "")) + ROW_BYTES)).head()
    sketch_bytes, set_bytes = (n or 0 for n in sizes)

    def probing(all_: Column) -> Column:
        """The size of the document and those of its hashes that a class open to this size can hold."""
        most = F.greatest(*(F.when(F.size(all_) >= c["least"], F.lit(c["most"])) for c in classes), F.lit(None).cast("long"), F.lit(None).cast("long"))
        return F.struct(F.size(all_).alias("n"), let(most, lambda t: F.filter(all_, lambda h: h <= t)).alias("h"))

    probed = docs.select(key.alias("key_"), let(hashes(words(docs["text"])), probing).alias("p_"))
    probes = probed.select("key_", F.col("p_.n").alias("n_"), F.explode("p_.h").alias("h_"))
    hits = _met(probes, F.col("h_"), sketch, sketch_bytes, "h_").where("n_ >= need_").select("key_", "item_key_").distinct()
    found = common.staged(hits, "candidates")
    asked = found.groupBy("key_").agg(F.collect_list("item_key_").alias("item_keys_"))
    theirs = _met(docs.select(key.alias("of_"), docs["text"].alias("text_")), F.col("of_"), asked, found.count() * ROW_BYTES, F.col("of_").eqNullSafe(F.col("key_")))
    texts = theirs.select("key_", shingles(words(F.col("text_"))).alias("has_"), "item_keys_").select("key_", "has_", F.explode("item_keys_").alias("item_key_"))
    common_ = F.size(F.array_intersect("shingles_", "has_"))
    sides = sets.select("item_key_", "shingles_", "q_", "need_")
    checked = texts.join(F.broadcast(sides) if set_bytes <= BROADCAST_BYTES else sides, "item_key_").withColumn("n_common", common_).where("n_common >= need_")
    return checked.select("key_", "item_key_", "n_common", "q_")


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Which items are in which documents: doc_id, item_id, n_common, n_item, containment."""
    checked = _checked(docs, items, docs["doc_id"].cast("long")).withColumnRenamed("key_", "doc_id")
    best = checked.groupBy("doc_id", "item_key_").agg(F.max("n_common").cast("long").alias("n_common"), F.max("q_").cast("long").alias("n_item"))
    ids = items.select(items["item_id"].cast("long").alias("item_id"), common.text_key(items["text"]).alias("item_key_")).distinct()
    return best.join(ids, "item_key_").select("doc_id", "item_id", "n_common", "n_item", (F.col("n_common") / F.col("n_item")).alias("containment"))


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents that hold benchmark items."""
    return contained_items(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def without_items(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that hold a benchmark item go, and no other row of their doc_id."""
    names, docs = docs.columns, common.located(docs)
    place = F.struct(common.FILE, common.PLACE)
    with common.scratch(spark) as keep:
        bad = keep(common.staged(_checked(docs, common.table(spark, sf_dir, "benchmark"), place).select(F.col("key_").alias("bad_")).distinct(), "contaminated"))
    safe = docs.toDF(*(f"c{i}_" for i in range(len(names))), common.FILE, common.PLACE)
    return safe.join(bad, place.eqNullSafe(F.col("bad_")), "left_anti").drop(common.FILE, common.PLACE).toDF(*names)


SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), s AS (
  SELECT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS shingle FROM w
), i AS (SELECT id, shingle, count(*) OVER (PARTITION BY id) AS n FROM s WHERE kind = 'i')
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_common, max(i.n) AS n_item, CAST(count(*) AS DOUBLE) / max(i.n) AS containment
FROM s d JOIN i ON d.shingle = i.shingle WHERE d.kind = 'd'
GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * max(i.n)
"""
