"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts form one atomic group; groups stand in the order of their smallest doc_id. The smallest
capacity C is sought for which cutting that sequence into at most ``shards`` runs leaves no run above C:
a binary search over C, each value checked greedily. The sequence itself stays distributed. The driver
holds a sketch of at most ``buckets`` of its boundaries for each refinement, checks both the cuts known
to exist and the cuts that could at best exist, and refines only where the two can differ, until the two
capacities meet; the capacity found is therefore exact. Among the cuts that respect it, those nearest
to even shares are taken, from left to right; where that depends on unknown boundaries, they are refined too.

Nulls: a null text has size 16 and is a group of its own; an empty text likewise. A null doc_id sorts first.
Repeated rows keep a row, and a slot, each. Empty tables give no rows. Other columns are left alone; a carried one that has the name
of a result's column (size, shard, slot and so on, in whatever case) is called ``document_<name>`` there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.llm import common

#: Bytes that every row counts besides its text, and the columns of the result.
OVERHEAD = 16
OWN = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@dataclass
class Boundaries:
    """Known ends of groups, as sums of sizes from the left; gap j (from at[j] to at[j + 1]) is whole if no end is missing in it."""

    at: np.ndarray
    whole: np.ndarray
    total: int = field(init=False)
    asked: set[int] = field(default_factory=set)  # gaps with missing ends that answers depended on

    def __post_init__(self) -> None:
        self.total = int(self.at[-1])

    def _depends(self, limit: int) -> None:
        j = int(np.searchsorted(self.at, limit, "right")) - 1
        if 0 <= j < len(self.whole) and not self.whole[j] and self.at[j] != limit:
            self.asked.add(j)

    def known(self, limit: int) -> int:
        """The largest known end up to limit."""
        self._depends(limit)
        return int(self.at[np.searchsorted(self.at, limit, "right") - 1])

    def possible(self, limit: int) -> int:
        """No end up to limit is larger than this."""
        j = int(np.searchsorted(self.at, limit, "right")) - 1
        return self.total if limit >= self.total else int(self.at[j]) if self.whole[j] else limit

    def from_right(self, limit: int) -> int:
        """The smallest known end from limit on."""
        self._depends(limit)
        return int(self.at[np.searchsorted(self.at, max(limit, 0), "left")])

    def walk(self, capacity: int, shards: int, step) -> list[int]:
        ends, p = [], 0
        for _ in range(shards):
            p = step(p + capacity)
            ends.append(p)
        return ends


def smallest(ends: Boundaries, shards: int, step, low: int, high: int) -> int:
    """The smallest capacity under which greedy steps reach the end."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if ends.walk(mid, shards, step)[-1] >= ends.total else (mid + 1, high)
    return low


def even_cuts(ends: Boundaries, capacity: int, shards: int) -> list[int]:
    """Inner cuts under the capacity, each the end nearest to an even share of what is left that the rest allows; of two, the lower."""
    least = [ends.total]
    for _ in range(shards - 1):
        least.append(ends.from_right(least[-1] - capacity))
    cuts, p = [], 0
    for left in range(shards - 1, 0, -1):
        low, high = max(p, least[left]), ends.known(p + capacity)
        share = -(-(ends.total - p) // (left + 1))
        aim = min(max(p + share, low), high)
        below, above = ends.known(aim), ends.from_right(aim)
        p = below if below >= low and (above > high or aim - below <= above - aim) else above
        cuts.append(p)
    return cuts


def minimax_cuts(bounds: DataFrame, total: int, shards: int, buckets: int = 1 << 15) -> tuple[int, list[int]]:
    """Smallest capacity and the inner cuts. bounds: one row for each end of a group, in the column ``end_``."""
    ends = _refine(bounds, Boundaries(np.array([0, total]), np.array([False])), [0], buckets)
    while True:
        low = smallest(ends, shards, ends.possible, -(-total // shards), total)
        high = smallest(ends, shards, ends.known, low, total)
        if low == high:
            break
        first, last = ends.walk(low, shards, ends.known), ends.walk(high, shards, ends.possible)
        unsure = {j for a, b in zip(first, last, strict=True) for j in range(int(np.searchsorted(ends.at, a, "right")) - 1, min(int(np.searchsorted(ends.at, b, "left")), len(ends.whole))) if not ends.whole[j]}
        ends = _refine(bounds, ends, sorted(unsure), buckets)
    while True:
        ends.asked.clear()
        cuts = even_cuts(ends, high, shards)
        if not ends.asked:
            return high, cuts
        ends = _refine(bounds, ends, sorted(ends.asked), buckets)


def _refine(bounds: DataFrame, ends: Boundaries, gaps: list[int], buckets: int) -> Boundaries:
    """Looks into the gaps: of each of their buckets, the first and last end and the number of ends."""
    lows, highs = ends.at[gaps], ends.at[[g + 1 for g in gaps]]
    each = max(2, buckets // len(gaps))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy().astype(np.int64)
            g = np.searchsorted(lows, x, "left") - 1
            ok = (g >= 0) & (x < highs[np.maximum(g, 0)])
            x, g = x[ok], g[ok]
            width = -(-(highs[g] - lows[g]) // each)
            yield pa.RecordBatch.from_arrays([pa.array(g * each + (x - lows[g]) // width), pa.array(x)], names=["bucket", "x"])

    rows = bounds.select("end_").mapInArrow(sketch, "bucket long, x long").groupBy("bucket").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("x").alias("n")).collect()
    inside = sorted((r["a"], r["b"], r["n"]) for r in rows)
    at, whole = [], {}
    for a, b, n in inside:
        at += [a] if a == b else [a, b]
        if n > 2:
            whole[a] = False  # what lies between the first and the last is still unknown
    every = np.union1d(ends.at, np.array(at, np.int64))
    asked = set(gaps)
    state = []
    for p in every[:-1].tolist():
        j = int(np.searchsorted(ends.at, p, "right")) - 1
        state.append(whole.get(p, True) if j in asked else bool(ends.whole[j]))
    return Boundaries(every, np.array(state, bool))


def minimax_shards(docs: DataFrame, shards: int = 40, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deals the rows of docs into ``shards`` runs of atomic groups of equal texts.

    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard) and the columns ``carry`` of docs.
    """
    docs = common.located(docs)
    text = docs["text"]
    place = [F.col(common.FILE).alias("file_"), F.col(common.PLACE).alias("place_")]
    with common.scratch(docs.sparkSession) as keep:
        base = docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"), common.crc32(text).alias("text_crc32"), common.text_key(text).alias("key_"), *place)
        base = common.staged(base, "sharding-base")
        many = common.staged(base.groupBy("key_").agg(F.min("doc_id").alias("lead_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_"), "sharding-groups")
        rows = base.join(many, "key_", "left").withColumn("lead_", F.coalesce("lead_", "doc_id")).withColumn("one_", F.lit(1).cast("long"))
        order = ["lead_", "key_", "doc_id", "file_", "place_"]
        run = keep(common.staged(common.in_order(rows, order, ["size", "one_"]), "sharding-run"))
        total = run.agg(F.max("run_size")).head()[0]
        cuts: list[int] = []
        if total:
            bounds = common.staged(run.groupBy("lead_", "key_").agg(F.max("run_size").alias("end_")).select("end_"), "sharding-ends")
            _, cuts = minimax_cuts(bounds, total, shards)
    shard = sum((F.when(F.col("run_size") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    dealt = run.withColumn("shard", shard)
    starts = {r["shard"]: r["start"] for r in dealt.groupBy("shard").agg(F.min("run_one_").alias("start")).collect()}
    start = F.create_map(*(x for k, v in starts.items() for x in (F.lit(k), F.lit(v)))) if starts else F.create_map(F.lit(0), F.lit(0).cast("long"))
    out = dealt.withColumn("slot", F.col("run_one_") - F.element_at(start, F.col("shard"))).select("doc_id", "size", "text_crc32", "shard", "slot", "file_", "place_")
    if not carry:
        return out.drop("file_", "place_")
    held = docs.select(*(docs[common.quoted(c)].alias(f"carried_{i}") for i, c in enumerate(carry)), *(p.alias(f"{n}of_") for n, p in zip(("file_", "place_"), place, strict=True)))
    both = out.join(held, (F.col("file_") == F.col("file_of_")) & (F.col("place_") == F.col("place_of_")))
    return both.select(*out.columns[:5], *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carried_names(carry))))


def carried_names(carry: tuple[str, ...]) -> list[str]:
    """Names of carried columns beside the result's own."""
    taken, out = set(OWN), []
    for name in carry:
        while name.lower() in taken:
            name = f"document_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def op3(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39, by near equal sizes."""
    common.small_batches(spark)
    return with_law(minimax_shards(common.table(spark, sf_dir, "documents")))


def with_law(dealt: DataFrame) -> DataFrame:
    """The contract's columns: the law that the shards follow, and none for one more shard."""
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *(common.quoted(c) for c in dealt.columns[5:]))


#: The same in SQL: a binary search whose every step jumps to the last end that a shard can reach.
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + {OVERHEAD} AS BIGINT) AS size, text FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS lead FROM d),
e AS (SELECT CAST(sum(s) OVER (ORDER BY lead) AS BIGINT) AS e FROM (SELECT lead, sum(size) AS s FROM g GROUP BY lead)),
z AS (SELECT max(e) AS total FROM e),
search AS (
  SELECT CAST((total + 39) // 40 AS BIGINT) AS low, total AS high, CAST(((total + 39) // 40 + total) // 2 AS BIGINT) AS mid, 0 AS k, CAST(0 AS BIGINT) AS p, total FROM z
  UNION ALL
  SELECT CASE WHEN k = 40 AND p < total THEN mid + 1 ELSE low END, CASE WHEN k = 40 AND p >= total THEN mid ELSE high END,
    CASE WHEN k < 40 THEN mid WHEN p < total THEN (mid + 1 + high) // 2 ELSE (low + mid) // 2 END,
    CASE WHEN k = 40 THEN 0 ELSE k + 1 END,
    CASE WHEN k = 40 THEN 0 ELSE coalesce((SELECT max(e) FROM e WHERE e <= p + mid), 0) END, total
  FROM search WHERE low < high
),
c AS (SELECT min(high) AS c, any_value(total) AS total FROM search),
back AS (
  SELECT 0 AS k, total AS p, c, total FROM c
  UNION ALL
  SELECT k + 1, coalesce((SELECT min(x.e) FROM (SELECT e FROM e UNION ALL SELECT 0) x WHERE x.e >= greatest(p - c, 0)), 0), c, total FROM back WHERE k < 39
),
cut AS (
  SELECT 40 AS n, CAST(0 AS BIGINT) AS p, c, total FROM c
  UNION ALL
  SELECT n - 1, CASE WHEN below >= low AND (above > high OR aim - below <= above - aim) THEN below ELSE above END, c, total FROM (
    SELECT *, (SELECT max(x.e) FROM (SELECT e FROM e UNION ALL SELECT 0) x WHERE x.e <= aim) AS below, (SELECT min(x.e) FROM (SELECT e FROM e UNION ALL SELECT 0) x WHERE x.e >= aim) AS above FROM (
      SELECT *, least(greatest(p + (total - p + n - 1) // n, low), high) AS aim FROM (
        SELECT n, p, c, total, greatest(p, (SELECT b.p FROM back b WHERE b.k = n - 1)) AS low, (SELECT max(x.e) FROM (SELECT e FROM e UNION ALL SELECT 0) x WHERE x.e <= cut.p + c) AS high FROM cut WHERE n > 1)))
),
run AS (SELECT *, sum(size) OVER (ORDER BY lead, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT *, CAST((SELECT count(*) FROM cut WHERE n < 40 AND cut.p < run.run) AS INTEGER) AS shard FROM run)
-- CRC-32 by bytes, over the table that its polynomial gives
, tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), [CAST(0 AS BIGINT) for x in range(0, 8)]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
b AS (SELECT doc_id, shard, size, lead, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST((strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes FROM s)
SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(t[CAST(xor(c, x) % 256 AS INTEGER) + 1], c // 256)), 4294967295) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY lead, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM b, tab
"""
