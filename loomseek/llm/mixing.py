"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of all documents by weight; a target stops at ``most`` times its source's words
and the excess is dealt again by weight. A document of a source with factor f = target / words is taken
floor(f) times for certain. The words that are still missing come from a sample without replacement, in which
a document's inclusion probability is proportional to its words: p = min(1, c * words), with c such that the expected
words are the missing ones. Documents with p = 1 are taken for certain; of the others a fixed number n, the rounded sum of their p,
is drawn by Pareto order: they rank by the odds of a random number u over the odds of p, and the first n are taken.
u derives from the document's id and the seed alone, so reruns agree.

A fixed number of documents leaves the words to chance. So pairs around the cut, the last ones taken and the first ones not taken
(up to ``CLOSING`` pairs of a source), change places one after another wherever that brings the words nearer to the missing ones:
n stays, and what is left is about half a document where a source has a few dozen documents.

Nulls: a null text has no words; null sources form one source, which comes last; a null id ranks by its own
random number. Documents without words are never drawn. Repeated rows are drawn row by row, ties by row. If no source has words,
every target is 0. An empty table has no rows. Other columns are left alone, whatever their names.

Nothing but two sums reaches the driver; sources are ranked and filled in distributed running sums, as they may be many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.llm import common

#: Relative weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Pairs around the cut that may change places, and the largest inclusion probability of a document that is drawn.
CLOSING, ALMOST = 200, 1 - 1e-9


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the sum of sizes by weight, none above ``most`` times its size; what is over is dealt again."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free, rest = [i for i in range(len(sizes)) if sizes[i]], total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = rest * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free = [i for i in free if i not in set(over)]
        rest = total - sum(out)
    return out


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone: 52 bits of their MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _filled(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """of_, source_size and target of each source; sizes: (source_, size, n_)."""
    spark = sizes.sparkSession
    sources = sizes.groupBy("source_").agg(F.sum(F.col("size") * F.col("n_")).alias("s_")).withColumns({"last_": F.col("source_").isNull(), "one_": F.lit(1).cast("long")})
    ranked = common.in_order(sources, ["last_", "source_"], ["one_"])
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), ((F.col("run_one_") - 1) % len(weights) + 1).cast("int"))
    named = common.staged(ranked.select("source_", "s_", "run_one_", weight.alias("w_")), "mixing-sources")
    total = named.agg(F.sum("s_").alias("s"), F.sum(F.when(F.col("s_") > 0, F.col("w_"))).alias("w")).head()
    # By words for each unit of weight, the sources that stop come first; from the first one on that has enough for its share, the others share the rest.
    order = common.in_order(named.where("s_ > 0").withColumn("ratio_", F.col("s_") / F.col("w_")), ["ratio_", "run_one_"], ["s_", "w_"])
    rest, free = F.lit(float(total["s"] or 0)) - most * (F.col("run_s_") - F.col("s_")), F.lit(float(total["w"] or 0)) - (F.col("run_w_") - F.col("w_"))
    first = order.withColumns({"rest": rest, "free": free}).where(F.col("rest") * F.col("w_") / F.col("free") <= most * F.col("s_")).orderBy("ratio_", "run_one_").select("rest", "free").limit(1).collect()
    rest, free = (first[0]["rest"], first[0]["free"]) if first else (0.0, 1.0)
    share, top = F.lit(rest) * F.col("w_") / F.lit(free), (most * F.col("s_")).cast("double")
    return named.select(F.col("source_").alias("of_"), F.col("run_one_").alias("rank_of_"), F.col("s_").alias("source_size"), F.when(F.col("s_") > 0, F.least(share, top)).otherwise(0.0).alias("target"))


def _plan(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row for each source: target, whole copies, the largest size that is drawn, and how many and which words are drawn.

    sizes has a row for each source and different size, so a window over a source has no more rows than texts can differ in words.
    """
    filled = common.staged(_filled(sizes, weights, most), "mixing-targets")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-9), F.lit(most))).otherwise(0).cast("long")
    filled = filled.withColumn("whole_", whole).withColumn("missing_", F.greatest(F.lit(0.0), F.col("target") - F.col("whole_") * F.col("source_size")))
    exact = "decimal(38,0)"
    below = Window.partitionBy("rank_of_").orderBy("size")
    counted = sizes.where("size > 0").join(filled.where("missing_ > 0"), sizes["source_"].eqNullSafe(F.col("of_")))
    sums = counted.withColumns({"words_": F.sum(F.col("n_") * F.col("size")).over(below), "squares_": F.sum(F.col("n_").cast(exact) * F.col("size") * F.col("size")).over(below).cast("double")})
    left = F.col("missing_") - (F.col("source_size") - F.col("words_"))
    drawn = sums.withColumn("left_", left).where(F.col("left_") * F.col("size") <= F.col("squares_"))
    chosen = drawn.groupBy("rank_of_").agg(F.max_by(F.struct("size", "words_", "squares_", "left_"), "size").alias("at_"))
    n = F.floor(F.col("at_.left_") / F.col("at_.squares_") * F.col("at_.words_") + 0.5).cast("long")
    chosen = chosen.select("rank_of_", F.col("at_.size").alias("top_"), F.col("at_.words_").alias("drawn_from_"), F.col("at_.left_").alias("left_"), n.alias("draws_"))
    return filled.join(chosen, "rank_of_", "left")


def _swaps(ranked: DataFrame) -> DataFrame:
    """rank_of_ and the numbers of the pairs around the cut that change places, one after another where the words come nearer."""
    pair = F.when(F.col("run_one_") <= F.col("draws_"), F.col("draws_") + 1 - F.col("run_one_")).otherwise(F.col("run_one_") - F.col("draws_"))
    near = ranked.where(F.abs(F.col("run_one_") - F.col("draws_") - F.lit(0.5)) < CLOSING)
    out = F.col("run_one_") <= F.col("draws_")
    sides = near.groupBy("rank_of_", pair.alias("pair_")).agg(F.max(F.when(out, F.col("size"))).alias("out_"), F.max(F.when(~out, F.col("size"))).alias("in_"), F.max(F.when(F.col("run_one_") == F.col("draws_"), F.col("left_") - F.col("run_size"))).alias("short_"))
    whole = sides.groupBy("rank_of_").agg(F.sort_array(F.collect_list(F.when(F.col("out_").isNotNull() & F.col("in_").isNotNull(), F.struct("pair_", (F.col("in_") - F.col("out_")).alias("more_"))))).alias("pairs_"), F.max("short_").alias("short_"))
    start = F.struct(F.col("short_").alias("short"), F.array().cast("array<long>").alias("taken"))

    def step(state: Column, pair: Column) -> Column:
        after = state["short"] - pair["more_"]
        better = F.abs(after) < F.abs(state["short"])
        return F.struct(F.when(better, after).otherwise(state["short"]).alias("short"), F.when(better, F.array_append(state["taken"], pair["pair_"])).otherwise(state["taken"]).alias("taken"))

    return whole.select("rank_of_", F.aggregate("pairs_", start, step, lambda s: s["taken"]).alias("swaps_"))


def mix(docs: DataFrame, seed: int = 20, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each row of docs.

    Returns doc_id, size, source_size, target, copies and taken; with ``carry``, for rows that are taken, also those columns of docs.
    """
    docs = common.located(docs)
    place = [F.col(common.FILE).alias("file_"), F.col(common.PLACE).alias("place_")]
    with common.scratch(docs.sparkSession) as keep:
        base = keep(common.staged(docs.select(docs["doc_id"].cast("long").alias("doc_id"), common.word_count(docs["text"]).alias("size"), docs["source"].cast("string").alias("source_"), *place), "mixing-base"))
        sizes = common.staged(base.groupBy("source_", "size").agg(F.count("*").alias("n_")), "mixing-sizes")
        per = keep(common.staged(_plan(sizes, weights, most), "mixing-plan"))
        joined = base.join(per, base["source_"].eqNullSafe(per["of_"])).drop("of_", "source_")
        odds = lambda p: p / (F.lit(1.0) - p)
        free = joined.where((F.col("size") > 0) & (F.col("size") <= F.col("top_")) & (F.col("draws_") > 0))
        chance = F.least(F.col("draws_") * F.col("size") / F.col("drawn_from_"), F.lit(ALMOST))
        ranked = free.select("rank_of_", "doc_id", "size", "file_", "place_", "draws_", "left_", (odds(uniform(F.col("doc_id"), seed)) / odds(chance)).alias("order_"), F.lit(1).cast("long").alias("one_"))
        ranked = common.staged(common.in_order(ranked, ["rank_of_", "order_", "doc_id", "size", "file_", "place_"], ["one_", "size"], within="rank_of_"), "mixing-order")
        # Written: one short row for each source, so a frequent source's documents need not meet in one task.
        swaps = common.staged(_swaps(ranked).select(F.col("rank_of_").alias("swap_of_"), "swaps_"), "mixing-swaps")
        pair = F.when(F.col("run_one_") <= F.col("draws_"), F.col("draws_") + 1 - F.col("run_one_")).otherwise(F.col("run_one_") - F.col("draws_"))
        changed = F.coalesce(F.array_contains("swaps_", pair), F.lit(False))
        drawn = ranked.join(swaps, F.col("rank_of_") == F.col("swap_of_"), "left").where((F.col("run_one_") <= F.col("draws_")) != changed)
        drawn = keep(common.staged(drawn.select(F.col("file_").alias("drawn_file_"), F.col("place_").alias("drawn_place_")), "mixing-drawn"))
    extra = F.coalesce((F.col("size") > F.col("top_")) | F.col("drawn_place_").isNotNull(), F.lit(False))
    out = joined.join(drawn, (F.col("file_") == F.col("drawn_file_")) & (F.col("place_") == F.col("drawn_place_")), "left")
    out = out.withColumn("copies", F.col("whole_") + F.when(extra, 1).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "size", "source_size", "target", "copies", "taken", "file_", "place_")
    if not carry:
        return out.drop("file_", "place_")
    held = docs.select(*(docs[common.quoted(c)].alias(f"carried_{i}") for i, c in enumerate(carry)), *(p.alias(f"{n}of_") for n, p in zip(("file_", "place_"), place, strict=True)))
    both = out.where("copies > 0").join(held, (F.col("file_") == F.col("file_of_")) & (F.col("place_") == F.col("place_of_")))
    return both.select(*out.columns[:6], *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)))


def mixed_rows(docs: DataFrame, seed: int = 20) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    names = docs.columns
    taken = mix(docs, seed, carry=tuple(names))
    rows = taken.toDF(*taken.columns[:6], *(f"c{i}_" for i in range(len(names))))
    return rows.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(F.col(f"c{i}_").alias(n) for i, n in enumerate(names)))


def op10(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    common.small_batches(spark)
    return mix(common.table(spark, sf_dir, "documents"))


#: The same in SQL, for tables whose ids do not repeat.
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, sum(size) AS s, list_extract([5.0, 2.0, 1.0], CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)) AS weight FROM w GROUP BY source),
fill AS (
  SELECT source, CAST(s AS DOUBLE) AS s, CAST(weight AS DOUBLE) AS weight, CAST(NULL AS DOUBLE) AS t, 0 AS round FROM src WHERE s > 0
  UNION ALL
  SELECT source, s, weight, CASE WHEN t IS NOT NULL THEN t WHEN rest * weight / free > {MOST} * s THEN {MOST} * s END, round + 1
  FROM (SELECT *, max(CASE WHEN t IS NULL AND rest * weight / free > {MOST} * s THEN 1 ELSE 0 END) OVER () AS again
    FROM (SELECT *, sum(s) OVER () - sum(coalesce(t, 0)) OVER () AS rest, sum(CASE WHEN t IS NULL THEN weight END) OVER () AS free FROM fill)) WHERE again = 1
),
last_ AS (SELECT *, sum(s) OVER () - sum(coalesce(t, 0)) OVER () AS rest, sum(CASE WHEN t IS NULL THEN weight END) OVER () AS free FROM fill WHERE round = (SELECT max(round) FROM fill)),
per AS (SELECT src.source, CAST(src.s AS BIGINT) AS source_size, CASE WHEN last_.s IS NULL THEN 0.0 ELSE coalesce(t, rest * last_.weight / free) END AS target FROM src LEFT JOIN last_ ON src.source IS NOT DISTINCT FROM last_.source),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size + 1e-9) AS BIGINT), {MOST}) ELSE 0 END AS whole FROM per),
need AS (SELECT *, CASE WHEN source_size > 0 THEN greatest(0.0, target - whole * source_size) ELSE 0.0 END AS missing FROM whole),
sums AS (SELECT need.source, source_size, missing, size, sum(count(*) * size) OVER w AS words, CAST(sum(count(*) * size * size) OVER w AS DOUBLE) AS squares
  FROM w JOIN need ON w.source IS NOT DISTINCT FROM need.source WHERE size > 0 AND missing > 0 GROUP BY need.source, source_size, missing, size WINDOW w AS (PARTITION BY need.source ORDER BY size)),
cut AS (SELECT source, max(size) AS top, max_by(words, size) AS drawn_from, max_by(missing - (source_size - words), size) AS lacks, max_by(CAST(floor((missing - (source_size - words)) / squares * words + 0.5) AS BIGINT), size) AS draws
  FROM sums WHERE (missing - (source_size - words)) * size <= squares GROUP BY source),
dice AS (SELECT doc_id, size, need.*, top, drawn_from, lacks, draws, (list_reduce(list_transform(range(1, 14), lambda i: CAST(strpos('0123456789abcdef', substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), i, 1)) - 1 AS BIGINT)), lambda a, x: a * 16 + x) + 0.5) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM w JOIN need ON w.source IS NOT DISTINCT FROM need.source LEFT JOIN cut ON w.source IS NOT DISTINCT FROM cut.source),
odds AS (SELECT *, (u / (1.0 - u)) / (least(CAST(draws * size AS DOUBLE) / drawn_from, {ALMOST}) / (1.0 - least(CAST(draws * size AS DOUBLE) / drawn_from, {ALMOST}))) AS o FROM dice WHERE size > 0 AND size <= top AND draws > 0),
ranked AS (SELECT *, row_number() OVER w AS r, sum(size) OVER w AS run FROM odds WINDOW w AS (PARTITION BY source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING)),
near AS (SELECT *, CASE WHEN r <= draws THEN draws + 1 - r ELSE r - draws END AS pair FROM ranked),
sides AS (SELECT source, pair, max(CASE WHEN r > draws THEN size END) - max(CASE WHEN r <= draws THEN size END) AS more FROM near WHERE pair <= {CLOSING} GROUP BY source, pair),
closing AS (
  SELECT source, CAST(0 AS BIGINT) AS pair, max(CASE WHEN r = draws THEN lacks - run END) AS short, false AS swap FROM ranked GROUP BY source
  UNION ALL
  SELECT c.source, s.pair, CASE WHEN abs(c.short - s.more) < abs(c.short) THEN c.short - s.more ELSE c.short END, abs(c.short - s.more) < abs(c.short)
  FROM closing c JOIN sides s ON c.source IS NOT DISTINCT FROM s.source AND s.pair = c.pair + 1 WHERE s.more IS NOT NULL
),
drawn AS (SELECT n.doc_id, n.size, n.source FROM near n LEFT JOIN closing c ON c.source IS NOT DISTINCT FROM n.source AND c.pair = n.pair WHERE (n.r <= n.draws) <> coalesce(c.swap, false)),
copied AS (SELECT d.*, d.whole + CASE WHEN d.missing > 0 AND (d.size > d.top OR EXISTS (SELECT 1 FROM drawn x WHERE x.doc_id IS NOT DISTINCT FROM d.doc_id AND x.source IS NOT DISTINCT FROM d.source)) THEN 1 ELSE 0 END AS copies FROM dice d)
SELECT doc_id, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM copied
"""
