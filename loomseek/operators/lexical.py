"""BM25 over three weighted fields, and the rerank by coverage and adjacent path terms.

Statistics (number of records, mean length, records by term) hold for the whole corpus; filters apply after them.
For one query, postings are never built: terms are counted in the token arrays of the records that have one, so
nothing but candidates is shuffled. ``postings`` is the form to write and to join for many queries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomseek.functions import text
from loomseek.functions.porter import stem, stem_column

#: Field weights, BM25's parameters, the two cuts.
WEIGHTS = {"path_terms": 3.0, "symbol_terms": 5.0, "body_terms": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
PRE_CUT, CANDIDATES = 150, 50


def postings(fields: DataFrame, key: str = "id") -> DataFrame:
    """(key, term, tf_path, tf_symbol, tf_body): counts are summed before they are shuffled."""
    parts = [fields.select(key, F.explode(c).alias("term"), F.lit(i).alias("field_")) for i, c in enumerate(WEIGHTS)]
    counts = {f"tf_{c.removesuffix('_terms')}": F.count_if(F.col("field_") == i) for i, c in enumerate(WEIGHTS)}
    return reduce(DataFrame.unionAll, parts).groupBy(key, "term").agg(*(v.alias(k) for k, v in counts.items()))


def lengths(fields: DataFrame, key: str = "id") -> DataFrame:
    return fields.select(key, length().alias("len"))


def length() -> Column:
    return reduce(add, (F.size(c) for c in WEIGHTS)).cast("long")


def term_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("n"))


def stemmed(fields: DataFrame, key: str = "id") -> DataFrame:
    """Postings by stem: the vocabulary is stemmed once and joined back."""
    posts = postings(fields, key)
    stems = posts.select("term").distinct().withColumn("stem", stem_column(F.col("term")))
    sums = [F.sum(c).alias(c) for c in posts.columns if c.startswith("tf_")]
    return posts.join(stems, "term").groupBy(key, F.col("stem").alias("term")).agg(*sums)


def stored(records: DataFrame, stems: bool = True) -> DataFrame:
    """Postings by stem or token as an index has them: (term, id, tf_path, tf_symbol, tf_body, len), in ranges of terms, so a query reads the rows of its terms."""
    sizes = records.select("id", length().alias("len"))
    return (stemmed(records) if stems else postings(records)).join(sizes, "id").select("term", "id", "tf_path", "tf_symbol", "tf_body", "len").repartitionByRange("term").sortWithinPartitions("term", "id")


def bm25_stored(posts: DataFrame, n: int, total: int, terms: Sequence[str], among: DataFrame | None = None, cut: int = PRE_CUT, key: str = "id") -> DataFrame:
    """(key, lexical) of the best records by stored postings; ``among`` (key) filters candidates, not statistics.

    One number for each term of the query comes to the driver. Parts are added in the order of the terms, so reruns agree.
    """
    asked = Counter(terms)
    rows = posts.where(F.col("term").isin(list(asked)))
    df = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}
    if not df:
        return posts.select(key, F.lit(0.0).alias("lexical")).limit(0)
    tf = reduce(add, (F.lit(w) * F.col(f"tf_{c.removesuffix('_terms')}") for c, w in WEIGHTS.items()))
    order = {t: i for i, t in enumerate(asked) if t in df}
    idfs = F.create_map(*(x for t in order for x in (F.lit(t), _idf(n, F.lit(float(df[t]))) * asked[t])))
    places = F.create_map(*(x for t, i in order.items() for x in (F.lit(t), F.lit(i))))
    part = _part(F.element_at(idfs, F.col("term")), tf, F.col("len"), F.lit(total / n if n else 1.0))
    scored = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.element_at(places, F.col("term")).alias("at"), part.alias("part")))).alias("parts_"))
    scored = scored.select(key, F.aggregate("parts_", F.lit(0.0), lambda s, x: s + x["part"]).alias("lexical"))
    kept = scored if among is None else scored.join(among.select(key), key, "left_semi")
    return kept.orderBy(F.desc("lexical"), key).limit(cut)


def _tf(term: str) -> Column:
    count = lambda c: F.size(F.filter(c, lambda t: t == F.lit(term)))
    return reduce(add, (F.lit(w) * count(c) for c, w in WEIGHTS.items()))


def _idf(n: int, df: Column | float) -> Column:
    return F.greatest(F.log((F.lit(n) - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def _part(idf: Column, tf: Column, size: Column, mean: Column) -> Column:
    return idf * (tf * (K1 + 1)) / (tf + K1 * (F.lit(1 - B) + B * size / mean))


def bm25(fields: DataFrame, terms: Sequence[str], where: Column | None = None, cut: int = PRE_CUT, key: str = "id") -> DataFrame:
    """The best records by BM25 (column lexical), ties by key. ``where`` filters candidates, not statistics."""
    if not terms:
        return fields.where(F.lit(False)).withColumn("lexical", F.lit(0.0))
    held = fields.withColumn("len_", length())
    has = [F.array_contains(F.concat(*WEIGHTS), t) for t in terms]
    # One row: the corpus statistics, in a pass that reads no more than the fields.
    stats = held.agg(F.count("*").alias("n_"), F.sum("len_").alias("sum_"), *(F.count_if(h).alias(f"df_{i}") for i, h in enumerate(has))).head()
    n, total = stats["n_"], stats["sum_"] or 0
    found = held.where(F.arrays_overlap(F.concat(*WEIGHTS), text.strings(terms)))
    if where is not None:
        found = found.where(where)
    mean = F.lit(total / n if n else 1.0)
    parts = [_part(_idf(n, F.lit(float(stats[f"df_{i}"]))), _tf(t), F.col("len_"), mean) for i, t in enumerate(terms)]
    return found.withColumn("lexical", reduce(add, parts)).drop("len_").orderBy(F.desc("lexical"), key).limit(cut)


def bm25_from_postings(posts: DataFrame, sizes: DataFrame, queries: DataFrame, key: str = "id", cut: int = PRE_CUT) -> DataFrame:
    """Many queries at once: queries (qid, term), with a term as often as it counts, to (qid, key, lexical), the best ``cut`` of each, ties to nine digits.

    Postings meet queries by term; scores add up by (qid, key) before anything is ranked.
    """
    size = sizes.agg(F.count("*").alias("n_"), F.avg("len").alias("mean_"))
    asked = queries.groupBy("qid", "term").agg(F.count("*").alias("times_"))
    df = posts.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df_"))
    tf = reduce(add, (F.lit(w) * F.col(f"tf_{c.removesuffix('_terms')}") for c, w in WEIGHTS.items()))
    idf = F.greatest(F.log((F.col("n_") - F.col("df_") + 0.5) / (F.col("df_") + 0.5)), F.lit(LEAST_IDF))
    rows = asked.join(df, "term").join(posts, "term").join(sizes, key).crossJoin(size)
    scored = rows.withColumn("part_", F.col("times_") * _part(idf, tf, F.col("len"), F.col("mean_")))
    sums = scored.groupBy("qid", key).agg(F.sum("part_").alias("lexical"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("lexical", 9)), key))
    return sums.withColumn("rank", rank).where(F.col("rank") <= cut)


def coverage(terms: Sequence[str], present: Column) -> Column:
    """The share of the query's terms among the tokens."""
    return F.size(F.array_intersect(text.strings(terms), present)) / F.lit(len(terms))


def path_boost(terms: Sequence[str], path_terms: Column) -> Column:
    """2 if two successive terms of the query stand side by side in the path, else 1."""
    padded = F.concat(F.lit(" "), F.array_join(path_terms, " "), F.lit(" "))
    hits = [padded.contains(f" {a} {b} ") for a, b in zip(terms, terms[1:], strict=False)]
    return F.when(reduce(Column.__or__, hits), 2.0).otherwise(1.0) if hits else F.lit(1.0)


def rerank(found: DataFrame, terms: Sequence[str], cut: int = CANDIDATES, key: str = "id") -> DataFrame:
    """Lexical scores times path boost and (0.5 + coverage); file, symbol and raw are the covered texts."""
    seen = text.tokens(F.concat_ws(" ", "file", "symbol", "raw"))
    score = F.col("lexical") * path_boost(terms, text.tokens(F.col("file"))) * (F.lit(0.5) + coverage(terms, seen)) if terms else F.lit(0.0)
    return found.withColumns({"score": score, "matched_by": F.lit("bm25")}).orderBy(F.desc("score"), key).limit(cut)


def stems_of(terms: Sequence[str]) -> list[str]:
    """Stems of the query's terms, one for each term: terms with one stem count twice."""
    return [stem(t) for t in terms]
