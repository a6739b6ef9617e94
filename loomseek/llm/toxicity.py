"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs to Latin letters, digits and signs that stand for letters to those
letters; one character stays one) and matched in one pass by an Aho-Corasick automaton. Entries are whole
words or word beginnings with a weight; a word counts its strongest entry, words inside an exception phrase
count nothing. The sum is divided by the text's length in words, and a logistic curve turns it into a score.

The lexicon starts from a few fixed entries and learns the others from labels: words and word beginnings
whose share among toxic documents is clearly above their share among others (a lower confidence bound on the
log ratio). Learning uses at most ``SAMPLE`` labelled rows, those with the smallest hashes of the id, so
the lexicon (at most ``ENTRIES`` entries) and all that reaches the driver have fixed bounds. Scoring covers whole texts
of all documents.

A null or empty text scores like one without any match; null labels teach nothing; an id with several
labels counts as toxic if one says so; a null id is not held out. Without toxic or other labels, the fixed entries
and a fixed curve are used. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.llm import common

#: Most labelled rows to learn from, and most entries to learn.
SAMPLE, ENTRIES = 10_000, 2_000
#: Characters that look like a Latin letter, and signs that are written for one.
HOMOGLYPHS = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еє", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κк", "l": "ⅼ", "m": "м",
    "n": "п", "o": "оοօ", "p": "рρ", "s": "ѕ", "t": "т", "u": "υ", "v": "ν", "w": "ѡω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Fixed entries, with one weight, and phrases in which entries are harmless.
INSULTS = ("idiot", "moron", "stupid", "imbecile", "scum", "loser", "pathetic", "worthless", "disgusting")
INSULT_WEIGHT = 4.0
EXCEPTIONS = ("scum line", "pond scum", "loser bracket", "trash can", "trash bin", "clown fish", "stupid question")
_FOLD = str.maketrans({chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {x: k for k, v in HOMOGLYPHS.items() for x in v} | SIGNS)
_WORD = re.compile(r"[@$]*\w+(?:[@$!|]+\w+)*")
#: Lengths of word beginnings that are tried, the flush of a task's counts, and what an entry must show.
PREFIXES, HELD, LEAST_DOCS, SIGMAS, LEAST_BOUND = (3, 4, 5, 6, 7, 8), 200_000, 3, 3.0, 0.8
#: The share of documents from which on a longer entry explains a shorter one.
SAME = 0.9
#: Words that are added to every length, and the curve used without labels.
SHRINK, CURVE = 20, (-3.0, 2.0)


@dataclass(frozen=True)
class Model:
    """entries: (text, whole word?) to weight; curve: intercept and slope."""

    entries: dict[tuple[str, bool], float]
    curve: tuple[float, float] = CURVE
    exceptions: tuple[str, ...] = EXCEPTIONS


def fold(text: str) -> str:
    """The folded text; every character stays at its place."""
    low = text.lower()
    return (low if len(low) == len(text) else "".join(c.lower()[0] for c in text)).translate(_FOLD)


def automaton(model: Model) -> ahocorasick.Automaton:
    values: dict[str, list] = defaultdict(list)
    for (word, whole), weight in model.entries.items():
        values[word].append((weight, whole))
    for phrase in model.exceptions:
        values[fold(phrase)].append((None, True))
    out = ahocorasick.Automaton()
    for word, found in values.items():
        out.add_word(word, (len(word), tuple(found)))
    if values:
        out.make_automaton()
    return out


def rate(text: str | None, ac: ahocorasick.Automaton) -> float:
    """Weights of the matched words for each word of the text."""
    if not text:
        return 0.0
    folded = fold(text)
    best: dict[int, tuple[float, int]] = {}
    spared: list[tuple[int, int]] = []
    if len(ac):
        for end, (n, found) in ac.iter(folded):
            start = end + 1 - n
            if start and text[start - 1].isalnum():
                continue
            closed = end + 1 == len(text) or not text[end + 1].isalnum()
            for weight, whole in found:
                if whole and not closed:
                    continue
                if weight is None:
                    spared.append((start, end))
                elif weight > best.get(start, (-math.inf, 0))[0]:
                    best[start] = weight, end
    total = sum(w for s, (w, e) in best.items() if not any(a <= s and e <= b for a, b in spared))
    return total / (len(text.split()) + SHRINK)


def curve_score(x: float, curve: tuple[float, float]) -> float:
    z = curve[0] + curve[1] * math.log1p(1000 * max(x, 0.0))
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(doc_id):
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % 5) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled ids that are not held out, with texts (text, toxic)."""
    known = labels.select(labels["doc_id"].cast("long").alias("id_"), labels["toxic"].cast("int").alias("toxic_")).where("id_ IS NOT NULL AND toxic_ IS NOT NULL")
    chosen = known.where(~held_out(F.col("id_"))).groupBy("id_").agg(F.max("toxic_").alias("toxic_")).orderBy(F.xxhash64("id_"), "id_").limit(sample)
    # At most ``sample`` rows of two numbers: this bound is what makes the broadcast safe.
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id_"))
    return common.staged(rows.select("text", (F.col("toxic_") > 0).alias("toxic")), "toxicity-sample")


def features(text: str) -> set[tuple[str, bool]]:
    """Whole words and word beginnings of the folded text."""
    out = set()
    for w in {fold(x) for x in _WORD.findall(text)}:
        if len(w) >= 3 and not w.isdigit():
            out.add((w, True))
            out.update((w[:k], False) for k in PREFIXES if k <= len(w))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label by feature, summed up in this task as far as memory allows."""
    held = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        keys = sorted({*held[0], *held[1]})
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys]), *(pa.array([h[k] for k in keys], pa.int64()) for h in (held[1], held[0]))], names=["word", "whole", "pos", "neg"])
        for h in held:
            h.clear()
        return out

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[toxic].update([("", True), *features(text or "")])
            if len(held[0]) + len(held[1]) > HELD:
                yield flush()
    yield flush()


def learn_entries(sample: DataFrame, most: int = ENTRIES) -> dict[tuple[str, bool], float]:
    counts = sample.mapInArrow(_count, "word string, whole boolean, pos long, neg long").groupBy("word", "whole").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = common.staged(counts.where(f"pos >= {LEAST_DOCS} OR word = ''"), "toxicity-counts")
    size = counts.where("word = ''").head()
    if not size or not size["pos"] or not size["neg"]:
        return {}
    ratio = F.log((F.col("pos") + 0.5) / (size["pos"] + 1)) - F.log((F.col("neg") + 0.5) / (size["neg"] + 1))
    spread = F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = counts.where("word <> ''").withColumns({"weight": ratio, "bound": ratio - SIGMAS * spread}).where(F.col("bound") > LEAST_BOUND).orderBy(F.desc("bound"), "word", "whole").limit(most).collect()
    found = {(r["word"], r["whole"]): (r["weight"], r["pos"]) for r in best}
    # A beginning that one longer entry explains gives way to it: it would only match more words.
    longer: Counter = Counter()
    for (w, whole), (_, pos) in found.items():
        for k in PREFIXES:
            if k < len(w) + whole:
                longer[w[:k]] = max(longer[w[:k]], pos)
    found = {(w, whole): v for (w, whole), v in found.items() if whole or longer[w] < SAME * v[1]}
    # And an entry adds nothing beside a beginning of it that weighs about as much.
    beginnings = {w: x for (w, whole), (x, _) in found.items() if not whole}
    return {(w, whole): x for (w, whole), (x, _) in found.items() if not any(beginnings.get(w[:k], -1) >= x - 0.3 for k in PREFIXES if k < len(w) + whole)}


def fit_curve(rates: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic regression of one variable by Newton steps, halved until they gain; a ridge holds separable samples."""
    x = np.column_stack([np.ones(len(rates)), np.log1p(1000 * np.maximum(rates, 0))])
    ridge = np.array([0.01, 0.1])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float(np.sum(np.logaddexp(0, z) - toxic * z) + ridge @ beta**2 / 2)

    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, x.T @ (toxic - p) - ridge * beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return float(round(beta[0], 6)), float(round(beta[1], 6))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and curve from the labels that are not held out."""
    common.small_batches(docs.sparkSession)
    with common.scratch(docs.sparkSession):
        rows = training_rows(docs, labels, sample)
        fixed = {(w, True): INSULT_WEIGHT for w in INSULTS}
        learned = learn_entries(rows)
        if not learned:
            return Model(fixed)
        model = Model(fixed | learned)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ac = automaton(model)
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([rate(t, ac) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["rate", "toxic"])

        pairs = sorted((r["rate"], r["toxic"]) for r in rows.mapInArrow(measure, "rate double, toxic boolean").collect())
        curve = fit_curve(np.array([p[0] for p in pairs]), np.array([float(p[1]) for p in pairs]))
        return Model(model.entries, curve if curve[1] > 0 else CURVE)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the columns held_out, score and predicted (the input's columns of these names are replaced)."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ac = automaton(model)
        for texts in batches:
            yield texts.map(lambda t: curve_score(rate(t, ac), model.curve)).astype("float64")

    value = F.coalesce(scored(F.coalesce(docs["text"].cast("string"), F.lit(""))), F.lit(0.0))
    return docs.withColumns({"held_out": held_out(docs["doc_id"]), "score": value}).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op7(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs, common.table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def keep_clean(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go."""
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    names = docs.columns
    safe = docs.toDF(*(f"c{i}_" for i in range(len(names))))
    where = {n: f"c{i}_" for i, n in enumerate(names)}
    kept = score(safe.withColumns({n: F.col(where[n]) for n in ("doc_id", "text")}), model).where("predicted = 0")
    return kept.select(*(F.col(where[n]).alias(n) for n in names))
