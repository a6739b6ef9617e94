"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings.

Base kinds are ``assign``, ``access`` and ``hex`` (see PATTERNS). Besides, every run of 20 or more characters of a
character class is a candidate: a window of fixed width slides over it, the Shannon entropy of the window's
characters is kept by incremental counts (one character leaves and one enters), and windows at or above the
class's threshold are joined to one span of the kind ``entropy_<class>``. Runs that an allow-list pattern
matches give no entropy span; base spans are never suppressed.

Offsets count code points, ends are exclusive. A null text is empty and gives no spans. Texts are scanned
whole; a task holds one Arrow batch of them. Null ids and repeated rows are scanned row by row, an empty table gives no rows, spans
that start together stand in the order of kinds, and other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomseek.llm import common

#: Fixed patterns: the contract's.
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
}
#: An assignment has one of these in it, in either case.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: By class: its runs, the window's width, and the least entropy in bits of a window.
CLASSES = {
    "hex": (re.compile(r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_=-])"), 20, 3.0),
    "base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.7),
}
#: Runs that only look random: UUIDs, plain words, numbers, rulers, and words joined by - _ or /.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z"),
    re.compile(r"[A-Za-z]?[a-z]+\Z|[A-Z]+\Z|\d+\Z|[=_+/-]+\Z"),
    re.compile(r"[A-Za-z]{1,15}([_/=+-]+[A-Za-z]{1,15})+[_/=-]*\Z"),
)
RANK = {k: i for i, k in enumerate((*PATTERNS, *(f"entropy_{c}" for c in CLASSES)))}


def window_entropies(run: str, width: int) -> Iterator[float]:
    """Entropy in bits of each window of ``width`` characters, from left to right."""
    bits = [0.0, *(n * math.log2(n) for n in range(1, width + 1))]
    counts: dict[str, int] = {}
    total = 0.0  # the sum of n log n over the counts
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += bits[n + 1] - bits[n]
        if i >= width:
            old = run[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += bits[n - 1] - bits[n]
        if i >= width - 1:
            yield math.log2(width) - total / width


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, by start and then by kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), "assign") for m in PATTERNS["assign"].finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in PATTERNS["access"].finditer(text) if m.end() - m.start() >= 16]
    out += [(*m.span(), "hex") for m in PATTERNS["hex"].finditer(text)]
    return sorted(out, key=lambda s: (s[0], RANK[s[2]]))


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """Joined windows of high entropy in runs that are not allowed."""
    out, hexes = [], set()
    for name, (runs, width, least) in CLASSES.items():
        for m in runs.finditer(text):
            run = m[0]
            if name == "hex":
                hexes.add(m.span())
            elif m.span() in hexes:
                continue
            if any(p.match(run) for p in ALLOWED):
                continue
            start = end = -1
            for i, e in enumerate(window_entropies(run, width)):
                if e < least:
                    continue
                if start >= 0 and i > end:
                    out.append((m.start() + start, m.start() + end, f"entropy_{name}"))
                    start = -1
                start, end = (i if start < 0 else start), i + width
            if start >= 0:
                out.append((m.start() + start, m.start() + end, f"entropy_{name}"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    every = sorted(base + entropy_spans(text), key=lambda s: (s[0], RANK[s[2]]))
    n = {k: sum(1 for s in base if s[2] == k) for k in PATTERNS}
    return n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)


def _scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    for b in batches:
        found = [scan(t) for t in b.column(1).to_pylist()]
        cols = list(zip(*found, strict=True)) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=names)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: how many spans of each base kind, their digest, and all spans."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_scan_all, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op8(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    common.small_batches(spark)
    return find_secrets(common.table(spark, sf_dir, "documents"))
