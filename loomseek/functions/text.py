"""Text expressions: tokens, lines, hashes, previews. All of them stay in the JVM.

A query's terms are computed on the driver by ``words`` and ``query_terms``, which agree with the columns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry nothing in a query.
STOP_WORDS = tuple(
    "a an the i we you how where what which is are was be to from in of for "
    "and or with do does can my our it this that find way code please".split()
)
#: What the casefold of frequent letters has beyond their lower case.
CASEFOLDS = (("ß", "ss"), ("ς", "σ"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ŉ", "ʼn"), ("ſ", "s"), ("µ", "μ"))
TOKEN = r"[\p{L}\p{N}]+"
LINE_END = r"\r\n|[\n\r\x0B\f\x1c\x1d\x1e\x85  ]"
BLANKS_AT_END = r"(?U)[\s\x1c-\x1f]+\z"


def camel_split(text: Column) -> Column:
    """Sets ``HTTPServer`` and ``fooBar`` apart at the borders of their words."""
    return F.regexp_replace(F.regexp_replace(text, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")


def casefold(text: Column) -> Column:
    out = F.lower(text)
    for a, b in CASEFOLDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def tokens(text: Column) -> Column:
    """Runs of letters and digits, camel case split, casefolded; null gives no tokens."""
    return F.coalesce(F.regexp_extract_all(casefold(camel_split(text)), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def words(text: str) -> list[str]:
    """The tokens of a text on the driver."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", text))
    out, run = [], []
    for c in [*spaced.casefold(), " "]:
        if unicodedata.category(c)[0] in "LN":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out


def parser_lines(source: str) -> list[str]:
    """The lines of a source text with their ends, as Python's parser counts them: only CR, LF and CR LF end a line."""
    return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", source)


def query_terms(text: str) -> list[str]:
    """Distinct tokens in order, without stop words."""
    return [w for w in dict.fromkeys(words(text)) if w not in STOP_WORDS]


def strings(values: Sequence[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a final line end opens no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS_AT_END, "")


def content_hash(file: Column, symbol: Column, raw: Column) -> Column:
    """The identity of a record's content: path, qualified symbol and text."""
    none = F.lit("")
    return F.sha2(F.concat_ws("\n", F.coalesce(file, none), F.coalesce(symbol, none), F.coalesce(raw, none)), 256)


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def preview(raw: Column, start: Column, terms: Sequence[str], lead: int = 3, height: int = 12) -> Column:
    """struct(preview_start, preview): a window of lines that begins a little above the line with most of the terms."""
    wanted = strings(terms)

    def cut(ls: Column) -> Column:
        hits = F.transform(ls, lambda line: F.size(F.array_intersect(tokens(line), wanted)))
        best = F.coalesce(F.array_position(hits, F.array_max(hits)), F.lit(1)).cast("int")
        offset = F.greatest(F.lit(0), best - 1 - lead)
        return F.struct((start + offset).cast("int").alias("preview_start"), F.array_join(F.slice(ls, offset + 1, F.lit(height)), "\n").alias("preview"))

    return F.get(F.transform(F.array(lines(raw)), cut), F.lit(0))
