"""Parts of DuckDB SQL that several queries share."""

from __future__ import annotations

from loomseek.functions.text import CASEFOLDS


def tok(x: str) -> str:
    """The tokens of a text expression."""
    spaced = rf"regexp_replace(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    out = f"lower({spaced})"
    for a, b in CASEFOLDS:
        out = f"replace({out}, '{a}', '{b}')"
    return rf"regexp_extract_all({out}, '[\p{{L}}\p{{N}}]+')"


def strings(values: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def split_lines(x: str) -> str:
    parts = rf"regexp_split_to_array(coalesce({x}, ''), '\r\n|[\n\r\x0B\f\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"list_transform([{parts}], lambda p: CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END)[1]"


#: Documents as files and as records: what the queries below search.
FILES = "files AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.src' AS path, text, sha256(text) AS digest FROM documents)"
RECORDS = """rec AS (
  SELECT doc_id AS id, source || '/' || lang || '/' || doc_id || '.src' AS file, source AS symbol, source || '.' || lang AS qualified_symbol,
    CASE lang WHEN 'en' THEN 'function' WHEN 'fr' THEN 'class' WHEN 'es' THEN 'document' ELSE 'window' END AS kind,
    CAST(1 AS INTEGER) AS start, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 1 END AS body_start, text AS raw FROM documents)"""
FIELDS = f"f AS (SELECT *, {tok('file')} AS pt, {tok('qualified_symbol')} AS st, {tok('raw')} AS bt FROM rec)"


def bm25(terms: list[str], where: str = "true", cut: int = 150) -> str:
    """CTEs ending in ``best``: the fields with a column lexical, cut by score and id."""
    tf = lambda t: f"(3.0 * len(list_filter(pt, lambda x: x = '{t}')) + 5.0 * len(list_filter(st, lambda x: x = '{t}')) + 1.0 * len(list_filter(bt, lambda x: x = '{t}')))"
    idf = lambda i: f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6)"
    has = lambda t: f"(list_contains(pt, '{t}') OR list_contains(st, '{t}') OR list_contains(bt, '{t}'))"
    dfs = ", ".join(f"count(*) FILTER ({has(t)}) AS df{i}" for i, t in enumerate(terms))
    parts = " + ".join(f"{idf(i)} * ({tf(t)} * 2.2) / ({tf(t)} + 1.2 * (0.25 + 0.75 * d / mean))" for i, t in enumerate(terms))
    any_ = " OR ".join(has(t) for t in terms)
    return f"""{RECORDS}, {FIELDS},
l AS (SELECT *, len(pt) + len(st) + len(bt) AS d FROM f),
stats AS (SELECT count(*) AS n, CAST(sum(d) AS DOUBLE) / count(*) AS mean, {dfs} FROM l),
best AS (SELECT l.*, {parts} AS lexical FROM l, stats WHERE ({any_}) AND ({where}) ORDER BY lexical DESC, id LIMIT {cut})"""


def coverage(terms: list[str], present: str) -> str:
    return f"len(list_intersect({strings(terms)}, {present})) / CAST({len(terms)} AS DOUBLE)"


def boost(terms: list[str], path_terms: str) -> str:
    tests = " OR ".join(f"contains(' ' || array_to_string({path_terms}, ' ') || ' ', ' {a} {b} ')" for a, b in zip(terms, terms[1:], strict=False))
    return f"CASE WHEN {tests} THEN 2.0 ELSE 1.0 END"
