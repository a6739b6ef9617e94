"""Files to bounded records: Python declarations by the standard library's parser, everything else as text windows."""

from __future__ import annotations

import ast
import tokenize
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomseek import session
from loomseek.functions import text

#: Bounds of a record, suffixes of prose, and kinds that are not declarations.
MAX_CHARS, MAX_LINES = 1800, 40
PROSE = (".md", ".mdx", ".rst", ".txt", ".adoc")
LOOSE_KINDS = ("window", "document", "statement")
PARSED = "file string, symbol string, qualified_symbol string, kind string, declaration_start int, body_start int, body_end int, start int, end int, raw string, extractor string, record_ord int, piece_ord int, error string"


def bounded(body: str, first: int = 1) -> list[tuple[int, int, str]]:
    """(start line, end line, text) of the pieces: at most MAX_CHARS characters and MAX_LINES lines each; longer lines are cut.

    Lines are cut first. Of the sums of their lengths, two binary searches give the end of each piece.
    """
    cuts = [(number, line[i : i + MAX_CHARS]) for number, line in enumerate(body.splitlines(keepends=True), first) for i in range(0, len(line), MAX_CHARS)]
    numbers, ends = [n for n, _ in cuts], [0, *accumulate(len(c) for _, c in cuts)]
    borders = [0]
    while borders[-1] < len(cuts):
        at = borders[-1]
        fits = bisect_right(ends, ends[at] + MAX_CHARS) - 1
        borders.append(max(at + 1, min(fits, bisect_left(numbers, numbers[at] + MAX_LINES))))
    out = [(numbers[i], numbers[j - 1], "".join(c for _, c in cuts[i:j]).rstrip()) for i, j in pairwise(borders)]
    return out if not out or out[-1][2] else out[:-1]


class _Declarations(ast.NodeVisitor):
    """Records of a module's own statements and of those of its classes; no other statement is looked into."""

    def __init__(self, source: str) -> None:
        body = ast.parse(source).body
        self.lines, self.names, self.found = text.parser_lines(source), [], []
        plain = iter([line.rstrip("\r\n") + "\n" for line in self.lines])
        tokens = tokenize.generate_tokens(lambda: next(plain, ""))
        self.remarks = {t.start[0] for t in tokens if t.type == tokenize.COMMENT and t.line[: t.start[1]].isspace() | (t.start[1] == 0)}
        self.visit_body(body)

    def visit_body(self, nodes: list[ast.stmt]) -> None:
        for node in nodes:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Assign, ast.AnnAssign)):
                self.visit(node)

    def top(self, node: ast.stmt, above: int = 0) -> int:
        """The first line of a statement with its decorators and the remarks right before it, but none up to the line ``above``."""
        line = min(x.lineno for x in (node, *getattr(node, "decorator_list", ())))
        return next((n + 1 for n in range(line - 1, above, -1) if n not in self.remarks), above + 1 if line > above + 1 else line)

    def record(self, node: ast.stmt, name: str, kind: str, last: int, body: bool = False) -> None:
        start = self.top(node)
        if start <= last:
            spans = {"declaration_start": node.lineno, "body_start": node.lineno if body else None, "body_end": node.end_lineno if body else None, "start": start}
            self.found.append({"symbol": name, "qualified_symbol": ".".join([*self.names, name]), "kind": kind, **spans, "text": "".join(self.lines[start - 1 : last])})

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.record(node, node.name, "method" if self.names else "function", node.end_lineno, body=True)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.record(node, node.name, "class", self.top(node.body[0], node.lineno) - 1)
        self.names.append(node.name)
        self.visit_body(node.body)
        self.names.pop()

    def visit_Assign(self, node: ast.Assign) -> None:
        self.record(node, ast.unparse(node.targets[0]), "variable", node.end_lineno)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.record(node, ast.unparse(node.target), "variable", node.end_lineno)


def python_declarations(source: str) -> list[dict]:
    """Module and class level functions, methods, class headers and assignments; raises SyntaxError."""
    return _Declarations(source).found


#: A parser gives the records of a source text, as python_declarations does; an empty list falls back to windows.
Parser = Callable[[str], list[dict]]
PARSERS: dict[str, tuple[str, Parser]] = {".py": ("python-ast", python_declarations)}


def file_records(path: str, source: str, parsers: dict[str, tuple[str, Parser]] | None = None) -> list[dict]:
    """The records of one file, before they are bounded. ``parsers`` has (extractor, parser) by lower-case suffix."""
    name = path.rsplit("/", 1)[-1]
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    extractor, parser = (PARSERS | (parsers or {})).get(suffix, (None, None))
    if parser and (found := parser(source)):
        return [r | {"extractor": extractor} for r in found]
    kind = "document" if suffix in PROSE else "window"
    return [{"symbol": "file", "qualified_symbol": "file", "kind": kind, "declaration_start": 1, "body_start": None, "body_end": None, "start": 1, "text": source, "extractor": "text"}]


def _parse(parsers: dict[str, tuple[str, Parser]] | None):
    names = [f.strip().split()[0] for f in PARSED.split(",")]
    kinds = [pa.int32() if f.strip().split()[1] == "int" else pa.string() for f in PARSED.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for i, r in enumerate(file_records(path or "", source or "", parsers)):
                        for k, (start, end, raw) in enumerate(bounded(r["text"], r["start"])):
                            rows.append((path, r["symbol"], r["qualified_symbol"], r["kind"], r["declaration_start"], r["body_start"], r["body_end"], start, end, raw, r["extractor"], i, k, None))
                except (SyntaxError, ValueError, tokenize.TokenError) as error:
                    rows.append((path, *[None] * 12, f"{type(error).__name__}: {error}"))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def parse(files: DataFrame, parsers: dict[str, tuple[str, Parser]] | None = None) -> DataFrame:
    """files (path, text) to bounded records; a file that cannot be parsed gives one row whose ``error`` is set."""
    session.ship(files.sparkSession)
    rows = files.select(files["path"], files["text"]).mapInArrow(_parse(parsers), PARSED)
    return rows.withColumn("content_hash", F.when(F.col("error").isNull(), text.content_hash(F.col("file"), F.col("qualified_symbol"), F.col("raw"))))


def with_ids(records: DataFrame) -> DataFrame:
    """Record ids that grow in the order of path, record and piece. They leave gaps, since every range numbers its own rows."""
    session.ship(records.sparkSession)
    ordered = records.repartitionByRange("file", "record_ord", "piece_ord").sortWithinPartitions("file", "record_ord", "piece_ord")
    return ordered.withColumn("id", F.monotonically_increasing_id())


def posting_fields(records: DataFrame, file: Column, symbol: Column, body: Column) -> DataFrame:
    """Adds the token arrays of the three weighted fields."""
    return records.withColumns({"path_terms": text.tokens(file), "symbol_terms": text.tokens(symbol), "body_terms": text.tokens(body)})
