"""Source trees as a table: path, content. Names that begin with a dot or an underscore are read like any other.

The listing happens on the driver (by git where the root is a checkout, else by a walk); the files are read by
the executors, so the root has to be on a file system that they share.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomseek import session
from loomseek.operators import discovery

#: The default name of a tree's file of ignored globs.
IGNORE_FILE = ".loomseekignore"
#: Files of one task.
CHUNK = 500


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, paths: list[str]) -> None:
        self.root, self.paths = root, paths

    def partitions(self) -> list[_Files]:
        return [_Files(self.paths[i : i + CHUNK]) for i in range(0, len(self.paths), CHUNK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple[str, bytes]]:
        for p in partition.paths:
            try:
                full = os.path.join(self.root, p)
                if os.path.islink(full) or not os.path.isfile(full) or os.path.getsize(full) > discovery.MAX_BYTES:
                    continue
                with open(full, "rb") as f:
                    yield p, f.read()
            except FileNotFoundError:
                continue  # it went since it was listed


class TreeSource(DataSource):
    """Format ``source_tree``; options root and paths (line ends between them)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["root"], [p for p in self.options.get("paths", "").split("\n") if p])


def confined(root: str | Path, value: str) -> str:
    """The path below root that value names, in POSIX form; raises ValueError outside of it."""
    base = Path(root).resolve()
    found = (base / value).resolve()
    if found != base and base not in found.parents:
        raise ValueError(f"{value} is outside of the root")
    return found.relative_to(base).as_posix()


def ignore_patterns(root: str | Path, name: str = IGNORE_FILE) -> list[str]:
    try:
        lines = (Path(root) / name).read_text().splitlines()
    except FileNotFoundError:
        return []
    return [x.strip() for x in lines if x.strip() and not x.strip().startswith("#")]


def _below(folder: str) -> Iterator[str]:
    """Files under a folder, relative to it; skipped directories and links to directories are not entered."""
    open_ = [""]
    while open_:
        at = open_.pop()
        with os.scandir(os.path.join(folder, at)) as found:
            for e in found:
                path = f"{at}/{e.name}" if at else e.name
                if not e.is_dir():
                    yield path
                elif e.name not in discovery.SKIP_DIRS and not e.is_symlink():
                    open_.append(path)


def _walked(base: Path, start: str) -> Iterator[str]:
    at = base / start
    place = at.relative_to(base).as_posix()
    if at.is_file():
        yield place
    elif at.is_dir() and not at.is_symlink():
        yield from (p if place == "." else f"{place}/{p}" for p in _below(str(at)))


def listed(root: str | Path, only: Sequence[str] | None = None) -> list[str]:
    """Paths of the tree in code point order: what git tracks or would track, else every file not below a skipped directory."""
    base = Path(root).resolve()
    specs = [f":(literal){p}" for p in only or []]
    git = subprocess.run(["git", "-C", str(base), "ls-files", "-z", "--cached", "--others", "--exclude-standard", "--", *specs], capture_output=True)
    found = git.stdout.decode("utf-8", "surrogateescape").split("\0") if git.returncode == 0 else chain.from_iterable(_walked(base, p) for p in only or ["."])
    return sorted(set(found) - {""})


def files(spark: SparkSession, root: str | Path, only: Sequence[str] | None = None, ignore_file: str = IGNORE_FILE) -> DataFrame:
    """The searchable files of a tree: path, text, digest."""
    session.ship(spark)
    spark.dataSource.register(TreeSource)
    paths = [p for p in listed(root, only) if "\n" not in p]
    raw = spark.read.format("source_tree").option("root", str(Path(root).resolve())).option("paths", "\n".join(paths)).load()
    kept = raw.where(discovery.admissible(F.col("path"), F.length("content")) & ~discovery.ignored(F.col("path"), ignore_patterns(root, ignore_file)) & (F.col("path") != ignore_file) & discovery.textual(F.col("content")))
    return kept.select("path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("digest"))


def cache_dir(home: str, root: str | Path) -> str:
    """The folder of a root's snapshots below home."""
    return f"{home.rstrip('/')}/{hashlib.sha256(os.path.normcase(str(Path(root).resolve())).encode()).hexdigest()[:24]}"


#: Limits of a diff: names, lines around a change, characters.
DIFF_NAMES, DIFF_LINES, DIFF_CHARS = 20, 3, 16_000


def git_diff(root: str | Path, indexed: DataFrame) -> dict:
    """The bounded diff of changed files that are indexed; a request's context, not a table."""
    base = str(Path(root).resolve())
    run = lambda *a: subprocess.run(["git", "-C", base, *a], capture_output=True, text=True, errors="replace")
    against = ["HEAD"] if run("rev-parse", "--verify", "HEAD").returncode == 0 else ["--cached"]
    names = [n for n in run("diff", "--name-only", "-z", *against).stdout.split("\0") if n]
    known = {r["path"] for r in indexed.where(F.col("path").isin(names)).select("path").collect()} if names else set()
    kept = [n for n in names if n in known][:DIFF_NAMES]
    text = run("diff", f"-U{DIFF_LINES}", *against, "--", *kept).stdout if kept else ""
    return {"files": kept, "diff": text[:DIFF_CHARS], "truncated": len(text) > DIFF_CHARS or len(kept) < len([n for n in names if n in known])}
