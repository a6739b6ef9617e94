"""Which files belong to a source tree: predicates on paths and contents."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories and names that are never searched, and the largest file in bytes.
SKIP_DIRS = ("node_modules", ".git", ".hg", ".svn", ".index", ".venv", "venv", "__pycache__", "dist", "build", "coverage", "vendor", ".pytest_cache")
SKIP_NAMES = (".gitignore", ".loomseekignore", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "Cargo.lock")
MAX_BYTES = 2_000_000


def admissible(path: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """No skipped directory or name, no environment or key file, not too large."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    env = F.exists(parts, lambda p: p.startswith(".env"))
    return ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIP_DIRS))) & ~name.isin(*SKIP_NAMES) & ~env & ~F.lower(name).rlike(r"\.(pem|key)$") & (size <= most)


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """A glob matches the path or its last part, or the path lies under it; ``*`` crosses slashes, case counts."""
    out = F.lit(False)
    for p in patterns:
        glob = fnmatch.translate(p).replace(r"\Z", r"\z")
        name = F.element_at(F.split(path, "/"), -1)
        out = out | path.rlike(f"^{glob}") | name.rlike(f"^{glob}") | path.startswith(p.rstrip("/") + "/")
    return out


def textual(content: Column) -> Column:
    """Valid UTF-8 without NUL, and at most one control byte in a hundred besides tab and line ends."""
    decoded = content.cast("string")
    controls = F.length(F.regexp_replace(decoded, r"[^\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return F.is_valid_utf8(decoded) & ~decoded.contains("\x00") & (controls * 100 <= F.length(content))
