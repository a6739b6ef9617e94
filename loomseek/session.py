"""What a session needs before it runs this package's Python functions."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def workspace(spark: SparkSession) -> str:
    """The folder that all machines share. Where none is set (as in local tests) a temporary one is made and set."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    folder = tempfile.mkdtemp(prefix="loomseek-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def ship(spark: SparkSession) -> None:
    """Hands the package to the Python workers of this application, once: they need not have it installed.

    The archive is a file of the driver's own, which it serves to every executor, also to those that come later.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    _shipped.add(context.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="loomseek-"), "loomseek.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(path)
