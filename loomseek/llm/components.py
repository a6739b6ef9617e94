"""Connected components by contraction, in joins of written tables.

Every round each node points to its smallest neighbour, pointers are followed four steps, and links are moved
to where their ends point; links within one node vanish. Rounds end when no link is left. Nothing but the
question whether links are left reaches the driver, and no round needs a node's links in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseek.llm import common


def _tidy(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of numbers to (node, component): the smallest number that is reachable. Nodes without links are left out."""
    with common.scratch(links.sparkSession) as keep:
        links = keep(common.staged(_tidy(links), "links"))
        found = None
        while not links.isEmpty():
            both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            to = common.staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), "pointers")
            for _ in range(2):
                to = common.staged(_follow(to, to), "pointers")
            found = to if found is None else common.staged(_follow(found, to, missing=True), "components")
            links = common.staged(_tidy(_moved(_moved(links, to, "a"), to, "b")), "links")
        if found is None:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return keep(found).select("node", F.col("to").alias("component"))


def _follow(start: DataFrame, to: DataFrame, missing: bool = False) -> DataFrame:
    """Where the targets of start point; with ``missing``, a target that points nowhere stays."""
    step = to.select(F.col("node").alias("at_"), F.col("to").alias("next_"))
    joined = start.join(step, F.col("to") == F.col("at_"), "left" if missing else "inner")
    return joined.select("node", F.coalesce("next_", "to").alias("to"))


def _moved(links: DataFrame, to: DataFrame, end: str) -> DataFrame:
    step = to.select(F.col("node").alias("at_"), F.col("to").alias("next_"))
    return links.join(step, F.col(end) == F.col("at_")).withColumn(end, F.col("next_")).select("a", "b")
