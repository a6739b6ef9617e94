"""The encoder that is there without a model: hashed bags of tokens, of unit length.

Any function from a text column to an array<float> column can take its place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomseek.functions import text

DIMENSIONS = 64


def hashed(value: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed counts of token hashes; a text without tokens gets the first unit vector."""
    hashes = F.transform(text.tokens(value), lambda t: F.xxhash64(t))
    at = F.sequence(F.lit(0), F.lit(dimensions - 1))

    def made(hs: Column) -> Column:
        sign = lambda h: F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        counts = F.transform(at, lambda i: F.aggregate(F.filter(hs, lambda h: F.pmod(h, F.lit(dimensions)) == i), F.lit(0.0), lambda s, h: s + sign(h)))
        return F.get(F.transform(F.array(counts), _unit), F.lit(0))

    return F.get(F.transform(F.array(hashes), made), F.lit(0)).cast("array<float>")


def _unit(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x, i: F.when(size > 0, x / size).otherwise(F.when(i == 0, 1.0).otherwise(0.0)))
