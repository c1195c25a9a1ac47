"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def hash_embedding(text: Column, dim: int = 1024) -> Column:
    """Deterministic vector in [-1, 1] from the SHA-512 of the text: value i is the big-endian
    16-bit number at byte 2i mod 64."""
    digest = F.sha2(text, 512)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.conv(F.substring(digest, ((2 * i) % 64) * 2 + 1, F.lit(4)), 16, 10).cast("double")
        / 65535.0
        * 2.0
        - 1.0,
    )
