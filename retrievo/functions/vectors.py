"""Vector functions over array columns, summed in order in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; the zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l1(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def product(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def max_sim(a: Column, b: Column) -> Column:
    """Mean over the vectors of a of the best dot product with a vector of b."""
    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: dot(x, y))))
    return _fold(best) / F.size(a)


def sinusoid(position: Column, dim: int = 32) -> Column:
    """Sine and cosine of position * pi / 10000^(2 i / dim), interleaved."""
    parts = []
    for i in range(dim // 2):
        angle = position * F.lit(math.pi / 10000 ** (2 * i / dim))
        parts += [F.sin(angle), F.cos(angle)]
    return F.array(*parts)


def hash_vector(name: Column, dim: int, seed: int = 42) -> Column:
    """A unit vector that depends on the name alone: Box-Muller over seeded hashes."""
    def uniform(i: int, part: int) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), name, F.lit(f"{i}/{part}")), 256)
        return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)

    return unit(F.array(*[F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1)) for i in range(dim)]))
