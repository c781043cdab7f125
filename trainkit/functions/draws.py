"""Repeatable draws: md5 of seed and key, so that results survive repartitioning and match in SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """md5 of the parts, joined by ':'; null if a part is null."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = [c.cast("string") for c in cols]
    joined = text[0]
    for t in text[1:]:
        joined = F.concat(joined, F.lit(":"), t)
    return F.md5(joined.cast("binary"))


def coin(p: float, *parts: Column | str | int) -> Column:
    """True with probability p; the comparison of hex digits orders like the numbers."""
    if p >= 1:
        return F.lit(True)
    return F.substring(draw(*parts), 1, 8) < F.lit(f"{int(p * 2**32):08x}")


def below(n: int | Column, *parts: Column | str | int) -> Column:
    """A whole number in [0, n), from the first six hex digits."""
    number = F.conv(F.substring(draw(*parts), 1, 6), 16, 10).cast("long")
    return F.pmod(number, n if isinstance(n, Column) else F.lit(n)).cast("int")


def _unit(digits: Column) -> Column:
    """A number inside (0, 1) from eight hex digits."""
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**32)


def normal(*parts: Column | str | int) -> Column:
    """A standard normal number by Box-Muller, from the first sixteen hex digits of one draw."""
    hashed = draw(*parts)
    return F.sqrt(F.log(_unit(F.substring(hashed, 1, 8))) * -2.0) * F.cos(_unit(F.substring(hashed, 9, 8)) * (2.0 * math.pi))


def normals(size: int | Column, *parts: Column | str | int) -> Column:
    """An array of standard normal numbers, each drawn from the parts and its place; null for a null part, empty for size 0."""
    known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts if isinstance(p, Column)], F.lit(True))
    n = size if isinstance(size, Column) else F.lit(size)
    drawn = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: normal(*parts, i))
    return F.when(known & n.isNotNull(), F.slice(drawn, F.lit(1), F.greatest(n, F.lit(0))))
