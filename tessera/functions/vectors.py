"""Column builders for fixed-width vectors: norms, products, rotations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-8


def once(x: Column | str, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once a row: what stands inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products; null if either is null."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(x: Column | str) -> Column:
    return F.sqrt(dot(x, x))


def unit(x: Column | str) -> Column:
    """x over its length, which counts as 1e-8 at least."""
    return once(x, lambda y: once(F.greatest(norm(y), F.lit(FLOOR)), lambda n: F.transform(y, lambda v: v / n)))


def shares(x: Column) -> Column:
    """x over its sum, which counts as 1e-8 at least."""
    return once(x, lambda y: once(F.greatest(total(y), F.lit(FLOOR)), lambda n: F.transform(y, lambda v: v / n)))


def rotate(x: Column | str, by: int, width: int = 12) -> Column:
    """Element i goes to (i + by) mod width, in every block of `width` elements."""
    x = F.col(x) if isinstance(x, str) else x
    by %= width
    return F.transform(x, lambda _, i: F.get(x, (i - i % width) + (i % width + (width - by)) % width))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
