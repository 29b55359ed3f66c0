"""Column builders for sample arrays: cut, pad, frame numbers, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_length(x: Column | str, n: Column | int) -> Column:
    """Exactly n elements: cut, or filled with zeros behind."""
    x = F.col(x) if isinstance(x, str) else x
    n = F.lit(n) if isinstance(n, int) else n
    zeros = F.array_repeat(F.lit(0.0), n.cast("int"))
    return F.slice(F.concat(x.cast("array<double>"), zeros), F.lit(1), n.cast("int"))


def window_at(x: Column | str, start: Column, n: int) -> Column:
    """n elements from place `start` (from 0) on, zeros beyond the end; null where nothing is left."""
    x = F.col(x) if isinstance(x, str) else x
    part = F.slice(x, F.greatest(start, F.lit(0)).cast("int") + 1, F.lit(n))
    return F.when((start < F.size(x)) & (F.size(part) > 0), fit_length(part, n))


def frame_of(start_s: Column, sr: int, hop: int, n: Column) -> Column:
    """Frame of a time: rounded half to even, from 0 to n - 1."""
    return F.least(F.greatest(F.rint(start_s * sr / hop).cast("long"), F.lit(0)), n - 1)


def clock(seconds: Column) -> Column:
    """m:ss"""
    s = F.floor(seconds)
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def clock_hundredths(seconds: Column) -> Column:
    """m:ss.cc"""
    c = F.floor(seconds * 100 + 0.5)
    return F.concat(F.floor(c / 6000).cast("string"), F.lit(":"), F.lpad((F.floor(c / 100) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def brightness(score: Column) -> Column:
    return 0.42 + 0.58 * F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
