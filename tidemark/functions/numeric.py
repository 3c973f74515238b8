"""Columns of the pixel arithmetic. Storage is float, arithmetic double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(value: Column, nodata: float | None = None, tolerance: float = 0.0) -> Column:
    """value, or NULL where it is NaN or the sentinel (within a tolerance)."""
    out = F.when(~F.isnan(value), value)
    if nodata is None:
        return out
    return F.when(F.abs(out - nodata) > tolerance, out) if tolerance else F.when(out != nodata, out)


def negated(db: Column) -> Column:
    return -db.cast("float")


def masked(x: Column, ceiling: float = 30.0) -> Column:
    """x up to the ceiling and on it; NULL above."""
    return F.when(x <= ceiling, x)


def plotting_position(k: Column, n: Column) -> Column:
    return (k / (n + 1)).cast("float")


def gumbel(f: Column, clip: float = 0.0) -> Column:
    """-ln(-ln f) for 0 < f < 1, NULL outside; with clip, f is first drawn into [clip, 1 - clip]."""
    f = f.cast("double")
    if clip:
        f = F.least(F.greatest(f, F.lit(clip)), F.lit(1 - clip))
    return F.when((f > 0) & (f < 1), -F.log(-F.log(f)))


def tcev(x: Column, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Two-component extreme value distribution; NULL if any input is."""
    return F.exp(-F.exp(-a1 * (x - b1))) * F.exp(-F.exp(-a2 * (x - b2)))


def pixel_index(value: Column, origin: Column, step: Column) -> Column:
    """Place on an axis, cut toward zero."""
    return F.try_divide(value - origin, step).cast("long")


def snapped(value: Column, origin: Column, step: Column) -> Column:
    return origin + F.rint(F.try_divide(value - origin, step)) * step


def pixel_size(metres: Column, geographic: Column) -> Column:
    """Metres in units of the reference system: degrees of 111,320 m in a geographic one."""
    return F.when(geographic, metres / 111320.0).otherwise(metres)


def resampled(values: Column, length: int) -> Column:
    """length items: evenly chosen (half-even) if there are as many, else the array with zeros after it."""
    n = F.size(values)
    place = lambda i: F.rint(i * (n - 1) / (length - 1) if length > 1 else i * 0.0).cast("int")
    zero = F.lit(0.0)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(n >= length, F.try_element_at(values, place(i) + 1)).otherwise(F.coalesce(F.try_element_at(values, i + 1), zero)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
