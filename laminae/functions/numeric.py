"""Column helpers with the pipelines' exact rounding, median and quantisation rules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_median(values: str | Column) -> Column:
    """The element at index n div 2 of the sorted values, not a mean of two."""
    ordered = F.sort_array(F.collect_list(values))
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def trunc_int(value: Column) -> Column:
    """Float to integer, toward zero."""
    return value.cast("bigint")


def half_even(value: Column) -> Column:
    return F.rint(value)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def narrow(value: Column, low: int, high: int) -> Column:
    """Rounds half away from zero and clamps to an integer type's range."""
    return clamp(F.round(value), low, high).cast("int")


def wrap_difference(a: Column) -> Column:
    """Circular difference in turns, in [-0.5, 0.5)."""
    return F.pmod(a + 0.5, F.lit(1.0)) - 0.5


def encode_share(a: Column) -> Column:
    """A share in [0, 1] as an unsigned byte, half to even."""
    return half_even(clamp(a, 0.0, 1.0) * 255).cast("int")


def decode_share(code: Column) -> Column:
    return code / 255.0


def encode_signed(a: Column) -> Column:
    """A component in [-1, 1] as an unsigned byte centred on 127.5; null and NaN become 0."""
    return F.when(a.isNull() | F.isnan(a), 0).otherwise(half_even(clamp(a, -1.0, 1.0) * 127.5 + 127.5)).cast("int")


def polar(dy: Column, dx: Column) -> tuple[Column, Column]:
    """(radius, angle in radians)."""
    return F.hypot(dy, dx), F.atan2(dy, dx)


def winding(dy: Column, dx: Column, pitch: float) -> Column:
    """Winding number of a spiral of the given pitch: radius in pitches plus the turn."""
    radius, angle = polar(dy, dx)
    return radius / pitch + angle / (2 * math.pi)


def morton(z: Column, y: Column, x: Column, bits: int = 12) -> Column:
    """Interleaves the low bits of three coordinates, x lowest: neighbours in space stay near in order."""
    out = F.lit(0).cast("bigint")
    for k in range(bits):
        for place, axis in enumerate((x, y, z)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(axis.cast("bigint"), k).bitwiseAND(F.lit(1)), 3 * k + place))
    return out


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """First matching verdict; a condition that is null does not match, so unmeasured values fall through."""
    out = None
    for condition, verdict in steps:
        condition = F.coalesce(condition, F.lit(False))
        out = F.when(condition, verdict) if out is None else out.when(condition, verdict)
    return out.otherwise(otherwise)
