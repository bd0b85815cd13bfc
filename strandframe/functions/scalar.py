"""Scalar expressions: thresholds, flags, rounding, transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value worked out once for a row.

    A column used inside a lambda is otherwise put in place of its name by the optimizer
    and worked out again for each element.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def binarise(x: Column | str, cutoff: float) -> Column:
    """1 where x lies strictly above the cutoff, else 0."""
    return (_col(x) > cutoff).cast("int")


def bit_filter(flag: Column, require: int = 0, exclude: int = 0) -> Column:
    """All bits of ``require`` set and none of ``exclude``."""
    flag = flag.cast("long")
    return (flag.bitwiseAND(F.lit(exclude).cast("long")) == 0) & (flag.bitwiseAND(F.lit(require).cast("long")) == require)


def percent_round(x: Column, digits: int = 2) -> Column:
    """Rounding half to even."""
    return F.bround(x, digits)


def log2p1(x: Column | str) -> Column:
    return F.log2(1 + _col(x))


def minus_log10(p: Column | str, floor: float = 1e-9) -> Column:
    return -10 * F.log10(floor + _col(p))


def signed_log(x: Column | str) -> Column:
    """sign(x) ln(1 + |x|), 0 at 0."""
    return F.signum(_col(x)) * F.log1p(F.abs(_col(x)))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Distance of two bit-packed rows (arrays of longs of equal length)."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)


def tag(*parts: object) -> str:
    """A name for a run from its parameters."""
    return "_".join(str(p).replace("/", "-") for p in parts)
