"""Checks and readings of identifiers and ratios, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Split factors that a ratio is read as; each stands for its inverse too
#: (fixed values).
FACTOR_BASES = (2.0, 3.0, 4.0, 5.0, 8.0, 10.0, 20.0, 25.0, 50.0, 100.0, 1000.0)


def is_isin(code: Column | str) -> Column:
    """A well-formed ISIN with a valid check digit (ISO 6166); null gives null.

    Letters count as two digits (A is 10); from the right every second digit
    of the expanded number, the check digit left out, is doubled.
    """
    code = F.upper(F.col(code) if isinstance(code, str) else code)
    shape = code.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$")
    body = F.filter(F.split(F.substring(code, 1, 11), ""), lambda c: c != "")
    expanded = F.array_join(F.transform(body, lambda c: F.conv(c, 36, 10)), "")
    digits = F.transform(F.filter(F.split(F.reverse(expanded), ""), lambda c: c != ""), lambda c: c.cast("int"))
    summed = F.aggregate(
        F.transform(
            digits,
            lambda d, i: F.when(i % 2 == 1, d).otherwise(F.floor(d * 2 / F.lit(10)).cast("int") + d * 2 % 10),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    check = (F.lit(10) - summed % 10) % 10
    return F.when(~shape, F.lit(False)).otherwise(check == F.substring(code, 12, 1).cast("int"))


def _factors() -> list[float]:
    return sorted({f for b in FACTOR_BASES for f in (b, 1.0 / b)})


def implied_factor(ratio: Column | str, tolerance: float = 0.05) -> Column:
    """The common factor nearest to a ratio, within a relative tolerance."""
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    usable = F.when(ratio > 0, ratio)
    near = F.array_min(
        F.array(*(F.struct(F.abs(F.log(usable / F.lit(f))).alias("d"), F.lit(f).alias("f")) for f in _factors()))
    )
    return F.when(usable.isNotNull() & (near.d <= F.log1p(F.lit(tolerance))), near.f)


def snapped_ratio(ratio: Column | str, tolerance: float = 0.005) -> Column:
    """A ratio as a common factor, or a whole percentage, if it is that close."""
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    near = implied_factor(ratio, tolerance * 2)
    percent = F.round(ratio, 2)

    def close(x: Column) -> Column:
        return F.abs(F.try_divide(ratio, x) - 1) <= tolerance

    return F.when(close(near), near).when(close(percent), percent).otherwise(ratio)
