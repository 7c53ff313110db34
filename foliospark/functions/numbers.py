"""Numeric Column helpers with the rounding rules that image sizes need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(x, col(low)), col(high))


def toward_zero(x: Column) -> Column:
    """The integer part, as a double."""
    return x.cast("long").cast("double")


def rounded(x: Column | str, digits: int) -> Column:
    """x to so many digits, halves to even: one multiplication and division, so that any engine gives the same."""
    return F.rint(col(x) * float(10**digits)) / float(10**digits)


def up_to_multiple(x: Column, step: int) -> Column:
    """The next multiple of step that isn't below the integer x."""
    return (F.ceil(x / F.lit(float(step))) * step).cast("long")


def fraction(text: Column) -> Column:
    """A number written as a decimal or as a quotient such as 1./255.; null if it is neither or divides by 0."""
    parts = F.split(F.trim(text), "/")
    top, bottom = (F.get(parts, F.lit(k)).try_cast("double") for k in (0, 1))
    return F.when(F.size(parts) == 1, top).when((F.size(parts) == 2) & (bottom != 0), top / bottom)
