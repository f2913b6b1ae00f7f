"""Number helpers as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLITTER = float(2 ** 27 + 1)
#: Decimal numbers with an optional exponent, and the names of the special values.
DECIMAL = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def to_number(column: Column) -> Column:
    """Cast to double; text that is no decimal number becomes null.

    The JVM also reads ``45d`` and ``0x1p3``, so the form is checked where a letter of these occurs.
    """
    return F.when(column.cast("string").rlike(f"^[^dDfFxX]*$|{DECIMAL}"), column.try_cast("double"))


def is_finite(column: Column) -> Column:
    return ~F.isnan(column) & (F.abs(column) < F.lit(float("inf")))


def round_exact(column: Column, digits: int) -> Column:
    """Round the exact binary value to ``digits`` places, ties to even.

    ``F.round`` and ``F.bround`` look at the printed decimal (22.15 is taken as a
    tie); a correctly rounded result needs the stored value, which is a little
    below 22.15. ``scaled + error`` is twice the shifted value without any
    rounding loss (an error-free product: the number is split into two halves of
    26 bits), so it can be compared with the odd integer at the midpoint.
    Holds while ``value * 2 * 10**digits`` stays below 2**53, for up to six digits.
    """
    value = F.abs(column.cast("double"))
    factor = F.lit(float(2 * 10 ** digits))
    scaled = value * factor
    spread = value * F.lit(SPLITTER)
    high = spread - (spread - value)
    error = (high * factor - scaled) + (value - high) * factor
    low = F.floor(scaled / 2)
    over = scaled - (2 * low + 1).cast("double")
    # above the midpoint, or on it with something left over, or on it with an odd lower neighbour
    up = F.signum(over) * 4 + F.signum(error) * 2 + low % 2 > 0
    magnitude = (low + up.cast("bigint")).cast("double") / float(10 ** digits)
    return F.signum(column.cast("double")) * magnitude


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent with two decimals; null for an empty group."""
    share = part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * F.lit(100.0)
    return round_exact(share, 2)


def round_to_grid(column: Column, digits: int) -> Column:
    """Scale, round half-even, scale back: the rounding of array libraries."""
    factor = float(10 ** digits)
    return F.rint(column * factor) / factor


def clip(column: Column, low: float, high: float) -> Column:
    """Clip into [low, high]; null stays null (``least``/``greatest`` would skip it)."""
    return F.when(column < low, F.lit(float(low))).when(column > high, F.lit(float(high))).otherwise(column)


def count_if(condition: Column) -> Column:
    """Rows where the condition is true; null counts as false."""
    return F.count(F.when(condition, F.lit(1)))


def add_all(columns: list[Column]) -> Column:
    """Left-to-right sum."""
    return reduce(lambda a, b: a + b, columns)
