"""Small building blocks for threshold rules and numeric clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str | float | int


def col(value: ColumnLike) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def clamp(value: ColumnLike, low: float, high: ColumnLike) -> Column:
    """Cut to a range. A missing value becomes `low`, because greatest and least skip nulls."""
    return F.least(F.lit(high) if isinstance(high, (int, float)) else high,
                   F.greatest(F.lit(low), col(value)))


def first_step(value: ColumnLike, steps: Sequence[tuple[float, object]], default=None) -> Column:
    """The result of the first (lower bound, result) pair whose bound `value` reaches."""
    value = col(value)
    out = None
    for bound, result in steps:
        test = value >= F.lit(bound)
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return out.otherwise(F.lit(default))


def below_step(value: ColumnLike, steps: Sequence[tuple[float, object]], default=None) -> Column:
    """The result of the first (upper bound, result) pair that `value` stays below."""
    value = col(value)
    out = None
    for bound, result in steps:
        test = value < F.lit(bound)
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return out.otherwise(F.lit(default))


def finite(value: ColumnLike) -> Column:
    """NaN becomes null, so that aggregates and windows skip it."""
    value = col(value)
    return F.when(~F.isnan(value), value)


def number(value: ColumnLike) -> Column:
    """Text or number to double; junk, booleans, NaN and the missing sentinel become null."""
    parsed = col(value).try_cast("double")
    return F.when(~F.isnan(parsed) & (parsed != F.lit(-999999.0)), parsed)


def defined_level(value: ColumnLike) -> Column:
    """A published level; values at or below -999 mean "not defined"."""
    value = col(value)
    return F.when(value > F.lit(-999.0), value)


def half_even(value: ColumnLike, digits: int) -> Column:
    """Round to `digits` decimals on the exact binary value, exact halves to the even side.

    `bround` decides on the shortest decimal text, so it takes 0.35 (a little below the half in
    binary) for an exact half. Here the scaled value is corrected by its own rounding error.
    The value appears several times, so give it a plain column: see `settle`.
    """
    x = col(value).cast("double")
    if digits == 0:
        return F.rint(x) + 0.0
    scale = float(10 ** digits)
    scaled = x * scale
    if digits == 1:
        # 8x and 2x are exact, so this is the exact error of their rounded sum.
        error = x * 2.0 - (scaled - x * 8.0)
    else:
        # Two parts of at most 27 bits make both products with the small scale exact.
        wide = x * 134217729.0
        high = wide - (wide - x)
        error = (high * scale - scaled) + (x - high) * scale
    side = F.signum(error)
    nearest = F.rint(scaled)
    # An apparent half that truly lies on the far side of it moves one step.
    moved = F.when(scaled - nearest == side * 0.5, nearest + side).otherwise(nearest)
    return moved / scale + 0.0


def settle(df: DataFrame, digits: int, exprs: dict[str, Column]) -> DataFrame:
    """Add rounded columns: the values in one projection, the rounding in the next, so that no
    value is computed more than once."""
    return df.withColumns(exprs).withColumns({name: half_even(name, digits) for name in exprs})


def once(value: Column, fn) -> Column:
    """`fn` of a costly array expression, which is evaluated a single time."""
    return F.transform(F.array(value), fn).getItem(0)
