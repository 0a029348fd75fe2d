"""Number and year expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A number as text: no suffixes, no 'NaN', no 'Infinity'.
PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def finite(c: Column) -> Column:
    """The double, NULL when it is no number or infinite."""
    return F.when(F.abs(c) < float("inf"), c)


def to_number(c: Column, default: float | None = 0.0) -> Column:
    """Number in any column; what is not a finite number, as '1d' or 'Infinity', becomes `default`."""
    # the type is known when the plan is made, so only texts are matched
    is_text = F.typeof(c) == "string"
    number = F.when(~is_text | c.cast("string").rlike(PLAIN_NUMBER), finite(c.try_cast("double")))
    return number if default is None else F.coalesce(number, F.lit(default))


def round_to_int(c: Column) -> Column:
    """Half-even rounding of a possibly missing quantity."""
    return F.bround(F.coalesce(c, F.lit(0)), 0).cast("bigint")


def thousands(c: Column, unit: str = "") -> Column:
    """'1,000,000', with the unit after it when one is given."""
    text = F.format_number(c, 0)
    return F.concat(text, F.lit(f" {unit}")) if unit else text


def year_of(c: Column) -> Column:
    """Year in a number, a year text, an ISO date or a text starting with a year."""
    text = c.cast("string")
    return F.coalesce(
        F.when(text.rlike("^[0-9]{4}$"), text.try_cast("int")),
        F.year(F.try_to_date(text, "yyyy-M-d")),
        F.left(text, F.lit(4)).try_cast("int"),
    )
