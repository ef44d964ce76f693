"""Rounding, number text and lenient parsing as column expressions."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts a CSV reader with default settings takes as "missing".
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# What counts as number text. Spark's own cast also takes Java suffixes such as "12d"; those are not numbers here.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

_INF = float("inf")


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == F.lit(_INF)))


def _reaches_half(x: Column, digits: int) -> Column:
    """For ``|x|`` below one unit of the last digit: whether it rounds up to that unit."""
    half = 0.5 / 10**digits
    stored, exact = Fraction(half), Fraction(1, 2 * 10**digits)
    return F.abs(x) >= half if stored > exact else F.abs(x) > half


def _decimal_text(x: Column, digits: int) -> Column:
    """Decimal text of a finite double.

    The number format rounds half to even on the exact binary value, except where all digits of the number fall
    away; those numbers are compared with one half.
    """
    zeros = "0." + "0" * digits if digits else "0"
    unit = zeros[:-1] + "1"
    small = F.concat(F.when(x < 0, "-").otherwise(""), F.when(_reaches_half(x, digits), unit).otherwise(zeros))
    return F.when(F.abs(x) < 10.0**-digits, small).otherwise(F.call_function("format_number", x, F.lit(zeros)))


def round_exact(value: Column | str, digits: int) -> Column:
    """Round half to even on the exact binary value of a double, as decimal text formatting does.

    ``round`` and ``bround`` first turn the double into its shortest decimal text, so 2.675 becomes a tie there
    although the stored value lies below it. Infinite and NaN values pass through; -0.0 becomes 0.0. The detour
    over text is meant for aggregate results, not for every input row.
    """
    x = _as_column(value).cast("double")
    return F.when(_is_finite(x), _decimal_text(x, digits).cast("double") + F.lit(0.0)).otherwise(x)


def fixed_text(value: Column | str, digits: int) -> Column:
    """Text of a double with a fixed number of decimals, rounded as in :func:`round_exact`."""
    x = _as_column(value).cast("double")
    other = F.replace(F.lower(x.cast("string")), F.lit("infinity"), F.lit("inf"))
    return F.when(_is_finite(x), _decimal_text(x, digits)).otherwise(other)


def significant(value: Column | str) -> Column:
    """A double with 12 significant digits.

    Sums of doubles, and lines fitted to them, vary in the last digits with the order of the rows. A figure that stands
    halfway between two texts would come out as one or the other; without these digits it is the same in every run.
    """
    x = _as_column(value).cast("double")
    return F.when(_is_finite(x), F.format_string("%.11e", x).cast("double") + F.lit(0.0)).otherwise(x)


def blank_to_null(value: Column | str) -> Column:
    """Null for every text that a CSV reader takes as missing."""
    x = _as_column(value)
    return F.when(~x.isin(*MISSING_TOKENS), x)


def parse_number(value: Column | str) -> Column:
    """Number text to double; anything else, NaN included, becomes null. Infinity is kept."""
    x = _as_column(value).cast("string")
    return F.nanvl(F.when(x.rlike(NUMBER_PATTERN), x.try_cast("double")), F.lit(None).cast("double"))


def parse_year(value: Column | str) -> Column:
    """Year text to int by way of double, so that ``2001.7`` is 2001. Out of range becomes null."""
    return parse_number(value).try_cast("int")


def parse_grouped_integer(value: Column | str) -> Column:
    """Whole number with thousands separators (``936,376``) to bigint; bad text becomes null."""
    return F.regexp_replace(_as_column(value), ",", "").try_cast("bigint")


def first_by(result: Column | str, *order: Column) -> Column:
    """Aggregate: ``result`` of the row that sorts first by ``order``.

    Ordering by a struct makes ties explicit: the last entries decide. ``max_by`` on the value alone would leave
    the choice among equal values to the arrival order of rows.
    """
    return F.min_by(_as_column(result), F.struct(*order))
