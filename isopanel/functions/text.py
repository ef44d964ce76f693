"""Label predicates and sentence templates as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_subtotal(label: Column | str) -> Column:
    """True when the label holds the word "total" in any case. A missing label is not a subtotal."""
    return F.coalesce(F.contains(F.lower(_as_column(label)), F.lit("total")), F.lit(False))


def differs_from(label: Column | str, text: str) -> Column:
    """``label != text`` where a missing label counts as different."""
    return ~_as_column(label).eqNullSafe(F.lit(text))


def fill(template: str, **parts: Column | str) -> Column:
    """Sentence from a ``{name}`` template. A null part makes the whole sentence null."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(_as_column(parts[name]))
    return F.concat(*pieces)


def sentences(*parts: Column, separator: str = " ") -> Column:
    """Join sentences, leaving out the null ones."""
    return F.concat_ws(separator, *parts)
