"""Cleaning that counts: rows that can't be used are kept aside with the reason, in the same pass as the others.

Loading drops rows whose country, year or value is missing or unreadable. Here the same rows are judged instead: each
gets the first reason that holds, or none. Good and bad rows go to one stored table, in a folder for each reason, so
readers of either open their own files only. Counts by reason are taken from it, by reading no more than the two labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import parse_number, parse_year
from ..sinks.tables import store
from . import catalog as c
from .catalog import RowRule
from .observations import REQUIRED

#: The reason of a row that is kept, and the column of a CSV line that doesn't fit its header.
KEPT, CORRUPT = "kept", "_corrupt_record"


@dataclass(frozen=True)
class Cleaned:
    rows: DataFrame
    """What loading would have returned."""
    quarantine: DataFrame
    """The other rows: their reason, and their texts as read."""
    counts: DataFrame
    """Number of rows by indicator and reason, kept ones included; reasons that don't occur are left out."""


def _reasons(extra: Iterable[str], required: Iterable[str], with_year: bool, with_lines: bool) -> list[tuple[Column, str]]:
    """Conditions on typed rows and their reasons, in the order in which they count."""
    texts = {"country": "country", "year": "period_text", "value": "value_text"} | {name: name for name in extra}
    found = [(F.col("line").isNotNull(), "malformed record")] if with_lines else []
    for name in required:
        if name == "year" and not with_year:
            continue
        found.append((F.col(texts[name]).isNull(), f"{name} missing"))
        if name in ("year", "value"):
            found.append((F.col(name).isNull(), f"{name} not a number"))
    return found


def judged(
    df: DataFrame,
    rule: RowRule,
    extra: Mapping[str, str] | None = None,
    required: Iterable[str] = REQUIRED,
    with_year: bool = True,
) -> tuple[DataFrame, list[str]]:
    """The rows that a rule selects, typed as loading does, with their ``reason`` and texts; and all reasons there are.

    A line that doesn't fit its header is judged whatever the rule says, since its columns can't be trusted.
    """
    extra = dict(extra or {})
    wanted = rule.condition()
    if CORRUPT in df.columns:
        wanted = wanted | F.col(CORRUPT).isNotNull()
    texts = {"period_text": c.PERIOD_COLUMN, "value_text": c.VALUE_COLUMN}
    line = F.col(CORRUPT) if CORRUPT in df.columns else F.lit(None).cast("string")
    columns = [F.col(f"`{c.COUNTRY_COLUMN}`").alias("country")]
    columns += [parse_year(F.col(c.PERIOD_COLUMN)).alias("year")] if with_year else []
    columns += [F.col(f"`{name}`").alias(alias) for name, alias in extra.items()]
    columns += [parse_number(F.col(c.VALUE_COLUMN)).alias("value")]
    columns += [F.col(name).alias(alias) for alias, name in texts.items()] + [line.alias("line")]
    # typed first: the reason looks at what was read, so each text is read once
    rows = df.where(wanted).select(*columns)
    reasons = _reasons(extra.values(), required, with_year, CORRUPT in df.columns)
    reason = reduce(lambda rest, r: F.when(r[0], r[1]).otherwise(rest), reversed(reasons), F.lit(KEPT))
    typed = [name for name in rows.columns if name not in (*texts, "line")]
    return rows.select(*typed, reason.alias("reason"), *texts, "line"), [KEPT, *[name for _, name in reasons]]


def _settled(rows: DataFrame, names: Iterable[str], reasons: Iterable[str], typed: list[str]) -> Cleaned:
    """Write judged rows once, by reason, and count what was written."""
    # texts of good rows aren't needed any more
    texts = {t: F.when(F.col("reason") != KEPT, F.col(t)) for t in ("period_text", "value_text", "line")}
    stored = store(rows.withColumns(texts), "cleaned", by="reason")
    seen = {(r[0], r[1]): r[2] for r in stored.groupBy("indicator", "reason").count().collect()}
    found = [(*pair, seen.get(pair, 0)) for pair in ((name, reason) for name in names for reason in reasons)]
    counts = rows.sparkSession.createDataFrame(
        [row for row in found if row[2]], "indicator string, reason string, n_rows bigint"
    )
    return Cleaned(
        stored.where(F.col("reason") == KEPT).select(*typed),
        stored.where(F.col("reason") != KEPT).select(
            "indicator", "reason", *[x for x in typed if x not in ("indicator", "agg", "year", "value")], "period_text", "value_text", "line"
        ),
        counts,
    )


def clean(
    df: DataFrame,
    rule: RowRule,
    name: str = "rows",
    extra: Mapping[str, str] | None = None,
    required: Iterable[str] = REQUIRED,
    with_year: bool = True,
) -> Cleaned:
    """The rows of one rule, cleaned. ``name`` stands for the indicator in counts and quarantine."""
    rows, reasons = judged(df, rule, extra, required, with_year)
    typed = [x for x in rows.columns if x not in ("reason", "period_text", "value_text", "line")]
    return _settled(rows.withColumn("indicator", F.lit(name)), [name], reasons, typed)


def clean_panels(datasets: Mapping[str, DataFrame], catalog: c.Catalog = c.STANDARD_CATALOG) -> Cleaned:
    """Rows (country, indicator, year, value, agg) of all indicators, cleaned in one pass over each source's use."""
    parts, reasons, names = [], [KEPT], []
    for i in catalog.indicators:
        if i.source in datasets:
            rows, own = judged(datasets[i.source], i.rows)
            parts.append(rows.withColumns({"indicator": F.lit(i.name), "agg": F.lit(i.agg)}))
            reasons += [x for x in own if x not in reasons]
            names.append(i.name)
    rows = reduce(DataFrame.unionByName, parts)
    return _settled(rows, names, reasons, ["country", "indicator", "year", "value", "agg"])


def by_aggregate(rows: DataFrame, catalog: c.Catalog = c.STANDARD_CATALOG) -> dict[str, DataFrame]:
    """Cleaned rows as panels, one for each aggregate in use."""
    return {agg: rows.where(F.col("agg") == agg).drop("agg") for agg in sorted({i.agg for i in catalog.indicators})}
