"""All power breakdowns from one pass over the rows.

Totals, source series and flows sum the same rows under different conditions on their labels. The rows are summed once
by all labels together; what is left has a row for each place, year, source and grid that occur together, and every
breakdown is a selection of these sums.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import parse_number, parse_year, round_exact
from ..sinks.tables import store
from ..sources import catalog as c
from ..sources.catalog import RowRule

LABELS = (c.UNIT_COLUMN, c.SOURCE_COLUMN, c.GRID_COLUMN)


def power_cells(df: DataFrame) -> DataFrame:
    """Sums of power rows by place, year and labels, stored. A missing year or label is one of its own.

    Rows without a country or a value are left out; no breakdown counts them.
    """
    rows = df.select(
        F.col(f"`{c.COUNTRY_COLUMN}`").alias("country"),
        parse_year(F.col(c.PERIOD_COLUMN)).alias("year"),
        *[F.col(f"`{name}`") for name in LABELS],
        parse_number(F.col(c.VALUE_COLUMN)).alias("value"),
    )
    present = rows.where("country is not null and value is not null")
    cells = present.groupBy("country", "year", *[F.col(f"`{name}`") for name in LABELS]).agg(
        F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_rows")
    )
    return store(cells, "power_cells")


def select_cells(cells: DataFrame, rule: RowRule, required: Iterable[str] = ()) -> DataFrame:
    """Cells of a rule as rows: country, year, source, target and value, the required ones of them present."""
    named = cells.where(rule.condition()).select(
        "country",
        "year",
        F.col(f"`{c.SOURCE_COLUMN}`").alias("source"),
        F.col(f"`{c.GRID_COLUMN}`").alias("target"),
        "value",
    )
    return named.dropna(subset=list(required)) if required else named


def total_rows(cells: DataFrame) -> DataFrame:
    """What is summed for totals: no subtotal sources, no all-grids rows."""
    return select_cells(cells, c.POWER_TOTAL_ROWS, ["year"]).select("country", "year", "value")


def all_grids_rows(cells: DataFrame) -> DataFrame:
    """The same with all-grids rows kept."""
    return select_cells(cells, c.POWER_ALL_GRIDS_ROWS, ["year"]).select("country", "year", "value")


def source_rows(cells: DataFrame) -> DataFrame:
    """All-grids rows by energy source: country, year, member, value."""
    found = select_cells(cells, c.POWER_BY_SOURCE_ROWS, ["year", "source"])
    return found.select("country", "year", F.col("source").alias("member"), "value")


def flow_rows(cells: DataFrame, with_subtotals: bool = False) -> DataFrame:
    """Source to grid, years known or not: country, year, source, target, value."""
    rule = c.POWER_FLOW_WITH_SUBTOTALS_ROWS if with_subtotals else c.POWER_FLOW_ROWS
    return select_cells(cells, rule, ["source", "target"])


def power_breakdowns(cells: DataFrame, digits: int | None = 2) -> DataFrame:
    """Every breakdown in one frame and one aggregation of the cells: part, country, year, source, target and value.

    The parts are ``total``, ``all grids``, ``source``, ``link`` and ``link with subtotals``. A cell is repeated for the
    parts that it belongs to, with the labels that the part doesn't tell apart left out.
    """
    source, grid, year = F.col(f"`{c.SOURCE_COLUMN}`"), F.col(f"`{c.GRID_COLUMN}`"), F.col("year")
    none = F.lit(None).cast("string")
    known, named = year.isNotNull(), source.isNotNull()

    def part(name: str, rule: RowRule, condition, *labels):
        entry = F.struct(F.lit(name).alias("part"), *[x.alias(n) for x, n in zip(labels, ("year", "source", "target"), strict=True)])
        return F.when(rule.condition() & condition, entry)

    parts = F.array(
        part("total", c.POWER_TOTAL_ROWS, known, year, none, none),
        part("all grids", c.POWER_ALL_GRIDS_ROWS, known, year, none, none),
        part("source", c.POWER_BY_SOURCE_ROWS, known & named, year, source, none),
        part("link", c.POWER_FLOW_ROWS, named, none.cast("int"), source, grid),
        part("link with subtotals", c.POWER_FLOW_WITH_SUBTOTALS_ROWS, named, none.cast("int"), source, grid),
    )
    repeated = cells.select("country", "value", F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("p"))
    summed = repeated.groupBy("p", "country").agg(F.sum("value").alias("value")).select("p.*", "country", "value")
    return summed if digits is None else summed.withColumn("value", round_exact("value", digits))
