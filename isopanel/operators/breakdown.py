"""Members of an indicator (products, energy sources): series, rankings, heatmaps and the latest mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import first_by, round_exact
from .median import exact_median, small_group_median
from .series import annual_series

COUNTRY = ("country",)


def member_annual(rows: DataFrame, agg: str, keys: Sequence[str] = COUNTRY, digits: int | None = 2) -> DataFrame:
    """One figure per member and year."""
    return annual_series(rows, agg, [*keys, "member", "year"], digits=digits)


def median_of_years(annual: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Median of each member's annual figures; a group holds one figure per year."""
    return annual.groupBy(*keys, "member").agg(small_group_median("value").alias("median"))


def median_of_rows(rows: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Median over all rows of each member."""
    return exact_median(rows, [*keys, "member"])


def rank_members(medians: DataFrame, side: str, n: int = 10, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """The ``n`` members with the highest or lowest median, rank 1 being the extreme.

    The bottom list is the top list read from its end: equal medians come in alphabetical order at the top and
    in reverse order at the bottom. With few members the two lists overlap.
    """
    if side == "top":
        order = [F.col("median").desc(), F.col("member").asc()]
    elif side == "bottom":
        order = [F.col("median").asc(), F.col("member").desc()]
    else:
        raise ValueError(f"unknown side: {side}")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = medians.where(F.col("median").isNotNull()).withColumn("rank", rank)
    return ranked.where(F.col("rank") <= n).select(*keys, F.lit(side).alias("side"), "rank", "member", "median")


def _laid_out(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each member's figures as a map by year, beside the years that any member of the country has.

    The years of a country travel as one array to its members. No rows are paired.
    """
    years = cells.groupBy(*keys).agg(F.array_sort(F.collect_set("year")).alias("years"))
    members = cells.groupBy(*keys, "member").agg(
        F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("_cells")
    )
    return members.join(years, list(keys))


def heatmap_pivot(cells: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Member by year: a row for each member with the country's years and, beside them, its figures or nulls.

    The years are whatever the data has. They are kept as an array, since columns would have to be named before the
    data is read; ``heatmap_columns`` makes columns of them.
    """
    figures = F.transform("years", lambda year: F.try_element_at("_cells", year))
    return _laid_out(cells, keys).select(*keys, "member", "years", figures.alias("values"))


def heatmap_columns(cells: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Member by year with a column for each year that the data has; Spark reads the years first."""
    return cells.groupBy(*keys, "member").pivot("year").agg(F.first("value"))


def heatmap_dense(cells: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """A row for every member and every year that any member of the country has; null where there is no figure."""
    return (
        _laid_out(cells, keys)
        .select(*keys, "member", F.explode("years").alias("year"), "_cells")
        .select(*keys, "member", "year", F.try_element_at("_cells", F.col("year")).alias("value"))
    )


def latest_period(cells: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """The latest year of a country over all its members."""
    return cells.groupBy(*keys).agg(F.max("year").alias("latest_year"))


def latest_mix(cells: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """The figures of a country's latest year: leader (first by name on ties), its figure and the total.

    Years are summed up first and the latest one is picked afterwards, so no row has to meet a window.
    """
    by_year = cells.groupBy(*keys, "year").agg(
        first_by("member", -F.col("value"), F.col("member")).alias("leader"),
        F.max("value").alias("leader_value"),
        F.sum("value").alias("total"),
    )
    return by_year.groupBy(*keys).agg(F.max_by(F.struct("year", "leader", "leader_value", "total"), "year").alias("m")).select(
        *keys, F.col("m.year").alias("latest_year"), "m.leader", "m.leader_value", "m.total"
    )


def mix_growth(cells: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Total of the first and the last year: growth if it rose, contraction otherwise."""
    totals = cells.groupBy(*keys, "year").agg(F.sum("value").alias("total"))
    ends = totals.groupBy(*keys).agg(
        F.min("year").alias("start_year"),
        F.max("year").alias("latest_year"),
        F.min_by("total", "year").alias("start_total"),
        F.max_by("total", "year").alias("latest_total"),
    )
    return ends.withColumn(
        "status", F.when(F.col("latest_total") > F.col("start_total"), "growth").otherwise("contraction")
    )


def member_arrays(cells: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Years and figures of each member as parallel arrays ordered by year, for the output side."""
    points = F.array_sort(F.collect_list(F.struct("year", "value")))
    return cells.groupBy(*keys, "member").agg(points.alias("_points")).select(
        *keys, "member", F.col("_points.year").alias("years"), F.col("_points.value").alias("values")
    )


def rounded(cells: DataFrame, digits: int, column: str = "value") -> DataFrame:
    return cells.withColumn(column, round_exact(column, digits))
