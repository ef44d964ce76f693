"""Annual series, regional baselines and what is read off them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import first_by, round_exact
from ..sinks.tables import store
from .median import Sketches, exact_median, small_group_median

KEYS = ("country", "indicator")
PANEL = ("country", "indicator", "year")


def panel_sketches(panels: Mapping[str, DataFrame]) -> Sketches:
    """Stored sketches and sums of all series: one pass from which both country series and regional medians start.

    ``panels`` holds, by aggregate, the rows of the indicators that it applies to.
    """
    rows = [panel.select(*PANEL, F.lit(agg).alias("agg"), "value") for agg, panel in panels.items()]
    return Sketches(reduce(DataFrame.unionByName, rows), [*PANEL, "agg"], of=F.col("agg") == "median")


def annual_series(
    panel: DataFrame, agg: str, keys: Sequence[str] = PANEL, digits: int | None = 3, output: str = "value"
) -> DataFrame:
    """One figure per key: the exact median or the sum of ``value``. Rows with a missing key or value do not count."""
    keys = list(keys)
    if agg == "median":
        figures = exact_median(panel, keys, output=output)
    elif agg == "sum":
        figures = panel.dropna(subset=[*keys, "value"]).groupBy(*keys).agg(F.sum("value").alias(output))
    else:
        raise ValueError(f"unknown aggregate: {agg}")
    return figures if digits is None else figures.withColumn(output, round_exact(output, digits))


def annual_panel(sketches: Sketches, digits: int | None = 3) -> DataFrame:
    """Annual series of all indicators, each by its own aggregate, from :func:`panel_sketches`."""
    sums = sketches.sums("value").where(F.col("agg") == "sum")
    figures = sketches.median(output="value").unionByName(sums).drop("agg")
    return figures if digits is None else figures.withColumn("value", round_exact("value", digits))


def regional_median(panel: DataFrame | Sketches, digits: int = 3) -> DataFrame:
    """Median over the raw rows of all countries per indicator and year, also for summed indicators."""
    keys = ("indicator", "year")
    if isinstance(panel, Sketches):
        figures = panel.median(keys, output="regional_median")
    else:
        figures = exact_median(panel, keys, output="regional_median")
    return figures.withColumn("regional_median", round_exact("regional_median", digits))


def regional_of_series(series: DataFrame, stat: str = "median", digits: int | None = None) -> DataFrame:
    """Median or mean over the countries' annual figures per indicator and year.

    A group holds one figure per country, so its size is bounded by the number of countries.
    """
    figure = small_group_median("value") if stat == "median" else F.avg("value")
    baseline = series.groupBy("indicator", "year").agg(figure.alias("regional_median"))
    return baseline if digits is None else baseline.withColumn("regional_median", round_exact("regional_median", digits))


def regional_mean(panel: DataFrame, digits: int | None = None) -> DataFrame:
    """Mean over the given rows per indicator and year."""
    return regional_of_series(panel, "mean", digits)


def align_regional(series: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each row with the regional figure of its indicator and year; null where the region has none."""
    return series.join(baseline, ["indicator", "year"], "left")


def comparison_lines(series: DataFrame, baseline: DataFrame, label: str) -> DataFrame:
    """Country rows and, under a label in place of a country, the baseline as rows of their own."""
    own = align_regional(series, baseline).select(*PANEL, "value", "regional_median")
    regional = baseline.select(
        F.lit(label).alias("country"), "indicator", "year", F.col("regional_median").alias("value"), "regional_median"
    )
    return own.unionByName(regional)


def headline_change(baseline: DataFrame, digits: int = 2) -> DataFrame:
    """First and last year of each regional series, their values and the absolute change."""
    ends = baseline.groupBy("indicator").agg(
        F.min("year").alias("start_year"),
        F.max("year").alias("end_year"),
        F.min_by("regional_median", "year").alias("start_value"),
        F.max_by("regional_median", "year").alias("end_value"),
    )
    return ends.withColumn("change", round_exact(F.col("end_value") - F.col("start_value"), digits))


def headline_stat(headline: DataFrame, labels: DataFrame, indicator: str, label: str) -> DataFrame:
    """The headline figure: one indicator's change with a label of its own and the indicator's unit."""
    units = labels.select("indicator", "unit")
    picked = headline.where(F.col("indicator") == indicator).join(units, "indicator")
    return picked.select(
        F.lit(label).alias("label"), "unit", "start_year", "end_year", "start_value", "end_value", "change"
    )


def _by_year(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest and highest value of each year. Rows may be raw ones, so they are reduced by hashing alone, before
    anything is picked by an order."""
    present = series.dropna(subset=[*keys, "year", "value"])
    return present.groupBy(*keys, "year").agg(F.min("value").alias("_min"), F.max("value").alias("_max"))


def series_extent(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First and last year, lowest and highest value and their years; the earliest year wins ties."""
    year = F.col("year")
    return _by_year(series, keys).groupBy(*keys).agg(
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.min("_min").alias("min_value"),
        F.max("_max").alias("max_value"),
        first_by(year, F.col("_min"), year).alias("min_year"),
        first_by(year, -F.col("_max"), year).alias("max_year"),
    )


def last_point(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Year and value of the latest entry. With several rows in the latest year, the highest value counts."""
    return _by_year(series, keys).groupBy(*keys).agg(
        F.max("year").alias("year"), F.max_by("_max", "year").alias("value")
    )


def first_n_last_n(series: DataFrame, n: int, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """The first and the last ``n`` rows by year, numbered from the outer end; equal years are ordered by value.

    Rows are counted by year, which names the years in which the n-th row from either end falls. Only rows up to there
    are looked at again, and only as distinct values with their number, of which ``n`` at most are ranked for a key.
    Returns the keys, year, value and position.
    """
    keys = list(keys)
    present = series.dropna(subset=[*keys, "year"])
    years = present.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("_n"))
    up, down = (Window.partitionBy(*keys).orderBy(order) for order in (F.col("year").asc(), F.col("year").desc()))
    ahead = {"_first": F.sum("_n").over(up) - F.col("_n"), "_last": F.sum("_n").over(down) - F.col("_n")}
    # stored, the few years that are left have a known size, and rows needn't be moved to meet them
    edges = store(years.withColumns(ahead).where((F.col("_first") < n) | (F.col("_last") < n)).drop("_n"), "edges")
    values = present.join(edges, [*keys, "year"]).groupBy(*keys, "year", "_first", "_last", "value").agg(
        F.count(F.lit(1)).alias("_n")
    )
    values = store(values, "edge_values")

    def edge(ahead: str, *order: Column) -> DataFrame:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        few = values.where(F.col(ahead) < n).withColumn("_rank", F.row_number().over(ordered)).where(F.col("_rank") <= n)
        before = few.withColumn("_before", F.sum("_n").over(ordered) - F.col("_n")).where(F.col("_before") < n)
        last = F.least(F.col("_before") + F.col("_n"), F.lit(n))
        places = F.explode(F.sequence((F.col("_before") + 1).cast("int"), last.cast("int")))
        return before.select(*keys, "year", "value", places.alias("position"))

    return (
        edge("_first", F.col("year").asc(), F.col("value").asc()),
        edge("_last", F.col("year").desc(), F.col("value").desc()),
    )


def coverage_counts(series: DataFrame) -> DataFrame:
    """Number of countries and of country-indicator series."""
    pairs = series.select(*KEYS).distinct().groupBy("country").agg(F.count(F.lit(1)).alias("_k"))
    return pairs.agg(
        F.count(F.lit(1)).alias("n_countries"), F.coalesce(F.sum("_k"), F.lit(0)).cast("bigint").alias("n_series")
    )


def sorted_series(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Annual figures with their position in the series, from 1. A series has one row for each year."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("year"))
    return series.select(*keys, position.alias("position"), "year", "value")


def series_arrays(aligned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Parallel arrays of years, values and regional medians, ordered by year. For the output side: a row holds
    one series, whose length is bounded by the number of years."""
    points = F.array_sort(F.collect_list(F.struct("year", "value", "regional_median")))
    return (
        aligned.groupBy(*keys)
        .agg(points.alias("_points"))
        .select(
            *keys,
            F.col("_points.year").alias("years"),
            F.col("_points.value").alias("values"),
            F.col("_points.regional_median").alias("regional_median"),
        )
    )
