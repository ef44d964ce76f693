"""Least-squares and windowed trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_exact
from .median import small_group_median
from .series import KEYS, first_n_last_n

CENTRE_YEAR = 2000
MIN_POINTS = 3
TINY = 1e-9


def linear_trend(series: DataFrame, keys: Sequence[str] = KEYS, centre: int = CENTRE_YEAR) -> DataFrame:
    """Least-squares line over all points of a series; all figures are null below three points.

    The year is centred before fitting, which avoids cancellation; the intercept is shifted back to year zero.
    A constant series has R² 0, and a series of zeros no relative slope.
    """
    x = (F.col("year") - centre).cast("double")
    y = F.col("value")
    fitted = (
        series.dropna(subset=[*keys, "year", "value"])
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_slope(y, x).alias("_slope"),
            F.regr_intercept(y, x).alias("_level"),
            F.regr_r2(y, x).alias("_r2"),
            F.avg(F.abs(y)).alias("_size"),
            (F.min(y) == F.max(y)).alias("_constant"),
        )
    )
    enough = F.col("n") >= MIN_POINTS
    slope = F.col("_slope")
    r2 = F.when(F.col("_constant"), F.lit(0.0)).otherwise(F.col("_r2"))
    relative = F.when(F.col("_size") > TINY, slope * 10 / F.col("_size") * 100)
    return fitted.select(
        *keys,
        "n",
        F.when(enough, round_exact(slope * 10, 4)).alias("slope_per_decade"),
        F.when(enough, slope).alias("slope_per_year"),
        F.when(enough, F.col("_level") - slope * centre).alias("intercept"),
        F.when(enough, round_exact(r2, 3)).alias("r_squared"),
        F.when(enough, round_exact(relative, 2)).alias("relative_slope_pct"),
    )


def fitted_endpoints(trend: DataFrame, extent: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The trend line at the first and last year of the series."""

    def at(year: str):
        return F.col("slope_per_year") * F.col(year) + F.col("intercept")

    years = extent.select(*keys, "first_year", "last_year")
    return trend.join(years, list(keys)).withColumns(
        {"fitted_first": at("first_year"), "fitted_last": at("last_year")}
    )


def window_trend(
    series: DataFrame, threshold: float, n: int = 10, stat: str = "mean", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean (or median) of the first and last ``n`` rows and how they compare: rising, falling or stable.

    Rows are counted, not years. Below ``2n`` rows the figure over the whole series stands in: ``short``. Of a
    long series no more than ``n`` rows at either end are ever brought together.
    """
    first, last = first_n_last_n(series, 2 * n, keys)
    figure = F.avg if stat == "mean" else small_group_median
    opening = first.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_first"),
        figure(F.col("value")).alias("_overall"),
        figure(F.when(F.col("position") <= n, F.col("value"))).alias("_start"),
    )
    closing = last.where(F.col("position") <= n).groupBy(*keys).agg(figure(F.col("value")).alias("_end"))
    is_short = F.col("n_first") < 2 * n
    start, end = F.col("_start"), F.col("_end")
    return opening.join(closing, list(keys)).select(
        *keys,
        F.when(is_short, F.lit("short"))
        .when(end > start + threshold, F.lit("rising"))
        .when(end < start - threshold, F.lit("falling"))
        .otherwise(F.lit("stable"))
        .alias("trend"),
        F.when(is_short, F.col("_overall")).alias("overall"),
        F.when(~is_short, start).alias("start_figure"),
        F.when(~is_short, end).alias("end_figure"),
    )
