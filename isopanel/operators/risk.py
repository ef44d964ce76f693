"""Extreme events of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import first_by, round_exact
from ..sinks.tables import store
from .series import KEYS

SPREADS = 2.0


def _spread(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        series.dropna(subset=[*keys, "year", "value"])
        .groupBy(*keys)
        .agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
    )


def tail_risk_stats(series: DataFrame, keys: Sequence[str] = KEYS, digits: int = 3) -> DataFrame:
    """Mean, population standard deviation and the distance beyond which a value is extreme."""
    return _spread(series, keys).select(
        *keys,
        round_exact("_mean", digits).alias("mean"),
        round_exact("_std", digits).alias("std"),
        round_exact(F.col("_std") * SPREADS, digits).alias("threshold"),
    )


def tail_risk_extremes(series: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Points farther from the mean than two standard deviations, tested on the unrounded figures."""
    spread = _spread(series, keys)
    far = F.abs(F.col("value") - F.col("_mean")) > F.col("_std") * SPREADS
    return series.join(spread, list(keys)).where(far).select(*keys, "year", "value")


def tail_risk_summary(stats: DataFrame, extremes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number of extreme events and the one farthest from the rounded mean; the earliest wins ties."""
    means = stats.select(*keys, "mean")
    distance = F.abs(F.col("value") - F.col("mean"))
    events = (
        extremes.join(means, list(keys))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_extremes"),
            first_by(F.struct("year", "value"), -distance, F.col("year")).alias("_top"),
        )
    )
    return stats.join(events, list(keys), "left").select(
        *keys,
        "mean",
        "std",
        "threshold",
        F.coalesce("n_extremes", F.lit(0)).cast("bigint").alias("n_extremes"),
        F.col("_top.year").alias("extreme_year"),
        F.col("_top.value").alias("extreme_value"),
    )


def zero_centred_threshold(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two sample standard deviations per key. Below two rows there is none (null)."""
    return (
        rows.dropna(subset=[*keys, "value"])
        .groupBy(*keys)
        .agg((F.stddev_samp("value") * SPREADS).alias("threshold"))
    )


def tail_risk_zero_centred(
    rows: DataFrame, thresholds: DataFrame, keys: Sequence[str] = KEYS, also: Sequence[str] = ()
) -> DataFrame:
    """Rows beyond the threshold on either side of zero, with further columns of the thresholds if asked for.

    The thresholds are a table of their own: stored before, they are small enough for the rows to stay where they are.
    """
    beyond = (F.col("value") > F.col("threshold")) | (F.col("value") < -F.col("threshold"))
    return rows.join(thresholds, list(keys)).where(beyond).select(*keys, "year", "value", "threshold", *also)


def zero_centred_overview(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Extent, threshold and number of events beyond it, per key, in two passes over the rows.

    The first pass takes figures that a task can add up, and is stored; the second counts against them and finds the
    years of the lowest and the highest value, the earliest on ties.
    """
    keys = list(keys)
    present = rows.dropna(subset=[*keys, "year", "value"])
    figures = store(
        present.groupBy(*keys).agg(
            (F.stddev_samp("value") * SPREADS).alias("threshold"),
            F.min("year").alias("first_year"),
            F.max("year").alias("last_year"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
        ),
        "figures",
    )
    value, threshold = F.col("value"), F.col("threshold")
    counts = present.join(figures, keys).groupBy(*keys).agg(
        F.count(F.when((value > threshold) | (value < -threshold), 1)).alias("n_extremes"),
        F.min(F.when(value == F.col("min_value"), F.col("year"))).alias("min_year"),
        F.min(F.when(value == F.col("max_value"), F.col("year"))).alias("max_year"),
    )
    return figures.join(counts, keys)
