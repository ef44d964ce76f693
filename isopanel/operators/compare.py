"""Requests for a country, optionally beside another one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import last_point

IN_LINE = 1e-6


def _names(dim: DataFrame, alias: str) -> DataFrame:
    return dim.select(F.col("country").alias(alias)).where(F.col(alias).isNotNull()).distinct()


def country_or_default(requests: DataFrame, dim: DataFrame, default: str, column: str = "country") -> DataFrame:
    """Replace names that the dimension does not know by the default."""
    known = _names(dim, "_known")
    return (
        requests.join(known, F.col(column) == F.col("_known"), "left")
        .withColumn(column, F.coalesce("_known", F.lit(default)))
        .drop("_known")
    )


def resolve_compare(requests: DataFrame, dim: DataFrame, primary: str = "country", compare: str = "compare") -> DataFrame:
    """Empty text for a compare country that is missing, unknown or the same as the primary one."""
    known = _names(dim, "_known")
    usable = F.col("_known").isNotNull() & (F.col("_known") != F.col(primary))
    return (
        requests.join(known, F.col(compare) == F.col("_known"), "left")
        .withColumn(compare, F.when(usable, F.col("_known")).otherwise(F.lit("")))
        .drop("_known")
    )


def known_countries(df: DataFrame, dim: DataFrame, known: bool = True) -> DataFrame:
    """Rows whose country is in the dimension, or with ``known=False`` the others."""
    return df.join(_names(dim, "country"), "country", "left_semi" if known else "left_anti")


def join_country_dim(dim: DataFrame, figures: DataFrame) -> DataFrame:
    """Every country of the dimension with its figures, if it has any. Other countries drop out."""
    return dim.join(figures, "country", "left")


def compare_pairs(latest: DataFrame, requests: DataFrame) -> DataFrame:
    """Latest figures of the primary country beside those of the compare country, indicator by indicator."""
    other = latest.select(
        F.col("country").alias("compare"),
        "indicator",
        F.col("year").alias("compare_year"),
        F.col("value").alias("compare_value"),
    )
    return requests.join(latest, "country").join(other, ["compare", "indicator"], "left")


def latest_vs_compare(pairs: DataFrame) -> DataFrame:
    """Distance between the two latest values and where the primary one lies; null without a compare value."""
    own, other = F.col("value"), F.col("compare_value")
    return pairs.withColumns(
        {
            "compare_gap": F.abs(own - other),
            "compare_relation": F.when(own > other, "higher than")
            .when(own < other, "lower than")
            .when(own == other, "the same as"),
        }
    )


def latest_vs_median(aligned: DataFrame) -> DataFrame:
    """Latest value of each series against the regional median of the same year."""
    latest = (
        aligned.dropna(subset=["country", "indicator", "year", "value"])
        .groupBy("country", "indicator")
        .agg(F.max_by(F.struct("year", "value", "regional_median"), "year").alias("l"))
        .select("country", "indicator", "l.*")
    )
    gap = F.abs(F.col("value") - F.col("regional_median"))
    return latest.withColumns(
        {
            "median_gap": gap,
            "median_relation": F.when(gap < IN_LINE, "in line")
            .when(F.col("value") > F.col("regional_median"), "above")
            .when(F.col("value") <= F.col("regional_median"), "below"),
        }
    )


def baseline_position(series: DataFrame, baseline: DataFrame, threshold: float) -> DataFrame:
    """Latest value against the latest regional figure, whichever years they are from."""
    own = last_point(series).select(
        "country", "indicator", F.col("year").alias("last_year"), F.col("value").alias("last_value")
    )
    regional = last_point(
        baseline.select("indicator", "year", F.col("regional_median").alias("value")), ["indicator"]
    ).select("indicator", F.col("year").alias("baseline_year"), F.col("value").alias("baseline_value"))
    value, base = F.col("last_value"), F.col("baseline_value")
    return own.join(regional, "indicator").withColumn(
        "position",
        F.when(value > base + threshold, "higher").when(value < base - threshold, "lower").otherwise("aligned"),
    )
