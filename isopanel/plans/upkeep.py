"""Series that are kept up to date file by file, without reading earlier files again.

Each batch of source files leaves states that can be merged: for every country, indicator and year the distinct values
with their number of rows. They hold all that exact medians and sums need. A new batch's states say which groups it
touches; for these alone the states of all batches are brought together, and only their annual figures, regional
medians, trends and tail risks are worked out again. All other figures are taken over. The states and the figures are a
release, so a batch that was ended half-way is simply added again.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_exact
from ..operators import risk as rk
from ..operators import series as s
from ..operators import trend as tr
from ..operators.median import exact_median, value_counts
from ..sinks import releases
from ..sinks.releases import Release
from ..sinks.tables import store
from ..sources import catalog as c
from ..sources import cleaning as cl

GROUP = ["country", "indicator", "year"]
REGION = ["indicator", "year"]
SERIES = ["country", "indicator"]
STATES = "states/"


def batch_states(datasets: Mapping[str, DataFrame], catalog: c.Catalog = c.STANDARD_CATALOG) -> DataFrame:
    """What a batch of sources adds: country, indicator, year, agg, value, and the number of rows ``n``."""
    return value_counts(cl.clean_panels(datasets, catalog).rows, [*GROUP, "agg"])


def all_states(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """The states of all batches of a release, one below the other."""
    parts = [table for name, table in sorted(tables.items()) if name.startswith(STATES)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def annual_of_states(states: DataFrame, digits: int | None = 3) -> DataFrame:
    """Annual figures of the groups in the states."""
    medians = exact_median(states.where("agg = 'median'"), GROUP, output="value", weight="n")
    sums = states.where("agg = 'sum'").groupBy(*GROUP).agg(F.sum(F.col("value") * F.col("n")).alias("value"))
    figures = medians.unionByName(sums)
    return figures if digits is None else figures.withColumn("value", round_exact("value", digits))


def regional_of_states(states: DataFrame, digits: int = 3) -> DataFrame:
    """Regional medians of the indicators and years in the states."""
    figures = exact_median(states, REGION, output="regional_median", weight="n")
    return figures.withColumn("regional_median", round_exact("regional_median", digits))


def replaced(old: DataFrame | None, new: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """The old figures with those of the touched groups left out, and the new ones."""
    return new if old is None else old.join(touched, keys, "left_anti").unionByName(new)


def add(
    spark: SparkSession,
    out: str,
    datasets: Mapping[str, DataFrame],
    catalog: c.Catalog = c.STANDARD_CATALOG,
    risk_indicators: tuple[str, ...] = c.TAIL_RISK_INDICATORS,
) -> dict[str, DataFrame]:
    """Add a batch of sources to the release of ``out`` and return its tables.

    The tables are ``series`` (with regional medians), ``trend``, ``risk``, ``extremes``, and the batches' states. The
    result is that of one build from all batches together; the order in which they come doesn't matter.
    """
    before = releases.tables(spark, out)
    release = Release(spark, out)
    n_batches = sum(name.startswith(STATES) for name in before)
    new = release.write(f"{STATES}{n_batches:08d}", batch_states(datasets, catalog))
    earlier = all_states(before)
    states = new if earlier is None else earlier.unionByName(new)
    groups = store(new.select(*GROUP).distinct(), "touched_groups")
    regions = store(groups.select(*REGION).distinct(), "touched_regions")
    changed = store(groups.select(*SERIES).distinct(), "touched_series")

    old = before.get("series")
    annual = annual_of_states(states.join(groups, GROUP, "left_semi"))
    regional = store(regional_of_states(states.join(regions, REGION, "left_semi")), "regional")
    kept = None if old is None else old.drop("regional_median")
    figures = replaced(kept, annual, groups, GROUP)
    # where a region is touched its median is new for all countries, else the one that a row had stays
    aligned = s.align_regional(figures, regional)
    if old is not None:
        was = old.select(*GROUP, F.col("regional_median").alias("_was"))
        aligned = aligned.join(was, GROUP, "left").withColumn("regional_median", F.coalesce("regional_median", "_was")).drop("_was")
    series = release.write("series", aligned.select(*GROUP, "value", "regional_median"))

    again = series.join(changed, SERIES, "left_semi").drop("regional_median")
    release.write("trend", replaced(before.get("trend"), tr.linear_trend(again), changed, SERIES))
    risky = again.where(F.col("indicator").isin(*risk_indicators))
    release.write("risk", replaced(before.get("risk"), rk.tail_risk_stats(risky), changed, SERIES))
    release.write("extremes", replaced(before.get("extremes"), rk.tail_risk_extremes(risky), changed, SERIES))
    return release.publish()
