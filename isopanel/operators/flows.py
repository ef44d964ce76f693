"""Source-to-target flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import first_by, round_exact

COUNTRY = ("country",)


def flow_links(rows: DataFrame, keys: Sequence[str] = COUNTRY, digits: int | None = 2) -> DataFrame:
    """Total per source and target over all years."""
    present = rows.dropna(subset=[*keys, "source", "target", "value"])
    links = present.groupBy(*keys, "source", "target").agg(F.sum("value").alias("value"))
    return links if digits is None else links.withColumn("value", round_exact("value", digits))


def flow_links_with_years(rows: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Unrounded total per source and target with the first and the last year, in one pass."""
    present = rows.dropna(subset=[*keys, "source", "target", "value"])
    return present.groupBy(*keys, "source", "target").agg(
        F.sum("value").alias("value"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


def flow_years(links: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """First and last year of all links of a country."""
    return links.groupBy(*keys).agg(F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"))


def flow_nodes(links: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Distinct sources and targets of each country."""
    sources = links.select(*keys, F.col("source").alias("label"))
    targets = links.select(*keys, F.col("target").alias("label"))
    return sources.union(targets).distinct()


def flow_index_nodes(links: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Nodes numbered from 0: sources by name, then targets in the order in which the links, sorted by source and
    target, first name them. A target that is also a source keeps its source number.

    Links are totals, so a country has one row per source and target here, not its data rows.
    """
    sources = links.groupBy(*keys, F.col("source").alias("label")).agg(
        F.lit(0).alias("_side"), F.min(F.struct(F.col("source").alias("a"), F.lit("").alias("b"))).alias("_seen")
    )
    targets = links.groupBy(*keys, F.col("target").alias("label")).agg(
        F.lit(1).alias("_side"), F.min(F.struct(F.col("source").alias("a"), F.col("target").alias("b"))).alias("_seen")
    )
    first_seen = (
        sources.unionByName(targets).groupBy(*keys, "label").agg(F.min(F.struct("_side", "_seen")).alias("_first"))
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1
    return first_seen.select(*keys, number.alias("idx"), "label")


def flow_link_nodes(links: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Nodes numbered from 0 as the links, sorted by source and target, name them: source first, then target."""

    def named(label: str, side: int) -> DataFrame:
        place = F.struct(F.col("source").alias("a"), F.col("target").alias("b"), F.lit(side).alias("side"))
        return links.groupBy(*keys, F.col(label).alias("label")).agg(F.min(place).alias("_first"))

    first_named = named("source", 0).unionByName(named("target", 1)).groupBy(*keys, "label").agg(F.min("_first").alias("_first"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_first")) - 1
    return first_named.select(*keys, number.alias("idx"), "label")


def flow_indexed(links: DataFrame, keys: Sequence[str] = COUNTRY, nodes: DataFrame | None = None) -> DataFrame:
    """Links with node numbers in place of names; by default those of ``flow_index_nodes``."""
    nodes = flow_index_nodes(links, keys) if nodes is None else nodes
    sources = nodes.select(*keys, F.col("label").alias("source"), F.col("idx").alias("source_idx"))
    targets = nodes.select(*keys, F.col("label").alias("target"), F.col("idx").alias("target_idx"))
    return (
        links.join(sources, [*keys, "source"])
        .join(targets, [*keys, "target"])
        .select(*keys, "source_idx", "target_idx", "value")
    )


def flow_leaders(links: DataFrame, keys: Sequence[str] = COUNTRY) -> DataFrame:
    """Leading source per target (first by name on ties), its figure and the total of the target."""
    return links.groupBy(*keys, "target").agg(
        first_by("source", -F.col("value"), F.col("source")).alias("leader"),
        F.max("value").alias("leader_value"),
        F.sum("value").alias("target_total"),
    )
