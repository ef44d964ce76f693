"""Nested records per country, and writing them.

The tables themselves are the result at scale; a document holds one country with its series, which are bounded
by the catalogue and the number of years, never data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.breakdown import member_arrays
from ..operators.series import series_arrays

TREND_FIELDS = ("slope_per_decade", "slope_per_year", "intercept", "r_squared", "relative_slope_pct")
LABEL_FIELDS = ("label", "unit", "chapter")


def _map_of(key: str, value: Column | str, name: str) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name)


def indicator_records(aligned: DataFrame, trend: DataFrame, labels: DataFrame) -> DataFrame:
    """One struct per country and indicator: labels, parallel arrays and trend."""
    record = F.struct(*LABEL_FIELDS, "years", "values", "regional_median", F.struct(*TREND_FIELDS).alias("trend"))
    return (
        series_arrays(aligned)
        .join(trend, ["country", "indicator"])
        .join(labels, "indicator")
        .select("country", "indicator", record.alias("record"))
    )


def country_document(dim: DataFrame, aligned: DataFrame, trend: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per country of the dimension: ``country``, ``meta`` and a map of its indicators, maybe empty."""
    records = indicator_records(aligned, trend, labels)
    maps = records.groupBy("country").agg(_map_of("indicator", "record", "indicators"))
    empty = F.create_map().cast(maps.schema["indicators"].dataType)
    meta = F.struct(*[c for c in dim.columns if c != "country"])
    return dim.select("country", meta.alias("meta")).join(maps, "country", "left").select(
        "country", "meta", F.coalesce("indicators", empty).alias("indicators")
    )


def enriched_document(
    document: DataFrame,
    products: DataFrame,
    sources: DataFrame,
    links: DataFrame,
    risk: DataFrame,
    extremes: DataFrame,
    series: DataFrame,
) -> DataFrame:
    """The country document with four more sections. The given document is read, not changed.

    ``products`` has indicator, member, year and value per country, ``sources`` the same without an indicator.
    """
    series_record = F.struct("years", "values")
    per_indicator = (
        member_arrays(products, ["country", "indicator"])
        .groupBy("country", "indicator")
        .agg(_map_of("member", series_record.alias("series"), "members"))
    )
    product_maps = per_indicator.groupBy("country").agg(_map_of("indicator", "members", "products"))
    source_maps = member_arrays(sources).groupBy("country").agg(
        _map_of("member", series_record.alias("series"), "power_sources")
    )
    flows = links.groupBy("country").agg(
        F.struct(F.array_sort(F.collect_list(F.struct("source", "target", "value"))).alias("links")).alias("power_sankey")
    )
    events = extremes.groupBy("country", "indicator").agg(
        F.array_sort(F.collect_list(F.struct("year", "value"))).alias("extremes")
    )
    points = series_arrays(series.withColumn("regional_median", F.lit(None).cast("double")))
    keys = ["country", "indicator"]
    risk_rows = points.select(*keys, "years", "values").join(risk, keys).join(events, keys, "left")
    no_events = F.array().cast("array<struct<year:int,value:double>>")
    risk_record = F.struct(
        "years", "values", "mean", "std", "threshold", F.coalesce("extremes", no_events).alias("extremes")
    )
    risk_maps = risk_rows.groupBy("country").agg(_map_of("indicator", risk_record.alias("risk"), "tail_risk"))

    joined = document
    for section in (product_maps, source_maps, flows, risk_maps):
        joined = joined.join(section, "country", "left")
    empty = {
        "products": F.create_map(),
        "power_sources": F.create_map(),
        "power_sankey": F.struct(F.array().alias("links")),
        "tail_risk": F.create_map(),
    }
    return joined.withColumns(
        {name: F.coalesce(name, value.cast(joined.schema[name].dataType)) for name, value in empty.items()}
    )


def write_documents(document: DataFrame, path: str) -> None:
    """JSON lines, one country per line. The path must not exist yet, so earlier results stay as they are."""
    document.write.mode("errorifexists").json(path)


def read_documents(reference: DataFrame, path: str) -> DataFrame:
    """Documents from JSON lines with the schema of ``reference``."""
    return reference.sparkSession.read.schema(reference.schema).json(path)


def chart_payload(table: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (``country``, ``compare``) the rows of these countries only, with their role.

    Without a compare country (empty text) only the primary one is shipped.
    """
    compare = F.when(F.col("compare") != "", F.struct(F.lit("compare").alias("role"), F.col("compare").alias("country")))
    roles = F.array(F.struct(F.lit("primary").alias("role"), "country"), compare)
    wanted = requests.select(F.col("country").alias("primary"), "compare", F.explode(roles).alias("_r")).where(
        F.col("_r").isNotNull()
    )
    return wanted.select("primary", "compare", F.col("_r.role").alias("role"), F.col("_r.country").alias("country")).join(
        table, "country"
    )
