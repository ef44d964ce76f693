"""Queries over nested documents, written out and read back."""

from __future__ import annotations

from posixpath import join

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..operators import risk as rk
from ..sinks import documents as d
from ..sinks.releases import Release
from ..sinks.tables import work_dir
from . import batch
from .oracle import with_
from .registry import query
from .testbed import Testbed


def _document(t: Testbed) -> DataFrame:
    t = t.stored
    return d.country_document(t.dim, t.aligned, t.trend, t.labels)


def _enriched(t: Testbed, document: DataFrame) -> DataFrame:
    t = t.stored
    return d.enriched_document(
        document,
        t.product_cells.withColumn("indicator", F.lit("crop_yield")),
        t.source_cells,
        t.links,
        rk.tail_risk_stats(t.monthly),
        rk.tail_risk_extremes(t.monthly),
        t.monthly,
    )


def _written(t: Testbed, document: DataFrame, name: str) -> DataFrame:
    path = join(work_dir(t.spark), name)
    d.write_documents(document, path)
    return d.read_documents(document, path)


@query("sink_country_document", with_("dim", "aligned", "trend", "labels") + """
SELECT country, area, indicator, label, unit, chapter, year, value, regional_median, slope_per_decade, r_squared
FROM dim LEFT JOIN (
    SELECT * FROM aligned JOIN trend USING (country, indicator) JOIN labels USING (indicator)
) USING (country)""")
def sink_country_document(t: Testbed):
    document = _written(t, _document(t), "countries")
    entries = document.select("country", "meta.area", F.explode_outer("indicators").alias("indicator", "record"))
    points = entries.select(
        "country", "area", "indicator", "record",
        F.explode_outer(F.arrays_zip("record.years", "record.values", "record.regional_median")).alias("point"),
    )
    return points.select(
        "country", "area", "indicator", "record.label", "record.unit", "record.chapter",
        F.col("point.years").alias("year"), F.col("point.values").alias("value"),
        F.col("point.regional_median").alias("regional_median"),
        F.col("record.trend.slope_per_decade").alias("slope_per_decade"),
        F.col("record.trend.r_squared").alias("r_squared"),
    )


@query("sink_enriched_document", with_("dim", "product_cells", "source_cells", "links", "stats", "extremes") + """
, sections AS (
    SELECT country, 'products' AS section, 'crop_yield' AS name, member, year, value FROM product_cells
    UNION ALL SELECT country, 'power_sources', NULL, member, year, value FROM source_cells
    UNION ALL SELECT country, 'power_sankey', target, source, NULL, value FROM links
    UNION ALL SELECT country, 'tail_risk', indicator, 'threshold', NULL, threshold FROM stats
    UNION ALL SELECT country, 'tail_risk', indicator, 'extreme', year, value FROM extremes
)
SELECT sections.* FROM sections SEMI JOIN dim USING (country)""")
def sink_enriched_document(t: Testbed):
    return sections(_written(t, _enriched(t, _written(t, _document(t), "countries")), "countries_enriched"))


def sections(document: DataFrame) -> DataFrame:
    """The added sections of enriched documents as rows."""
    none = F.lit(None).cast("string")

    def series(section: str, members: DataFrame) -> DataFrame:
        points = members.select(
            "country", "name", "member", F.explode(F.arrays_zip("series.years", "series.values")).alias("p")
        )
        return points.select(
            "country", F.lit(section).alias("section"), "name", "member", F.col("p.years").alias("year"),
            F.col("p.values").alias("value"),
        )

    products = document.select("country", F.explode("products").alias("name", "members")).select(
        "country", "name", F.explode("members").alias("member", "series")
    )
    sources = document.select("country", none.alias("name"), F.explode("power_sources").alias("member", "series"))
    links = document.select("country", F.explode("power_sankey.links").alias("l")).select(
        "country", F.lit("power_sankey").alias("section"), F.col("l.target").alias("name"),
        F.col("l.source").alias("member"), F.lit(None).cast("int").alias("year"), F.col("l.value").alias("value"),
    )
    risks = document.select("country", F.explode("tail_risk").alias("name", "risk"))
    thresholds = risks.select(
        "country", F.lit("tail_risk").alias("section"), "name", F.lit("threshold").alias("member"),
        F.lit(None).cast("int").alias("year"), F.col("risk.threshold").alias("value"),
    )
    events = risks.select("country", "name", F.explode("risk.extremes").alias("e")).select(
        "country", F.lit("tail_risk").alias("section"), "name", F.lit("extreme").alias("member"), "e.year", "e.value"
    )
    parts = [series("power_sources", sources), links, thresholds, events]
    result = series("products", products)
    for part in parts:
        result = result.unionByName(part)
    return result


@query("enrich_results", with_("dim", "annual", "product_cells", "source_cells", "links", "extremes") + """
SELECT country, area, (SELECT count(*) FROM annual a WHERE a.country = dim.country) AS n_points,
       (SELECT count(*) FROM product_cells p WHERE p.country = dim.country) AS n_product_cells,
       (SELECT count(*) FROM source_cells s WHERE s.country = dim.country) AS n_source_cells,
       (SELECT count(*) FROM links l WHERE l.country = dim.country) AS n_links,
       (SELECT count(*) FROM extremes e WHERE e.country = dim.country) AS n_extremes
FROM dim""")
def enrich_results(t: Testbed):
    document = _enriched(t, _document(t))

    def total(parts, size):
        return F.aggregate(F.map_values(parts), F.lit(0).cast("bigint"), lambda acc, x: acc + size(x))

    return document.select(
        "country",
        "meta.area",
        total("indicators", lambda r: F.size(r.getField("years"))).alias("n_points"),
        total(
            "products",
            lambda members: F.aggregate(
                F.map_values(members), F.lit(0).cast("bigint"), lambda acc, x: acc + F.size(x.getField("years"))
            ),
        ).alias("n_product_cells"),
        total("power_sources", lambda r: F.size(r.getField("years"))).alias("n_source_cells"),
        F.size("power_sankey.links").cast("bigint").alias("n_links"),
        total("tail_risk", lambda r: F.size(r.getField("extremes"))).alias("n_extremes"),
    )


@query("chart_payload", with_("aligned", "nation_requests") + """
, roles AS (
    SELECT country AS "primary", compare, 'primary' AS role, country FROM nation_requests
    UNION ALL SELECT country, compare, 'compare', compare FROM nation_requests WHERE compare <> ''
)
SELECT "primary", compare, role, country, indicator, year, value, regional_median
FROM aligned JOIN roles USING (country)""")
def chart_payload(t: Testbed):
    out = work_dir(t.spark)
    release = Release(t.spark, out)
    release.write("series", t.aligned)
    release.write("countries", t.countries)
    release.publish()
    return batch.payload(t.spark, out, t.nation_requests, default="NATION_0").select(
        "primary", "compare", "role", "country", "indicator", "year", "value", "regional_median"
    )


@query("flagship", with_("aligned", "trend") + """
SELECT country, indicator, n, slope_per_decade, r_squared, relative_slope_pct, last_year, last_value, last_median
FROM trend JOIN (
    SELECT country, indicator, max(year) AS last_year, arg_max(value, year) AS last_value,
           arg_max(regional_median, year) AS last_median
    FROM aligned GROUP BY country, indicator
) USING (country, indicator)""")
def flagship(t: Testbed):
    t = t.stored
    latest = cmp.latest_vs_median(t.aligned).select(
        "country", "indicator", F.col("year").alias("last_year"), F.col("value").alias("last_value"),
        F.col("regional_median").alias("last_median"),
    )
    figures = t.trend.select("country", "indicator", "n", "slope_per_decade", "r_squared", "relative_slope_pct")
    return figures.join(latest, ["country", "indicator"])
