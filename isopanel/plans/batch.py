"""From a folder of observation files to result tables and documents, and from those to answers.

Each step reads what the step before has written, so no step's result depends on the lifetime of an executor. The
tables of a build are a release of the output folder: they are written aside and become current together, so a build
that was ended at any place is simply run again, and readers never see tables of two builds.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import breakdown as b
from ..operators import compare as cmp
from ..operators import flows as fl
from ..operators import narrative as n
from ..operators import power as pw
from ..operators import risk as rk
from ..operators import series as s
from ..operators import trend as tr
from ..sinks import releases
from ..sinks.documents import chart_payload, country_document, enriched_document
from ..sinks.releases import Release
from ..sinks.tables import store
from ..sources import catalog as c
from ..sources import cleaning as cl
from ..sources import observations as o
from ..sources.countries import project_map_xy, standard_countries

#: Detail tables that a request's charts show, with the rankings made for them.
CHART_TABLES = ("products", "power_sources", "power_links", "risk", "extremes")
#: Countries of requests that are looked up by name, each in its own files; with more of them tables are read whole.
NAMES = 1_000


def stage(
    spark: SparkSession, root: str, files: Mapping[str, str] = c.SOURCE_FILES
) -> dict[str, DataFrame]:
    """Source files as Parquet, so that each is parsed once however many results read it.

    Lines that don't fit their header are kept whole in a column of their own, for the quarantine.
    """
    return {name: store(df, name) for name, df in o.scan_many(spark, root, files, corrupt=cl.CORRUPT).items()}


def build(
    datasets: Mapping[str, DataFrame],
    out: str,
    dim: DataFrame | None = None,
    catalog: c.Catalog = c.STANDARD_CATALOG,
) -> dict[str, DataFrame]:
    """Annual series with regional medians, trends, headline figures and one document per country, as a release of ``out``.

    Rows that can't be used are released too, with their reasons (``quarantine``), and counted (``cleaning``).
    """
    spark = next(iter(datasets.values())).sparkSession
    dim = standard_countries(spark) if dim is None else dim
    cleaned = cl.clean_panels(datasets, catalog)
    sketches = s.panel_sketches(cl.by_aggregate(cleaned.rows, catalog))
    regional = store(s.regional_median(sketches), "regional")
    series = s.align_regional(s.annual_panel(sketches), regional)
    labels = catalog.frame(spark)
    headline = store(s.headline_change(regional), "headline")
    release = Release(spark, out)
    release.write("cleaning", cleaned.counts)
    release.write("quarantine", cleaned.quarantine)
    series = release.write("series", series)
    trend = release.write("trend", tr.linear_trend(series))
    release.write("headline", headline)
    release.write("headline_stat", s.headline_stat(headline, labels, c.HEADLINE_INDICATOR, c.HEADLINE_LABEL))
    countries = release.write("countries", project_map_xy(dim))
    labels = release.write("catalog", labels)
    release.write("documents", country_document(countries, series, trend, labels), "json")
    return release.publish()


def enrich(
    datasets: Mapping[str, DataFrame],
    built: Mapping[str, DataFrame],
    out: str,
    product_indicators: tuple[str, ...] = c.PRODUCT_INDICATORS,
    risk_indicators: tuple[str, ...] = c.TAIL_RISK_INDICATORS,
    catalog: c.Catalog = c.STANDARD_CATALOG,
) -> dict[str, DataFrame]:
    """Product, energy source, flow and tail-risk tables, and documents with those sections, as a release of ``out``.

    The first batch is read and left as it is; its tables are taken over into the release.
    """
    rows = [
        o.load_products(datasets[catalog[name].source], catalog[name].rows).withColumn("indicator", F.lit(name))
        for name in product_indicators
    ]
    keys = ["country", "indicator"]
    power = pw.power_cells(datasets[catalog["power_generation"].source])
    risky = built["series"].where(F.col("indicator").isin(*risk_indicators)).drop("regional_median")
    release = Release(built["series"].sparkSession, out)
    tables = {
        name: release.write(name, table)
        for name, table in {
            "products": b.member_annual(reduce(DataFrame.unionByName, rows), "median", keys),
            "power_sources": b.member_annual(pw.source_rows(power), "sum"),
            "power_links": fl.flow_links(pw.flow_rows(power)),
            "risk": rk.tail_risk_stats(risky),
            "extremes": rk.tail_risk_extremes(risky),
        }.items()
    }
    document = enriched_document(
        built["documents"], tables["products"], tables["power_sources"], tables["power_links"], tables["risk"],
        tables["extremes"], risky,
    )
    release.write("documents_enriched", document, "json")
    published = release.publish()
    return {name: published[name] for name in (*tables, "documents_enriched")}


def answer(
    built: Mapping[str, DataFrame],
    details: Mapping[str, DataFrame],
    requests: DataFrame,
    default: str = c.DEFAULT_COUNTRY,
    product_indicators: tuple[str, ...] = c.PRODUCT_INDICATORS,
) -> dict[str, DataFrame]:
    """Texts, rankings and chart rows for a table of requests (``country``, ``compare``).

    Any number of requests is answered at once; they are joined to the tables by country. ``charts`` has the series and
    ``charts_<table>`` the products, sources, flows, tail risk and rankings, each for the primary and the compare
    country with its role.
    """
    dim, series, labels = built["countries"], built["series"], built["catalog"]
    asked = cmp.resolve_compare(cmp.country_or_default(requests, dim, default), dim)
    asked = asked.select("country", "compare").distinct()
    named = (
        asked.select("country").union(asked.where(F.col("compare") != "").select("compare")).distinct()
    )

    endpoints = tr.fitted_endpoints(built["trend"], s.series_extent(series))
    insights = n.insight_indicator(n.indicator_facts(endpoints, cmp.latest_vs_median(series), labels, asked))
    keys = ["country", "indicator"]
    medians = b.median_of_years(details["products"], keys).join(named, "country", "left_semi")
    ranked = {side: store(b.rank_members(medians, side, keys=keys), side) for side in ("top", "bottom")}
    both = ranked["top"].unionByName(ranked["bottom"])
    extended = {**{name: details[name] for name in CHART_TABLES}, "ranked": both}
    has_series = series.select(*keys).distinct().withColumn("_has", F.lit(True))
    wanted = named.withColumn("indicator", F.explode(F.array(*[F.lit(i) for i in product_indicators])))
    wanted = wanted.join(has_series, keys, "left").select(
        *keys, F.coalesce("_has", F.lit(False)).alias("has_series")
    )
    risk = rk.tail_risk_summary(details["risk"], details["extremes"]).join(named, "country", "left_semi")
    return {
        "insights": insights.select("country", "compare", "indicator", "text"),
        "summary": n.insight_summary(insights),
        "ranked": both,
        "ranked_insights": n.insight_ranked(wanted, labels, ranked["top"], ranked["bottom"]),
        "tail_risk_insights": n.insight_tail_risk(risk, labels),
        "power_mix_insights": n.insight_power_mix(named, b.latest_mix(details["power_sources"])),
        "flow_insights": n.insight_flow(named, fl.flow_leaders(details["power_links"])),
        "charts": chart_payload(series, asked),
        **{f"charts_{name}": chart_payload(table, asked) for name, table in extended.items()},
    }


def requested(requests: DataFrame, dim: DataFrame, default: str = c.DEFAULT_COUNTRY, most: int = NAMES) -> list[str] | None:
    """Names of all countries that the requests ask for, or None if there are more than ``most``."""
    asked = cmp.resolve_compare(cmp.country_or_default(requests, dim, default), dim)
    names = asked.select("country").union(asked.select("compare")).where("country <> ''").distinct().limit(most + 1).collect()
    return None if len(names) > most else sorted(r[0] for r in names)


def payload(
    spark: SparkSession, out: str, requests: DataFrame, table: str = "series", default: str = c.DEFAULT_COUNTRY
) -> DataFrame:
    """Chart rows of one table of the current release for the requests. Only the asked countries' files are read."""
    entries = releases.current(spark, out)
    dim = releases.read_entry(spark, out, entries["countries"])
    asked = cmp.resolve_compare(cmp.country_or_default(requests, dim, default), dim)
    rows = releases.read_entry(spark, out, entries[table], requested(requests, dim, default))
    return chart_payload(rows, asked.select("country", "compare").distinct())


def answer_from(
    spark: SparkSession, out: str, requests: DataFrame, default: str = c.DEFAULT_COUNTRY
) -> dict[str, DataFrame]:
    """:func:`answer` from the current release, of which only the asked countries' files are read."""
    entries = releases.current(spark, out)
    dim = releases.read_entry(spark, out, entries["countries"])
    names = requested(requests, dim, default)
    found = {name: releases.read_entry(spark, out, entry, names) for name, entry in entries.items()}
    found["countries"] = dim
    return answer(found, found, requests, default)
