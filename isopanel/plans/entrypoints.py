"""Queries that go the whole way: source files, batch tables, documents, and answers to requests.

The source files are written from the test tables, staged, and run through the batch and overview computations as a
user would. A session stages and builds each folder of test tables once; all queries read what was written, so the first
of them takes the time of the build. What was built for a session is forgotten when another one begins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_exact
from ..sinks.tables import work_dir
from ..sources import catalog as c
from . import batch, overview, upkeep
from .cleaning import write_sources
from .narratives import FLOW_TEXT, INSIGHTS, MIX_TEXT, RANKED_TEXT, RISK_TEXT, SUMMARY_TEXT
from .oracle import f, r, sig, with_
from .registry import query
from .testbed import Testbed


@dataclass
class Run:
    datasets: dict[str, DataFrame]
    built: dict[str, DataFrame]
    details: dict[str, DataFrame]
    answers: dict[str, DataFrame]


_runs: dict[tuple[str, str], Run] = {}


def _run(t: Testbed) -> Run:
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _runs:
        for old in [k for k in _runs if k[0] != key[0]]:
            del _runs[old]
        datasets = batch.stage(t.spark, write_sources(t))
        out = work_dir(t.spark)
        dim = t.table("nation").where("n_regionkey <> 3").select(
            F.col("n_name").alias("country"),
            (F.col("n_nationkey") - 12.0).alias("lat"),
            (F.col("n_nationkey") + 150.0).alias("lon"),
        )
        built = batch.build(datasets, out, dim)
        details = batch.enrich(datasets, built, out)
        asked = t.nation_requests.where(F.col("country").isNotNull())
        _runs[key] = Run(datasets, built, details, batch.answer(built, details, asked, "NATION_0"))
    return _runs[key]


@query("batch_build", with_("dim", "aligned", "trend", "labels", standard=True) + f"""
SELECT country, {r('(n_nationkey + 25) / 110.0 * 100', 2)} AS x_pct, indicator, label, unit, chapter, year, value,
       regional_median, slope_per_decade, r_squared
FROM dim JOIN nation ON n_name = country LEFT JOIN (
    SELECT * FROM aligned JOIN trend USING (country, indicator) JOIN labels USING (indicator)
) USING (country)""")
def batch_build(t: Testbed):
    entries = _run(t).built["documents"].select("country", "meta.x_pct", F.explode_outer("indicators").alias("indicator", "record"))
    zipped = F.arrays_zip("record.years", "record.values", "record.regional_median")
    return entries.select("country", "x_pct", "indicator", "record", F.explode_outer(zipped).alias("point")).select(
        "country", "x_pct", "indicator", "record.label", "record.unit", "record.chapter",
        F.col("point.years").alias("year"), F.col("point.values").alias("value"),
        F.col("point.regional_median").alias("regional_median"), "record.trend.slope_per_decade", "record.trend.r_squared",
    )


@query("batch_headline", with_("regional", "labels", standard=True) + f"""
SELECT '{c.HEADLINE_LABEL}' AS label, unit, min(year) AS start_year, max(year) AS end_year,
       arg_min(regional_median, year) AS start_value, arg_max(regional_median, year) AS end_value,
       {r('arg_max(regional_median, year) - arg_min(regional_median, year)', 2)} AS change
FROM regional JOIN labels USING (indicator) WHERE indicator = '{c.HEADLINE_INDICATOR}' GROUP BY unit""")
def batch_headline(t: Testbed):
    return _run(t).built["headline_stat"]


@query("upkeep_series", with_("aligned", standard=True) + "SELECT country, indicator, year, value, regional_median FROM aligned")
def upkeep_series(t: Testbed):
    """All sources in two batches, of which the second one touches many groups of the first."""
    out = work_dir(t.spark)
    late = F.pmod(F.hash(c.PERIOD_COLUMN, c.VALUE_COLUMN), F.lit(3)) == 0
    for part in (~late, late):
        batch_of = {name: rows.where(part) for name, rows in t.raw_sources.items()}
        tables = upkeep.add(t.spark, out, batch_of)
    return tables["series"].select("country", "indicator", "year", "value", "regional_median")


_SECTIONS = """
, sections AS (
    SELECT country, 'products' AS section, indicator AS name, member, year, value FROM product_cells
    UNION ALL SELECT country, 'power_sources', NULL, member, year, value FROM source_cells
    UNION ALL SELECT country, 'power_sankey', target, source, NULL, value FROM links
    UNION ALL SELECT country, 'tail_risk', indicator, 'threshold', NULL, threshold FROM stats
    UNION ALL SELECT country, 'tail_risk', indicator, 'extreme', year, value FROM extremes
)"""


@query("batch_enrich", with_("dim", "product_cells", "source_cells", "links", "stats", "extremes", standard=True)
       + _SECTIONS + "SELECT sections.* FROM sections SEMI JOIN dim USING (country)")
def batch_enrich(t: Testbed):
    from .documents import sections

    return sections(_run(t).details["documents_enriched"])


@query("batch_payload", with_("dim", "nation_requests", "product_cells", "source_cells", "links", "stats", "extremes", standard=True)
       + _SECTIONS + """
, medians AS (SELECT country, indicator, member, median(value) AS median FROM product_cells GROUP BY ALL)
, ranks AS (
    SELECT *, row_number() OVER (PARTITION BY country, indicator ORDER BY median DESC, member) AS up,
           row_number() OVER (PARTITION BY country, indicator ORDER BY median, member DESC) AS down FROM medians
), every AS (
    SELECT * FROM sections
    UNION ALL SELECT country, 'ranked top', indicator, member, CAST(up AS INTEGER), median FROM ranks WHERE up <= 10
    UNION ALL SELECT country, 'ranked bottom', indicator, member, CAST(down AS INTEGER), median FROM ranks WHERE down <= 10
), known AS (
    SELECT coalesce(d.country, 'NATION_0') AS country, q.compare FROM nation_requests q LEFT JOIN dim d USING (country)
), resolved AS (
    SELECT DISTINCT k.country, CASE WHEN k.compare <> k.country THEN coalesce(d.country, '') ELSE '' END AS compare
    FROM known k LEFT JOIN dim d ON d.country = k.compare
), roles AS (
    SELECT country AS "primary", compare, 'primary' AS role, country FROM resolved
    UNION ALL SELECT country, compare, 'compare', compare FROM resolved WHERE compare <> ''
)
SELECT "primary", compare, role, country, section, name, member, year, value FROM every JOIN roles USING (country)""")
def batch_payload(t: Testbed):
    answers = _run(t).answers
    nothing = {"name": F.lit(None).cast("string"), "year": F.lit(None).cast("int")}

    def shown(table: str, **columns) -> DataFrame:
        rows = answers[f"charts_{table}"]
        return rows.select("primary", "compare", "role", "country", *[
            columns.get(name, nothing.get(name, F.col(name) if name in rows.columns else None)).alias(name)
            for name in ("section", "name", "member", "year", "value")
        ])

    parts = [
        shown("products", section=F.lit("products"), name=F.col("indicator"), year=F.col("year")),
        shown("power_sources", section=F.lit("power_sources"), year=F.col("year")),
        shown("power_links", section=F.lit("power_sankey"), name=F.col("target"), member=F.col("source")),
        shown("risk", section=F.lit("tail_risk"), name=F.col("indicator"), member=F.lit("threshold"), value=F.col("threshold")),
        shown("extremes", section=F.lit("tail_risk"), name=F.col("indicator"), member=F.lit("extreme"), year=F.col("year")),
        shown(
            "ranked", section=F.concat_ws(" ", F.lit("ranked"), "side"), name=F.col("indicator"), year=F.col("rank"),
            value=F.col("median"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


_REQUESTS = """
, asked AS (
    SELECT DISTINCT k.country, CASE WHEN k.compare <> k.country THEN coalesce(d.country, '') ELSE '' END AS compare
    FROM (SELECT coalesce(x.country, 'NATION_0') AS country, q.compare FROM nation_requests q LEFT JOIN dim x USING (country)) k
    LEFT JOIN dim d ON d.country = k.compare
), named AS (SELECT country FROM asked UNION SELECT compare FROM asked WHERE compare <> '')"""


@query("batch_insights", with_("dim", "endpoints", "latest", "labels", "nation_requests", standard=True) + _REQUESTS
       + INSIGHTS.replace("FROM nation_requests q", "FROM asked q") + "SELECT country, compare, indicator, text FROM insights")
def batch_insights(t: Testbed):
    return _run(t).answers["insights"]


@query("batch_summary", with_("dim", "endpoints", "latest", "labels", "nation_requests", standard=True) + _REQUESTS
       + INSIGHTS.replace("FROM nation_requests q", "FROM asked q") + SUMMARY_TEXT)
def batch_summary(t: Testbed):
    return _run(t).answers["summary"]


@query("batch_details", with_("dim", "annual", "product_cells", "source_cells", "links", "risk", "labels", "nation_requests", standard=True)
       + _REQUESTS + f"""
, medians AS (SELECT country, indicator, member, median(value) AS median FROM product_cells GROUP BY ALL)
, picks AS (
    SELECT country, indicator, arg_min(member, (-median, member)) AS top, max(median) AS top_value,
           arg_min(member, (median, -rank)) AS bottom, min(median) AS bottom_value
    FROM (SELECT *, row_number() OVER (PARTITION BY country, indicator ORDER BY member) AS rank FROM medians)
    GROUP BY country, indicator
), wanted AS (SELECT country, indicator FROM named, (VALUES ('crop_yield'), ('livestock_yield')) AS v(indicator))
{FLOW_TEXT.facts}
SELECT 'ranked' AS kind, w.country, w.indicator, {RANKED_TEXT} AS text
FROM wanted w JOIN labels USING (indicator) LEFT JOIN picks USING (country, indicator)
UNION ALL SELECT 'tail risk', r.country, indicator, {RISK_TEXT} FROM risk r JOIN labels USING (indicator) SEMI JOIN named USING (country)
UNION ALL SELECT 'mix', country, NULL, {MIX_TEXT.text} FROM named LEFT JOIN ({MIX_TEXT.source}) USING (country)
UNION ALL SELECT 'flow', country, NULL, {FLOW_TEXT.text} FROM named LEFT JOIN facts USING (country)""")
def batch_details(t: Testbed):
    answers = _run(t).answers
    none = F.lit(None).cast("string").alias("indicator")
    kinds = {
        "ranked": answers["ranked_insights"].select("country", "indicator", "text"),
        "tail risk": answers["tail_risk_insights"].select("country", "indicator", "text"),
        "mix": answers["power_mix_insights"].select("country", none, "text"),
        "flow": answers["flow_insights"].select("country", none, "text"),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "*") for kind, df in kinds.items()])


_LINES_SQL = " UNION ALL ".join(
    f"""
    SELECT '{x.indicator}' AS indicator, country, year, value, regional_median
    FROM (SELECT * FROM {'panel' if x.annual is None else 'raw_annual'} WHERE indicator = '{x.indicator}')
    LEFT JOIN (SELECT year, median(value) AS regional_median FROM {'panel' if x.annual is None else 'raw_annual'}
               WHERE indicator = '{x.indicator}' GROUP BY year) USING (year)
    UNION ALL SELECT '{x.indicator}', '{overview.REGION_LABEL}', year, median(value), median(value)
    FROM {'panel' if x.annual is None else 'raw_annual'} WHERE indicator = '{x.indicator}' GROUP BY year"""
    for x in overview.SECTIONS
)


@query("overview_lines", with_("panel", "raw_annual", standard=True) + f"""
SELECT indicator, country, year, {r('value', 4)} AS value, {r('regional_median', 4)} AS regional_median, count(*) AS n
FROM ({_LINES_SQL}) GROUP BY ALL""")
def overview_lines(t: Testbed):
    run = _run(t)
    lines = reduce(DataFrame.unionByName, [overview.comparison(run.datasets, x)[0] for x in overview.SECTIONS])
    shown = lines.select("indicator", "country", "year", "value", "regional_median").groupBy(
        "indicator", "country", "year", "value", "regional_median"
    ).agg(F.count(F.lit(1)).alias("n"))
    return shown.withColumns({name: round_exact(name, 4) for name in ("value", "regional_median")})


@query("overview_tail_risk", with_("panel", "labels", standard=True) + f"""
, limits AS (
    SELECT country, 2 * stddev_samp(value) AS threshold, min(year) AS y0, max(year) AS y1, min(value) AS lo, max(value) AS hi
    FROM panel WHERE indicator = 'rainfall_anomaly' GROUP BY country
), facts AS (
    SELECT country, any_value(threshold) AS threshold, any_value(y0) AS y0, any_value(y1) AS y1, any_value(lo) AS lo,
           any_value(hi) AS hi, count(CASE WHEN value > threshold OR value < -threshold THEN 1 END) AS n,
           min(CASE WHEN value = lo THEN year END) AS lo_year, min(CASE WHEN value = hi THEN year END) AS hi_year
    FROM panel JOIN limits USING (country) WHERE indicator = 'rainfall_anomaly' GROUP BY country
)
SELECT country, n, y0, y1, {r('threshold', 6)} AS threshold, lo, hi, lo_year, hi_year,
       contains(text, '**' || {f(sig('threshold'), 2)} || 'mm**') AS named
FROM facts JOIN (SELECT country, '**' || {f(sig('threshold'), 2)} || 'mm**' AS text FROM facts) USING (country)""")
def overview_tail_risk(t: Testbed):
    from ..functions.numeric import fixed_text, significant
    from ..operators import risk as rk

    section = next(x for x in overview.SECTIONS if x.indicator == "rainfall_anomaly")
    run = _run(t)
    facts = rk.zero_centred_overview(overview.section_rows(run.datasets, section))
    texts = overview.tail_risk(run.datasets, section)[1].select("country", "text")
    named = F.col("text").contains(F.concat(F.lit("**"), fixed_text(significant("threshold"), 2), F.lit("mm**")))
    return facts.join(texts, "country").select(
        "country", F.col("n_extremes").alias("n"), F.col("first_year").alias("y0"), F.col("last_year").alias("y1"),
        round_exact("threshold", 6).alias("threshold"), F.col("min_value").alias("lo"), F.col("max_value").alias("hi"),
        F.col("min_year").alias("lo_year"), F.col("max_year").alias("hi_year"), named.alias("named"),
    )


@query("overview_power", with_("power", "raw_source_cells") + """
, rows AS (
    SELECT country, source, grid AS target, year, value FROM power
    WHERE unit = 'GWH' AND grid IN ('On-grid', 'Off-grid') AND source IS NOT NULL AND country IS NOT NULL
    AND value IS NOT NULL
)
SELECT part, country, name, target, year, """ + r("value", 4) + """ AS value FROM (
    SELECT 'cell' AS part, country, member AS name, CAST(NULL AS VARCHAR) AS target, year, value FROM raw_source_cells
    UNION ALL SELECT 'link', country, source, target, CAST(NULL AS INTEGER), sum(value) FROM rows
    GROUP BY country, source, target)""")
def overview_power(t: Testbed):
    power = overview.power(_run(t).datasets)
    nodes = power["nodes"]
    names = [nodes.select("country", F.col("idx").alias(f"{x}_idx"), F.col("label").alias(x)) for x in ("source", "target")]
    links = power["links"].join(names[0], ["country", "source_idx"]).join(names[1], ["country", "target_idx"])
    none = F.lit(None)
    cells = power["cells"].select(
        F.lit("cell").alias("part"), "country", F.col("member").alias("name"), none.cast("string").alias("target"), "year", "value"
    )
    flows = links.select(
        F.lit("link").alias("part"), "country", F.col("source").alias("name"), "target", none.cast("int").alias("year"), "value"
    )
    return cells.unionByName(flows).withColumn("value", round_exact("value", 4))


@query("overview_products", with_("products", standard=True) + """
, medians AS (
    SELECT country, member, median(value) AS median FROM products WHERE indicator = 'livestock_yield' GROUP BY ALL)
SELECT country, 'top' AS side, CAST(rank AS INTEGER) AS rank, member, median
FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY median DESC, member) AS rank FROM medians) WHERE rank <= 10
UNION ALL SELECT country, 'bottom', CAST(rank AS INTEGER), member, median
FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY median, member DESC) AS rank FROM medians) WHERE rank <= 10""")
def overview_products(t: Testbed):
    return overview.products(_run(t).datasets, "livestock_yield")["ranked"]
