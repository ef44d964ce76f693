"""Queries that write summary sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breakdown as b
from ..operators import compare as cmp
from ..operators import flows as fl
from ..operators import narrative as n
from ..operators import risk as rk
from ..operators import series as s
from ..operators import trend as tr
from ..sinks.tables import store
from ..sources import observations as o
from .breakdown import flow_leaders_sql, latest_mix_sql, mix_growth_sql
from .oracle import f, sig, with_
from .registry import query
from .series import window_sql
from .testbed import WINDOW_THRESHOLD, Testbed

# The wording in the SQL of this module is that of the texts it checks.
_WORD = "CASE WHEN {0} IS NULL THEN 'held steady' WHEN {0} > 0 THEN 'risen' ELSE 'fallen' END"

INSIGHTS = f"""
, facts AS (
    SELECT q.country, q.compare, e.indicator, l.label, l.unit, l.indicator_order, l.chapter_order, l.chapter_title,
           e.slope_per_decade AS slope, e.first_year, e.last_year, e.fitted_first, e.fitted_last, a.value,
           a.regional_median AS med, b.value AS other, b.slope_per_decade AS other_slope
    FROM nation_requests q
    JOIN endpoints e ON e.country = q.country
    JOIN latest a ON a.country = q.country AND a.indicator = e.indicator
    JOIN labels l ON l.indicator = e.indicator
    LEFT JOIN (SELECT country, indicator, latest.value, slope_per_decade FROM latest
               JOIN trend USING (country, indicator)) b ON b.country = q.compare AND b.indicator = e.indicator
), insights AS (
    SELECT *, CASE WHEN slope IS NULL
        THEN 'Data for ' || lower(label) || ' is too limited for ' || country || ' to establish a trend.'
        ELSE concat_ws(' ',
            'From ' || first_year || ' to ' || last_year || ', ' || country || '''s ' || lower(label) || ' has '
            || {_WORD.format('slope')} || ' at a rate of ' || {f('abs(slope)', 2)} || unit || ' per decade, from roughly '
            || {f(sig('fitted_first'), 2)} || unit || ' to ' || {f(sig('fitted_last'), 2)} || unit || ' along that trend.',
            CASE WHEN abs(value - med) < 1e-6
                THEN 'That''s in line with the regional median of ' || {f('med', 2)} || unit || '.'
                ELSE 'That''s ' || {f(sig('abs(value - med)'), 2)} || unit
                     || CASE WHEN value > med THEN ' above' ELSE ' below' END
                     || ' the regional median (' || {f('med', 2)} || unit || ').' END,
            'By comparison, ' || compare || '''s most recent value is ' || {f(sig('abs(value - other)'), 2)} || unit
            || CASE WHEN value > other THEN ' higher than ' WHEN value < other THEN ' lower than '
                    ELSE ' the same as ' END || country || '''s, and has ' || {_WORD.format('other_slope')}
            || ' over its own recorded period.') END AS text
    FROM facts
)"""


def _insights(t: Testbed):
    requests = cmp.resolve_compare(t.nation_requests, t.countries)
    t = t.stored
    ends = tr.fitted_endpoints(t.trend, s.series_extent(t.annual))
    return n.insight_indicator(n.indicator_facts(ends, cmp.latest_vs_median(t.aligned), t.labels, requests))


@query("insight_indicator", with_("endpoints", "latest", "labels", "nation_requests") + INSIGHTS + """
SELECT country, compare, indicator, text FROM insights""")
def insight_indicator(t: Testbed):
    return _insights(t).select("country", "compare", "indicator", "text")


SUMMARY_TEXT = """
, chapters AS (
    SELECT country, compare, chapter_order,
           '**' || chapter_title || '**: ' || string_agg(text, ' ' ORDER BY indicator_order) AS paragraph
    FROM insights WHERE slope IS NOT NULL GROUP BY country, compare, chapter_order, chapter_title
)
SELECT country, compare, string_agg(paragraph, chr(10) || chr(10) ORDER BY chapter_order) AS text
FROM chapters GROUP BY country, compare"""


@query("insight_summary", with_("endpoints", "latest", "labels", "nation_requests") + INSIGHTS + SUMMARY_TEXT)
def insight_summary(t: Testbed):
    return n.insight_summary(_insights(t))


@query("insight_ranked", with_("product_cells") + f"""
, medians AS (SELECT country, member, median(value) AS median FROM product_cells GROUP BY country, member)
, picks AS (
    SELECT country, arg_min(member, (-median, member)) AS top, max(median) AS top_value,
           arg_min(member, (median, -rank)) AS bottom, min(median) AS bottom_value
    FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY member) AS rank FROM medians) GROUP BY country
)
, places AS (SELECT n_name AS country, n_regionkey FROM nation UNION ALL SELECT r_name, r_regionkey FROM region)
SELECT p.country, 'crop_yield' AS indicator,
       CASE WHEN p.country NOT LIKE 'NATION%' AND n_regionkey > 2 THEN 'No crop yield data is available for ' || p.country || '.'
            WHEN top IS NULL THEN 'Not enough product-level data is available for ' || p.country || '.'
            ELSE 'Across all recorded years, ' || lower(top) || ' has the highest median crop yield in ' || p.country
                 || ' at ' || {f('top_value', 2)} || ' KG/HA, while ' || lower(bottom) || ' has the lowest at '
                 || {f('bottom_value', 2)} || ' KG/HA.' END AS text
FROM places p LEFT JOIN picks USING (country)""")
def insight_ranked(t: Testbed):
    from ..sources.catalog import STANDARD_CATALOG

    medians = b.median_of_years(t.stored.product_cells).withColumn("indicator", F.lit("crop_yield"))
    keys = ["country", "indicator"]
    nations = t.table("nation").select(F.col("n_name").alias("country"), F.lit(True).alias("has_series"))
    regions = t.table("region").select("r_name", F.col("r_regionkey") <= 2)
    countries = nations.union(regions).withColumn("indicator", F.lit("crop_yield"))
    return n.insight_ranked(
        countries,
        STANDARD_CATALOG.frame(t.spark),
        b.rank_members(medians, "top", 1, keys),
        b.rank_members(medians, "bottom", 1, keys),
    )


# For any indicator, where the country's series are in ``annual``.
RANKED_TEXT = f"""
       CASE WHEN NOT EXISTS (SELECT 1 FROM annual a WHERE a.country = w.country AND a.indicator = w.indicator)
                THEN 'No ' || replace(w.indicator, '_', ' ') || ' data is available for ' || w.country || '.'
            WHEN top IS NULL THEN 'Not enough product-level data is available for ' || w.country || '.'
            ELSE 'Across all recorded years, ' || lower(top) || ' has the highest median ' || lower(label) || ' in '
                 || w.country || ' at ' || {f('top_value', 2)} || unit || ', while ' || lower(bottom)
                 || ' has the lowest at ' || {f('bottom_value', 2)} || unit || '.' END"""
RISK_TEXT = f"""
    CASE WHEN r.n_extremes = 0
        THEN r.country || ' has recorded no anomalies beyond ' || {f('r.threshold', 2)} || unit
             || ' from the historical mean (' || {f('r.mean', 2)} || unit || ') -- no extreme ' || lower(label)
             || ' events stand out in this record.'
        ELSE r.country || ' has recorded ' || r.n_extremes || ' extreme ' || lower(label)
             || ' event(s), each more than ' || {f('r.threshold', 2)} || unit || ' from the historical mean ('
             || {f('r.mean', 2)} || unit || '). The most extreme was ' || r.extreme_year || ', at '
             || {f('r.extreme_value', 2)} || unit || '.' END"""


@query("insight_tail_risk", with_("risk", "labels") + f"""
SELECT country, indicator, {RISK_TEXT} AS text FROM risk r JOIN labels USING (indicator)""")
def insight_tail_risk(t: Testbed):
    return n.insight_tail_risk(_risk(t), t.labels)


@query("insight_tail_risk_compare", with_("risk", "labels", "nation_requests") + f"""
SELECT q.country, q.compare, r.indicator, concat_ws(' ', {RISK_TEXT},
    CASE WHEN c.n_extremes = 0
        THEN 'By comparison, ' || q.compare || ' has recorded no anomalies beyond its own threshold of '
             || {f('c.threshold', 2)} || unit || ' from its historical mean (' || {f('c.mean', 2)} || unit || ').'
        WHEN c.n_extremes > 0
        THEN 'By comparison, ' || q.compare || ' has recorded ' || c.n_extremes
             || ' extreme event(s) of its own, the most extreme being ' || c.extreme_year || ' at '
             || {f('c.extreme_value', 2)} || unit || '.' END) AS text
FROM nation_requests q JOIN risk r ON r.country = q.country JOIN labels USING (indicator)
LEFT JOIN risk c ON c.country = q.compare AND c.indicator = r.indicator""")
def insight_tail_risk_compare(t: Testbed):
    return n.insight_tail_risk(_risk(t), t.labels, cmp.resolve_compare(t.nation_requests, t.countries))


def _risk(t: Testbed):
    t = t.stored
    return rk.tail_risk_summary(rk.tail_risk_stats(t.monthly), rk.tail_risk_extremes(t.monthly))


_PLACES = ", places AS (SELECT n_name AS country FROM nation UNION ALL SELECT r_name FROM region)"


def _places(t: Testbed):
    return t.countries.union(t.table("region").select("r_name"))


class MIX_TEXT:
    """Text of the latest mix, and the rows it is made from."""

    source = latest_mix_sql("source_cells")
    text = f"""CASE WHEN leader IS NULL THEN 'No power generation source data is available for ' || country || '.'
       ELSE 'As of ' || latest_year || ', ' || country || '''s power generation was led by ' || lower(leader)
            || ', contributing ' || {f('leader_value', 1)} || ' GWH of ' || {f(sig('total'), 1)} || ' GWH total that year.'
       END"""


@query("insight_power_mix", with_("source_cells") + _PLACES + f"""
SELECT country, {MIX_TEXT.text} AS text FROM places LEFT JOIN ({MIX_TEXT.source}) USING (country)""")
def insight_power_mix(t: Testbed):
    return n.insight_power_mix(_places(t), b.latest_mix(t.source_cells))


_FLOW_FACTS = f"""
, facts AS (
    SELECT country, sum(target_total) AS total, max(CASE WHEN target = 'On-grid' THEN leader END) AS on_leader,
           max(CASE WHEN target = 'On-grid' THEN leader_value END) AS on_value,
           max(CASE WHEN target = 'Off-grid' THEN leader END) AS off_leader,
           max(CASE WHEN target = 'Off-grid' THEN leader_value END) AS off_value
    FROM ({flow_leaders_sql(7)}) GROUP BY country
)"""


class FLOW_TEXT:
    """Text of the flows, and the expression it is made from."""

    facts = _FLOW_FACTS
    text = f"""CASE WHEN total IS NULL THEN 'No power generation flow data is available for ' || country || '.'
       ELSE concat_ws(' ',
           'Across the recorded period, ' || country || ' generated ' || {f(sig('total'), 1)} || ' GWH in total.',
           on_leader || ' leads On-grid supply at ' || {f('on_value', 1)} || ' GWH.',
           off_leader || ' leads Off-grid supply at ' || {f('off_value', 1)} || ' GWH.') END"""


@query("insight_flow", with_("links") + _PLACES + _FLOW_FACTS + f"""
SELECT country, {FLOW_TEXT.text} AS text FROM places LEFT JOIN facts USING (country)""")
def insight_flow(t: Testbed):
    return n.insight_flow(_places(t), fl.flow_leaders(t.links))


def _phrase(p: str = "") -> str:
    overall, start, end = (
        f"{f(sig(p + name), 2)} || unit" for name in ("overall", "start_figure", "end_figure")
    )
    return f"""CASE {p}trend
        WHEN 'short' THEN 'an average of ' || {overall} || ' throughout the period'
        WHEN 'rising' THEN 'a significant increasing trend, from ' || {start} || ' to ' || {end} || ' in recent years'
        WHEN 'falling' THEN 'a significant decreasing trend, from ' || {start} || ' to ' || {end} || ' in recent years'
        ELSE 'a relatively stable trend, with an average around ' || {start} END"""


@query("insight_comparison", with_("raw_monthly", "monthly_region", "labels") + f"""
, own AS ({window_sql('avg', 'raw_monthly')})
, region AS (
    SELECT indicator, trend AS r_trend, overall AS r_overall, start_figure AS r_start_figure,
           end_figure AS r_end_figure
    FROM ({window_sql('avg', 'monthly_region', 'indicator')})
)
, range AS (
    SELECT country, indicator, min(year) AS y0, max(year) AS y1, min(value) AS lo, max(value) AS hi,
           arg_min(year, (value, year)) AS lo_year, arg_min(year, (-value, year)) AS hi_year,
           arg_max(value, year) AS last_value
    FROM raw_monthly GROUP BY country, indicator
)
, base AS (SELECT indicator, arg_max(value, year) AS base_value FROM monthly_region GROUP BY indicator)
SELECT country, indicator, '
### Dynamic Insight for ' || country || ' (' || label || '):

**Overview (' || y0 || '-' || y1 || '):**

Between ' || y0 || ' and ' || y1 || ', ' || country || ' has experienced ' || {_phrase()} || '. Values ranged from a low
of **' || {f('lo', 2)} || unit || '** (around ' || lo_year || ') to a high of **' || {f('hi', 2)} || unit
|| '** (around ' || hi_year || ').

During the same period, the **regional median** has shown ' || {_phrase('r_')} || '.

**Comparison:**

' || country || '''s recent values ' || CASE WHEN last_value > base_value + {WINDOW_THRESHOLD} THEN 'are notably higher than'
    WHEN last_value < base_value - {WINDOW_THRESHOLD} THEN 'are notably lower than' ELSE 'closely align with' END
|| ' the regional median. 
' AS text
FROM range JOIN own USING (country, indicator) JOIN region USING (indicator) JOIN base USING (indicator)
JOIN labels USING (indicator)""")
def insight_comparison(t: Testbed):
    t = t.stored
    baseline = s.regional_of_series(t.raw_monthly)
    regional_series = baseline.select("indicator", "year", F.col("regional_median").alias("value"))
    return n.insight_comparison(
        s.series_extent(t.raw_monthly),
        tr.window_trend(t.raw_monthly, WINDOW_THRESHOLD),
        tr.window_trend(regional_series, WINDOW_THRESHOLD, keys=["indicator"]),
        cmp.baseline_position(t.raw_monthly, baseline, WINDOW_THRESHOLD),
        t.labels,
    )


@query("insight_tail_risk_script", with_("anomalies", "zero_thresholds") + f"""
, facts AS (
    SELECT country, indicator, min(year) AS y0, max(year) AS y1, min(value) AS lo, max(value) AS hi,
           arg_min(year, (value, year)) AS lo_year, arg_min(year, (-value, year)) AS hi_year,
           any_value(threshold) AS threshold,
           count(CASE WHEN value > threshold OR value < -threshold THEN 1 END) AS n
    FROM anomalies JOIN zero_thresholds USING (country, indicator) GROUP BY country, indicator
)
SELECT country, indicator, '
### Dynamic Insight for ' || country || ' (Historical Tail-Risk Analysis - Price Anomaly):

**Overview (' || y0 || '-' || y1 || '):**

Extreme events are defined as anomalies exceeding **' || {f(sig('threshold'), 2)} || ' USD** above or below average
(two standard deviations from the historical mean).

**Key Observations:**

* **Number of Extreme Events:** ' || n || '
* **Highest Anomaly:** ' || {f('hi', 2)} || ' USD in ' || hi_year || '
* **Lowest Anomaly:** ' || {f('lo', 2)} || ' USD in ' || lo_year || '
' AS text
FROM facts""")
def insight_tail_risk_script(t: Testbed):
    labels = t.spark.createDataFrame([("anomaly", "Price Anomaly", " USD")], "indicator string, label string, unit string")
    return n.insight_tail_risk_overview(rk.zero_centred_overview(t.anomalies), labels)


@query("insight_mix_growth", with_("raw_source_cells") + f"""
SELECT country, '
### Dynamic Insight for ' || country || ' (Power Generation Mix):

Between ' || start_year || ' and ' || g.latest_year || ', ' || country
|| '''s power generation has shown a general ' || status || '.
As of ' || g.latest_year || ', total generation reached **' || {f(sig('total'), 1)} || ' GWH**, led by **' || leader || '**
(' || {f('leader_value', 1)} || ' GWH).
' AS text
FROM ({mix_growth_sql('raw_source_cells')}) g JOIN ({latest_mix_sql('raw_source_cells', 7)}) m USING (country)""")
def insight_mix_growth(t: Testbed):
    cells = t.stored.raw_source_cells
    return n.insight_mix_growth(b.mix_growth(cells), b.latest_mix(cells))


@query("insight_flow_script", with_("power") + f"""
, rows AS (
    SELECT country, source, grid AS target, year, value FROM power
    WHERE unit = 'GWH' AND grid IN ('On-grid', 'Off-grid') AND source IS NOT NULL AND country IS NOT NULL
    AND value IS NOT NULL
), links AS (SELECT country, source, target, sum(value) AS value FROM rows GROUP BY ALL)
, years AS (SELECT country, min(year) AS y0, max(year) AS y1 FROM rows GROUP BY country)
{_FLOW_FACTS}
SELECT country, '
### Dynamic Insight for ' || country || '''s Power Generation Flow (' || y0 || '-' || y1 || '):

Total power generation across On-grid and Off-grid was **' || {f(sig('total'), 1)} || ' GWH**.
' || coalesce('**' || on_leader || '** leads On-grid supply.', 'No significant On-grid generation.') || ' '
|| coalesce('**' || off_leader || '** leads Off-grid supply.', 'No significant Off-grid generation.') || '
' AS text
FROM facts JOIN years USING (country)""")
def insight_flow_script(t: Testbed):
    links = store(fl.flow_links_with_years(o.load_flow_rows_with_year(t.raw_power)), "links")
    return n.insight_flow_overview(fl.flow_leaders(links), fl.flow_years(links))
