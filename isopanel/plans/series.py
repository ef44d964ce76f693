"""Queries over annual series, baselines, trends, risk and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_exact
from ..operators import compare as cmp
from ..operators import risk as rk
from ..operators import series as s
from ..operators import trend as tr
from ..sinks.tables import store
from ..sources import catalog as c
from ..sources import observations as o
from .oracle import r, with_
from .registry import query
from .testbed import CATALOG, REGION_LABEL, WINDOW_THRESHOLD, Testbed

KEYS = ("country", "indicator")


def _orders_panel(t: Testbed):
    return t.orders.select("country", F.lit("order_value").alias("indicator"), "year", "value")


@query("annual_series_median", with_("orders_obs") + f"""
SELECT country, 'order_value' AS indicator, year, {r('median(value)', 3)} AS value
FROM orders_obs GROUP BY country, year""")
def annual_series_median(t: Testbed):
    return s.annual_series(_orders_panel(t), "median")


@query("annual_series_sum", with_("line_obs") + f"""
SELECT country, 'shipped_quantity' AS indicator, year, {r('sum(value)', 3)} AS value
FROM line_obs GROUP BY country, year""")
def annual_series_sum(t: Testbed):
    return s.annual_series(t.shipped, "sum")


@query("annual_panel", with_("annual") + "SELECT * FROM annual")
def annual_panel(t: Testbed):
    return t.annual


@query("regional_median_raw", with_("regional") + "SELECT * FROM regional")
def regional_median_raw(t: Testbed):
    return s.regional_median(t.panel)


@query("regional_median_of_countries", with_("raw_annual") + f"""
SELECT indicator, year, {r('median(value)', 4)} AS regional_median FROM raw_annual GROUP BY indicator, year""")
def regional_median_of_countries(t: Testbed):
    return s.regional_of_series(t.raw_annual, digits=4)


@query("regional_mean", with_("panel") + f"""
SELECT indicator, year, {r('avg(value)', 3)} AS regional_median FROM panel GROUP BY indicator, year""")
def regional_mean(t: Testbed):
    return s.regional_mean(t.panel, digits=3)


@query("join_regional_baseline", with_("orders_obs") + f"""
, baseline AS (SELECT year, {r('median(value)', 3)} AS regional_median FROM orders_obs GROUP BY year)
SELECT country, 'order_value' AS indicator, year, value, regional_median
FROM orders_obs LEFT JOIN baseline USING (year)""")
def join_regional_baseline(t: Testbed):
    rows = _orders_panel(t)
    return s.align_regional(rows, store(s.regional_median(rows), "regional"))


@query("align_regional_median", with_("aligned") + "SELECT * FROM aligned")
def align_regional_median(t: Testbed):
    return t.aligned


@query("join_country_dim", with_("aligned", "dim") + """
SELECT country, area, indicator, year, value, regional_median FROM dim LEFT JOIN aligned USING (country)""")
def join_country_dim(t: Testbed):
    return cmp.join_country_dim(t.dim, t.aligned)


@query("linear_trend", with_("trend") + f"""
SELECT country, indicator, n, slope_per_decade, {r('slope_per_year', 6)} AS slope_per_year,
       {r('intercept', 5)} AS intercept, r_squared, relative_slope_pct FROM trend""")
def linear_trend(t: Testbed):
    return t.trend.withColumns(
        {"slope_per_year": round_exact("slope_per_year", 6), "intercept": round_exact("intercept", 5)}
    )


_FLAT = """
, flat AS (
    SELECT country, indicator, year, CASE WHEN country LIKE '%3' THEN 0.0 WHEN country LIKE '%4' THEN 42.5
           ELSE value END AS value
    FROM annual
)"""


def _flat(t: Testbed):
    """Series of which some are all zero and some constant."""
    country = F.col("country")
    value = F.when(country.endswith("3"), 0.0).when(country.endswith("4"), 42.5).otherwise(F.col("value"))
    return t.annual.withColumn("value", value)


@query("trend_r2", with_("annual") + _FLAT + f"""
SELECT country, indicator, CASE WHEN count(*) >= 3 THEN CASE WHEN min(value) = max(value) THEN 0.0
       ELSE {r('regr_r2(value, year - 2000)', 3)} END END AS r_squared
FROM flat GROUP BY country, indicator""")
def trend_r2(t: Testbed):
    return tr.linear_trend(_flat(t)).select(*KEYS, "r_squared")


@query("relative_slope", with_("annual") + _FLAT + f"""
SELECT country, indicator, CASE WHEN count(*) >= 3 AND avg(abs(value)) > 1e-9
       THEN {r('regr_slope(value, year - 2000) * 10 / avg(abs(value)) * 100', 2)} END AS relative_slope_pct
FROM flat GROUP BY country, indicator""")
def relative_slope(t: Testbed):
    return tr.linear_trend(_flat(t)).select(*KEYS, "relative_slope_pct")


@query("fitted_endpoints", with_("endpoints") + f"""
SELECT country, indicator, first_year, last_year, {r('fitted_first', 5)} AS fitted_first,
       {r('fitted_last', 5)} AS fitted_last FROM endpoints""")
def fitted_endpoints(t: Testbed):
    t = t.stored
    ends = tr.fitted_endpoints(t.trend, s.series_extent(t.annual))
    return ends.select(
        *KEYS, "first_year", "last_year", round_exact("fitted_first", 5).alias("fitted_first"),
        round_exact("fitted_last", 5).alias("fitted_last"),
    )


@query("headline_change", with_("regional") + f"""
, ends AS (
    SELECT indicator, min(year) AS start_year, max(year) AS end_year, arg_min(regional_median, year) AS start_value,
           arg_max(regional_median, year) AS end_value
    FROM regional GROUP BY indicator
)
SELECT *, {r('end_value - start_value', 2)} AS change FROM ends""")
def headline_change(t: Testbed):
    return s.headline_change(t.regional)


@query("series_extent", with_("extent") + "SELECT * FROM extent")
def series_extent(t: Testbed):
    return s.series_extent(t.annual)


@query("last_point", with_("orders_obs") + """
SELECT country, 'order_value' AS indicator, year, value FROM orders_obs
QUALIFY row_number() OVER (PARTITION BY country ORDER BY year DESC, value DESC) = 1""")
def last_point(t: Testbed):
    return s.last_point(_orders_panel(t))


@query("first_n_last_n", with_("orders_obs") + """
, numbered AS (
    SELECT country, year, value, row_number() OVER (PARTITION BY country ORDER BY year, value) AS a,
           row_number() OVER (PARTITION BY country ORDER BY year DESC, value DESC) AS d
    FROM orders_obs
)
SELECT country, 'first' AS side, CAST(a AS INTEGER) AS position, year, value FROM numbered WHERE a <= 10
UNION ALL SELECT country, 'last', CAST(d AS INTEGER), year, value FROM numbered WHERE d <= 10""")
def first_n_last_n(t: Testbed):
    first, last = s.first_n_last_n(_orders_panel(t), 10)
    both = first.withColumn("side", F.lit("first")).union(last.withColumn("side", F.lit("last")))
    return both.select("country", "side", "position", "year", "value")


_LONG_AND_SHORT = """
, mixed AS (
    SELECT country, indicator, year, value FROM raw_monthly
    UNION ALL SELECT country, indicator, year, value FROM raw_annual WHERE indicator = 'early_order_value'
)"""


def _long_and_short(t: Testbed):
    rows = c.tag_indicators(t.orders, [CATALOG["early_order_value"]], "country", "year", "value")
    return store(t.raw_monthly.unionByName(s.annual_series(rows, "median", digits=None)), "long_and_short")


def window_sql(stat: str, source: str, keys: str = "country, indicator") -> str:
    """Windowed trend of a series, by numbering its rows from both ends."""
    return f"""
    SELECT {keys}, CASE WHEN n < 20 THEN 'short' WHEN b > a + {WINDOW_THRESHOLD} THEN 'rising'
           WHEN b < a - {WINDOW_THRESHOLD} THEN 'falling' ELSE 'stable' END AS trend,
           CASE WHEN n < 20 THEN o END AS overall, CASE WHEN n >= 20 THEN a END AS start_figure,
           CASE WHEN n >= 20 THEN b END AS end_figure
    FROM (
        SELECT {keys}, count(*) AS n, {stat}(value) AS o, {stat}(CASE WHEN up <= 10 THEN value END) AS a,
               {stat}(CASE WHEN down <= 10 THEN value END) AS b
        FROM (
            SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY year, value) AS up,
                   row_number() OVER (PARTITION BY {keys} ORDER BY year DESC, value DESC) AS down
            FROM {source}
        ) GROUP BY {keys}
    )"""


def _window_figures(df):
    return df.withColumns({name: round_exact(name, 6) for name in ("overall", "start_figure", "end_figure")})


_WINDOW_COLUMNS = (
    f"trend, {r('overall', 6)} AS overall, {r('start_figure', 6)} AS start_figure, {r('end_figure', 6)} AS end_figure"
)


@query("window_trend", with_("raw_monthly", "raw_annual") + _LONG_AND_SHORT + f"""
SELECT country, indicator, {_WINDOW_COLUMNS} FROM ({window_sql('avg', 'mixed')})""")
def window_trend(t: Testbed):
    return _window_figures(tr.window_trend(_long_and_short(t), WINDOW_THRESHOLD))


@query("window_trend_median", with_("raw_monthly", "raw_annual") + _LONG_AND_SHORT + f"""
SELECT country, indicator, {_WINDOW_COLUMNS} FROM ({window_sql('median', 'mixed')})""")
def window_trend_median(t: Testbed):
    return _window_figures(tr.window_trend(_long_and_short(t), WINDOW_THRESHOLD, stat="median"))


@query("baseline_position", with_("raw_monthly", "monthly_region") + f"""
, own AS (
    SELECT country, indicator, max(year) AS last_year, arg_max(value, year) AS last_value
    FROM raw_monthly GROUP BY country, indicator
), base AS (
    SELECT indicator, max(year) AS baseline_year, arg_max(value, year) AS baseline_value
    FROM monthly_region GROUP BY indicator
)
SELECT country, indicator, last_year, {r('last_value', 4)} AS last_value, baseline_year, {r('baseline_value', 4)} AS baseline_value,
       CASE WHEN last_value > baseline_value + {WINDOW_THRESHOLD} THEN 'higher'
            WHEN last_value < baseline_value - {WINDOW_THRESHOLD} THEN 'lower' ELSE 'aligned' END AS position
FROM own JOIN base USING (indicator)""")
def baseline_position(t: Testbed):
    t = t.stored
    position = cmp.baseline_position(t.raw_monthly, s.regional_of_series(t.raw_monthly), WINDOW_THRESHOLD)
    return position.withColumns({name: round_exact(name, 4) for name in ("last_value", "baseline_value")})


@query("latest_vs_median", with_("latest") + f"""
SELECT country, indicator, year, value, regional_median, {r('median_gap', 3)} AS median_gap, median_relation
FROM latest""")
def latest_vs_median(t: Testbed):
    return cmp.latest_vs_median(t.aligned).withColumn("median_gap", round_exact("median_gap", 3))


_PAIRS = """
, last_values AS (
    SELECT country, indicator, year, value FROM annual
    QUALIFY row_number() OVER (PARTITION BY country, indicator ORDER BY year DESC) = 1
), pairs AS (
    SELECT q.country, q.compare, a.indicator, a.year, a.value, b.year AS compare_year, b.value AS compare_value
    FROM nation_requests q JOIN last_values a ON a.country = q.country
    LEFT JOIN last_values b ON b.country = q.compare AND b.indicator = a.indicator
)"""


def _pairs(t: Testbed):
    t = t.stored
    requests = cmp.resolve_compare(t.nation_requests, t.countries)
    return cmp.compare_pairs(s.last_point(t.annual), requests)


@query("compare_pairs", with_("annual", "nation_requests") + _PAIRS + "SELECT * FROM pairs")
def compare_pairs(t: Testbed):
    return _pairs(t)


@query("latest_vs_compare", with_("annual", "nation_requests") + _PAIRS + f"""
SELECT country, compare, indicator, {r('abs(value - compare_value)', 3)} AS compare_gap,
       CASE WHEN value > compare_value THEN 'higher than' WHEN value < compare_value THEN 'lower than'
            WHEN value = compare_value THEN 'the same as' END AS compare_relation
FROM pairs""")
def latest_vs_compare(t: Testbed):
    return cmp.latest_vs_compare(_pairs(t)).select(
        "country", "compare", "indicator", round_exact("compare_gap", 3).alias("compare_gap"), "compare_relation"
    )


@query("coverage_counts", with_("panel") + """
SELECT count(DISTINCT country) AS n_countries, count(DISTINCT (country, indicator)) AS n_series FROM panel""")
def coverage_counts(t: Testbed):
    return s.coverage_counts(t.panel)


@query("chapter_index", with_("panel", "labels") + """
, present AS (SELECT indicator, count(DISTINCT country) AS n FROM panel GROUP BY indicator)
SELECT chapter, chapter_title, CAST(chapter_order AS INTEGER) AS chapter_order,
       string_agg(indicator || '=' || label, ';' ORDER BY indicator_order) AS indicators,
       CAST(sum(n) AS BIGINT) AS n_series
FROM labels JOIN present USING (indicator) GROUP BY chapter, chapter_title, chapter_order""")
def chapter_index(t: Testbed):
    present = t.panel.select("indicator", "country").distinct().groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("indicator_order", F.concat_ws("=", "indicator", "label").alias("entry"))
    return (
        t.labels.join(present, "indicator")
        .groupBy("chapter", "chapter_title", "chapter_order")
        .agg(
            F.array_join(F.array_sort(F.collect_list(entry)).getField("entry"), ";").alias("indicators"),
            F.sum("n").alias("n_series"),
        )
    )


@query("sorted_series", with_("annual") + """
SELECT country, indicator, CAST(row_number() OVER (PARTITION BY country, indicator ORDER BY year) AS INTEGER)
       AS position, year, value FROM annual""")
def sorted_series(t: Testbed):
    return s.sorted_series(t.annual)


@query("series_arrays", with_("aligned") + """
SELECT country, indicator, CAST(count(*) AS INTEGER) AS n, string_agg(year, ',' ORDER BY year) AS years,
       string_agg(printf('%.3f', value), ',' ORDER BY year) AS values,
       string_agg(printf('%.3f', regional_median), ',' ORDER BY year) AS medians
FROM aligned GROUP BY country, indicator""")
def series_arrays(t: Testbed):
    from ..functions.numeric import fixed_text

    def text(name: str):
        return F.array_join(F.transform(name, lambda x: fixed_text(x, 3)), ",")

    return s.series_arrays(t.aligned).select(
        *KEYS, F.size("years").alias("n"), F.array_join(F.col("years").cast("array<string>"), ",").alias("years"),
        text("values").alias("values"), text("regional_median").alias("medians"),
    )


@query("comparison_lines", with_("raw_monthly", "monthly_region") + f"""
, base AS (SELECT indicator, year, {r('value', 4)} AS regional_median FROM monthly_region)
SELECT country, indicator, year, value, regional_median FROM raw_monthly LEFT JOIN base USING (indicator, year)
UNION ALL SELECT '{REGION_LABEL}', indicator, year, regional_median, regional_median FROM base""")
def comparison_lines(t: Testbed):
    t = t.stored
    return s.comparison_lines(t.raw_monthly, s.regional_of_series(t.raw_monthly, digits=4), REGION_LABEL)


@query("power_total_all_grids", with_("power") + f"""
SELECT country, 'power' AS indicator, year, {r('sum(value)', 3)} AS value FROM power
WHERE unit = 'GWH' AND NOT coalesce(source ILIKE '%total%', false)
AND country IS NOT NULL AND year IS NOT NULL AND value IS NOT NULL GROUP BY country, year""")
def power_total_all_grids(t: Testbed):
    rows = o.load_power_all_grids(t.raw_power).withColumn("indicator", F.lit("power"))
    return s.annual_series(rows, "sum")


@query("tail_risk_stats", with_("stats") + "SELECT * FROM stats")
def tail_risk_stats(t: Testbed):
    return rk.tail_risk_stats(t.monthly)


@query("tail_risk_extremes", with_("extremes") + "SELECT * FROM extremes")
def tail_risk_extremes(t: Testbed):
    return rk.tail_risk_extremes(t.stored.monthly)


@query("tail_risk_summary", with_("risk") + "SELECT * FROM risk")
def tail_risk_summary(t: Testbed):
    t = t.stored
    return rk.tail_risk_summary(rk.tail_risk_stats(t.monthly), rk.tail_risk_extremes(t.monthly))


@query("tail_risk_zero_centred", with_("anomalies", "zero_thresholds") + f"""
SELECT country, indicator, year, value, {r('threshold', 3)} AS threshold
FROM anomalies JOIN zero_thresholds USING (country, indicator) WHERE value > threshold OR value < -threshold""")
def tail_risk_zero_centred(t: Testbed):
    thresholds = rk.zero_centred_threshold(t.anomalies)
    thresholds = store(thresholds.withColumn("shown", round_exact("threshold", 3)), "thresholds")
    beyond = rk.tail_risk_zero_centred(t.anomalies, thresholds, also=("shown",))
    return beyond.drop("threshold").withColumnRenamed("shown", "threshold")
