"""Queries over sources: scanning, filtering, typing."""

from __future__ import annotations

from posixpath import join

from pyspark.sql import functions as F

from ..functions.numeric import round_exact
from ..operators import compare as cmp
from ..sinks.tables import work_dir
from ..sources import catalog as c
from ..sources import cleaning as cl
from ..sources import countries as geo
from ..sources import observations as o
from .oracle import MISSING, f, number, r, with_, year
from .registry import query
from .testbed import CATALOG, RAW_SOURCES, Testbed

SHORT = {
    c.PERIOD_COLUMN: "period",
    c.COUNTRY_COLUMN: "country",
    c.VALUE_COLUMN: "value",
    c.UNIT_COLUMN: "unit",
    c.SOURCE_COLUMN: "source",
    c.GRID_COLUMN: "grid",
}


def _write_csv(df, path: str) -> None:
    (
        df.write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("escape", '"')
        .option("compression", "lz4")
        .csv(path)
    )


def write_sources(t: Testbed) -> str:
    """All source files, as folders of CSV parts below a new folder."""
    root = work_dir(t.spark)
    for name, rows in t.raw_sources.items():
        _write_csv(rows, join(root, c.SOURCE_FILES[name]))
    return root


@query("scan_observations", with_("raw_power") + f"""
SELECT TIME_PERIOD AS period, "{c.COUNTRY_COLUMN}" AS country,
       CASE WHEN OBS_VALUE NOT IN {MISSING} THEN OBS_VALUE END AS value, UNIT_MEASURE AS unit,
       "{c.SOURCE_COLUMN}" AS source, "{c.GRID_COLUMN}" AS grid
FROM raw_power""")
def scan_observations(t: Testbed):
    path = join(work_dir(t.spark), c.SOURCE_FILES["power_generation"])
    _write_csv(t.raw_power, path)
    return o.scan_observations(t.spark, path).withColumnsRenamed(SHORT)


def _scan_sql(name: str) -> str:
    columns = RAW_SOURCES[name][1]
    counted = [f'count("{x}")' if x in columns else "0" for x in (c.SOURCE_COLUMN, c.PRODUCT_COLUMN)]
    return f"""
SELECT '{name}' AS dataset, UNIT_MEASURE AS unit, count(*) AS n_rows,
       count(CASE WHEN OBS_VALUE NOT IN {MISSING} THEN 1 END) AS n_values, {counted[0]} AS n_sources,
       {counted[1]} AS n_products
FROM raw_{name} GROUP BY UNIT_MEASURE"""


@query("scan_many", with_(*(f"raw_{name}" for name in c.SOURCE_FILES)) + " UNION ALL ".join(map(_scan_sql, c.SOURCE_FILES)))
def scan_many(t: Testbed):
    union = o.union_datasets(o.scan_many(t.spark, write_sources(t)))
    return union.groupBy("dataset", F.col(c.UNIT_COLUMN).alias("unit")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(c.VALUE_COLUMN).alias("n_values"),
        F.count(F.col(f"`{c.SOURCE_COLUMN}`")).alias("n_sources"),
        F.count(F.col(f"`{c.PRODUCT_COLUMN}`")).alias("n_products"),
    )


@query("scan_catalog", with_("panel", "labels") + """
SELECT indicator, label, unit, chapter, CAST(indicator_order AS INTEGER) AS indicator_order, n_rows
FROM labels JOIN (SELECT indicator, count(*) AS n_rows FROM panel GROUP BY indicator) USING (indicator)""")
def scan_catalog(t: Testbed):
    rows = t.panel.groupBy("indicator").agg(F.count(F.lit(1)).alias("n_rows"))
    return CATALOG.frame(t.spark).join(rows, "indicator").select(
        "indicator", "label", "unit", "chapter", "indicator_order", "n_rows"
    )


@query("scan_country_dim", """
WITH dim AS (
    SELECT n_name AS country, substr(r_name, 1, 2) AS code, format('{:,}', count(*) * 1234) AS population,
           count(*) * 1234 AS population_count, sum(c_acctbal) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY n_name, r_name
)
SELECT country, code, chr(127462 + ascii(code) - 65) || chr(127462 + ascii(substr(code, 2)) - 65) AS flag,
       population, population_count
FROM dim""")
def scan_country_dim(t: Testbed):
    placed = (
        t.table("customer")
        .join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    dim = placed.groupBy(F.col("n_name").alias("country"), F.substring("r_name", 1, 2).alias("code")).agg(
        F.format_number(F.count(F.lit(1)) * 1234, 0).alias("population")
    )
    return geo.with_counts(geo.with_flag(dim), "population").select(
        "country", "code", "flag", "population", "population_count"
    )


@query("standardize_columns", with_("raw_power") + f"""
SELECT {year('TIME_PERIOD')} AS year, "{c.COUNTRY_COLUMN}" AS country, OBS_VALUE AS value FROM raw_power""")
def standardize_columns(t: Testbed):
    return o.standardize_columns(t.raw_power).select("year", "country", F.col(c.VALUE_COLUMN).alias("value"))


@query("filter_by_codes", with_("raw_crops") + f"""
SELECT TIME_PERIOD AS period, "{c.COUNTRY_COLUMN}" AS country, OBS_VALUE AS value, "{c.PRODUCT_COLUMN}" AS product
FROM raw_crops WHERE AGRICULTURE_PRODUCTION_TYPE = 'CROP_YIELD' AND UNIT_MEASURE = 'KGHA'""")
def filter_by_codes(t: Testbed):
    rows = o.filter_by_codes(t.raw_crops, c.CROP_ROWS.equals)
    return rows.withColumnsRenamed({**SHORT, c.PRODUCT_COLUMN: "product"}).select(
        "period", "country", "value", "product"
    )


@query("filter_and_rename", with_("raw_crops") + f"""
SELECT {year('TIME_PERIOD')} AS year, "{c.COUNTRY_COLUMN}" AS country, OBS_VALUE AS crop_yield
FROM raw_crops WHERE AGRICULTURE_PRODUCTION_TYPE = 'CROP_YIELD' AND UNIT_MEASURE = 'KGHA'""")
def filter_and_rename(t: Testbed):
    rows = o.filter_and_rename(t.raw_crops, c.CROP_ROWS.equals, "crop_yield")
    return rows.select("year", "country", "crop_yield")


_SOURCE_ROWS = "country, year, source, grid, value"


@query("exclude_subtotals", with_("power") + f"""
SELECT {_SOURCE_ROWS} FROM power WHERE NOT coalesce(lower(source) LIKE '%total%', false)""")
def exclude_subtotals(t: Testbed):
    return _power_rows(t, c.RowRule(no_subtotals=(c.SOURCE_COLUMN,)))


@query("exclude_value_nullsafe", with_("power") + f"""
SELECT {_SOURCE_ROWS} FROM power WHERE grid IS DISTINCT FROM 'Total'""")
def exclude_value_nullsafe(t: Testbed):
    return _power_rows(t, c.RowRule(differs={c.GRID_COLUMN: "Total"}))


@query("filter_membership", with_("power") + f"""
SELECT {_SOURCE_ROWS} FROM power WHERE grid IN ('Off-grid', 'On-grid')""")
def filter_membership(t: Testbed):
    return _power_rows(t, c.RowRule(one_of={c.GRID_COLUMN: ("Off-grid", "On-grid")}))


def _power_rows(t: Testbed, rule: c.RowRule):
    extra = {c.SOURCE_COLUMN: "source", c.GRID_COLUMN: "grid"}
    return o.load_rows(t.raw_power, rule, extra, required=()).select("country", "year", "source", "grid", "value")


@query("coerce_numeric", with_("raw_power") + f"""
SELECT OBS_VALUE AS text, {number('OBS_VALUE')} AS value, count(*) AS n_rows FROM raw_power GROUP BY ALL""")
def coerce_numeric(t: Testbed):
    typed = o.coerce_numeric(t.raw_power.select(F.col(c.VALUE_COLUMN).alias("text"), c.VALUE_COLUMN), c.VALUE_COLUMN)
    return typed.groupBy("text", F.col(c.VALUE_COLUMN).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("drop_incomplete", with_("power") + """
SELECT country, year, source, value FROM power
WHERE country IS NOT NULL AND year IS NOT NULL AND source IS NOT NULL AND value IS NOT NULL""")
def drop_incomplete(t: Testbed):
    rows = _power_rows(t, c.RowRule()).select("country", "year", "source", "value")
    return o.drop_incomplete(rows, "country", "year", "source", "value")


@query("load_indicator", with_("crops") + """
SELECT country, year, value FROM crops WHERE country IS NOT NULL AND year IS NOT NULL AND value IS NOT NULL""")
def load_indicator(t: Testbed):
    return o.load_indicator(t.raw_crops, c.STANDARD_CATALOG["crop_yield"])


@query("load_power_total", with_("power") + """
SELECT country, year, value FROM power
WHERE unit = 'GWH' AND grid IS DISTINCT FROM 'Total' AND NOT coalesce(source ILIKE '%total%', false)
AND country IS NOT NULL AND year IS NOT NULL AND value IS NOT NULL""")
def load_power_total(t: Testbed):
    return o.load_power_total(t.raw_power)


_REASONS = f"""
, judged AS (
    SELECT CASE WHEN "{c.COUNTRY_COLUMN}" IS NULL THEN 'country missing' WHEN TIME_PERIOD IS NULL THEN 'year missing'
                WHEN {year('TIME_PERIOD')} IS NULL THEN 'year not a number' WHEN OBS_VALUE IS NULL THEN 'value missing'
                WHEN {number('OBS_VALUE')} IS NULL THEN 'value not a number' ELSE 'kept' END AS reason,
           "{c.COUNTRY_COLUMN}" AS country, TIME_PERIOD AS period_text, OBS_VALUE AS value_text
    FROM raw_power WHERE UNIT_MEASURE = 'GWH' AND "{c.GRID_COLUMN}" IS DISTINCT FROM 'Total'
    AND NOT coalesce("{c.SOURCE_COLUMN}" ILIKE '%total%', false))"""


def _cleaned(t: Testbed) -> cl.Cleaned:
    return cl.clean(t.raw_power, c.POWER_TOTAL_ROWS, "power")


@query("counted_cleaning", with_("raw_power") + _REASONS + """
SELECT 'power' AS indicator, reason, count(*) AS n_rows FROM judged GROUP BY reason""")
def counted_cleaning(t: Testbed):
    return _cleaned(t).counts


@query("quarantined_rows", with_("raw_power") + _REASONS + """
SELECT reason, country, period_text, value_text, count(*) AS n_rows FROM judged WHERE reason <> 'kept' GROUP BY ALL""")
def quarantined_rows(t: Testbed):
    rows = _cleaned(t).quarantine
    return rows.groupBy("reason", "country", "period_text", "value_text").agg(F.count(F.lit(1)).alias("n_rows"))


@query("load_power_by_source", with_("power_sources") + "SELECT * FROM power_sources")
def load_power_by_source(t: Testbed):
    return t.power_sources


@query("load_power_by_source_grid", with_("flow_rows") + "SELECT * FROM flow_rows")
def load_power_by_source_grid(t: Testbed):
    return t.flows


@query("load_products", with_("products") + "SELECT * FROM products")
def load_products(t: Testbed):
    return t.products


@query("project_canonical", with_("products") + "SELECT country, year, value FROM products")
def project_canonical(t: Testbed):
    return o.project_canonical(t.products)


@query("project_map_xy", f"""
WITH places AS (
    SELECT c_custkey, c_acctbal / 200 - 30 AS lat,
           CASE WHEN c_acctbal / 100 + 125 > 180 THEN c_acctbal / 100 + 125 - 360 ELSE c_acctbal / 100 + 125 END AS lon
    FROM customer
)
SELECT c_custkey, {r('(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END - 125) / 110 * 100', 2)} AS x_pct,
       {r('(20 - lat) / 50 * 100', 2)} AS y_pct
FROM places""")
def project_map_xy(t: Testbed):
    east = F.col("c_acctbal") / 100 + 125
    places = t.table("customer").select(
        "c_custkey", (F.col("c_acctbal") / 200 - 30).alias("lat"), F.when(east > 180, east - 360).otherwise(east).alias("lon")
    )
    return geo.project_map_xy(places).select("c_custkey", "x_pct", "y_pct")


@query("country_or_default", with_("customer_requests", "dim") + """
SELECT request, CASE WHEN country IN (SELECT country FROM dim) THEN country ELSE 'NATION_0' END AS country
FROM customer_requests""")
def country_or_default(t: Testbed):
    return cmp.country_or_default(t.customer_requests, t.dim, "NATION_0").select("request", "country")


@query("resolve_compare", with_("customer_requests", "dim") + """
SELECT request, country, CASE WHEN compare <> country AND compare IN (SELECT country FROM dim) THEN compare ELSE '' END
       AS compare
FROM customer_requests""")
def resolve_compare(t: Testbed):
    return cmp.resolve_compare(t.customer_requests, t.dim).select("request", "country", "compare")


@query("known_countries", with_("orders_obs", "dim") + """
SELECT country, count(*) AS n_rows, bool_and(country IN (SELECT country FROM dim)) AS known
FROM orders_obs GROUP BY country""")
def known_countries(t: Testbed):
    rows = t.orders.groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"))
    return cmp.known_countries(rows, t.dim).withColumn("known", F.lit(True)).union(
        cmp.known_countries(rows, t.dim, known=False).withColumn("known", F.lit(False))
    )


@query("master_country_list", with_("raw_power", "orders_obs", "dim") + f"""
SELECT country FROM (
    SELECT "{c.COUNTRY_COLUMN}" AS country FROM raw_power UNION SELECT country FROM orders_obs
    UNION SELECT country FROM dim
) WHERE country IS NOT NULL""")
def master_country_list(t: Testbed):
    return o.master_country_list([t.raw_power, t.orders, t.dim, t.table("region")]).orderBy("country")


@query("fixed_text", with_("line_obs") + f"""
SELECT country, year, {f('avg(l_discount)', 2)} AS two, {f('-avg(l_extendedprice)', 1)} AS one,
       {r('avg(l_discount * value)', 3)} AS rounded
FROM line_obs GROUP BY country, year""")
def fixed_text(t: Testbed):
    from ..functions.numeric import fixed_text as text

    return t.lines.groupBy("country", "year").agg(
        text(F.avg("l_discount"), 2).alias("two"),
        text(-F.avg("l_extendedprice"), 1).alias("one"),
        round_exact(F.avg(F.col("l_discount") * F.col("value")), 3).alias("rounded"),
    )
