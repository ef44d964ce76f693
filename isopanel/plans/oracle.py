"""Building blocks of the check SQL: common table expressions over the test tables, for DuckDB."""

from __future__ import annotations

from ..sources import catalog as c
from ..sources.catalog import STANDARD_CATALOG, RowRule
from .testbed import RAW_CROPS, RAW_POWER, RAW_SOURCES

MISSING = "('', 'NA', 'N/A', 'n/a', 'NaN', 'nan', 'null', 'NULL', 'None')"


def r(expression: str, digits: int) -> str:
    """Exact rounding by way of decimal text."""
    return f"(CAST(printf('%.{digits}f', {expression}) AS DOUBLE) + 0.0)"


def sig(expression: str) -> str:
    """A double with 12 significant digits."""
    return f"(CAST(printf('%.11e', {expression}) AS DOUBLE) + 0.0)"


def f(expression: str, digits: int) -> str:
    """Fixed-decimal text."""
    return f"printf('%.{digits}f', {expression})"


def number(expression: str) -> str:
    return f"(CASE WHEN NOT isnan(TRY_CAST({expression} AS DOUBLE)) THEN TRY_CAST({expression} AS DOUBLE) END)"


def year(expression: str) -> str:
    return f"CAST(trunc(TRY_CAST({expression} AS DOUBLE)) AS INTEGER)"


def with_(*names: str, standard: bool = False) -> str:
    """WITH clause of the named expressions and all that they need, in order.

    ``standard``: over the standard catalogue's indicators, taken from what the source files hold.
    """
    needed: list[str] = []
    ctes = CTES | STANDARD_CTES if standard else CTES

    def add(name: str) -> None:
        for other in ctes[name][0]:
            add(other)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({ctes[name][1]})" for name in needed) + "\n"


def _columns(expressions: dict[str, str]) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in expressions.items())


def _rule(rule: RowRule) -> str:
    """A row rule as SQL."""
    parts = [f"\"{name}\" = '{value}'" for name, value in rule.equals.items()]
    parts += [f"\"{name}\" IN ({', '.join(repr(v) for v in values)})" for name, values in rule.one_of.items()]
    parts += [f"coalesce(\"{name}\" <> '{value}', true)" for name, value in rule.differs.items()]
    parts += [f"NOT coalesce(\"{name}\" ILIKE '%total%', false)" for name in rule.no_subtotals]
    return " AND ".join(parts)


_LINES = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "orders_obs": ((), """
        SELECT n_name AS country, CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS period,
               o_totalprice AS value, o_orderkey, o_orderpriority, o_orderstatus,
               CASE WHEN year(o_orderdate) <= n_regionkey + 1995 THEN 'early' ELSE 'late' END AS phase
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "line_obs": ((), f"""
        SELECT n_name AS country, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS value,
               l_extendedprice, l_discount, l_returnflag, l_linestatus
        FROM {_LINES}"""),
    "raw_power": ((), f"SELECT {_columns(RAW_POWER)} FROM {_LINES}"),
    "raw_crops": ((), f"SELECT {_columns(RAW_CROPS)} FROM {_LINES} JOIN part ON l_partkey = p_partkey"),
    "power": (("raw_power",), f"""
        SELECT "{c.COUNTRY_COLUMN}" AS country, {year('TIME_PERIOD')} AS year, "{c.SOURCE_COLUMN}" AS source,
               "{c.GRID_COLUMN}" AS grid, {number('OBS_VALUE')} AS value, UNIT_MEASURE AS unit
        FROM raw_power"""),
    "crops": (("raw_crops",), f"""
        SELECT "{c.COUNTRY_COLUMN}" AS country, {year('TIME_PERIOD')} AS year, "{c.PRODUCT_COLUMN}" AS member,
               {number('OBS_VALUE')} AS value
        FROM raw_crops WHERE AGRICULTURE_PRODUCTION_TYPE = 'CROP_YIELD' AND UNIT_MEASURE = 'KGHA'"""),
    "products": (("crops",), """
        SELECT * FROM crops WHERE country IS NOT NULL AND year IS NOT NULL AND member IS NOT NULL
        AND value IS NOT NULL"""),
    "product_cells": (("products",), f"""
        SELECT country, member, year, {r('median(value)', 2)} AS value FROM products GROUP BY ALL"""),
    "power_sources": (("power",), """
        SELECT country, year, source AS member, value FROM power
        WHERE unit = 'GWH' AND grid = 'Total' AND source NOT ILIKE '%total%'
        AND country IS NOT NULL AND year IS NOT NULL AND value IS NOT NULL"""),
    "raw_source_cells": (("power_sources",), """
        SELECT country, member, year, sum(value) AS value FROM power_sources GROUP BY ALL"""),
    "source_cells": (("power_sources",), f"""
        SELECT country, member, year, {r('sum(value)', 2)} AS value FROM power_sources GROUP BY ALL"""),
    "flow_rows": (("power",), """
        SELECT country, source, grid AS target, value FROM power
        WHERE unit = 'GWH' AND grid IN ('On-grid', 'Off-grid') AND source NOT ILIKE '%total%'
        AND country IS NOT NULL AND value IS NOT NULL"""),
    "links": (("flow_rows",), f"""
        SELECT country, source, target, {r('sum(value)', 2)} AS value FROM flow_rows GROUP BY ALL"""),
    "panel": (("orders_obs", "line_obs"), """
        SELECT country, 'order_value' AS indicator, year, value FROM orders_obs
        UNION ALL SELECT country, 'early_order_value', year, value FROM orders_obs WHERE phase = 'early'
        UNION ALL SELECT country, 'shipped_quantity', year, value FROM line_obs
        UNION ALL SELECT country, 'returned_quantity', year, value FROM line_obs WHERE l_returnflag = 'R'"""),
    "annual": (("panel",), f"""
        SELECT country, indicator, year,
               CASE WHEN indicator IN ('order_value', 'early_order_value') THEN {r('median(value)', 3)}
                    ELSE {r('sum(value)', 3)} END AS value
        FROM panel GROUP BY country, indicator, year"""),
    "regional": (("panel",), f"""
        SELECT indicator, year, {r('median(value)', 3)} AS regional_median FROM panel GROUP BY ALL"""),
    "aligned": (("annual", "regional"), "SELECT * FROM annual LEFT JOIN regional USING (indicator, year)"),
    "labels": ((), """
        SELECT * FROM (VALUES
            ('order_value', 0, 'Order Value', ' USD', 'ocean', 1, 'Ocean & Atmosphere'),
            ('early_order_value', 1, 'Early Order Value', ' USD', 'land', 0, 'Land & Food'),
            ('shipped_quantity', 2, 'Shipped Quantity', '', 'people', 2, 'People & Economy'),
            ('returned_quantity', 3, 'Returned Quantity', ' PCS', 'people', 2, 'People & Economy')
        ) AS t(indicator, indicator_order, label, unit, chapter, chapter_order, chapter_title)"""),
    "trend": (("annual",), f"""
        SELECT country, indicator, count(*) AS n,
               CASE WHEN count(*) >= 3 THEN {r('regr_slope(value, year - 2000) * 10', 4)} END AS slope_per_decade,
               CASE WHEN count(*) >= 3 THEN regr_slope(value, year - 2000) END AS slope_per_year,
               CASE WHEN count(*) >= 3
                    THEN regr_intercept(value, year - 2000) - 2000 * regr_slope(value, year - 2000) END AS intercept,
               CASE WHEN count(*) >= 3 THEN CASE WHEN min(value) = max(value) THEN 0.0
                    ELSE {r('regr_r2(value, year - 2000)', 3)} END END AS r_squared,
               CASE WHEN count(*) >= 3 AND avg(abs(value)) > 1e-9
                    THEN {r('regr_slope(value, year - 2000) * 10 / avg(abs(value)) * 100', 2)}
               END AS relative_slope_pct
        FROM annual GROUP BY country, indicator"""),
    "extent": (("annual",), """
        SELECT country, indicator, min(year) AS first_year, max(year) AS last_year, min(value) AS min_value,
               max(value) AS max_value, arg_min(year, (value, year)) AS min_year,
               arg_min(year, (-value, year)) AS max_year
        FROM annual GROUP BY country, indicator"""),
    "endpoints": (("trend", "extent"), """
        SELECT trend.*, first_year, last_year, slope_per_year * first_year + intercept AS fitted_first,
               slope_per_year * last_year + intercept AS fitted_last
        FROM trend JOIN extent USING (country, indicator)"""),
    "latest": (("aligned",), """
        SELECT country, indicator, year, value, regional_median, abs(value - regional_median) AS median_gap,
               CASE WHEN abs(value - regional_median) < 1e-6 THEN 'in line' WHEN value > regional_median THEN 'above'
                    WHEN value <= regional_median THEN 'below' END AS median_relation
        FROM aligned QUALIFY row_number() OVER (PARTITION BY country, indicator ORDER BY year DESC) = 1"""),
    "monthly": (("orders_obs",), f"""
        SELECT country, 'order_value' AS indicator, period AS year, {r('median(value)', 3)} AS value
        FROM orders_obs GROUP BY country, period"""),
    "raw_annual": (("panel",), """
        SELECT country, indicator, year,
               CASE WHEN indicator IN ('order_value', 'early_order_value') THEN median(value) ELSE sum(value) END AS value
        FROM panel GROUP BY country, indicator, year"""),
    "raw_monthly": (("orders_obs",), """
        SELECT country, 'order_value' AS indicator, period AS year, median(value) AS value
        FROM orders_obs GROUP BY country, period"""),
    "monthly_region": (("raw_monthly",), """
        SELECT indicator, year, median(value) AS value FROM raw_monthly GROUP BY indicator, year"""),
    "spread": (("monthly",), """
        SELECT country, indicator, avg(value) AS m, stddev_pop(value) AS s FROM monthly GROUP BY ALL"""),
    "stats": (("spread",), f"""
        SELECT country, indicator, {r('m', 3)} AS mean, {r('s', 3)} AS std, {r('2 * s', 3)} AS threshold
        FROM spread"""),
    "extremes": (("monthly", "spread"), """
        SELECT country, indicator, year, value FROM monthly JOIN spread USING (country, indicator)
        WHERE abs(value - m) > 2 * s"""),
    "risk": (("stats", "extremes"), """
        SELECT country, indicator, mean, std, threshold, count(year) AS n_extremes,
               arg_min(year, (-abs(value - mean), year)) AS extreme_year,
               arg_min(value, (-abs(value - mean), year)) AS extreme_value
        FROM stats LEFT JOIN extremes USING (country, indicator) GROUP BY ALL"""),
    "anomalies": (("line_obs",), """
        SELECT country, 'anomaly' AS indicator, year, l_extendedprice * (l_discount - 0.05) AS value FROM line_obs"""),
    "zero_thresholds": (("anomalies",), """
        SELECT country, indicator, 2 * stddev_samp(value) AS threshold FROM anomalies GROUP BY ALL"""),
    "dim": ((), """
        SELECT n_name AS country, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE r_name <> 'EUROPE' UNION ALL SELECT r_name, r_name FROM region"""),
    "nation_requests": ((), """
        SELECT n_name AS country, CASE WHEN n_regionkey IN (0, 1, 2) THEN ''
               ELSE 'NATION_' || ((n_nationkey + 5) % 25) END AS compare
        FROM nation"""),
    "customer_requests": ((), """
        SELECT c_custkey AS request, 'NATION_' || (c_custkey % 28) AS country,
               CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'NATION_' || (c_custkey * 3 % 28) END AS compare
        FROM customer"""),
}

_PLACES = {
    "orders": "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "lines": _LINES,
    "parts": f"{_LINES} JOIN part ON l_partkey = p_partkey",
}
CTES |= {f"raw_{name}": ((), f"SELECT {_columns(columns)} FROM {_PLACES[base]}") for name, (base, columns) in RAW_SOURCES.items()}


def _rows(indicator: str, member: str | None = None) -> str:
    entry = STANDARD_CATALOG[indicator]
    extra = f', "{member}" AS member' if member else ""
    missing = f' AND "{member}" IS NOT NULL' if member else ""
    return f"""
        SELECT * FROM (
            SELECT "{c.COUNTRY_COLUMN}" AS country, '{indicator}' AS indicator, {year(c.PERIOD_COLUMN)} AS year,
                   {number(c.VALUE_COLUMN)} AS value{extra}
            FROM raw_{entry.source} WHERE {_rule(entry.rows)}{missing})
        WHERE country IS NOT NULL AND year IS NOT NULL AND value IS NOT NULL"""


_SUMMED = ", ".join(f"'{name}'" for name in STANDARD_CATALOG.names("sum"))
_RISKY = ", ".join(f"'{name}'" for name in c.TAIL_RISK_INDICATORS)
_CHAPTERS = {key: (n, title) for n, (key, title) in enumerate(STANDARD_CATALOG.chapters)}
_LABEL_ROWS = ", ".join(
    f"('{i.name}', {n}, '{i.label}', '{i.unit}', '{i.chapter}', {_CHAPTERS[i.chapter][0]}, '{_CHAPTERS[i.chapter][1]}')"
    for n, i in enumerate(STANDARD_CATALOG.indicators)
)

#: Expressions that stand for those of the same name where the standard catalogue's indicators are meant.
STANDARD_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "panel": (
        tuple(dict.fromkeys(f"raw_{i.source}" for i in STANDARD_CATALOG.indicators)),
        " UNION ALL ".join(_rows(i.name) for i in STANDARD_CATALOG.indicators),
    ),
    "annual": (("panel",), f"""
        SELECT country, indicator, year, CASE WHEN indicator IN ({_SUMMED}) THEN {r('sum(value)', 3)}
               ELSE {r('median(value)', 3)} END AS value
        FROM panel GROUP BY country, indicator, year"""),
    "raw_annual": (("panel",), f"""
        SELECT country, indicator, year, CASE WHEN indicator IN ({_SUMMED}) THEN sum(value) ELSE median(value) END AS value
        FROM panel GROUP BY country, indicator, year"""),
    "labels": ((), f"""
        SELECT * FROM (VALUES {_LABEL_ROWS})
            AS t(indicator, indicator_order, label, unit, chapter, chapter_order, chapter_title)"""),
    "monthly": (("annual",), f"SELECT country, indicator, year, value FROM annual WHERE indicator IN ({_RISKY})"),
    "products": (
        ("raw_crop_yield", "raw_livestock_yield"),
        " UNION ALL ".join(_rows(name, c.PRODUCT_COLUMN) for name in c.PRODUCT_INDICATORS),
    ),
    "product_cells": (("products",), f"""
        SELECT country, indicator, member, year, {r('median(value)', 2)} AS value FROM products GROUP BY ALL"""),
    "dim": ((), "SELECT n_name AS country FROM nation WHERE n_regionkey <> 3"),
}
