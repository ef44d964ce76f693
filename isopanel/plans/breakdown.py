"""Queries over members and flows: rankings, heatmaps, mixes, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import fixed_text, round_exact
from ..operators import breakdown as b
from ..operators import flows as fl
from ..operators import power as pw
from ..sinks.tables import store
from ..sources import observations as o
from .oracle import r, with_
from .registry import query
from .testbed import Testbed


@query("product_annual_median", with_("product_cells") + "SELECT * FROM product_cells")
def product_annual_median(t: Testbed):
    return t.product_cells


@query("source_annual_sum", with_("source_cells") + "SELECT * FROM source_cells")
def source_annual_sum(t: Testbed):
    return t.source_cells


@query("product_median_of_years", with_("product_cells") + f"""
SELECT country, member, {r('median(value)', 4)} AS median FROM product_cells GROUP BY country, member""")
def product_median_of_years(t: Testbed):
    return b.rounded(b.median_of_years(t.product_cells), 4, "median")


@query("product_median_raw", with_("products") + """
SELECT country, member, median(value) AS median FROM products GROUP BY country, member""")
def product_median_raw(t: Testbed):
    return b.median_of_rows(t.products)


def _ranked_sql(side: str, medians: str, n: int = 10) -> str:
    order = "median DESC, member" if side == "top" else "median, member DESC"
    return f"""
    SELECT country, '{side}' AS side, CAST(rank AS INTEGER) AS rank, member, median
    FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY {order}) AS rank FROM {medians})
    WHERE rank <= {n}"""


_MEDIANS = """
, medians AS (SELECT country, member, median(value) AS median FROM product_cells GROUP BY country, member)"""
_RAW_MEDIANS = """
, medians AS (SELECT country, member, median(value) AS median FROM products GROUP BY country, member)"""


@query("rank_products_top", with_("product_cells") + _MEDIANS + f"""
SELECT country, side, rank, member, {r('median', 4)} AS median FROM ({_ranked_sql('top', 'medians')})""")
def rank_products_top(t: Testbed):
    return b.rounded(b.rank_members(b.median_of_years(t.product_cells), "top"), 4, "median")


@query("rank_products_bottom", with_("product_cells") + _MEDIANS + f"""
SELECT country, side, rank, member, {r('median', 4)} AS median FROM ({_ranked_sql('bottom', 'medians')})""")
def rank_products_bottom(t: Testbed):
    return b.rounded(b.rank_members(b.median_of_years(t.product_cells), "bottom"), 4, "median")


@query("rank_products_raw", with_("products") + _RAW_MEDIANS + f"""
{_ranked_sql('top', 'medians')} UNION ALL {_ranked_sql('bottom', 'medians')}""")
def rank_products_raw(t: Testbed):
    medians = store(b.median_of_rows(t.products), "medians")
    return b.rank_members(medians, "top").union(b.rank_members(medians, "bottom"))


@query("heatmap_pivot", with_("source_cells") + """
SELECT country, member, string_agg(year, ',' ORDER BY year) AS years,
       string_agg(coalesce(printf('%.2f', c.value), '-'), ',' ORDER BY year) AS cells
FROM (SELECT DISTINCT country, member FROM source_cells)
JOIN (SELECT DISTINCT country, year FROM source_cells) USING (country)
LEFT JOIN source_cells c USING (country, member, year) GROUP BY country, member""")
def heatmap_pivot(t: Testbed):
    pivoted = b.heatmap_pivot(t.stored.source_cells)
    cells = F.transform("values", lambda x: F.coalesce(fixed_text(x, 2), F.lit("-")))
    years = F.array_join(F.col("years").cast("array<string>"), ",")
    return pivoted.select("country", "member", years.alias("years"), F.array_join(cells, ",").alias("cells"))


@query("heatmap_dense", with_("product_cells") + """
SELECT country, member, year, c.value
FROM (SELECT DISTINCT country, member FROM product_cells)
JOIN (SELECT DISTINCT country, year FROM product_cells) USING (country)
LEFT JOIN product_cells c USING (country, member, year)""")
def heatmap_dense(t: Testbed):
    return b.heatmap_dense(t.stored.product_cells)


@query("latest_period", with_("source_cells") + """
SELECT country, max(year) AS latest_year FROM source_cells GROUP BY country""")
def latest_period(t: Testbed):
    return b.latest_period(t.source_cells)


def latest_mix_sql(cells: str, digits: int = 2) -> str:
    return f"""
SELECT country, year AS latest_year, arg_min(member, (-value, member)) AS leader, max(value) AS leader_value,
       {r('sum(value)', digits)} AS total
FROM {cells} JOIN (SELECT country, max(year) AS year FROM {cells} GROUP BY country) USING (country, year)
GROUP BY country, year"""


def mix_growth_sql(cells: str) -> str:
    return f"""
SELECT country, min(year) AS start_year, max(year) AS latest_year, arg_min(total, year) AS start_total,
       arg_max(total, year) AS latest_total,
       CASE WHEN arg_max(total, year) > arg_min(total, year) THEN 'growth' ELSE 'contraction' END AS status
FROM (SELECT country, year, sum(value) AS total FROM {cells} GROUP BY country, year) GROUP BY country"""


@query("latest_mix", with_("source_cells") + latest_mix_sql("source_cells"))
def latest_mix(t: Testbed):
    return b.rounded(b.latest_mix(t.source_cells), 2, "total")


@query("mix_growth", with_("raw_source_cells") + f"""
SELECT country, start_year, latest_year, {r('start_total', 3)} AS start_total, {r('latest_total', 3)} AS latest_total,
       status FROM ({mix_growth_sql('raw_source_cells')})""")
def mix_growth(t: Testbed):
    growth = b.mix_growth(t.raw_source_cells)
    return growth.withColumns({name: round_exact(name, 3) for name in ("start_total", "latest_total")})


@query("flow_links", with_("links") + "SELECT * FROM links")
def flow_links(t: Testbed):
    return t.links


@query("flow_links_with_subtotals", with_("power") + f"""
SELECT country, source, grid AS target, {r('sum(value)', 2)} AS value FROM power
WHERE unit = 'GWH' AND grid IN ('On-grid', 'Off-grid') AND source IS NOT NULL AND country IS NOT NULL
AND value IS NOT NULL GROUP BY country, source, grid""")
def flow_links_with_subtotals(t: Testbed):
    return fl.flow_links(o.load_power_by_source_grid(t.raw_power, with_subtotals=True))


def flow_leaders_sql(digits: int = 2) -> str:
    return f"""
SELECT country, target, arg_min(source, (-value, source)) AS leader, max(value) AS leader_value,
       {r('sum(value)', digits)} AS target_total
FROM links GROUP BY country, target"""


@query("flow_leaders", with_("links") + flow_leaders_sql())
def flow_leaders(t: Testbed):
    return b.rounded(fl.flow_leaders(t.links), 2, "target_total")


@query("flow_nodes", with_("links") + """
SELECT country, source AS label FROM links UNION SELECT country, target FROM links""")
def flow_nodes(t: Testbed):
    return fl.flow_nodes(t.links)


_NODES = """
, seen AS (
    SELECT country, label, min((side, a, b)) AS first_seen
    FROM (SELECT country, source AS label, 0 AS side, source AS a, '' AS b FROM links
          UNION ALL SELECT country, target, 1, source, target FROM links)
    GROUP BY country, label
), nodes AS (
    SELECT country, label, CAST(row_number() OVER (PARTITION BY country ORDER BY first_seen) - 1 AS INTEGER) AS idx
    FROM seen
)"""


@query("flow_indexed", with_("links") + _NODES + """
SELECT l.country, s.idx AS source_idx, t.idx AS target_idx, l.value
FROM links l JOIN nodes s ON s.country = l.country AND s.label = l.source
JOIN nodes t ON t.country = l.country AND t.label = l.target""")
def flow_indexed(t: Testbed):
    return fl.flow_indexed(t.stored.links)


@query("flow_index_nodes", with_("links") + _NODES + "SELECT country, idx, label FROM nodes")
def flow_index_nodes(t: Testbed):
    return fl.flow_index_nodes(t.links)


@query("flow_link_nodes", with_("links") + """
, named AS (
    SELECT country, source AS label, source AS a, target AS b, 0 AS side FROM links
    UNION ALL SELECT country, target, source, target, 1 FROM links
), nodes AS (
    SELECT country, label, CAST(row_number() OVER (PARTITION BY country ORDER BY min((a, b, side))) - 1 AS INTEGER) AS idx
    FROM named GROUP BY country, label
)
SELECT l.country, s.idx AS source_idx, t.idx AS target_idx, l.value
FROM links l JOIN nodes s ON s.country = l.country AND s.label = l.source
JOIN nodes t ON t.country = l.country AND t.label = l.target""")
def flow_link_nodes(t: Testbed):
    links = t.stored.links
    return fl.flow_indexed(links, nodes=fl.flow_link_nodes(links))


@query("power_breakdowns", with_("power", "source_cells", "links") + f"""
, rows AS (SELECT * FROM power WHERE unit = 'GWH' AND country IS NOT NULL AND value IS NOT NULL)
SELECT 'total' AS part, country, year, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS target,
       {r('sum(value)', 2)} AS value FROM rows
WHERE grid IS DISTINCT FROM 'Total' AND NOT coalesce(source ILIKE '%total%', false) AND year IS NOT NULL
GROUP BY country, year
UNION ALL SELECT 'all grids', country, year, NULL, NULL, {r('sum(value)', 2)} FROM rows
WHERE NOT coalesce(source ILIKE '%total%', false) AND year IS NOT NULL GROUP BY country, year
UNION ALL SELECT 'source', country, year, member, NULL, value FROM source_cells
UNION ALL SELECT 'link', country, NULL, source, target, value FROM links
UNION ALL SELECT 'link with subtotals', country, NULL, source, grid, {r('sum(value)', 2)} FROM rows
WHERE grid IN ('On-grid', 'Off-grid') AND source IS NOT NULL GROUP BY country, source, grid""")
def power_breakdowns(t: Testbed):
    return pw.power_breakdowns(pw.power_cells(t.raw_power))
