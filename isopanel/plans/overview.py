"""Overview texts by windowed trends, for every country at once.

These sections keep to definitions of their own: raw rows instead of annual figures where a source has one row per
year, regional medians over annual country figures, sample deviations around zero, and power totals that keep the
all-grids rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import breakdown as b
from ..operators import compare as cmp
from ..operators import flows as fl
from ..operators import narrative as n
from ..operators import power as pw
from ..operators import risk as rk
from ..operators import series as s
from ..operators import trend as tr
from ..sinks.tables import store
from ..sources import catalog as c
from ..sources import observations as o


@dataclass(frozen=True)
class Section:
    indicator: str
    label: str
    threshold: float
    annual: str | None
    """Aggregate per country and year, or None where the rows are taken as they are."""


# Sections with their labels, thresholds and aggregates.
SECTIONS = (
    Section("surface_temp_anomaly", "Mean Surface Temperature Anomalies", 0.1, None),
    Section("rainfall_anomaly", "Rainfall Anomalies", 5.0, None),
    Section("sea_surface_temp_anomaly", "Sea Surface Temperature Anomalies", 0.1, None),
    Section("crop_yield", "Crop Yield", 500.0, "median"),
    Section("livestock_yield", "Livestock Yield", 5.0, "median"),
    Section("tourism_arrivals", "Tourism Arrivals (Overnight tourists)", 1000.0, "sum"),
)
REGION_LABEL = "Median (All Countries)"
POWER_REGION_LABEL = "Regional Median (Total Generation)"


def section_rows(datasets: Mapping[str, DataFrame], section: Section) -> DataFrame:
    """Rows of a section: country, indicator, year, value."""
    indicator = c.STANDARD_CATALOG[section.indicator]
    rows = o.load_indicator(datasets[indicator.source], indicator)
    # Generated, not a constant: with the same constant on both sides of a join the optimizer would drop the join
    # condition and pair all rows.
    rows = rows.withColumn("indicator", F.explode(F.array(F.lit(indicator.name))))
    return rows if section.annual is None else s.annual_series(rows, section.annual, digits=None)


def section_baseline(rows: DataFrame, section: Section) -> DataFrame:
    """Regional median per year, unrounded."""
    if section.annual is not None:
        return s.regional_of_series(rows)
    return s.annual_series(rows, "median", ("indicator", "year"), digits=None, output="regional_median")


def comparison(datasets: Mapping[str, DataFrame], section: Section) -> tuple[DataFrame, DataFrame]:
    """Chart rows and overview text of one section for all countries."""
    rows = section_rows(datasets, section)
    if section.annual is not None:
        rows = store(rows, section.indicator)
    baseline = store(section_baseline(rows, section), f"{section.indicator}_baseline")
    lines = s.comparison_lines(rows, baseline, REGION_LABEL)
    regional = baseline.select("indicator", "year", F.col("regional_median").alias("value"))
    labels = _labels(rows, section)
    text = n.insight_comparison(
        s.series_extent(rows),
        tr.window_trend(rows, section.threshold),
        tr.window_trend(regional, section.threshold, keys=["indicator"]),
        cmp.baseline_position(rows, baseline, section.threshold),
        labels,
    )
    return lines, text


def tail_risk(datasets: Mapping[str, DataFrame], section: Section) -> tuple[DataFrame, DataFrame]:
    """Extreme rows around zero and their text."""
    rows = section_rows(datasets, section)
    facts = store(rk.zero_centred_overview(rows), f"{section.indicator}_facts")
    text = n.insight_tail_risk_overview(facts, _labels(rows, section))
    return rk.tail_risk_zero_centred(rows, facts.select("country", "indicator", "threshold")), text


def power(datasets: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Power totals against the regional median, source heatmap cells, flow nodes and links, and their texts."""
    sums = pw.power_cells(datasets["power_generation"])
    totals = store(
        s.annual_series(pw.all_grids_rows(sums).withColumn("indicator", F.lit("power")), "sum", digits=None),
        "power_totals",
    )
    cells = store(b.member_annual(pw.source_rows(sums), "sum", digits=None), "power_cells")
    dated = store(fl.flow_links_with_years(pw.flow_rows(sums, with_subtotals=True)), "power_links")
    links = dated.drop("first_year", "last_year")
    return {
        "lines": s.comparison_lines(totals, s.regional_of_series(totals), POWER_REGION_LABEL),
        "cells": cells,
        "nodes": fl.flow_index_nodes(links),
        "links": fl.flow_indexed(links),
        "mix_text": n.insight_mix_growth(b.mix_growth(cells), b.latest_mix(cells)),
        "flow_text": n.insight_flow_overview(fl.flow_leaders(links), fl.flow_years(dated)),
    }


def products(datasets: Mapping[str, DataFrame], indicator: str) -> dict[str, DataFrame]:
    """Rankings by the median of all rows, and heatmap cells."""
    entry = c.STANDARD_CATALOG[indicator]
    rows = o.load_products(datasets[entry.source], entry.rows)
    medians = store(b.median_of_rows(rows), f"{indicator}_medians")
    ranked = [b.rank_members(medians, side) for side in ("top", "bottom")]
    return {
        "ranked": reduce(DataFrame.unionByName, ranked),
        "cells": b.member_annual(rows, "median", digits=None),
    }


def _labels(rows: DataFrame, section: Section) -> DataFrame:
    unit = c.STANDARD_CATALOG[section.indicator].unit
    return rows.sparkSession.createDataFrame(
        [(section.indicator, section.label, unit)], "indicator string, label string, unit string"
    )
