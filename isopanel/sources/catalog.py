"""Which rows of which source make up an indicator, and how it is labelled and aggregated."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import differs_from, is_subtotal


@dataclass(frozen=True)
class RowRule:
    """Conjunction of simple conditions on the coded columns of a source."""

    equals: Mapping[str, str] = field(default_factory=dict)
    one_of: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    differs: Mapping[str, str] = field(default_factory=dict)
    no_subtotals: tuple[str, ...] = ()

    def condition(self) -> Column:
        parts = [_name(c) == F.lit(v) for c, v in self.equals.items()]
        parts += [_name(c).isin(*values) for c, values in self.one_of.items()]
        parts += [differs_from(_name(c), v) for c, v in self.differs.items()]
        parts += [~is_subtotal(_name(c)) for c in self.no_subtotals]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class Indicator:
    name: str
    source: str
    unit: str
    label: str
    chapter: str
    agg: str = "median"
    rows: RowRule = field(default_factory=RowRule)


@dataclass(frozen=True)
class Catalog:
    indicators: tuple[Indicator, ...]
    chapters: tuple[tuple[str, str], ...]
    """Chapter keys and titles in the order in which they are shown."""

    def names(self, agg: str | None = None) -> list[str]:
        return [i.name for i in self.indicators if agg is None or i.agg == agg]

    def __getitem__(self, name: str) -> Indicator:
        return next(i for i in self.indicators if i.name == name)

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per indicator. It is a literal of a few rows, so joins broadcast it by its known size."""
        order = {key: n for n, (key, _) in enumerate(self.chapters)}
        titles = dict(self.chapters)
        rows = [
            (i.name, n, i.label, i.unit, i.agg, i.chapter, titles[i.chapter], order[i.chapter])
            for n, i in enumerate(self.indicators)
        ]
        return spark.createDataFrame(
            rows,
            "indicator string, indicator_order int, label string, unit string, agg string, "
            "chapter string, chapter_title string, chapter_order int",
        )


def _name(column: str) -> Column:
    return F.col(f"`{column}`")


def tag_indicators(df: DataFrame, indicators: Iterable[Indicator], *columns: str) -> DataFrame:
    """All indicators of one source in one pass: each row is repeated once per indicator whose rule it meets."""
    indicators = list(indicators)
    rules = [(i.name, i.rows.condition()) for i in indicators]
    wanted = reduce(lambda a, b: a | b, [c for _, c in rules])
    tags = F.array(*[F.when(c, F.lit(name)) for name, c in rules])
    tagged = df.where(wanted).select(*columns, F.explode(tags).alias("indicator"))
    return tagged.where(F.col("indicator").isNotNull())


# Column names and codes of the source files.
PERIOD_COLUMN = "TIME_PERIOD"
COUNTRY_COLUMN = "Pacific Island Countries and territories"
VALUE_COLUMN = "OBS_VALUE"
UNIT_COLUMN = "UNIT_MEASURE"
CLIMATE_COLUMN = "CLIMATE_CHANGE_INDICATORS"
PRODUCTION_COLUMN = "AGRICULTURE_PRODUCTION_TYPE"
PRODUCT_COLUMN = "Agricultural product"
SOURCE_COLUMN = "Energy source"
GRID_COLUMN = "Grid connection status"
VISITOR_COLUMN = "Visitor duration category"

# Source files by short name.
SOURCE_FILES = {
    "mean_surface_temp_anomalies": "Mean surface temperature anomalies.csv",
    "mean_sea_surface_temp_anomalies": " Mean sea surface temperature anomalies.csv",
    "crop_yield": "Crop yield (disaggregated).csv",
    "environmental_taxes": "Environmental taxes (disaggregated).csv",
    "greenhouse_gas_emissions": "Greenhouse gas emissions per capita.csv",
    "livestock_yield": "Livestock yield (disaggregated).csv",
    "meteorological_monitoring": "Meteorological monitoring network (disaggregated).csv",
    "power_generation": "Power generation (disaggregated).csv",
    "rainfall_anomalies": "Rainfall anomalies.csv",
    "sea_level_anomalies": "Sea level anomalies.csv",
    "tourist_arrivals": "Tourist arrivals (disaggregated).csv",
}

POWER_TOTAL_ROWS = RowRule(
    equals={UNIT_COLUMN: "GWH"}, differs={GRID_COLUMN: "Total"}, no_subtotals=(SOURCE_COLUMN,)
)
POWER_ALL_GRIDS_ROWS = RowRule(equals={UNIT_COLUMN: "GWH"}, no_subtotals=(SOURCE_COLUMN,))
POWER_BY_SOURCE_ROWS = RowRule(equals={UNIT_COLUMN: "GWH", GRID_COLUMN: "Total"}, no_subtotals=(SOURCE_COLUMN,))
POWER_FLOW_ROWS = RowRule(
    equals={UNIT_COLUMN: "GWH"}, one_of={GRID_COLUMN: ("Off-grid", "On-grid")}, no_subtotals=(SOURCE_COLUMN,)
)
POWER_FLOW_WITH_SUBTOTALS_ROWS = RowRule(equals={UNIT_COLUMN: "GWH"}, one_of={GRID_COLUMN: ("Off-grid", "On-grid")})
CROP_ROWS = RowRule(equals={PRODUCTION_COLUMN: "CROP_YIELD", UNIT_COLUMN: "KGHA"})
LIVESTOCK_ROWS = RowRule(equals={PRODUCTION_COLUMN: "LVST_YIELD", UNIT_COLUMN: "KG_AN"})

# The indicators, in the order in which they are shown, and their chapters.
STANDARD_CATALOG = Catalog(
    indicators=(
        Indicator(
            "surface_temp_anomaly", "mean_surface_temp_anomalies", "°C", "Land Surface Temperature Anomaly", "ocean",
            rows=RowRule(equals={UNIT_COLUMN: "CELSIUS", CLIMATE_COLUMN: "ST_ANOM"}),
        ),
        Indicator(
            "sea_surface_temp_anomaly", "mean_sea_surface_temp_anomalies", "°C", "Sea Surface Temperature Anomaly",
            "ocean", rows=RowRule(equals={UNIT_COLUMN: "CELSIUS", CLIMATE_COLUMN: "SST_ANOM"}),
        ),
        Indicator(
            "rainfall_anomaly", "rainfall_anomalies", "mm", "Rainfall Anomaly", "land",
            rows=RowRule(equals={UNIT_COLUMN: "MM", CLIMATE_COLUMN: "RAIN_ANOM"}),
        ),
        Indicator("crop_yield", "crop_yield", " KG/HA", "Crop Yield", "land", rows=CROP_ROWS),
        Indicator("livestock_yield", "livestock_yield", " KG/AN", "Livestock Yield", "land", rows=LIVESTOCK_ROWS),
        Indicator(
            "power_generation", "power_generation", " GWH", "Total Power Generation", "people", "sum",
            POWER_TOTAL_ROWS,
        ),
        Indicator(
            "tourism_arrivals", "tourist_arrivals", "", "Overnight Tourist Arrivals", "people", "sum",
            RowRule(equals={UNIT_COLUMN: "N", VISITOR_COLUMN: "Overnight tourists"}),
        ),
    ),
    chapters=(("land", "Land & Food"), ("ocean", "Ocean & Atmosphere"), ("people", "People & Economy")),
)
PRODUCT_INDICATORS = ("crop_yield", "livestock_yield")
HEADLINE_INDICATOR = "surface_temp_anomaly"
HEADLINE_LABEL = "Regional Median Surface Temperature Anomaly"
TAIL_RISK_INDICATORS = ("surface_temp_anomaly", "rainfall_anomaly")
DEFAULT_COUNTRY = "Fiji"
