"""The roles of the operators played by the test tables.

Orders and line items are the observations, nations are the countries, and the coded text columns of a source file
are derived from line items, with the blanks, bad numbers and subtotal labels that such files hold.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_exact
from ..operators import breakdown as b
from ..operators import flows as fl
from ..operators import series as s
from ..operators import trend as tr
from ..operators.median import Sketches
from ..operators.skew import split_join
from ..sinks.tables import store
from ..sources import catalog as c
from ..sources import observations as o
from ..sources.catalog import Catalog, Indicator, RowRule

CATALOG = Catalog(
    indicators=(
        Indicator("order_value", "orders", " USD", "Order Value", "ocean"),
        Indicator(
            "early_order_value", "orders", " USD", "Early Order Value", "land",
            rows=RowRule(equals={"phase": "early"}),
        ),
        Indicator("shipped_quantity", "lines", "", "Shipped Quantity", "people", "sum"),
        Indicator(
            "returned_quantity", "lines", " PCS", "Returned Quantity", "people", "sum",
            RowRule(equals={"l_returnflag": "R"}),
        ),
    ),
    chapters=(("land", "Land & Food"), ("ocean", "Ocean & Atmosphere"), ("people", "People & Economy")),
)
WINDOW_THRESHOLD = 5000.0
REGION_LABEL = "Median (All Countries)"

# SQL text that both engines read: how a messy source file is made from line items.
RAW_POWER = {
    c.PERIOD_COLUMN: (
        "CASE WHEN l_orderkey % 41 = 0 THEN 'abc' "
        "WHEN l_orderkey % 17 = 0 THEN CAST(year(l_shipdate) AS STRING) || '.7' "
        "ELSE CAST(year(l_shipdate) AS STRING) END"
    ),
    c.COUNTRY_COLUMN: "CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE n_name END",
    c.VALUE_COLUMN: (
        "CASE WHEN l_orderkey % 11 = 0 THEN 'n/a' WHEN l_orderkey % 19 = 0 THEN '12d' "
        "WHEN l_orderkey % 23 = 0 THEN ' 12 ' WHEN l_orderkey % 31 = 0 THEN '1e3' "
        "WHEN l_orderkey % 37 = 0 THEN 'NaN' WHEN l_orderkey % 43 = 0 THEN '1,234' "
        # fractions whose sums hardly ever stand halfway between two rounded figures
        "ELSE CAST(CAST(l_quantity AS INT) AS STRING) || CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '.1371359' "
        "WHEN 2 THEN '.2917173' ELSE '.5833791' END END"
    ),
    c.UNIT_COLUMN: "CASE WHEN l_linenumber = 7 THEN 'MW' ELSE 'GWH' END",
    c.SOURCE_COLUMN: (
        "CASE l_returnflag "
        "WHEN 'A' THEN CASE WHEN l_linenumber = 1 THEN 'Renewable (total)' ELSE 'Solar' END "
        "WHEN 'N' THEN CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'TOTAL' ELSE 'Oil' END "
        "ELSE CASE WHEN l_linenumber < 4 THEN 'Hydro' ELSE 'Wind' END END"
    ),
    c.GRID_COLUMN: (
        "CASE WHEN l_discount > 0.08 THEN NULL WHEN l_discount > 0.05 THEN 'Total' "
        "WHEN l_linestatus = 'O' THEN 'On-grid' ELSE 'Off-grid' END"
    ),
}
RAW_CROPS = {
    **{name: RAW_POWER[name] for name in (c.PERIOD_COLUMN, c.COUNTRY_COLUMN)},
    c.VALUE_COLUMN: (
        "CASE WHEN l_orderkey % 11 = 0 THEN 'n/a' WHEN l_orderkey % 19 = 0 THEN '12d' "
        "WHEN l_orderkey % 23 = 0 THEN ' 12 ' WHEN l_orderkey % 31 = 0 THEN '1e3' "
        "WHEN l_orderkey % 37 = 0 THEN 'NaN' WHEN l_orderkey % 43 = 0 THEN '1,234' "
        "ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"
    ),
    c.UNIT_COLUMN: "CASE WHEN l_returnflag = 'R' THEN 'T' ELSE 'KGHA' END",
    c.PRODUCTION_COLUMN: "CASE WHEN l_linestatus = 'O' THEN 'AREA' ELSE 'CROP_YIELD' END",
    c.PRODUCT_COLUMN: "CASE WHEN l_linenumber = 6 THEN NULL ELSE p_brand END",
}
RAW_LIVESTOCK = {
    **RAW_CROPS,
    c.UNIT_COLUMN: "CASE WHEN l_returnflag = 'A' THEN 'T' ELSE 'KG_AN' END",
    c.PRODUCTION_COLUMN: "CASE WHEN l_linestatus = 'F' THEN 'HEADS' ELSE 'LVST_YIELD' END",
    c.PRODUCT_COLUMN: "CASE WHEN l_linenumber = 5 THEN NULL ELSE p_type END",
}


def _from_orders(spread: int, unit: str, **more: str) -> dict[str, str]:
    """Columns of a source made from orders: figures around zero in steps of an eighth."""
    return {
        c.PERIOD_COLUMN: (
            "CASE WHEN o_orderkey % 41 = 0 THEN 'abc' "
            "WHEN o_orderkey % 17 = 0 THEN CAST(year(o_orderdate) AS STRING) || '.7' "
            "ELSE CAST(year(o_orderdate) AS STRING) END"
        ),
        c.COUNTRY_COLUMN: "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE n_name END",
        c.VALUE_COLUMN: (
            "CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 23 = 0 THEN ' 12 ' "
            f"ELSE CAST(CAST(o_custkey % {spread} AS INT) - {spread // 3} AS STRING) || CASE CAST(o_orderkey % 3 AS INT) "
            "WHEN 0 THEN '' WHEN 1 THEN '.125' ELSE '.5' END END"
        ),
        c.UNIT_COLUMN: f"CASE WHEN o_orderkey % 13 = 0 THEN 'OTHER' ELSE '{unit}' END",
        **more,
    }


def _climate(code: str) -> str:
    return f"CASE WHEN o_orderkey % 7 = 0 THEN 'OTHER' ELSE '{code}' END"


#: Columns of every source file: of the joined orders, the line items, or the line items with their parts.
RAW_SOURCES = {
    "mean_surface_temp_anomalies": ("orders", _from_orders(9, "CELSIUS", **{c.CLIMATE_COLUMN: _climate("ST_ANOM")})),
    "mean_sea_surface_temp_anomalies": ("orders", _from_orders(6, "CELSIUS", **{c.CLIMATE_COLUMN: _climate("SST_ANOM")})),
    "crop_yield": ("parts", RAW_CROPS),
    "environmental_taxes": ("orders", _from_orders(50, "USD")),
    "greenhouse_gas_emissions": ("orders", _from_orders(40, "T")),
    "livestock_yield": ("parts", RAW_LIVESTOCK),
    "meteorological_monitoring": ("orders", _from_orders(30, "N")),
    "power_generation": ("lines", RAW_POWER),
    "rainfall_anomalies": ("orders", _from_orders(300, "MM", **{c.CLIMATE_COLUMN: _climate("RAIN_ANOM")})),
    "sea_level_anomalies": ("orders", _from_orders(20, "MM")),
    "tourist_arrivals": (
        "orders",
        _from_orders(
            900, "N", **{c.VISITOR_COLUMN: "CASE WHEN o_orderkey % 5 = 0 THEN 'Same-day' ELSE 'Overnight tourists' END"}
        ),
    ),
}

#: What the sources made of orders, and of line items with their parts, read of these.
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderdate", "n_name")
PART_COLUMNS = (
    "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate", "n_name", "p_brand", "p_type"
)

# Types of the test tables as written; naming them saves a look into the files per query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
}


class Testbed:
    """Frames over one folder of test tables. All of them are plans until an action runs."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @cached_property
    def _order_places(self) -> DataFrame:
        return (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        )

    @cached_property
    def raw_sources(self) -> dict[str, DataFrame]:
        """What the source files hold, by data set.

        Many sources are made of the same orders, and two of the same parts. Each join is made once and stored, with the
        columns that they read.
        """
        parts = self._line_places.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        places = {
            "orders": store(self._order_places.select(*ORDER_COLUMNS), "order_places"),
            "lines": self._line_places,
            "parts": store(parts.select(*PART_COLUMNS), "part_places"),
        }
        return {
            name: places[base].select(*[F.expr(sql).alias(column) for column, sql in columns.items()])
            for name, (base, columns) in RAW_SOURCES.items()
        }

    @cached_property
    def orders(self) -> DataFrame:
        joined = self._order_places
        year = F.year("o_orderdate")
        return joined.select(
            F.col("n_name").alias("country"),
            year.alias("year"),
            (year * 12 + F.month("o_orderdate") - 1).alias("period"),
            F.col("o_totalprice").alias("value"),
            "o_orderkey",
            "o_orderpriority",
            "o_orderstatus",
            F.when(year <= F.col("n_regionkey") + 1995, "early").otherwise("late").alias("phase"),
        )

    @cached_property
    def _line_places(self) -> DataFrame:
        return (
            split_join(self.table("lineitem"), self.table("supplier"), "l_suppkey", "s_suppkey")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self._line_places.select(
            F.col("n_name").alias("country"),
            F.year("l_shipdate").alias("year"),
            F.col("l_quantity").alias("value"),
            "l_extendedprice",
            "l_discount",
            "l_returnflag",
            "l_linestatus",
            "l_partkey",
        )

    @cached_property
    def shipped(self) -> DataFrame:
        """Quantities summed per supplier and year before the suppliers are looked up.

        A sum can be taken in parts, so the line items themselves need not be shuffled to the join, and a supplier
        with very many of them arrives there as one row per year.
        """
        per_supplier = (
            self.table("lineitem")
            .groupBy("l_suppkey", F.year("l_shipdate").alias("year"))
            .agg(F.sum("l_quantity").alias("value"))
        )
        placed = per_supplier.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
            self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        return placed.select(
            F.col("n_name").alias("country"), F.lit("shipped_quantity").alias("indicator"), "year", "value"
        )

    @cached_property
    def raw_power(self) -> DataFrame:
        return self._line_places.select(*[F.expr(sql).alias(name) for name, sql in RAW_POWER.items()])

    @cached_property
    def raw_crops(self) -> DataFrame:
        parts = self._line_places.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        return parts.select(*[F.expr(sql).alias(name) for name, sql in RAW_CROPS.items()])

    @cached_property
    def products(self) -> DataFrame:
        return o.load_products(self.raw_crops)

    @cached_property
    def power_sources(self) -> DataFrame:
        return o.load_power_by_source(self.raw_power)

    @cached_property
    def flows(self) -> DataFrame:
        return o.load_power_by_source_grid(self.raw_power)

    @cached_property
    def panels(self) -> dict[str, DataFrame]:
        """Indicators by aggregate; a source is read once for all indicators that share an aggregate."""
        sources = {"orders": self.orders, "lines": self.lines}
        panels: dict[str, list[DataFrame]] = {}
        for agg in ("median", "sum"):
            for name, frame in sources.items():
                indicators = [i for i in CATALOG.indicators if i.source == name and i.agg == agg]
                if indicators:
                    tagged = c.tag_indicators(frame, indicators, "country", "year", "value")
                    panels.setdefault(agg, []).append(tagged.select("country", "indicator", "year", "value"))
        return {agg: reduce(DataFrame.union, parts) for agg, parts in panels.items()}

    @cached_property
    def panel(self) -> DataFrame:
        return reduce(DataFrame.union, self.panels.values())

    @cached_property
    def sketches(self) -> Sketches:
        return s.panel_sketches(self.panels)

    @cached_property
    def annual(self) -> DataFrame:
        return s.annual_panel(self.sketches)

    @cached_property
    def regional(self) -> DataFrame:
        return s.regional_median(self.sketches)

    @cached_property
    def raw_annual(self) -> DataFrame:
        """Annual figures as they come, for the variants that don't round before going on."""
        return s.annual_panel(self.sketches, digits=None)

    @cached_property
    def aligned(self) -> DataFrame:
        return s.align_regional(self.annual, self.regional)

    @cached_property
    def stored(self) -> Testbed:
        """The same tables with the series that several results are made of written out once."""
        return StoredTestbed(self.spark, self.sf_dir)

    @cached_property
    def trend(self) -> DataFrame:
        return tr.linear_trend(self.annual)

    @cached_property
    def labels(self) -> DataFrame:
        return CATALOG.frame(self.spark)

    @cached_property
    def raw_monthly(self) -> DataFrame:
        """A long series: the period counts months and plays the year."""
        rows = self.orders.select(
            "country", F.lit("order_value").alias("indicator"), F.col("period").alias("year"), "value"
        )
        return s.annual_series(rows, "median", digits=None)

    @cached_property
    def monthly(self) -> DataFrame:
        return self.raw_monthly.withColumn("value", round_exact("value", 3))

    @cached_property
    def anomalies(self) -> DataFrame:
        """Row-level values around zero."""
        return self.lines.select(
            "country",
            F.lit("anomaly").alias("indicator"),
            "year",
            (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("value"),
        )

    @cached_property
    def dim(self) -> DataFrame:
        """Countries of all regions but one, and places that have no rows at all."""
        nations = (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .where(F.col("r_name") != "EUROPE")
            .select(F.col("n_name").alias("country"), F.col("r_name").alias("area"))
        )
        return nations.union(self.table("region").select(F.col("r_name").alias("country"), F.col("r_name")))

    @cached_property
    def nation_requests(self) -> DataFrame:
        """One request per country; by region the compare country is empty, the same, unknown or valid."""
        other = F.concat(F.lit("NATION_"), ((F.col("n_nationkey") + 5) % 25).cast("string"))
        compare = (
            F.when(F.col("n_regionkey") == 0, "")
            .when(F.col("n_regionkey") == 1, F.col("n_name"))
            .when(F.col("n_regionkey") == 2, "Atlantis")
            .otherwise(other)
        )
        return self.table("nation").select(F.col("n_name").alias("country"), compare.alias("compare"))

    @cached_property
    def product_cells(self) -> DataFrame:
        return b.member_annual(self.products, "median")

    @cached_property
    def raw_source_cells(self) -> DataFrame:
        return b.member_annual(self.power_sources, "sum", digits=None)

    @cached_property
    def source_cells(self) -> DataFrame:
        return b.member_annual(self.power_sources, "sum")

    @cached_property
    def links(self) -> DataFrame:
        return fl.flow_links(self.flows)

    @cached_property
    def countries(self) -> DataFrame:
        return self.table("nation").select(F.col("n_name").alias("country"))

    @cached_property
    def customer_requests(self) -> DataFrame:
        """One request per customer, some for names that do not exist."""

        def name(number):
            return F.concat(F.lit("NATION_"), (number % 28).cast("string"))

        return self.table("customer").select(
            F.col("c_custkey").alias("request"),
            name(F.col("c_custkey")).alias("country"),
            F.when(F.col("c_mktsegment") == "BUILDING", "")
            .otherwise(name(F.col("c_custkey") * 3))
            .alias("compare"),
        )


class StoredTestbed(Testbed):
    """Series, cells and links as written tables. Each is written when it is first asked for."""

    @cached_property
    def plain(self) -> Testbed:
        return Testbed(self.spark, self.sf_dir)

    @cached_property
    def stored(self) -> Testbed:
        return self

    @cached_property
    def aligned(self) -> DataFrame:
        return store(self.plain.aligned, "aligned")

    @cached_property
    def annual(self) -> DataFrame:
        return self.aligned.drop("regional_median")

    @cached_property
    def raw_monthly(self) -> DataFrame:
        return store(self.plain.raw_monthly, "raw_monthly")

    @cached_property
    def monthly(self) -> DataFrame:
        return store(self.plain.monthly, "monthly")

    @cached_property
    def raw_source_cells(self) -> DataFrame:
        return store(self.plain.raw_source_cells, "raw_source_cells")

    @cached_property
    def product_cells(self) -> DataFrame:
        return store(self.plain.product_cells, "product_cells")

    @cached_property
    def source_cells(self) -> DataFrame:
        return store(self.plain.source_cells, "source_cells")

    @cached_property
    def links(self) -> DataFrame:
        return store(self.plain.links, "links")
