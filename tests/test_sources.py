"""The source files of the test bed: joins are made once, and the files hold what the plain joins give."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from isopanel.plans.cleaning import write_sources
from isopanel.plans.testbed import RAW_SOURCES, SCHEMAS, Testbed
from isopanel.sources import catalog as c
from isopanel.sources import observations as o

ROWS = {
    "nation": [(0, "A", 0), (1, "B", 1), (2, None, 1)],
    "customer": [(1, "x", 0, 1.0, "m"), (2, "y", 1, 1.0, "m"), (2, "z", 2, 1.0, "m"), (None, "w", 0, 1.0, "m")],
    "supplier": [(1, "s", 0, 1.0), (1, "t", 1, 1.0), (2, "u", None, 1.0), (None, "v", 1, 1.0)],
    "part": [(1, "p", "b1", "t1", 1, 1.0), (1, "q", "b2", None, 1, 1.0), (None, "r", "b3", "t3", 1, 1.0)],
}


@pytest.fixture(scope="module")
def bed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    when = F.expr("timestamp_ntz'1995-03-04 00:00:00' + make_dt_interval(cast(id * 40 as int))")
    key = F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 4)
    orders = spark.range(60).select(
        F.col("id").alias("o_orderkey"), key.alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit(1.5).alias("o_totalprice"),
        when.alias("o_orderdate"), F.lit("1").alias("o_orderpriority"),
    )
    lines = spark.range(200).select(
        (F.col("id") % 60).alias("l_orderkey"), key.alias("l_partkey"), (F.col("id") % 3).alias("l_suppkey"),
        (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity"),
        F.lit(1.0).alias("l_extendedprice"), (F.col("id") % 11 / 100).alias("l_discount"), F.lit(0.0).alias("l_tax"),
        F.element_at(F.array(*map(F.lit, "ANR")), (F.col("id") % 3 + 1).cast("int")).alias("l_returnflag"),
        F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("l_linestatus"), when.alias("l_shipdate"),
    )
    tables = {name: spark.createDataFrame(rows, SCHEMAS[name]) for name, rows in ROWS.items()}
    for name, table in (tables | {"orders": orders, "lineitem": lines}).items():
        table.write.parquet(f"{root}/{name}.parquet")
    return Testbed(spark, str(root))


def collected(df):
    return Counter(map(tuple, df.collect()))


def test_files_hold_the_rows_of_plain_joins(bed):
    root = write_sources(bed)
    parts = bed._line_places.join(bed.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    places = {"orders": bed._order_places, "lines": bed._line_places, "parts": parts}
    for name, (base, columns) in RAW_SOURCES.items():
        expected = places[base].select(*[F.expr(sql).alias(column) for column, sql in columns.items()])
        assert expected.count() > 0
        assert collected(bed.raw_sources[name]) == collected(expected)
        files = [p.name for p in Path(root, c.SOURCE_FILES[name]).glob("part-*")]
        assert files and all(p.endswith(".lz4") for p in files)
        assert o.scan_observations(bed.spark, f"{root}/{c.SOURCE_FILES[name]}").count() == expected.count()


def test_sources_of_one_join_read_what_was_stored(bed):
    for name, (base, _) in RAW_SOURCES.items():
        plan = bed.raw_sources[name]._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plan) == (base == "lines")
