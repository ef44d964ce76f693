"""Joins with a key that holds half of all rows, with adaptive execution's own skew handling off."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from isopanel.operators import skew


@pytest.fixture
def plain_session(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield spark
    for name in settings:
        spark.conf.unset(name)


def tables(spark, n=40_000):
    """Supplier 7 has half of the line items; some have none or an unknown one; one lookup key occurs twice."""
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.pmod(F.hash("id"), F.lit(500)))
    facts = spark.range(n).select(F.col("id").alias("line"), key.alias("l_suppkey"), F.lit(1.0).alias("value"))
    rows = [(k, f"nation {k % 25}") for k in range(480)] + [(11, "again"), (None, "none")]
    return facts, spark.createDataFrame(rows, "s_suppkey int, place string")


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_half_of_the_rows_in_one_key(plain_session):
    facts, lookup = tables(plain_session)
    plain = facts.join(lookup, F.col("l_suppkey") == F.col("s_suppkey"))
    split = skew.split_join(facts, lookup, "l_suppkey", "s_suppkey")
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in plan
    assert Counter(map(tuple, split.collect())) == Counter(map(tuple, plain.collect()))
    assert largest_share(plain) > 0.5 and largest_share(split) < 0.25


def test_even_keys_are_joined_plainly(plain_session):
    facts, lookup = tables(plain_session)
    even = facts.withColumn("l_suppkey", F.col("line") % 400)
    assert skew.frequent_keys(even, "l_suppkey", 1 / 8) == {}
    plan = skew.split_join(even, lookup, "l_suppkey", "s_suppkey")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1


def test_a_small_lookup_is_broadcast_and_the_facts_are_not_read_before(spark):
    facts, lookup = tables(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    joined = skew.split_join(facts.mapInArrow(counted, facts.schema), lookup, "l_suppkey", "s_suppkey", broadcastable=True)
    assert read.value == 0 and joined.count() > 30_000 and read.value == 40_000


def test_empty_facts(plain_session):
    facts, lookup = tables(plain_session)
    assert skew.split_join(facts.where("line < 0"), lookup, "l_suppkey", "s_suppkey").count() == 0
