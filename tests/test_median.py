from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from isopanel.operators.median import Sketches, exact_median, value_counts


def groups():
    rng = random.Random(11)
    made = {
        "one": [3.5],
        "two": [1.0, 2.0],
        "even gap": [1.0, 2.0, 1e9, 2e9],
        "equal": [7.25] * 9,
        "zero": [0.0, -0.0, 0.0],
        "signs": [rng.uniform(-1, 1) for _ in range(501)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(400)],
        "tiny": [5e-324, 1e-320, -5e-324, 2e-310],
        "narrow": [288.15 + k * 2.0**-40 for k in range(1000)],
        "close": [1.0 + k * 2.0**-52 for k in range(300)],
        "skewed": [42.0] * 5000 + [rng.uniform(0, 100) for _ in range(999)],
        "infinite": [float("-inf"), 1.0, 2.0, float("inf"), float("inf")],
    }
    return made


@pytest.mark.parametrize(
    ("few", "size", "margin"),
    [
        (4096, 4096, 0.0025),  # all groups but one are held whole by their sketches
        (4096, 64, 0.1),  # brackets
        (1, 64, 0.1),  # brackets that are narrowed down
        (8, 16, 0.0),  # brackets of no width, so that proofs fail
        (1, 8, 0.001),
    ],
)
def test_matches_brute_force(spark, few, size, margin):
    rows = [(g, float(v)) for g, values in groups().items() for v in values]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, value double").repartition(7)
    got = {r["g"]: r["median"] for r in exact_median(df, ["g"], few=few, size=size, margin=margin).collect()}
    for g, values in groups().items():
        ordered = sorted(values)
        a, b = ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]
        assert got[g] == (a + b) / 2, g


def test_missing_values_and_keys_are_left_out(spark):
    rows = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", 4.0), (None, 9.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    assert [tuple(r) for r in exact_median(df, ["g"]).collect()] == [("a", 2.5)]


def test_counts_roll_up(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xyz"), rng.randrange(3), float(rng.randrange(20))) for _ in range(800)]
    df = spark.createDataFrame(rows, "a string, b int, value double")
    counts = value_counts(df, ["a", "b"])
    got = {r["b"]: r["median"] for r in exact_median(counts, ["b"], weight="n").collect()}
    assert got == {b: statistics.median(v for _, k, v in rows if k == b) for b in range(3)}


def test_order_and_partitioning_do_not_matter(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(4), rng.gauss(0, 1)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g int, value double")
    first = exact_median(df, ["g"]).orderBy("g").collect()
    again = exact_median(df.orderBy(F.rand(1)).repartition(13), ["g"]).orderBy("g").collect()
    assert first == again


def test_many_values_in_one_slab(spark):
    """Nearly all values share the first slab of a range that one far value stretches, level after level."""
    near = [1.0 + k * 2.0**-40 for k in range(6000)]
    rows = [(v,) for v in [*near, 1e3, 1e6, 1e300, -1e300]]
    df = spark.createDataFrame(rows, "value double").withColumn("g", F.lit("a"))
    ordered = sorted(v for (v,) in rows)
    expected = (ordered[(len(rows) - 1) // 2] + ordered[len(rows) // 2]) / 2
    assert [r["median"] for r in exact_median(df, ["g"], few=4).collect()] == [expected]
    counts = value_counts(df, ["g"])
    assert [r["median"] for r in exact_median(counts, ["g"], weight="n", few=4).collect()] == [expected]


def test_no_group_meets_in_one_task_before_it_is_narrowed(spark):
    """Rows leave their scan as (group, value) counts; a group's own rows meet only where few of them are left."""
    df = spark.range(20000).select((F.col("id") % 2).alias("g"), F.rand(4).alias("value"))
    counts = value_counts(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    first_shuffle = [line for line in counts.splitlines() if "Exchange hashpartitioning" in line][-1]
    assert "value" in first_shuffle
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exact_median(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ObjectHashAggregate" not in plan and "collect_list" not in plan and "CartesianProduct" not in plan
    assert plan.count("Scan parquet") <= 3  # the stored counts once, and the groups' ranges


def test_narrowing_leaves_few_values(spark):
    df = spark.range(50000).select(F.lit(1).alias("g"), F.exp(F.randn(5) * 9).alias("value"))
    values = sorted(r["value"] for r in df.collect())
    assert exact_median(df, ["g"], few=16).first()["median"] == (values[24999] + values[25000]) / 2


def test_coarser_groups_start_from_the_same_sketches(spark):
    rng = random.Random(12)
    rows = [(rng.choice("abc"), rng.randrange(4), rng.choice([rng.gauss(0, 1), 0.5])) for _ in range(9000)]
    sketches = Sketches(spark.createDataFrame(rows, "a string, b int, value double"), ["a", "b"], size=512, margin=0.02)
    fine = {(r["a"], r["b"]): r["median"] for r in sketches.median().collect()}
    assert fine == {k: statistics.median(v for a, b, v in rows if (a, b) == k) for k in {r[:2] for r in rows}}
    coarse = {r["b"]: r["median"] for r in sketches.median(["b"]).collect()}
    assert coarse == {k: statistics.median(v for _, b, v in rows if b == k) for k in range(4)}
    sums = {(r["a"], r["b"]): r["sum"] for r in sketches.sums().collect()}
    assert all(abs(sums[k] - sum(v for a, b, v in rows if (a, b) == k)) < 1e-9 for k in fine)


def test_two_passes_over_the_rows_at_most(spark):
    """Rows are counted as they are read: small groups once, large ones twice, whatever the values are."""
    for n, passes in ((3000, 1), (60000, 2)):
        read = spark.sparkContext.accumulator(0)

        def counted(batches, read=read):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        df = spark.range(n).select(F.lit(1).alias("g"), F.exp(F.randn(3) * 50).alias("value"))
        assert exact_median(df.mapInArrow(counted, "g int, value double"), ["g"]).count() == 1
        assert read.value == passes * n


def test_one_group_with_most_rows_sends_few(spark):
    """What the second pass stores of a hot group is its bracket, a small share of its rows."""
    df = spark.range(200000).select((F.col("id") % 100 == 0).cast("int").alias("g"), F.rand(8).alias("value"))
    sketches = Sketches(df, ["g"])
    values = sorted(r["value"] for r in df.where("g = 0").collect())
    got = {r["g"]: r["median"] for r in sketches.median().collect()}
    assert got[0] == (values[98999] + values[99000]) / 2
    lo, hi = (F.kll_sketch_get_quantile_double("_sketch", F.lit(0.5 + x * sketches.margin)) for x in (-1, 1))
    bracket = sketches.states.where("g = 0").select(lo.alias("lo"), hi.alias("hi")).first()
    assert 0 < sum(bracket["lo"] <= v <= bracket["hi"] for v in values) < 0.01 * len(values)


def test_nothing_to_take_a_median_of(spark):
    df = spark.range(50).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("value"))
    none = spark.createDataFrame([], df.schema)
    for empty in (none, df.where("false"), df.where("value < 0"), df.withColumn("value", F.lit(None).cast("double"))):
        assert exact_median(empty, ["g"]).collect() == []
