"""Counted cleaning: what is kept equals what loading keeps, and the rest is kept aside with its reason."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from isopanel.operators import power as pw
from isopanel.operators import series as s
from isopanel.plans import batch
from isopanel.sinks import releases
from isopanel.sources import catalog as c
from isopanel.sources import cleaning as cl
from isopanel.sources import observations as o

from .test_batch import result, root, tables  # noqa: F401  (fixtures)

NAMES = [c.PERIOD_COLUMN, c.COUNTRY_COLUMN, c.VALUE_COLUMN, c.UNIT_COLUMN, c.SOURCE_COLUMN, c.GRID_COLUMN]


def power(spark, n=600, seed=2):
    rng = random.Random(seed)
    rows = [
        (
            rng.choice(["2001", "2002", "2002.7", "abc", None]), rng.choice(["Fiji", "Samoa", None]),
            rng.choice(["1", " 2.5 ", "1e3", "12d", "NaN", "inf", None]), rng.choice(["GWH", "GWH", "MW", None]),
            rng.choice(["Solar", "Oil", "Renewable (total)", "TOTAL", None]),
            rng.choice(["On-grid", "Off-grid", "Total", "Other", None]),
        )
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, ", ".join(f"`{name}` string" for name in NAMES)).repartition(3)


def collected(df):
    return Counter(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_kept_rows_are_those_of_loading(spark):
    df = power(spark)
    cases = (
        (c.POWER_TOTAL_ROWS, {}, ("country", "year", "value"), True),
        (c.POWER_BY_SOURCE_ROWS, {c.SOURCE_COLUMN: "member"}, ("country", "year", "member", "value"), True),
        (c.POWER_FLOW_ROWS, {c.SOURCE_COLUMN: "source", c.GRID_COLUMN: "target"}, ("country", "source", "target", "value"), False),
        (c.RowRule(), {}, (), True),
    )
    for rule, extra, required, with_year in cases:
        found = cl.clean(df, rule, "x", extra, required, with_year)
        assert collected(found.rows) == collected(o.load_rows(df, rule, extra, required, with_year))
        counts = {r["reason"]: r["n_rows"] for r in found.counts.collect()}
        assert sum(counts.values()) == df.where(rule.condition()).count()
        assert counts.pop(cl.KEPT, 0) == found.rows.count()
        assert counts == {r["reason"]: r["count"] for r in found.quarantine.groupBy("reason").count().collect()}
        assert required or not counts


def test_first_reason_counts_and_texts_are_kept(spark):
    rows = [
        ("abc", None, "x"), ("abc", "Fiji", "x"), (None, "Fiji", None), ("2001", "Fiji", None), ("2001", "Fiji", "12d"),
        ("2001", "Fiji", "5"),
    ]
    df = spark.createDataFrame(rows, f"`{c.PERIOD_COLUMN}` string, `{c.COUNTRY_COLUMN}` string, `{c.VALUE_COLUMN}` string")
    found = cl.clean(df, c.RowRule(), "i")
    assert {tuple(r) for r in found.quarantine.select("indicator", "reason", "country", "period_text", "value_text").collect()} == {
        ("i", "country missing", None, "abc", "x"), ("i", "year not a number", "Fiji", "abc", "x"),
        ("i", "year missing", "Fiji", None, None), ("i", "value missing", "Fiji", "2001", None),
        ("i", "value not a number", "Fiji", "2001", "12d"),
    }
    assert [tuple(r) for r in found.rows.collect()] == [("Fiji", 2001, 5.0)]


def test_one_pass_over_the_rows(spark):
    read = spark.sparkContext.accumulator(0)
    df = power(spark)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    found = cl.clean(df.mapInArrow(counted, df.schema), c.RowRule(), "x")
    assert found.rows.count() + found.quarantine.count() == 600 == read.value and found.counts.count() > 3
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(reason" in plan


def test_lines_that_do_not_fit_their_header(spark, tmp_path):
    path = tmp_path / "m.csv"
    header = f'{c.PERIOD_COLUMN},"{c.COUNTRY_COLUMN}",{c.VALUE_COLUMN},{c.UNIT_COLUMN}\n'
    path.write_text(header + "2001,Fiji,5,X\n2002,Fiji,6,X,more\n2003,Fiji\n2004,Fiji,NA,X\n2005,Fiji,7,Y\n", encoding="utf-8")
    df = o.scan_observations(spark, str(path), corrupt=cl.CORRUPT)
    found = cl.clean(df, c.RowRule(equals={c.UNIT_COLUMN: "X"}), "i")
    assert [tuple(r) for r in found.rows.collect()] == [("Fiji", 2001, 5.0)]
    assert {(r["reason"], r["line"]) for r in found.quarantine.collect()} == {
        ("malformed record", "2002,Fiji,6,X,more"), ("malformed record", "2003,Fiji"), ("value missing", None),
    }


def test_a_build_releases_counts_and_quarantine(spark, result, tables):  # noqa: F811
    _, built, _, out = result
    counts = {(r["indicator"], r["reason"]): r["n_rows"] for r in built["cleaning"].collect()}
    climate = {reason: n for (name, reason), n in counts.items() if name == "surface_temp_anomaly"}
    assert climate == {"kept": 121, "year not a number": 1, "value missing": 1, "country missing": 1, "value not a number": 2}
    rows = releases.tables(spark, out)["quarantine"].where("indicator = 'surface_temp_anomaly'").collect()
    assert Counter(r["reason"] for r in rows) == Counter({k: n for k, n in climate.items() if k != "kept"})
    assert {"12d", "1,234"} <= {r["value_text"] for r in rows}


def test_power_is_read_once(spark, result):  # noqa: F811
    datasets, built, _, out = result
    df = power(spark)
    cells = pw.power_cells(df)
    pairs = [
        (pw.total_rows(cells), o.load_power_total(df), ["country", "year"]),
        (pw.all_grids_rows(cells), o.load_power_all_grids(df), ["country", "year"]),
        (pw.source_rows(cells), o.load_power_by_source(df), ["country", "year", "member"]),
        (pw.flow_rows(cells).drop("year"), o.load_power_by_source_grid(df), ["country", "source", "target"]),
        (pw.flow_rows(cells, True).drop("year"), o.load_power_by_source_grid(df, True), ["country", "source", "target"]),
    ]
    for ours, plain, keys in pairs:
        summed = [x.groupBy(*keys).agg(F.sum("value").alias("v")).collect() for x in (ours, plain)]
        assert sorted(map(str, summed[0])) == sorted(map(str, summed[1])) and summed[0]
    read = spark.sparkContext.accumulator(0)
    raw = datasets["power_generation"]

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    batch.enrich({**datasets, "power_generation": raw.mapInArrow(counted, raw.schema)}, built, out + "-again")
    assert read.value == raw.count()


def test_both_ends_without_sorting_rows(spark):
    rng = random.Random(4)
    rows = [
        (k, rng.choice([2000, 2000, 2000, 2001, 2005]) + rng.randrange(2), rng.choice([None, 1.0, 1.0, rng.random()]))
        for k in "abcd" for _ in range({"a": 900, "b": 40, "c": 7, "d": 1}[k])
    ] + [("e", None, 1.0), (None, 2000, 1.0)]
    df = spark.createDataFrame(rows, "k string, year int, value double").repartition(4)
    for n in (1, 10, 25):
        first, last = s.first_n_last_n(df, n, ["k"])
        for got, reverse in ((first, False), (last, True)):
            found = Counter(map(tuple, got.select("k", "position", "year", "value").collect()))
            expected = Counter()
            for k in "abcd":
                own = [(y, v) for x, y, v in rows if x == k]
                own.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0), reverse=reverse)
                expected.update((k, i + 1, *row) for i, row in enumerate(own[:n]))
            assert found == expected
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    first, _ = s.first_n_last_n(df.mapInArrow(counted, df.schema), 10, ["k"])
    read = seen.value
    first.count()
    assert seen.value == read == 2 * len(rows)  # what is returned sorts stored counts, no rows


def test_counting_reasons_adds_nothing_to_each_row(spark):
    """Rows are written without being counted on the way, and each text is read by one expression."""
    df = power(spark)
    rows, reasons = cl.judged(df, c.POWER_TOTAL_ROWS)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2  # the year and the value
    assert reasons[0] == cl.KEPT and len(reasons) == 6
    found = cl.clean(df, c.POWER_TOTAL_ROWS, "x")
    assert "CollectMetrics" not in found.rows._jdf.queryExecution().optimizedPlan().toString()
    counts = [(r["indicator"], r["reason"], r["n_rows"]) for r in found.counts.collect()]
    kept = rows.groupBy("reason").count().collect()
    assert sorted(counts) == sorted(("x", r["reason"], r["count"]) for r in kept)
