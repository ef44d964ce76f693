from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from isopanel.operators import breakdown as b
from isopanel.operators import compare as cmp
from isopanel.operators import flows as fl
from isopanel.operators import narrative as n
from isopanel.operators import risk as rk
from isopanel.operators import series as s
from isopanel.operators import trend as tr

SERIES = "country string, indicator string, year int, value double"
CELLS = "country string, member string, year int, value double"
LINKS = "country string, source string, target string, value double"


def series(spark, **values):
    rows = [(c, "i", 2000 + k, float(v)) for c, vs in values.items() for k, v in enumerate(vs)]
    return spark.createDataFrame(rows, SERIES)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def least_squares(values):
    xs = [2000 + k for k in range(len(values))]
    mx, my = statistics.fmean(xs), statistics.fmean(values)
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, values)) / sum((x - mx) ** 2 for x in xs)
    return slope, my - slope * mx


def test_trend(spark):
    rng = random.Random(1)
    long = [round(0.3 * k + rng.gauss(0, 1), 3) for k in range(40)]
    got = by(tr.linear_trend(series(spark, one=[1], two=[1, 5], three=[1, 2, 4], flat=[2.5] * 5, zero=[0] * 4, long=long)), "country")
    for short in ("one", "two"):
        assert got[short]["slope_per_decade"] is None and got[short]["r_squared"] is None
        assert got[short]["intercept"] is None
    assert got["flat"]["r_squared"] == 0 and got["flat"]["slope_per_decade"] == 0
    assert got["flat"]["relative_slope_pct"] == 0
    assert got["zero"]["relative_slope_pct"] is None
    for name, values in (("three", [1, 2, 4]), ("long", long)):
        slope, intercept = least_squares(values)
        fitted = [slope * (2000 + k) + intercept for k in range(len(values))]
        mean = statistics.fmean(values)
        r2 = 1 - sum((y - f) ** 2 for y, f in zip(values, fitted)) / sum((y - mean) ** 2 for y in values)
        assert got[name]["slope_per_decade"] == round(slope * 10, 4)
        assert math.isclose(got[name]["slope_per_year"], slope, rel_tol=1e-9)
        assert math.isclose(got[name]["intercept"], intercept, rel_tol=1e-9)
        assert got[name]["r_squared"] == round(r2, 3)
        size = statistics.fmean(abs(v) for v in values)
        assert got[name]["relative_slope_pct"] == round(slope * 10 / size * 100, 2)


def test_full_series_trend_and_windowed_trend_differ(spark):
    values = [0] * 10 + [100] * 5 + [0] * 10
    df = series(spark, a=values)
    assert by(tr.window_trend(df, 1.0), "country")["a"]["trend"] == "stable"
    rising = series(spark, a=[0] * 10 + list(range(10)))
    assert by(tr.window_trend(rising, 1.0), "country")["a"]["trend"] == "rising"
    assert by(tr.linear_trend(rising), "country")["a"]["slope_per_decade"] == round(least_squares([0] * 10 + list(range(10)))[0] * 10, 4)


@pytest.mark.parametrize("stat", ["mean", "median"])
def test_window_limits(spark, stat):
    rng = random.Random(6)
    data = {f"n{k}": [rng.uniform(0, 10) for _ in range(k)] for k in (1, 19, 20, 21, 45)}
    figure = statistics.fmean if stat == "mean" else statistics.median
    got = by(tr.window_trend(series(spark, **data), 0.5, stat=stat), "country")
    for name, values in data.items():
        row = got[name]
        if len(values) < 20:
            assert row["trend"] == "short" and math.isclose(row["overall"], figure(values))
        else:
            start, end = figure(values[:10]), figure(values[-10:])
            assert math.isclose(row["start_figure"], start) and math.isclose(row["end_figure"], end)
            expected = "rising" if end > start + 0.5 else "falling" if end < start - 0.5 else "stable"
            assert row["trend"] == expected


def test_windows_count_rows_not_years(spark):
    rows = [("a", "i", 2000 + k // 5, float(k)) for k in range(25)]
    row = tr.window_trend(spark.createDataFrame(rows, SERIES), 1.0).collect()[0]
    assert (row["start_figure"], row["end_figure"]) == (4.5, 19.5)


def test_annual_series(spark):
    rows = [("a", "i", 2000, 1.0), ("a", "i", 2000, 2.0), ("a", "i", 2001, 5.0), ("a", "i", 2001, None), (None, "i", 2000, 9.0)]
    df = spark.createDataFrame(rows, SERIES)
    median = by(s.annual_series(df, "median"), "year")
    assert {y: r["value"] for y, r in median.items()} == {2000: 1.5, 2001: 5.0}
    total = by(s.annual_series(df, "sum"), "year")
    assert {y: r["value"] for y, r in total.items()} == {2000: 3.0, 2001: 5.0}
    with pytest.raises(ValueError):
        s.annual_series(df, "mode")


def test_regional_median_uses_raw_rows(spark):
    rows = [("a", "i", 2000, v) for v in (1.0, 1.0, 1.0)] + [("b", "i", 2000, 9.0)]
    df = spark.createDataFrame(rows, SERIES)
    assert s.regional_median(df).collect()[0]["regional_median"] == 1.0
    countries = s.annual_series(df, "median")
    assert s.regional_of_series(countries).collect()[0]["regional_median"] == 5.0
    assert s.regional_mean(df).collect()[0]["regional_median"] == 3.0


def test_headline_change_is_absolute_across_zero(spark):
    base = spark.createDataFrame([("t", 1990, -0.25), ("t", 2000, 0.1), ("t", 2020, 1.0)], "indicator string, year int, regional_median double")
    row = s.headline_change(base).collect()[0]
    assert (row["start_year"], row["end_year"], row["change"]) == (1990, 2020, 1.25)


def test_extent_ties_go_to_the_earliest_year(spark):
    row = s.series_extent(series(spark, a=[3, 1, 9, 1, 9])).collect()[0]
    assert (row["min_year"], row["max_year"], row["first_year"], row["last_year"]) == (2001, 2002, 2000, 2004)


def test_first_and_last_rows_do_not_gather_the_series(spark):
    df = spark.range(0, 5000, 1, 8).select(
        F.when(F.col("id") < 4000, "a").otherwise("b").alias("country"), F.lit("i").alias("indicator"),
        F.col("id").cast("int").alias("year"), F.rand().alias("value"),
    )
    first, last = s.first_n_last_n(df, 3)
    assert sorted(r["year"] for r in first.collect()) == [0, 1, 2, 4000, 4001, 4002]
    assert sorted(r["year"] for r in last.collect()) == [3997, 3998, 3999, 4997, 4998, 4999]
    plan = first._jdf.queryExecution().executedPlan().toString()
    final, shuffle, partial = plan.index("3, Final"), plan.index("Exchange"), plan.index("3, Partial")
    assert final < shuffle < partial


def test_comparison_lines(spark):
    df = series(spark, a=[1, 2], b=[3, 4])
    lines = s.comparison_lines(df, s.regional_of_series(df), "Median")
    assert lines.where("country = 'Median'").count() == 2
    assert {r["value"] for r in lines.where("country = 'Median'").collect()} == {2.0, 3.0}
    assert {r["regional_median"] for r in lines.where("country = 'a'").collect()} == {2.0, 3.0}


def test_tail_risk_limits(spark):
    # Nineteen zeros and one value of 20: mean 1, deviation sqrt(19), so the value is far outside.
    got = by(rk.tail_risk_summary(
        rk.tail_risk_stats(series(spark, calm=[1, 2, 3], spike=[0] * 19 + [20])),
        rk.tail_risk_extremes(series(spark, calm=[1, 2, 3], spike=[0] * 19 + [20])),
    ), "country")
    assert got["calm"]["n_extremes"] == 0 and got["calm"]["extreme_year"] is None
    assert (got["spike"]["n_extremes"], got["spike"]["extreme_year"], got["spike"]["extreme_value"]) == (1, 2019, 20.0)
    assert got["spike"]["std"] == round(math.sqrt(19), 3)


def test_exactly_two_deviations_is_not_extreme(spark):
    # Mean 0 and population deviation 1: the two values of +-2 lie exactly at the threshold.
    values = [2, -2] + [0] * 6
    assert statistics.pstdev(values) == 1
    assert rk.tail_risk_extremes(series(spark, a=values)).count() == 0


def test_most_extreme_event_ties_go_to_the_earliest(spark):
    df = series(spark, a=[10, -10] + [0] * 18)
    row = rk.tail_risk_summary(rk.tail_risk_stats(df), rk.tail_risk_extremes(df)).collect()[0]
    assert (row["n_extremes"], row["extreme_year"]) == (2, 2000)


def test_zero_centred_risk_uses_sample_deviation(spark):
    values = [5.0, 5.5, 6.0, 5.2]
    df = series(spark, a=values)
    limits = rk.zero_centred_threshold(df)
    assert math.isclose(limits.collect()[0]["threshold"], 2 * statistics.stdev(values))
    assert rk.tail_risk_zero_centred(df, limits).count() == 4  # all far from zero, though close to the mean
    assert rk.tail_risk_extremes(df).count() == 0
    calm = series(spark, b=[-1, 1, -1, 1])
    assert rk.zero_centred_overview(calm).collect()[0]["n_extremes"] == 0
    peaks = rk.zero_centred_overview(series(spark, c=[-9, 9, 1, -9, 9] + [0] * 15)).collect()[0]
    assert (peaks["n_extremes"], peaks["min_year"], peaks["max_year"]) == (4, 2000, 2001)
    assert (peaks["first_year"], peaks["last_year"], peaks["min_value"], peaks["max_value"]) == (2000, 2019, -9.0, 9.0)
    single = rk.zero_centred_overview(series(spark, d=[3])).collect()[0]
    assert single["threshold"] is None and single["n_extremes"] == 0


def test_ranks(spark):
    for count in (0, 5, 10, 25):
        members = [(f"m{k:02d}", float(k // 2)) for k in range(count)]
        df = spark.createDataFrame([("c", m, v) for m, v in members], "country string, member string, median double")
        ordered = sorted(members, key=lambda p: p[1], reverse=True)
        top, bottom = ordered[:10], list(reversed(ordered[-10:]))
        for side, expected in (("top", top), ("bottom", bottom)):
            got = b.rank_members(df, side).orderBy("rank").collect()
            assert [(r["member"], r["median"]) for r in got] == expected
            assert [r["rank"] for r in got] == list(range(1, len(expected) + 1))


def test_medians_of_years_and_of_rows_differ(spark):
    rows = [("c", "m", 2000, v) for v in (1.0, 1.0, 1.0, 1.0, 1.0)] + [("c", "m", 2001, 9.0), ("c", "m", 2002, 9.0)]
    df = spark.createDataFrame(rows, CELLS)
    assert b.median_of_years(b.member_annual(df, "median")).collect()[0]["median"] == 9.0
    assert b.median_of_rows(df).collect()[0]["median"] == 1.0


def cells(spark):
    rows = [("c", "oil", 2000, 5.0), ("c", "oil", 2001, 4.0), ("c", "sun", 2001, 4.0), ("c", "wind", 2003, 1.0), ("d", "oil", 1999, 2.0)]
    return spark.createDataFrame(rows, CELLS)


def test_heatmaps(spark):
    dense = {(r["country"], r["member"], r["year"]): r["value"] for r in b.heatmap_dense(cells(spark)).collect()}
    assert len(dense) == 3 * 3 + 1
    assert dense["c", "oil", 2000] == 5.0 and dense["c", "sun", 2000] is None and dense["d", "oil", 1999] == 2.0
    wide = by(b.heatmap_pivot(cells(spark)), "country", "member")
    assert wide["c", "oil"]["years"] == [2000, 2001, 2003] and wide["c", "oil"]["values"] == [5.0, 4.0, None]
    assert wide["d", "oil"]["years"] == [1999]
    columns = by(b.heatmap_columns(cells(spark)), "country", "member")
    assert columns["c", "oil"]["2001"] == 4.0 and columns["d", "oil"]["1999"] == 2.0


def test_raw_rows_are_hashed_before_anything_is_picked(spark):
    raw = spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("country"), F.lit("i").alias("indicator"),
        (F.col("id") % 20).cast("int").alias("year"), F.rand(1).alias("value"),
    )
    for figures in (s.series_extent(raw), s.last_point(raw)):
        plan = figures._jdf.queryExecution().executedPlan().toString().splitlines()
        lowest = [line for line in plan if "Aggregate" in line][-1]
        assert "HashAggregate" in lowest and "SortAggregate" not in lowest and "year" in lowest
    plan = rk.zero_centred_overview(raw)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_headline_stat(spark):
    rows = [("surface_temp_anomaly", 2000, 0.25), ("surface_temp_anomaly", 2005, 1.0), ("other", 2000, 1.0)]
    baseline = spark.createDataFrame(rows, "indicator string, year int, regional_median double")
    labels = spark.createDataFrame([("surface_temp_anomaly", "°C"), ("other", "m")], "indicator string, unit string")
    got = s.headline_stat(s.headline_change(baseline), labels, "surface_temp_anomaly", "Headline").collect()
    assert [tuple(r) for r in got] == [("Headline", "°C", 2000, 2005, 0.25, 1.0, 0.75)]


def test_latest_mix_and_growth(spark):
    mix = by(b.latest_mix(cells(spark)), "country")
    assert (mix["c"]["latest_year"], mix["c"]["leader"], mix["c"]["total"]) == (2003, "wind", 1.0)
    earlier = by(b.latest_mix(cells(spark).where("year < 2003")), "country")
    assert (earlier["c"]["leader"], earlier["c"]["leader_value"], earlier["c"]["total"]) == ("oil", 4.0, 8.0)
    growth = by(b.mix_growth(cells(spark)), "country")
    assert growth["c"]["status"] == "contraction" and growth["d"]["status"] == "contraction"


def links(spark):
    rows = [("c", "Oil", "On-grid", 3.0), ("c", "Oil", "Off-grid", 1.0), ("c", "Solar", "On-grid", 3.0), ("c", "Wind", "Loop", 2.0), ("c", "Loop", "Oil", 1.0)]
    return spark.createDataFrame(rows, LINKS)


def test_nodes_in_link_order(spark):
    nodes = {(r["country"], r["label"]): r["idx"] for r in fl.flow_link_nodes(links(spark)).collect()}
    # Loop > Oil, Oil > Off-grid, Oil > On-grid, Solar > On-grid, Wind > Loop
    assert [label for _, label in sorted(nodes, key=nodes.get)] == ["Loop", "Oil", "Off-grid", "On-grid", "Solar", "Wind"]
    indexed = {(r["source_idx"], r["target_idx"]) for r in fl.flow_indexed(links(spark), nodes=fl.flow_link_nodes(links(spark))).collect()}
    assert indexed == {(0, 1), (1, 2), (1, 3), (4, 3), (5, 0)}


def test_flow_nodes_and_index(spark):
    nodes = {r["label"]: r["idx"] for r in fl.flow_index_nodes(links(spark)).collect()}
    # Sources by name, then targets as the sorted links first name them.
    assert nodes == {"Loop": 0, "Oil": 1, "Solar": 2, "Wind": 3, "Off-grid": 4, "On-grid": 5}
    indexed = {(r["source_idx"], r["target_idx"], r["value"]) for r in fl.flow_indexed(links(spark)).collect()}
    assert indexed == {(1, 5, 3.0), (1, 4, 1.0), (2, 5, 3.0), (3, 0, 2.0), (0, 1, 1.0)}
    assert fl.flow_nodes(links(spark)).count() == 6


def test_flow_leaders_and_totals(spark):
    rows = [("c", s_, t, v) for s_, t, v in (("Sun", "On-grid", 1.005), ("Oil", "On-grid", 1.0), ("Sun", "On-grid", 2.0))]
    made = fl.flow_links(spark.createDataFrame(rows, LINKS))
    assert {(r["source"], r["value"]) for r in made.collect()} == {("Sun", round(1.005 + 2.0, 2)), ("Oil", 1.0)}
    leaders = by(fl.flow_leaders(links(spark)), "target")
    assert leaders["On-grid"]["leader"] == "Oil" and leaders["On-grid"]["target_total"] == 6.0


def test_resolve_compare_has_one_rule(spark):
    dim = spark.createDataFrame([("Fiji",), ("Samoa",)], "country string")
    asked = spark.createDataFrame(
        [(1, "Fiji", ""), (2, "Fiji", None), (3, "Fiji", "Atlantis"), (4, "Fiji", "Fiji"), (5, "Fiji", "Samoa"), (6, "Nowhere", "Fiji")],
        "id int, country string, compare string",
    )
    known = cmp.country_or_default(asked, dim, "Fiji")
    got = {r["id"]: (r["country"], r["compare"]) for r in cmp.resolve_compare(known, dim).collect()}
    assert got == {1: ("Fiji", ""), 2: ("Fiji", ""), 3: ("Fiji", ""), 4: ("Fiji", ""), 5: ("Fiji", "Samoa"), 6: ("Fiji", "")}


def test_country_dimension_join(spark):
    dim = spark.createDataFrame([("a",), ("empty",)], "country string")
    df = series(spark, a=[1], stranger=[5])
    joined = cmp.join_country_dim(dim, s.align_regional(df, s.regional_median(df))).collect()
    assert {(r["country"], r["regional_median"]) for r in joined} == {("a", 3.0), ("empty", None)}
    assert [r["country"] for r in cmp.known_countries(df, dim, known=False).collect()] == ["stranger"]


def test_baseline_position_may_use_different_years(spark):
    df = spark.createDataFrame([("a", "i", 2000, 10.0), ("b", "i", 2005, 1.0)], SERIES)
    got = by(cmp.baseline_position(df, s.regional_of_series(df), 0.5), "country")
    assert (got["a"]["position"], got["a"]["last_year"], got["a"]["baseline_year"]) == ("higher", 2000, 2005)
    assert got["b"]["position"] == "aligned"


def labels(spark):
    return spark.createDataFrame([("i", 0, "Rain", "mm", "land", 0, "Land")], "indicator string, indicator_order int, label string, unit string, chapter string, chapter_order int, chapter_title string")


def insights(spark, df, requests):
    aligned = s.align_regional(df, s.regional_median(df))
    ends = tr.fitted_endpoints(tr.linear_trend(df), s.series_extent(df))
    asked = spark.createDataFrame(requests, "country string, compare string")
    return n.insight_indicator(n.indicator_facts(ends, cmp.latest_vs_median(aligned), labels(spark), asked))


def test_indicator_texts(spark):
    df = series(spark, A=[1, 2, 3], B=[3, 2, 1], C=[9, 9])
    got = by(insights(spark, df, [("A", "B"), ("B", ""), ("C", "A")]), "country")
    assert got["A"]["text"] == (
        "From 2000 to 2002, A's rain has risen at a rate of 10.00mm per decade, from roughly 1.00mm to 3.00mm along "
        "that trend. That's 1.00mm above the regional median (2.00mm). By comparison, B's most recent value is 2.00mm "
        "higher than A's, and has fallen over its own recorded period."
    )
    assert got["B"]["text"].endswith("That's 1.00mm below the regional median (2.00mm).")
    assert got["C"]["text"] == "Data for rain is too limited for C to establish a trend."


def test_in_line_and_flat_texts(spark):
    got = by(insights(spark, series(spark, A=[2, 2, 2]), [("A", "")]), "country")
    assert got["A"]["text"] == (
        "From 2000 to 2002, A's rain has fallen at a rate of 0.00mm per decade, from roughly 2.00mm to 2.00mm along "
        "that trend. That's in line with the regional median of 2.00mm."
    )


def test_summary_skips_what_has_no_trend(spark):
    texts = insights(spark, series(spark, A=[1, 2, 3], C=[9, 9]), [("A", ""), ("C", "")])
    got = by(n.insight_summary(texts), "country")
    assert set(got) == {"A"} and got["A"]["text"].startswith("**Land**: From 2000 to 2002, A's rain has risen")


def test_no_data_texts(spark):
    places = spark.createDataFrame([("X",)], "country string")
    assert n.insight_power_mix(places, b.latest_mix(cells(spark))).collect()[0]["text"] == "No power generation source data is available for X."
    assert n.insight_flow(places, fl.flow_leaders(links(spark))).collect()[0]["text"] == "No power generation flow data is available for X."
    ranked = spark.createDataFrame([], "country string, indicator string, side string, rank int, member string, median double")
    names = spark.createDataFrame([("X", "crop_yield", False), ("Y", "crop_yield", True)], "country string, indicator string, has_series boolean")
    titles = spark.createDataFrame([("crop_yield", "Crop Yield", " KG")], "indicator string, label string, unit string")
    got = by(n.insight_ranked(names, titles, ranked, ranked), "country")
    assert got["X"]["text"] == "No crop yield data is available for X."
    assert got["Y"]["text"] == "Not enough product-level data is available for Y."


def test_flow_text_with_one_target(spark):
    places = spark.createDataFrame([("c",)], "country string")
    only = fl.flow_leaders(links(spark).where("target = 'On-grid'"))
    assert n.insight_flow(places, only).collect()[0]["text"] == (
        "Across the recorded period, c generated 6.0 GWH in total. Oil leads On-grid supply at 3.0 GWH."
    )
