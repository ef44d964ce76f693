"""The whole path from CSV files to documents and texts, against plain Python on a small fixture."""

from __future__ import annotations

import csv
import json
import random
import statistics
from collections import defaultdict
from pathlib import Path

import pytest

from isopanel.plans import batch, overview
from isopanel.sources import catalog as c
from isopanel.sources import observations as o

BASE = [c.PERIOD_COLUMN, c.COUNTRY_COLUMN, c.VALUE_COLUMN, c.UNIT_COLUMN]
PLACES = ["Fiji", "Samoa", "Tonga", "Lemuria"]  # the last one is not in the dimension


def climate_rows(code, unit, rng, years=range(1990, 2020)):
    rows = []
    for place in PLACES:
        for year in years:
            rows.append([str(year), place, f"{rng.gauss(0, 1):.4f}", unit, code])
    rows += [
        ["abc", "Fiji", "1", unit, code], ["2001.7", "Fiji", "0.5", unit, code], ["2001", "Fiji", "n/a", unit, code],
        ["2001", "", "9", unit, code], ["2001", "Fiji", "99", "OTHER", code], ["2001", "Fiji", "99", unit, "OTHER"],
        ["2001", "Fiji", "12d", unit, code], ["2002", "Samoa", "1,234", unit, code],
    ]
    return BASE + [c.CLIMATE_COLUMN], rows


def product_rows(kind, unit, rng):
    rows = []
    for place in ("Fiji", "Samoa", "Lemuria"):
        for product in ("Taro", "Yam", "Maize, green", "Coconut"):
            for year in range(2000, 2006):
                for _ in range(2):
                    rows.append([str(year), place, str(rng.randrange(100, 900)), unit, kind, product])
    rows.append(["2001", "Fiji", "5000", unit, kind, ""])
    return BASE + [c.PRODUCTION_COLUMN, c.PRODUCT_COLUMN], rows


def power_rows(rng):
    rows = []
    for place in ("Fiji", "Samoa", "Lemuria"):
        for year in range(2010, 2015):
            total = 0
            for source in ("Oil", "Solar"):
                parts = [rng.randrange(1, 50), rng.randrange(1, 50)]
                total += sum(parts)
                for grid, value in zip(("On-grid", "Off-grid"), parts):
                    rows.append([str(year), place, str(value), "GWH", source, grid])
                rows.append([str(year), place, str(sum(parts)), "GWH", source, "Total"])
            rows.append([str(year), place, str(total), "GWH", "Renewable (total)", "Total"])
            rows.append([str(year), place, str(total), "GWH", "TOTAL", "On-grid"])
    rows += [["2010", "Fiji", "7", "GWH", "", "On-grid"], ["2010", "Fiji", "8", "GWH", "Oil", ""], ["2010", "Fiji", "9", "MW", "Oil", "On-grid"]]
    return BASE + [c.SOURCE_COLUMN, c.GRID_COLUMN], rows


def visitor_rows(rng):
    rows = [
        [str(y), p, str(rng.randrange(100, 9999)), "N", kind]
        for p in ("Fiji", "Samoa") for y in range(2015, 2020) for kind in ("Overnight tourists", "Same-day") for _ in range(2)
    ]
    return BASE + [c.VISITOR_COLUMN], rows


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(7)
    made = {
        "mean_surface_temp_anomalies": climate_rows("ST_ANOM", "CELSIUS", rng),
        "mean_sea_surface_temp_anomalies": climate_rows("SST_ANOM", "CELSIUS", rng),
        "rainfall_anomalies": climate_rows("RAIN_ANOM", "MM", rng, range(2000, 2012)),
        "crop_yield": product_rows("CROP_YIELD", "KGHA", rng),
        "livestock_yield": product_rows("LVST_YIELD", "KG_AN", rng),
        "power_generation": power_rows(rng),
        "tourist_arrivals": visitor_rows(rng),
    }
    for name in ("environmental_taxes", "greenhouse_gas_emissions", "meteorological_monitoring", "sea_level_anomalies"):
        made[name] = (BASE, [["2000", "Tonga", "1", "X"], ["2001", "Atlantis", "2", "X"]])
    return made


@pytest.fixture(scope="module")
def root(tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    for name, (header, rows) in tables.items():
        with open(folder / c.SOURCE_FILES[name], "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([header, *rows])
    return str(folder)


@pytest.fixture(scope="module")
def result(spark, root, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    datasets = batch.stage(spark, root)
    built = batch.build(datasets, out)
    before = {p: p.read_bytes() for p in Path(out).rglob("*.parquet")}
    details = batch.enrich(datasets, built, out)
    assert all(p.read_bytes() == data for p, data in before.items())
    return datasets, built, details, out


def kept(tables, name):
    """Rows of a source as dictionaries with parsed year and value, bad ones left out."""
    header, rows = tables[name]
    for row in rows:
        entry = dict(zip(header, row))
        try:
            entry["year"], entry["value"] = int(float(entry[c.PERIOD_COLUMN])), float(entry[c.VALUE_COLUMN])
        except ValueError:
            continue
        if entry[c.COUNTRY_COLUMN]:
            yield entry


def expected_series(tables):
    def rows():
        for i in c.STANDARD_CATALOG.indicators:
            for e in kept(tables, i.source):
                if any(e[k] != v for k, v in i.rows.equals.items()):
                    continue
                if i.name == "power_generation" and ("total" in e[c.SOURCE_COLUMN].lower() or e[c.GRID_COLUMN] == "Total"):
                    continue
                yield i, e

    own, region = defaultdict(list), defaultdict(list)
    for i, e in rows():
        own[i.name, e[c.COUNTRY_COLUMN], e["year"]].append(e["value"])
        region[i.name, e["year"]].append(e["value"])
    agg = {"median": statistics.median, "sum": sum}
    return (
        {k: round(agg[c.STANDARD_CATALOG[k[0]].agg](v), 3) for k, v in own.items()},
        {k: round(statistics.median(v), 3) for k, v in region.items()},
    )


def test_series_and_regional_medians(result, tables):
    _, built, _, _ = result
    own, region = expected_series(tables)
    got = {(r["indicator"], r["country"], r["year"]): (r["value"], r["regional_median"]) for r in built["series"].collect()}
    assert got == {k: (v, region[k[0], k[2]]) for k, v in own.items()}


def test_documents(result, tables):
    _, _, _, out = result
    documents = [json.loads(line) for p in Path(out).glob("versions/*/documents/*/*.json") for line in p.read_text("utf-8").splitlines()]
    by_name = {d["country"]: d for d in documents}
    assert len(by_name) == 22 and "Lemuria" not in by_name
    own, _ = expected_series(tables)
    fiji = by_name["Fiji"]["indicators"]
    assert set(fiji) == {i.name for i in c.STANDARD_CATALOG.indicators}
    for name, record in fiji.items():
        assert record["years"] == sorted(record["years"])
        assert record["values"] == [own[name, "Fiji", y] for y in record["years"]]
        assert record["label"] == c.STANDARD_CATALOG[name].label
    assert by_name["Tuvalu"]["indicators"] == {}
    assert (by_name["Fiji"]["meta"]["x_pct"], by_name["Fiji"]["meta"]["y_pct"]) == (48.24, 75.43)


def test_enriched_documents(result, tables):
    _, built, details, out = result
    documents = [json.loads(line) for p in Path(out).glob("versions/*/documents_enriched/*/*.json") for line in p.read_text("utf-8").splitlines()]
    fiji = next(d for d in documents if d["country"] == "Fiji")
    cells = defaultdict(list)
    for e in kept(tables, "crop_yield"):
        if e[c.COUNTRY_COLUMN] == "Fiji" and e[c.PRODUCT_COLUMN]:
            cells[e[c.PRODUCT_COLUMN], e["year"]].append(e["value"])
    products = fiji["products"]["crop_yield"]
    assert set(products) == {"Taro", "Yam", "Maize, green", "Coconut"}
    for product, found in products.items():
        assert found["values"] == [round(statistics.median(cells[product, y]), 2) for y in found["years"]]
    values = fiji["tail_risk"]["surface_temp_anomaly"]["values"]
    mean, std = statistics.fmean(values), statistics.pstdev(values)
    assert fiji["tail_risk"]["surface_temp_anomaly"]["std"] == round(std, 3)
    assert [e["value"] for e in fiji["tail_risk"]["surface_temp_anomaly"]["extremes"]] == [v for v in values if abs(v - mean) > 2 * std]
    links = {(link["source"], link["target"]): link["value"] for link in fiji["power_sankey"]["links"]}
    expected = defaultdict(float)
    for e in kept(tables, "power_generation"):
        if e[c.COUNTRY_COLUMN] == "Fiji" and e[c.UNIT_COLUMN] == "GWH" and e[c.SOURCE_COLUMN] in ("Oil", "Solar") and e[c.GRID_COLUMN] in ("On-grid", "Off-grid"):
            expected[e[c.SOURCE_COLUMN], e[c.GRID_COLUMN]] += e["value"]
    assert links == dict(expected)
    tuvalu = next(d for d in documents if d["country"] == "Tuvalu")
    assert tuvalu["products"] == {} and tuvalu["power_sankey"] == {"links": []} and tuvalu["tail_risk"] == {}


def test_subtotals_are_not_counted_twice(spark, root, tables):
    raw = o.scan_observations(spark, f"{root}/{c.SOURCE_FILES['power_generation']}")
    parts = sum(r["value"] for r in o.load_power_total(raw).where("country = 'Samoa' AND year = 2012").collect())
    subtotal = next(
        e["value"] for e in kept(tables, "power_generation")
        if e[c.COUNTRY_COLUMN] == "Samoa" and e["year"] == 2012 and e[c.SOURCE_COLUMN] == "Renewable (total)"
    )
    assert parts == subtotal
    both = sum(r["value"] for r in o.load_power_all_grids(raw).where("country = 'Samoa' AND year = 2012").collect())
    assert both == 2 * subtotal
    # Missing source or grid labels stay in the total.
    assert o.load_power_total(raw).where("country = 'Fiji' AND value IN (7, 8)").count() == 2


def test_answers(spark, result):
    _, built, details, _ = result
    asked = spark.createDataFrame([("Fiji", "Samoa"), ("Nowhere", "Fiji"), ("Tonga", "Tonga")], "country string, compare string")
    got = batch.answer(built, details, asked)
    texts = {(r["country"], r["compare"], r["indicator"]): r["text"] for r in got["insights"].collect()}
    assert ("Fiji", "Samoa", "crop_yield") in texts and ("Fiji", "", "crop_yield") in texts
    assert "By comparison, Samoa's" in texts["Fiji", "Samoa", "rainfall_anomaly"]
    assert "By comparison" not in texts["Tonga", "", "rainfall_anomaly"]
    summary = {(r["country"], r["compare"]): r["text"] for r in got["summary"].collect()}
    paragraphs = summary["Fiji", "Samoa"].split("\n\n")
    assert [p.split("**")[1] for p in paragraphs] == ["Land & Food", "Ocean & Atmosphere", "People & Economy"]
    ranked = {(r["country"], r["indicator"]): r["text"] for r in got["ranked_insights"].collect()}
    assert ranked["Tonga", "crop_yield"] == "No crop yield data is available for Tonga."
    assert ranked["Fiji", "crop_yield"].startswith("Across all recorded years, ")
    roles = {(r["primary"], r["compare"], r["role"], r["country"]) for r in got["charts"].collect()}
    assert roles == {
        ("Fiji", "Samoa", "primary", "Fiji"), ("Fiji", "Samoa", "compare", "Samoa"), ("Fiji", "", "primary", "Fiji"),
        ("Tonga", "", "primary", "Tonga"),
    }
    assert len(got["tail_risk_insights"].collect()) == 6
    assert len(got["power_mix_insights"].collect()) == 3 and len(got["flow_insights"].collect()) == 3


def test_overviews(result, tables):
    datasets, _, _, _ = result
    lines, text = overview.comparison(datasets, overview.SECTIONS[0])
    texts = {r["country"]: r["text"] for r in text.collect()}
    assert set(texts) == set(PLACES) and texts["Fiji"].startswith("\n### Dynamic Insight for Fiji (Mean Surface")
    assert "**Overview (1990-2019):**" in texts["Tonga"]
    assert not any(step in text._jdf.queryExecution().executedPlan().toString() for step in ("Cartesian", "NestedLoop"))
    regional = {r["year"]: r["value"] for r in lines.where(f"country = '{overview.REGION_LABEL}'").collect()}
    values = defaultdict(list)
    for e in kept(tables, "mean_surface_temp_anomalies"):
        if e[c.UNIT_COLUMN] == "CELSIUS" and e[c.CLIMATE_COLUMN] == "ST_ANOM":
            values[e["year"]].append(e["value"])
    assert regional == {y: statistics.median(v) for y, v in values.items()}

    rows, risk = overview.tail_risk(datasets, overview.SECTIONS[0])
    own = [e["value"] for e in kept(tables, "mean_surface_temp_anomalies")
           if e[c.UNIT_COLUMN] == "CELSIUS" and e[c.CLIMATE_COLUMN] == "ST_ANOM" and e[c.COUNTRY_COLUMN] == "Tonga"]
    limit = 2 * statistics.stdev(own)
    assert sorted(r["value"] for r in rows.where("country = 'Tonga'").collect()) == sorted(v for v in own if abs(v) > limit)
    assert f"exceeding **{limit:.2f}°C**" in {r["country"]: r["text"] for r in risk.collect()}["Tonga"]

    power = overview.power(datasets)
    assert {r["country"] for r in power["mix_text"].collect()} == {"Fiji", "Samoa", "Lemuria"}
    flow = {r["country"]: r["text"] for r in power["flow_text"].collect()}
    assert "Flow (2010-2014)" in flow["Samoa"]
    assert power["nodes"].where("country = 'Samoa'").count() == 5
    assert overview.products(datasets, "crop_yield")["ranked"].where("country = 'Fiji'").count() == 8
    _, tourism = overview.comparison(datasets, overview.SECTIONS[5])
    assert "Tourism Arrivals (Overnight tourists)" in tourism.collect()[0]["text"]


def test_scan_union_and_country_list(spark, root):
    datasets = o.scan_many(spark, root)
    union = o.union_datasets(datasets)
    assert {r["dataset"] for r in union.select("dataset").distinct().collect()} == set(c.SOURCE_FILES)
    names = {r["country"] for r in o.master_country_list(datasets.values()).collect()}
    assert names == {*PLACES, "Atlantis"}


def test_tourism_filter(spark):
    assert c.STANDARD_CATALOG["tourism_arrivals"].rows.equals[c.VISITOR_COLUMN] == "Overnight tourists"


def _csv(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")


def test_header_names_decide(spark, tmp_path):
    _csv(tmp_path, "a.csv", "OBS_VALUE,TIME_PERIOD,UNIT_MEASURE\n5,2001,X\nNA,2002,Y\n")
    rows = o.scan_observations(spark, str(tmp_path / "a.csv"), ["TIME_PERIOD", "OBS_VALUE"]).collect()
    assert [tuple(r) for r in rows] == [("2001", "5"), ("2002", None)]
    assert o.scan_observations(spark, str(tmp_path / "a.csv")).columns == ["OBS_VALUE", "TIME_PERIOD", "UNIT_MEASURE"]


def test_parts_with_other_headers_are_refused(spark, tmp_path):
    _csv(tmp_path / "parts", "a.csv", "TIME_PERIOD,OBS_VALUE\n2001,5\n")
    _csv(tmp_path / "parts", "b.csv", "OBS_VALUE,TIME_PERIOD\n6,2002\n")
    with pytest.raises(Exception, match="(?i)header"):
        o.scan_observations(spark, str(tmp_path / "parts")).collect()


def test_line_breaks_inside_of_quotes(spark, tmp_path):
    _csv(tmp_path, "m.csv", 'TIME_PERIOD,NOTE\n2001,"one\ntwo, ""three"""\n2002,four\n')
    rows = o.scan_observations(spark, str(tmp_path / "m.csv"), multiline=True).collect()
    assert [tuple(r) for r in rows] == [("2001", 'one\ntwo, "three"'), ("2002", "four")]


def test_extended_payload_and_types(spark, result):
    _, built, details, _ = result
    asked = spark.createDataFrame([("Fiji", "Samoa"), ("Tonga", "")], "country string, compare string")
    got = batch.answer(built, details, asked)
    for name in (*batch.CHART_TABLES, "ranked"):
        rows = got[f"charts_{name}"].select("primary", "role", "country").distinct().collect()
        assert {("Fiji", "primary", "Fiji"), ("Fiji", "compare", "Samoa")} <= {tuple(r) for r in rows} or name == "extremes"
        assert {r["country"] for r in rows} <= {"Fiji", "Samoa", "Tonga"}
    assert dict(built["series"].dtypes)["indicator"] == "string"
    headline = built["headline_stat"].collect()
    assert len(headline) == 1 and headline[0]["unit"] == "°C" and headline[0]["label"] == c.HEADLINE_LABEL
