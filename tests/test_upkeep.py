"""Batches that are added one by one give what one build from all of them gives."""

from __future__ import annotations

import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopanel.plans import batch, upkeep
from isopanel.sinks import releases
from isopanel.sinks.releases import Release
from isopanel.sources import catalog as c

NAMES = ("mean_surface_temp_anomalies", "rainfall_anomalies", "tourist_arrivals", "power_generation")


def source(spark, name, seed, years):
    """Some rows of one source, with missing and unreadable ones."""
    rng = random.Random(seed)
    indicator = next(i for i in c.STANDARD_CATALOG.indicators if i.source == name)
    codes = dict(indicator.rows.equals)
    if name == "power_generation":
        codes |= {c.SOURCE_COLUMN: "Solar", c.GRID_COLUMN: "On-grid"}
    names = [c.PERIOD_COLUMN, c.COUNTRY_COLUMN, c.VALUE_COLUMN, *codes]
    rows = [
        (str(rng.choice(years)), rng.choice(["Fiji", "Samoa", "Tonga", None]), rng.choice([str(rng.randrange(-9, 40)), "3.25", "n/a"]), *codes.values())
        for _ in range(150)
    ]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


@pytest.fixture(scope="module")
def batches(spark):
    """Three batches; the last one has new years and also more rows for years of the first."""
    return [
        {name: source(spark, name, 31 * k + n, years) for n, name in enumerate(NAMES) if not (k == 1 and name == "rainfall_anomalies")}
        for k, years in enumerate([range(2000, 2008), range(2005, 2010), [2003, 2012, 2013]])
    ]


def together(batches):
    return {
        name: reduce(DataFrame.unionByName, [b[name] for b in batches if name in b]) for name in NAMES
    }


def rows_of(table):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in table.select(*sorted(table.columns)).collect())


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_batches_one_by_one(spark, batches, tmp_path, order):
    out, whole = str(tmp_path / "out"), str(tmp_path / "whole")
    catalog = c.Catalog(tuple(i for i in c.STANDARD_CATALOG.indicators if i.source in NAMES), c.STANDARD_CATALOG.chapters)
    for k in order:
        found = upkeep.add(spark, out, batches[k], catalog)
    built = batch.build(together(batches), whole, catalog=catalog)
    assert rows_of(found["series"]) == rows_of(built["series"])
    assert rows_of(found["trend"]) == rows_of(built["trend"])
    risky = built["series"].where(F.col("indicator").isin(*c.TAIL_RISK_INDICATORS)).drop("regional_median")
    assert rows_of(found["risk"]) == rows_of(upkeep.rk.tail_risk_stats(risky))
    assert rows_of(found["extremes"]) == rows_of(upkeep.rk.tail_risk_extremes(risky))
    assert sum(name.startswith(upkeep.STATES) for name in found) == 3


def test_untouched_groups_are_not_worked_out_again(spark, batches, tmp_path, monkeypatch):
    """Only the new batch's groups reach the medians, and a batch that was ended leaves everything as it was."""
    out = str(tmp_path / "out")
    catalog = c.Catalog((c.STANDARD_CATALOG["surface_temp_anomaly"],), c.STANDARD_CATALOG.chapters)
    name = "mean_surface_temp_anomalies"
    first = upkeep.add(spark, out, {name: batches[0][name]}, catalog)
    before = rows_of(first["series"])
    seen = []
    plain = upkeep.annual_of_states
    monkeypatch.setattr(upkeep, "annual_of_states", lambda states, *a: (seen.append(states), plain(states, *a))[1])
    publish = Release.publish
    monkeypatch.setattr(Release, "publish", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        upkeep.add(spark, out, {name: batches[2][name]}, catalog)
    assert rows_of(releases.tables(spark, out)["series"]) == before
    monkeypatch.setattr(Release, "publish", publish)
    upkeep.add(spark, out, {name: batches[2][name]}, catalog)
    assert {r["year"] for r in seen[-1].select("year").distinct().collect()} == {2003, 2012, 2013}
    after = rows_of(releases.tables(spark, out)["series"].where("year NOT IN (2003, 2012, 2013)"))
    assert after == rows_of(first["series"].where("year <> 2003"))
