"""Releases: builds that are ended and run again, readers, and the files that a request reads."""

from __future__ import annotations

import pytest

from isopanel.plans import batch
from isopanel.sinks import releases
from isopanel.sinks.releases import Release

from .test_batch import result, root, tables  # noqa: F401  (fixtures)


def frame(spark, rows, names="country string, value double"):
    return spark.createDataFrame(rows, names)


def contents(spark, out):
    return {name: sorted(map(tuple, table.collect())) for name, table in releases.tables(spark, out).items()}


def test_nothing_is_visible_before_it_is_published(spark, tmp_path):
    out = str(tmp_path / "out")
    assert releases.tables(spark, out) == {}
    first = Release(spark, out)
    first.write("a", frame(spark, [("x", 1.0)]))
    assert releases.tables(spark, out) == {}
    first.publish()
    second = Release(spark, out)
    second.write("a", frame(spark, [("x", 2.0)]))
    second.write("b", frame(spark, [("y", 3.0)]))
    assert contents(spark, out) == {"a": [("x", 1.0)]}
    before = releases.tables(spark, out)["a"]
    second.publish()
    assert contents(spark, out) == {"a": [("x", 2.0)], "b": [("y", 3.0)]}
    assert [tuple(r) for r in before.collect()] == [("x", 1.0)]  # a reader stays with the release that it found


def test_tables_are_taken_over(spark, tmp_path):
    out = str(tmp_path / "out")
    first = Release(spark, out)
    first.write("a", frame(spark, [("x", 1.0)]))
    first.publish()
    second = Release(spark, out)
    second.write("b", frame(spark, [(7,)], "n int"))
    second.publish()
    assert contents(spark, out) == {"a": [("x", 1.0)], "b": [(7,)]}


def test_two_builds_at_a_time(spark, tmp_path):
    out = str(tmp_path / "out")
    one, other = Release(spark, out), Release(spark, out)
    one.write("a", frame(spark, [("x", 1.0)]))
    other.write("a", frame(spark, [("x", 2.0)]))
    one.publish()
    with pytest.raises(RuntimeError, match="another release"):
        other.publish()
    assert contents(spark, out) == {"a": [("x", 1.0)]}


def test_unused_folders_go(spark, tmp_path):
    out = str(tmp_path / "out")
    for value in (1.0, 2.0, 3.0):
        release = Release(spark, out)
        release.write("a", frame(spark, [("x", value)]))
        release.publish()
    Release(spark, out).write("a", frame(spark, [("x", 9.0)]))  # never published
    gone = releases.remove_unused(spark, out, keep=1)
    assert len(gone) == 3 and contents(spark, out) == {"a": [("x", 3.0)]}
    assert releases.remove_unused(spark, out, keep=1) == []


def test_names_like_numbers_stay_text(spark, tmp_path):
    out = str(tmp_path / "out")
    release = Release(spark, out)
    table = frame(spark, [("1", "2", 2.0), ("", None, None)], "country string, indicator string, value double")
    back = release.write("t", table)
    assert back.dtypes == table.dtypes and sorted(map(str, back.collect())) == sorted(map(str, table.collect()))


@pytest.mark.parametrize("end_at", ["series", "countries", "catalog", "documents", "publish"])
def test_a_build_that_was_ended_is_run_again(spark, result, tmp_path, monkeypatch, end_at):  # noqa: F811
    """A build is ended before each of its tables; readers see the release before, then the whole new one."""
    datasets, _, _, _ = result
    out = str(tmp_path / "out")
    old = Release(spark, out)
    old.write("series", frame(spark, [("old", 1.0)]))
    old.publish()
    write, publish = Release.write, Release.publish

    def broken_write(self, name, *rest):
        if name == end_at:
            raise KeyboardInterrupt(name)
        return write(self, name, *rest)

    def broken_publish(self):
        if end_at == "publish":
            raise KeyboardInterrupt
        return publish(self)

    monkeypatch.setattr(Release, "write", broken_write)
    monkeypatch.setattr(Release, "publish", broken_publish)
    some = {"tourist_arrivals": datasets["tourist_arrivals"]}
    catalog = batch.c.Catalog(
        tuple(i for i in batch.c.STANDARD_CATALOG.indicators if i.source in some), batch.c.STANDARD_CATALOG.chapters
    )
    with pytest.raises(KeyboardInterrupt):
        batch.build(some, out, catalog=catalog)
    assert contents(spark, out) == {"series": [("old", 1.0)]}
    monkeypatch.undo()
    built = batch.build(some, out, catalog=catalog)
    assert built["series"].count() == releases.tables(spark, out)["series"].count() > 0
    names = {"cleaning", "quarantine", "series", "trend", "headline", "headline_stat", "countries", "catalog", "documents"}
    assert names == set(built)


def test_only_the_asked_countries_are_read(spark, tmp_path):
    """The plan of a request has a filter on folders, and only files of the asked countries' folders are opened."""
    out = str(tmp_path / "out")
    names = [f"Place {i}" for i in range(200)]
    rows = [(name, "i", year, float(k)) for k, name in enumerate(names) for year in range(3)]
    release = Release(spark, out)
    release.write("series", spark.createDataFrame(rows, "country string, indicator string, year int, value double"))
    release.write("countries", frame(spark, [(n,) for n in names], "country string"))
    release.publish()
    requests = frame(spark, [("Place 7", "Place 150"), ("Nowhere", "")], "country string, compare string")
    found = batch.payload(spark, out, requests, default="Place 3")
    assert {(r["primary"], r["role"], r["country"]) for r in found.collect()} == {
        ("Place 7", "primary", "Place 7"), ("Place 7", "compare", "Place 150"), ("Place 3", "primary", "Place 3"),
    }
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "value#" in line)
    assert f"PartitionFilters: [{releases.CLUSTER}" in scan and "PushedFilters: [In(country" in scan
    entry = releases.current(spark, out)["series"]
    asked = ["Place 7", "Place 150", "Place 3"]
    some = releases.read_entry(spark, out, entry, asked)
    assert {r["country"] for r in some.collect()} == set(asked)
    kept = {row[0] for row in some.select("_metadata.file_path").distinct().collect()}
    whole = {row[0] for row in releases.read_entry(spark, out, entry).select("_metadata.file_path").distinct().collect()}
    clusters = {f"{releases.CLUSTER}={releases.zlib.crc32(n.encode()) % releases.CLUSTERS}" for n in asked}
    assert {path.split("/")[-2] for path in kept} == clusters and len(whole) > 50


def test_answers_from_a_release(spark, result):  # noqa: F811
    _, built, details, out = result
    asked = spark.createDataFrame([("Fiji", "Samoa"), ("Nowhere", "Fiji")], "country string, compare string")
    whole, few = batch.answer(built, details, asked), batch.answer_from(spark, out, asked)
    for name in whole:
        assert sorted(map(str, few[name].collect())) == sorted(map(str, whole[name].collect())), name
