"""Results in releases: tables are written aside and become current together, by one small file.

A release writes its tables into a folder of its own. Its last step, the manifest, makes them visible: it names place and
schema of each table, those taken over from the release before included. A reader looks for the newest manifest once, so
all tables that it reads are of one release. What a build that was ended half-way has written is in no manifest; it is
never read, and the next build writes elsewhere.

Tables with a country are clustered by it: rows of a country lie in one folder out of a fixed number, sorted, so
that a reader of a few countries opens their files alone, however many countries there are.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Mapping
from posixpath import join

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Folders of a clustered table.
CLUSTERS = 256
CLUSTER = "_cluster"
_MANIFESTS = "manifests"


def cluster_of(country: Column | str) -> Column:
    return (F.crc32(F.encode(F.col(country) if isinstance(country, str) else country, "UTF-8")) % CLUSTERS).cast("int")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests, in rising order."""
    where, files = _folder(spark, join(root, _MANIFESTS))
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def _manifest(spark: SparkSession, root: str, number: int) -> dict[str, dict]:
    path = join(root, _MANIFESTS, f"{number:08d}.json")
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def current(spark: SparkSession, root: str) -> dict[str, dict]:
    """The entries of the newest manifest; none before the first release."""
    numbers = _numbers(spark, root)
    return _manifest(spark, root, numbers[-1]) if numbers else {}


def read_entry(spark: SparkSession, root: str, entry: Mapping, countries: Iterable[str] | None = None) -> DataFrame:
    """A table of a manifest, or only the rows of some countries, of which alone files are read."""
    schema = StructType.fromJson(entry["schema"])
    columns = schema.names
    if entry["clustered"]:
        schema = StructType(schema.fields).add(CLUSTER, IntegerType())
    table = spark.read.schema(schema).format(entry["format"]).load(join(root, entry["path"]))
    if countries is not None and "country" in columns:
        names = list(countries)
        table = table.where(F.col("country").isin(names))
        if entry["clustered"]:
            table = table.where(F.col(CLUSTER).isin(sorted({zlib.crc32(n.encode()) % CLUSTERS for n in names})))
    return table.select(*[F.col(f"`{c}`") for c in columns])


def tables(spark: SparkSession, root: str, countries: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """All tables of the current release. With ``countries`` those that have a country hold these only."""
    names = None if countries is None else list(countries)
    return {name: read_entry(spark, root, entry, names) for name, entry in current(spark, root).items()}


class Release:
    """Tables that become current together. Nothing of it is visible before :meth:`publish`."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        numbers = _numbers(spark, root)
        self.number = numbers[-1] + 1 if numbers else 1
        self.entries = _manifest(spark, root, numbers[-1]) if numbers else {}
        self.folder = join("versions", f"{self.number:08d}-{uuid.uuid4().hex[:12]}")

    def write(self, name: str, table: DataFrame, kind: str = "parquet") -> DataFrame:
        """Write a table aside and return it as it is read back, with its own types."""
        clustered = "country" in table.columns
        path = join(self.folder, name)
        rows = table
        if clustered:
            # adaptive execution splits a cluster that is much larger than the others
            rows = table.withColumn(CLUSTER, cluster_of("country")).hint("rebalance", CLUSTER)
            order = [c for c in ("country", "indicator", "year") if c in table.columns]
            rows = rows.sortWithinPartitions(CLUSTER, *order)
        writer = rows.write.format(kind)
        (writer.partitionBy(CLUSTER) if clustered else writer).save(join(self.root, path))
        self.entries[name] = {"path": path, "format": kind, "schema": table.schema.jsonValue(), "clustered": clustered}
        return read_entry(self.spark, self.root, self.entries[name])

    def publish(self) -> dict[str, DataFrame]:
        """Make the release current. Fails, and changes nothing, if another one was published since it began."""
        target, files = _folder(self.spark, join(self.root, _MANIFESTS, f"{self.number:08d}.json"))
        aside, _ = _folder(self.spark, join(self.root, _MANIFESTS, f"_{uuid.uuid4().hex}"))
        out = files.create(aside, False)
        out.write(bytearray(json.dumps(self.entries, indent=1).encode()))
        out.close()
        # a rename shows the whole file or none of it; a store that lets it replace a file needs the look before
        if files.exists(target) or not files.rename(aside, target):
            files.delete(aside, False)
            raise RuntimeError(f"another release was published below {self.root} since this one began")
        return {name: read_entry(self.spark, self.root, entry) for name, entry in self.entries.items()}


def remove_unused(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the folders that the newest ``keep`` manifests don't name, and return them.

    Run it when no build is under way: an unfinished release is in no manifest either.
    """
    numbers = _numbers(spark, root)
    if not numbers:
        return []
    used = {entry["path"].split("/")[1] for n in numbers[-keep:] for entry in _manifest(spark, root, n).values()}
    where, files = _folder(spark, join(root, "versions"))
    unused = [s.getPath() for s in files.listStatus(where) if s.getPath().getName() not in used]
    for path in unused:
        files.delete(path, True)
    for n in numbers[:-keep]:
        files.delete(_folder(spark, join(root, _MANIFESTS, f"{n:08d}.json"))[0], False)
    return sorted(path.getName() for path in unused)
