"""SimHash near-duplicates, found through vantage-point trees over the fingerprints.

Fingerprints of all documents become distinct ones first, so that copies never meet. The distinct fingerprints are
dealt to shards by a vantage-point tree: a node has a vantage point and a radius (the median distance of a bounded
sample), points within the radius go to one side and the rest to the other. Each fingerprint is a point of its home
shard and a query to every shard of a higher number that the ball around it reaches, by the triangle bounds: a ball of
radius r around x reaches the inner side if d(x, v) - r <= radius and the outer side if d(x, v) + r > radius. A pair at
distance r or less therefore meets in the home shard of one of the two, and no pair is missed whatever the sample is.

A shard is searched by a vantage-point tree of its own, with the same bounds, down to small leaves. It returns a
spanning forest of its links, never all pairs of a group. Components are found by spreading the smallest label over
these links, with a stored table for each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hidden, bytes_of, doc_columns, mix, steps, store

#: Distinct fingerprints that the shards' tree is fitted on at most. It decides how evenly the shards are filled only.
SAMPLE = 20_000
#: Distinct fingerprints that a shard holds about, and the levels that the tree has at least.
SHARD_POINTS, LEAST_LEVELS = 8_192, 5
#: Pairs that are compared at once in a leaf of a shard's own tree.
LEAF_PAIRS = 1 << 20
#: Sample points whose median distance splits a node; with fewer it is split at half of the bits.
LEAST_SAMPLE = 16

_SHIFTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of one text: bit b is 1 if over half the shingles' hashes have it; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), 1 << 16):  # a long text in parts
        parts = zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in parts], dtype="<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(_SHIFTS[set_bits * 2 > len(starts)].sum())


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch.column(1))
            for part in steps(texts):
                values = np.array([fingerprint(t, shingle) for t in texts[part]], dtype=np.uint64).view(np.int64)
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(values)], ["doc_id", "fp"])

    narrow = doc_columns(docs, doc_id, text).selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text")
    return narrow.mapInArrow(run, "doc_id bigint, fp bigint")


class ShardTree:
    """A vantage-point tree of a fixed number of levels whose leaves are shards."""

    def __init__(self, sample: np.ndarray, levels: int) -> None:
        self.levels = levels
        # nodes that the sample doesn't reach split at half of the bits from points of their own
        self.vantage = mix(np.arange(1, (1 << levels) + 1, dtype=np.uint64))
        self.radius = np.full(1 << levels, 32, dtype=np.int64)
        parts = {1: sample}
        for node in range(1, 1 << levels):
            points = parts.pop(node, sample[:0])
            if len(points) >= LEAST_SAMPLE:
                self.vantage[node] = points[len(points) // 2]
                distance = np.bitwise_count(points ^ self.vantage[node]).astype(np.int64)
                self.radius[node] = np.median(distance)
                inner = distance <= self.radius[node]
                parts[2 * node], parts[2 * node + 1] = points[inner], points[~inner]

    def homes(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        for _ in range(self.levels):
            outer = np.bitwise_count(points ^ self.vantage[node]).astype(np.int64) > self.radius[node]
            node = 2 * node + outer
        return node - (1 << self.levels)

    def reached(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of points, and the shards that the balls around them reach."""
        at, node = np.arange(len(points)), np.ones(len(points), dtype=np.int64)
        for _ in range(self.levels):
            distance = np.bitwise_count(points[at] ^ self.vantage[node]).astype(np.int64)
            inner, outer = distance - reach <= self.radius[node], distance + reach > self.radius[node]
            at, node = np.concatenate((at[inner], at[outer])), np.concatenate((2 * node[inner], 2 * node[outer] + 1))
        return at, node - (1 << self.levels)


class Forest:
    """Union-find over positions; the smallest position of a set is its root."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.up[a], self.up[b]  # most pairs of a group are joined already
        for x, y in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def flatten(self) -> None:
        while not np.array_equal(self.up, up := self.up[self.up]):
            self.up = up


def link_within(points: np.ndarray, own: int, reach: int) -> np.ndarray:
    """The root of each point among those linked within a shard.

    The first ``own`` points are at home; all points are queries against these.
    """
    forest = Forest(len(points))
    todo = [(np.arange(own), np.arange(len(points)))]
    while todo:
        held, asked = todo.pop()
        if not len(held) or not len(asked):
            continue
        if len(held) * len(asked) > LEAF_PAIRS:
            vantage = points[held[len(held) // 2]]
            to_held = np.bitwise_count(points[held] ^ vantage).astype(np.int64)
            radius = int(np.median(to_held))
            inner = to_held <= radius
            if inner.all():  # the median is the largest distance
                radius -= 1
                inner = to_held <= radius
            if inner.any():
                to_asked = np.bitwise_count(points[asked] ^ vantage).astype(np.int64)
                todo.append((held[inner], asked[to_asked - reach <= radius]))
                todo.append((held[~inner], asked[to_asked + reach > radius]))
                continue
        width = max(1, LEAF_PAIRS // len(asked))
        for k in range(0, len(held), width):
            some = held[k : k + width]
            i, j = np.nonzero(np.bitwise_count(points[some][:, None] ^ points[asked][None, :]) <= reach)
            forest.flatten()
            forest.join(some[i], asked[j])
    forest.flatten()
    return forest.up


def links(distinct: DataFrame, reach: int, count: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that are within reach, without all pairs."""
    spark = distinct.sparkSession
    levels = max(LEAST_LEVELS, int(np.ceil(np.log2(max(1, count / SHARD_POINTS)))))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE)
    tree = spark.sparkContext.broadcast(
        ShardTree(np.array([r[0] for r in sample.collect()], dtype=np.int64).view(np.uint64), levels)
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            home = tree.value.homes(points)
            at, shard = tree.value.reached(points, reach)
            keep = shard >= home[at]  # the pair is found in the higher one's shard
            at, shard = at[keep], shard[keep]
            columns = [shard, points[at].view(np.int64), shard == home[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        points, home = group.column("fp").to_numpy().view(np.uint64), group.column("home").to_numpy()
        order = np.argsort(~home, kind="stable")
        points = points[order]
        root = link_within(points, int(home.sum()), reach)
        linked = root != np.arange(len(points))
        pairs = [points[linked].view(np.int64), points[root[linked]].view(np.int64)]
        return pa.table([pa.array(p) for p in pairs], names=["a", "b"])

    dealt = distinct.select("fp").mapInArrow(deal, "shard bigint, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """fp and label for every end of an edge: the smallest end that is reachable, as signed numbers.

    Each round takes the smallest label among the neighbours and then the label of that label. Rounds are stored, so
    lineage stays short and a lost executor costs one round at most.
    """
    both = store(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.col("fp"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["fp"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["fp"] == near["a"]).select(
            "fp", F.col("label").alias("was"), F.least("label", "near").alias("label")
        )
        above = labels.select(F.col("fp").alias("at"), F.col("label").alias("jump"))
        moved = store(
            stepped.join(above, stepped["label"] == above["at"], "left").select(
                "fp", "was", F.least("label", F.coalesce("jump", "label")).alias("label")
            ),
            "labels",
        )
        labels = moved.select("fp", "label")
        if moved.where("label <> was").isEmpty():
            return labels


def same_document(prints: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints that rows of one doc_id have. Rows without an id share none."""
    known = prints.where("doc_id is not null")
    ids = known.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b <> most")
    several = store(ids.select("doc_id", "b"), "several")
    return known.join(several, "doc_id").where("fp <> b").select(F.col("fp").alias("a"), "b")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, reach: int = 3
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable) for every row.

    Fingerprints at ``reach`` bits or less are linked; copies are linked by having the same one. Null and empty texts
    have the fingerprint zero and are linked like any other. A doc_id is one document: if its rows differ, what any of
    them is linked to is reachable from all. Repeated rows are returned as often as they occur; a row with a null doc_id
    is returned and its id is never the smallest, so a component of such rows only has a null id. Further columns are
    left out. An empty table gives an empty result.
    """
    prints = store(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = components(links(distinct, reach, distinct.count()).unionAll(same_document(prints)))
    labelled = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = store(labelled.join(smallest, "label").select("fp", "component_id"), "components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(by_print, "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, whole and with all its columns.

    Of rows that repeat this id and its text one stays. Rows without an id can't be told apart and stay.
    """
    hidden = Hidden(docs)
    doc_id, text = hidden[doc_id], hidden[text]
    found = near_duplicates(hidden.docs, doc_id, text).select(F.col("doc_id").alias("__id"), "component_id")
    found = store(found, "found")
    copies = found.where("__id <> component_id").select("__id").distinct()
    repeated = found.where("__id = component_id").groupBy("__id").count().where("count > 1").select("__id")
    repeated = store(repeated, "repeated")
    same = F.col(doc_id) == F.col("__id")
    rest = hidden.docs.join(copies, same, "left_anti").join(repeated, same, "left_anti")
    once = hidden.docs.join(repeated, same, "left_semi").dropDuplicates([doc_id, text])
    return hidden.restore(rest.unionByName(once))
