"""MinHash near-duplicates by tensored banding, with every link confirmed on full sets.

Banding finds pairs of similarity s or more with tables whose keys are runs of minhashes. Here the keys are formed from
two small collections: each value of the first is paired with each of the second, so ``HALVES`` halves on either side
make ``HALVES ** 2`` tables out of ``2 * HALVES * HALF`` minhashes, about the square root of what as many tables of
their own would need. A pair is missed if all halves of one side differ: at similarity 0.8 in 9 of a million pairs.

Documents with equal sets are one class, so copies never meet. A table's key can only repeat if both of its halves do.
Halves that a single class has are dropped; classes that share a first half meet in its bucket, where the keys with the
second halves are compared. A pair belongs to the first bucket that it shares. Buckets beyond a bound are cut into
blocks, and a pair of blocks is a group, so a group holds two blocks whatever a bucket's size is. A first, narrow pass
over the buckets says which classes have such a partner there; only their sets are made again from the texts and sent.
A group compares sets exactly and returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, doc_columns, mix, shingle_hashes, steps, store, word_hashes
from .simhash import Forest, components

#: Words of a shingle, and the least similarity of a link as a fraction.
SHINGLE, LEAST = 4, (80, 100)
#: Halves of keys on each side, and minhashes of a half.
HALVES, HALF = 12, 2
#: Classes of a block of a bucket, about.
BLOCK = 1_024
#: Bits of the sketch that rules pairs out before their sets are compared, and elements compared at once.
SKETCH_BITS, COMPARED = 1_024, 1 << 20

_FACTORS = mix(np.arange(1, 2 * HALVES * HALF + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles' hashes of each text in rising order; a text without words has none."""
    words, _, first = word_hashes(texts)
    hashes, begins = shingle_hashes(words, first, size)
    return [np.unique(hashes[a:b]) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


def halves(sets: list[np.ndarray]) -> np.ndarray:
    """The halves of the keys of sets that are not empty, a row for each set: first those of one side, then the other.

    A half mixes ``HALF`` minhashes with its own number, so halves of different numbers never meet.
    """
    if not sets:
        return np.empty((0, 2 * HALVES), dtype=np.uint64)
    begins = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    flat = np.concatenate(sets)
    out = np.repeat(_FACTORS[None, ::HALF], len(sets), axis=0)
    for k, factor in enumerate(_FACTORS):
        hashed = flat * factor
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xD6E8FEB86659FD93)
        out[:, k // HALF] = mix(out[:, k // HALF] + np.minimum.reduceat(hashed, begins))
    return out


def identity(elements: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return xxhash.xxh3_128_digest(elements.tobytes())


def prints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """doc_id, the text's digest, the set's size, identity and halves of every row. An empty set has no halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch.column(2))
            for part in steps(texts):
                sets = shingle_sets(texts[part], shingle)
                made = iter(halves([s for s in sets if len(s)]))
                columns = [batch.column(k).slice(part.start, part.stop - part.start) for k in (0, 1)]
                columns += [
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([identity(s) for s in sets], pa.binary()),
                    pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "id", "halves"])

    return keyed(docs, doc_id, text).mapInArrow(run, "doc_id bigint, digest string, n bigint, id binary, halves binary")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, digest of the text, and the text; a null text is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = doc_columns(docs, doc_id, text).select(F.col(doc_id).cast("bigint").alias("doc_id"), whole.alias("text"))
    return narrow.select("doc_id", F.md5("text").alias("digest"), "text")


def slots(classes: DataFrame) -> DataFrame:
    """id, slot and value of every half of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int64)
            slot = np.tile(np.arange(2 * HALVES), batch.num_rows)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), 2 * HALVES)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(slot.astype(np.int32)), pa.array(values)], ["id", "slot", "value"])

    return classes.select("id", "halves").mapInArrow(run, "id binary, slot int, value bigint")


def likely(a: np.ndarray, b: np.ndarray, slot: int) -> np.ndarray:
    """Whether pairs of rows of halves share a table's key and no first half before ``slot``, which all of them have."""
    before = np.zeros((len(a), len(b)), dtype=bool)
    for k in range(slot):
        before |= a[:, None, k] == b[None, :, k]
    both = np.zeros_like(before)
    for k in range(HALVES, 2 * HALVES):
        both |= a[:, None, k] == b[None, :, k]
    return both & ~before


def alike_in_size(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether sets of these sizes can be linked at all."""
    small, large = np.minimum(a[:, None], b[None, :]), np.maximum(a[:, None], b[None, :])
    return small * least[1] >= large * least[0]


def sketch(elements: np.ndarray) -> np.ndarray:
    """A bit for each element; of different sets, each bit that one lacks is an element that it lacks."""
    bits = np.zeros(SKETCH_BITS, dtype=np.uint8)
    bits[(elements % np.uint64(SKETCH_BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def linked(one: np.ndarray, others: list[np.ndarray], least: tuple[int, int]) -> np.ndarray:
    """Which of the other sets are linked with the one, by the sizes of intersection and union."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    common = np.add.reduceat((one[at] == flat).astype(np.int64), begins)
    return common * least[1] >= (len(one) + sizes - common) * least[0]


def forest_of(
    sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, candidates: np.ndarray, least: tuple[int, int]
) -> np.ndarray:
    """The root of each set among those that are linked. Candidates are pairs of ``rows`` and ``columns``.

    Pairs that are connected already are passed over, as are those whose sketches differ in too many bits: if u bits of
    one sketch are not in the other, the intersection has u elements less than the one set at least.
    """
    forest = Forest(len(sets))
    sketches = np.stack([sketch(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    for i, row in enumerate(rows.tolist()):
        partners = columns[candidates[i]]
        if not len(partners):
            continue
        ours, theirs = sketches[row], sketches[partners]
        most = np.minimum(
            sizes[row] - np.bitwise_count(ours & ~theirs).sum(axis=1, dtype=np.int64),
            sizes[partners] - np.bitwise_count(theirs & ~ours).sum(axis=1, dtype=np.int64),
        )
        partners = partners[most * least[1] >= (sizes[row] + sizes[partners] - most) * least[0]]
        while len(partners):
            forest.flatten()
            partners = partners[forest.up[partners] != forest.up[row]]
            held = np.cumsum(sizes[partners])
            some = partners[: max(1, int(np.searchsorted(held, COMPARED)))]
            if len(some):
                good = some[linked(sets[row], [sets[p] for p in some.tolist()], least)]
                forest.join(np.full(len(good), row), good)
            partners = partners[len(some) :]
    forest.flatten()
    return forest.up


_GROUP = ["slot", "value", "u", "v"]


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of a group's two blocks, and whether they are the same one."""
    block = table.column("block").to_numpy()
    u, v = (table.column(name)[0].as_py() for name in ("u", "v"))
    return np.flatnonzero(block == u), np.flatnonzero(block == v), u == v


def pairs_of(table: pa.Table, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's rows, columns and candidates: every pair of the group's blocks that belongs to its bucket, once."""
    own = np.frombuffer(b"".join(table.column("halves").to_pylist()), dtype=np.uint64).reshape(len(table), -1)
    n, slot = table.column("n").to_numpy(), table.column("slot")[0].as_py()
    rows, columns, same = sides(table)
    found = likely(own[rows], own[columns], slot) & alike_in_size(n[rows], n[columns], least)
    return rows, columns, np.triu(found, 1) if same else found


def links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Links (a, b) between identities that connect all classes whose sets are alike."""
    spare = slots(classes)
    shared = store(
        spare.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared"
    )
    both = store(spare.join(shared, ["slot", "value"]), "halves")
    useful = both.groupBy("id").agg(F.max(F.col("slot") >= HALVES).alias("second")).where("second").select("id")
    blocks = F.expr(f"cast((size + {BLOCK - 1}) div {BLOCK} as int)")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = (
        both.where(F.col("slot") < HALVES)
        .join(useful, "id", "left_semi")
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .withColumn("other", other)
        .select(
            "id", "slot", "value", "block", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v")
        )
    )
    members = placed.join(classes.select("id", "n", "halves"), "id")

    def narrow(table: pa.Table) -> pa.Table:
        rows, columns, found = pairs_of(table, least)
        needed = np.union1d(rows[found.any(axis=1)], columns[found.any(axis=0)])
        return table.take(pa.array(needed)).select(["id", *_GROUP, "block"])

    group = "id binary, slot int, value bigint, u int, v int, block int"
    needed = store(members.groupBy(*_GROUP).applyInArrow(narrow, group), "needed")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch.column(1))
            for part in steps(texts):
                sets = [s.tobytes() for s in shingle_sets(texts[part], shingle)]
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], ["id", "elements"])

    asked = classes.join(needed.select("id").distinct(), "id", "left_semi").select(
        "id", F.col("first").alias("by"), F.col("digest").alias("of")
    )
    met = keyed(docs, doc_id, text).join(asked, F.col("doc_id").eqNullSafe(F.col("by")) & (F.col("digest") == F.col("of")))
    sets = store(met.dropDuplicates(["id"]).select("id", "text").mapInArrow(make, "id binary, elements binary"), "sets")

    def confirm(table: pa.Table) -> pa.Table:
        rows, columns, found = pairs_of(table, least)
        elements = [np.frombuffer(x, dtype=np.uint64) for x in table.column("elements").to_pylist()]
        root = forest_of(elements, rows, columns, found, least)
        some = np.flatnonzero(root != np.arange(len(root)))
        ids = table.column("id").combine_chunks()
        return pa.table([ids.take(pa.array(some)), ids.take(pa.array(root[some]))], names=["a", "b"])

    whole = needed.join(classes.select("id", "n", "halves"), "id").join(sets, "id")
    return whole.groupBy(*_GROUP).applyInArrow(confirm, "a binary, b binary")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    least: tuple[int, int] = LEAST,
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (whether it is the own one) of all rows.

    A document's set has its distinct shingles, or with fewer words the whole sequence; sets are linked if their
    intersection is ``least`` of their union or more. Shingles are compared by 64-bit hashes. A document without words
    is linked with nothing. Rows without a doc_id are linked like others, and their id is never the smallest; if no
    row of a component has one, its id is null and its rows are kept. Repeated rows are returned as often as they
    occur. Further columns are left out. An empty table gives an empty result.
    """
    every = store(prints(docs, doc_id, text, shingle), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    classes = every.where("n > 0").groupBy("id").agg(first, F.first("n").alias("n"), F.first("halves").alias("halves"))
    classes = store(
        classes.select("id", F.col("first.doc_id").alias("first"), F.col("first.digest").alias("digest"), "n", "halves"),
        "classes",
    )
    labels = components(links(docs, classes, doc_id, text, shingle, least))
    labelled = classes.select("id", "first").join(labels.withColumnRenamed("fp", "id"), "id", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "id"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_class = store(labelled.join(smallest, "label").select("id", "component_id"), "components")
    narrow = every.select("doc_id", F.col("n").alias("n_shingles"), "id")
    alone = narrow.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    rows = narrow.where("n_shingles > 0").join(by_class, "id").unionByName(alone)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
