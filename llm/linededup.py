"""Line deduplication through a sharded minimal perfect hash over the hashes of repeated lines.

Lines are known by 128-bit hashes of their keys. Pass one counts them: for each key and bucket of documents the
smallest and the largest document that holds it and the number of lines, reduced in the tasks before any shuffle. Keys
of several documents are indexed: each shard of the key space builds a minimal perfect hash, which numbers its keys
without gaps, and compact arrays at these numbers: a fingerprint, the count and the owner (the smallest document).
Pass two probes the arrays with the keys of each bucket, once for each bucket and key, and what is found goes back to
the bucket's documents, whose texts are rewritten there. A line that a third of all documents share is one entry of
the index and one probe of each bucket, so no task meets it more often than there are buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WORD_BASE, Hidden, buckets_for, bytes_of, count_and_bytes, doc_columns, mix, store

#: Code points that a key has at least.
LEAST_KEY = 10
#: Bytes of text of a bucket, repeated keys of a shard, and keys that are asked for there, about.
BUCKET_BYTES, SHARD_KEYS, ASKED_KEYS = 8_000_000, 250_000, 500_000
#: Bits for each key on a level of the perfect hash.
GAMMA = 2
#: White space that keys lose at both ends.
BLANKS = b" \t\n\v\f\r"

KEYS_SCHEMA = "bucket int, high bigint, low bigint, doc_id bigint, n bigint"
INDEX_SCHEMA = (
    "shard int, sizes array<int>, bits binary, fingerprints binary, counts binary, owners binary, others binary"
)
FOUND_SCHEMA = "bucket int, high bigint, low bigint, owner bigint, n bigint"


def line_keys(text: bytes, least: int = LEAST_KEY) -> list[tuple[bytes, bytes | None]]:
    """Each line with the hash of its key, None for a key that is too short."""
    out = []
    digest = xxhash.xxh3_128_digest
    for line, lowered in zip(text.split(b"\n"), text.lower().split(b"\n"), strict=True):
        key = lowered.strip(BLANKS)
        long = len(key) >= 4 * least or (len(key) >= least and len(key.decode()) >= least)
        out.append((line, digest(key) if long else None))
    return out


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit hashes: levels of bit arrays.

    On each level a key that alone hits its bit keeps it, the others go on to the next level. A key's number is the
    number of set bits before its own.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        words = np.concatenate((bits, np.zeros(-len(bits) % 8, dtype=np.uint8))).view(np.uint64)
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salted = keys + np.uint64((level + 1) * WORD_BASE % (1 << 64))
        return (mix(salted) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, parts, level = [], [], 0
        while len(keys):
            size = max(64, GAMMA * len(keys))
            slot = cls.slots(keys, level, size)
            hits = np.bincount(slot, minlength=size)
            parts.append(hits == 1)
            sizes.append(size)
            keys = keys[hits[slot] > 1]
            level += 1
        flags = np.concatenate(parts) if parts else np.zeros(0, dtype=bool)
        return cls(sizes, np.packbits(flags, bitorder="little"))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1, or any number, for a key that was not built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.slots(keys[open_], level, size) + self.starts[level]
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            found = at[hit]
            below = self.words[found >> 6] & ((np.uint64(1) << (found & 63).astype(np.uint64)) - np.uint64(1))
            out[open_[hit]] = self.before[found >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


def _id(doc_id: str) -> Column:
    """A null id counts as larger than any other."""
    return F.coalesce(F.col(doc_id).cast("bigint"), F.lit((1 << 63) - 1))


def _bucket(doc_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(buckets)).cast("int")


def document_keys(docs: DataFrame, buckets: int, doc_id: str, text: str) -> DataFrame:
    """bucket, key (two 64-bit halves), doc_id and lines, for each key of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, buckets_, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))
            rows: list[tuple[int, bytes, int, int]] = []
            for i, text_ in enumerate(texts):
                counts: dict[bytes, int] = {}
                for _, key in line_keys(text_):
                    if key is not None:
                        counts[key] = counts.get(key, 0) + 1
                rows += [(buckets_[i], key, ids[i], n) for key, n in counts.items()]
                if len(rows) > 200_000 or (i + 1 == len(texts) and rows):
                    bucket, key, at, n = zip(*rows, strict=True)
                    high, low = _halves(list(key))
                    columns = [pa.array(bucket, pa.int32()), pa.array(high), pa.array(low)]
                    columns += [pa.array(x, pa.int64()) for x in (at, n)]
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "high", "low", "doc_id", "n"])
                    rows = []

    narrow = doc_columns(docs, doc_id, text).select(
        _id(doc_id).alias("doc_id"), _bucket(doc_id, buckets).alias("bucket"), F.col(text).alias("text")
    )
    return narrow.mapInArrow(run, KEYS_SCHEMA)


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """A row for each shard: the levels and bits of its perfect hash, and the arrays at the numbers it gives.

    The perfect hash is over the keys' first halves and the fingerprints are the second ones. Of keys that share a
    first half, which two of billions may, one is in the arrays and the others are listed beside them.
    """

    def build(group: pa.Table) -> pa.Table:
        rows = np.stack([group.column(c).to_numpy() for c in ("high", "low", "n", "owner")], axis=1)
        _, first = np.unique(rows[:, 0], return_index=True)
        others = np.delete(rows, first, axis=0)
        high, *arrays = rows[first].T
        perfect = PerfectHash.build(high.astype(np.int64).view(np.uint64))
        placed = np.empty((3, len(first)), dtype=np.int64)
        placed[:, perfect.numbers(high.astype(np.int64).view(np.uint64))] = arrays
        row = [perfect.bits.tobytes(), *(x.tobytes() for x in placed), np.ascontiguousarray(others).tobytes()]
        sizes = pa.array([perfect.sizes], pa.list_(pa.int32()))
        return pa.table(
            [group.column("shard")[:1], sizes, *(pa.array([x], pa.binary()) for x in row)],
            names=["shard", "sizes", "bits", "fingerprints", "counts", "owners", "others"],
        )

    sharded = keys.withColumn("shard", F.pmod("high", F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(build, INDEX_SCHEMA)


def probe(keys: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """The indexed ones among the keys of each bucket, with owner and count."""

    def look(asked: pa.Table, indexed: pa.Table) -> pa.Table:
        names = ["bucket", "high", "low", "owner", "n"]
        if not len(indexed) or not len(asked):
            return pa.table([pa.array([], t) for t in (pa.int32(), *[pa.int64()] * 4)], names=names)
        shard = indexed.to_pylist()[0]
        perfect = PerfectHash(shard["sizes"], np.frombuffer(shard["bits"], dtype=np.uint8))
        arrays = [np.frombuffer(shard[c], dtype=np.int64) for c in ("fingerprints", "counts", "owners")]
        bucket, high, low = (asked.column(c).to_numpy() for c in ("bucket", "high", "low"))
        at = perfect.numbers(high.view(np.uint64))
        owner, n = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        known = (at >= 0) & (arrays[0][at] == low)
        n[known], owner[known] = arrays[1][at[known]], arrays[2][at[known]]
        for other in np.frombuffer(shard["others"], dtype=np.int64).reshape(-1, 4):  # high, low, n and owner
            same = (high == other[0]) & (low == other[1])
            known |= same
            n[same], owner[same] = other[2], other[3]
        return pa.table([pa.array(c[known]) for c in (bucket, high, low, owner, n)], names=names)

    dealt = keys.select("bucket", "high", "low").withColumn("shard", F.pmod("high", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(look, FOUND_SCHEMA)


def rewrite(docs: DataFrame, found: DataFrame, buckets: int, doc_id: str, text: str) -> DataFrame:
    """docs with the dropped lines gone from their texts, __n_lines and __n_dropped; found: each bucket's known keys."""

    def drop(held: pa.Table, repeated: pa.Table) -> pa.Table:
        both = np.stack([repeated.column(c).to_numpy() for c in ("high", "low")], axis=1).astype(">i8").tobytes()
        keys = [both[i : i + 16] for i in range(0, len(both), 16)]
        owner = dict(zip(keys, repeated.column("owner").to_pylist(), strict=True))
        n_lines, n_dropped, kept = [], [], []
        for i, body in zip(held.column("__id").to_pylist(), bytes_of(held.column(text)), strict=True):
            lines = line_keys(body)
            stay = [line for line, key in lines if key is None or owner.get(key, i) == i]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(stay))
            kept.append(b"\n".join(stay).decode())
        held = held.set_column(held.column_names.index(text), text, pa.array(kept, held.schema.field(text).type))
        held = held.drop_columns(["__bucket", "__id"])
        return held.append_column("__n_lines", pa.array(n_lines, pa.int64())).append_column(
            "__n_dropped", pa.array(n_dropped, pa.int64())
        )

    counts = [StructField(name, LongType()) for name in ("__n_lines", "__n_dropped")]
    schema = StructType([*docs.schema.fields, *counts])
    held = docs.withColumn("__id", _id(doc_id)).withColumn("__bucket", _bucket(doc_id, buckets))
    return held.groupBy("__bucket").cogroup(found.groupBy("bucket")).applyInArrow(drop, schema)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the dropped lines gone from their texts, and __n_lines (before), __n_dropped.

    Keys of at least LEAST_KEY code points that at least two documents hold lose their lines everywhere but in the
    document of the smallest id. Null and empty texts have one empty line, which stays; a null becomes empty. Rows that
    repeat an id are one document: all of them keep what it owns. A null id is larger than any other. All rows and
    columns are returned, in no order. An empty table gives no rows.
    """
    spark = docs.sparkSession
    _, size = count_and_bytes(docs, text)
    buckets = buckets_for(spark, size, BUCKET_BYTES)
    keys = store(
        document_keys(docs, buckets, doc_id, text)
        .groupBy("high", "low", "bucket")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n").alias("n")),
        "keys",
    )
    repeated = keys.groupBy("high", "low").agg(
        F.min("first").alias("owner"), F.max("last").alias("last"), F.sum("n").alias("n")
    )
    repeated = store(repeated.where("owner < last").drop("last"), "repeated")
    # a shard is met by its own repeated keys and by all keys that are asked for there, most of them of single lines
    shards = max(buckets_for(spark, repeated.count(), SHARD_KEYS), keys.count() // ASKED_KEYS + 1)
    index = store(build_index(repeated, shards), "index")
    return rewrite(docs, probe(keys, index, shards), buckets, doc_id, text)


def without_repeated_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars"
) -> DataFrame:
    """The documents with all their columns, their texts without the dropped lines, and n_chars counted anew."""
    hidden = Hidden(docs)
    kept = dedup_lines(hidden.docs, hidden[doc_id], hidden[text])
    if n_chars in hidden.names:
        counted = hidden[n_chars]
        kept = kept.withColumn(counted, F.char_length(hidden[text]).cast(hidden.docs.schema[counted].dataType))
    return hidden.restore(kept)
