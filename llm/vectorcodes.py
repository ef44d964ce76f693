"""Vector code compression: codebooks for parts of integer vectors, refined over Hilbert-sorted flat blocks.

Vectors become integers and are cut into parts. Rows are packed into chunks, once: in a chunk, each part's points are
sorted along a Hilbert curve and cut into flat blocks, and a block stores its points, the box of their least and
greatest components, and their sums. A round needs these only. The distances between a block's box and all entries of
the codebook bound those of its points: an entry whose nearest corner is farther away than the farthest corner of
another one can't win. A block that is left with one entry adds its stored sums to it as a whole; the others compare
their points with their shortlist, in integers, so the result is exact and doesn't depend on how rows are packed.

A round sends a task's sums for each entry to the aggregation, and the driver gets one number for each component of the
codebook, which is bounded by the number of entries and the vectors' length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, store

#: Parts of a vector, entries of a part's codebook, and rounds that move the entries.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: What a component is multiplied with before it is cut down to an integer.
SCALE = 256
#: Rows and components of a chunk at most, and points of a flat block.
CHUNK, CHUNK_COMPONENTS, BLOCK = 16_384, 1 << 22, 8
#: Distances that one kernel holds at once.
KERNEL = 1 << 21

_LARGEST = 1 << 62


def hilbert_index(points: np.ndarray) -> np.ndarray:
    """The place of each point (a row) on a Hilbert curve through the box of all of them.

    Components are taken with the same few bits, such that an index has 62 bits at most; of very many dimensions
    the first 62 count. Bits are handled from the highest on: a component with the bit set inverts the lower bits of
    the first one, and one without swaps them with the first one's, which is the turn of the curve in that cell.
    """
    points = points[:, :62]
    n, dims = points.shape
    if not n or not dims:
        return np.zeros(n, dtype=np.int64)
    bits = max(1, min(8, 62 // dims))
    above = points.astype(np.float64) - points.min(axis=0)
    x = np.minimum(above / np.maximum(above.max(axis=0), 1.0) * (1 << bits), (1 << bits) - 1).astype(np.int64)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for d in range(dims):
            has = (x[:, d] >> bit & 1).astype(bool)
            swap = np.where(has, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(has, below, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn[:, None]
    index = np.zeros(n, dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << 1 | (x[:, d] >> bit & 1)
    return index


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; what is beyond 2**62 ends there."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * scale), -_LARGEST, _LARGEST).astype(np.int64)


def part_bounds(dims: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; equal if the length allows."""
    return [(k * dims // parts, (k + 1) * dims // parts) for k in range(parts)]


@dataclass
class Blocks:
    """One part of a chunk's rows: points in Hilbert order, and box and sums of each flat block."""

    order: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> Blocks:
        order = np.argsort(hilbert_index(points), kind="stable").astype(np.uint16)
        points = points[order]
        starts = np.arange(0, len(points), BLOCK)
        exact = points.astype(object) if len(points) and np.abs(points).max(initial=0) > 1 << 50 else points
        return cls(
            order,
            points,
            np.minimum.reduceat(points, starts, axis=0),
            np.maximum.reduceat(points, starts, axis=0),
            np.add.reduceat(exact, starts, axis=0),
        )


def narrowest(values: np.ndarray) -> np.dtype:
    for kind in (np.int16, np.int32):
        info = np.iinfo(kind)
        if values.size == 0 or (values.min() >= info.min and values.max() <= info.max):
            return np.dtype(kind)
    return np.dtype(np.int64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of points (blocks, points, dims) to their block's entries (blocks, entries, dims)."""
    out = np.zeros((a.shape[0], a.shape[1], b.shape[1]), dtype=a.dtype)
    for d in range(a.shape[2]):
        difference = a[:, :, None, d] - b[:, None, :, d]
        out += difference * difference
    return out


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Whether an entry (column) can be the nearest of any point in a block's box (row)."""
    zero = np.zeros((len(low), len(entries)), dtype=low.dtype)
    nearest, farthest = zero, zero.copy()
    for d in range(low.shape[1]):
        under, over = low[:, None, d] - entries[None, :, d], entries[None, :, d] - high[:, None, d]
        gap = np.maximum(np.maximum(under, over), 0)
        reach = np.maximum(-under, -over)
        nearest = nearest + gap * gap
        farthest = farthest + reach * reach
    return nearest <= farthest.min(axis=1, keepdims=True)


def as_safe(entries: np.ndarray, *others: np.ndarray) -> type:
    """The integers in which no squared distance of a part overflows: 64 bits, or else Python's own."""
    most = max((int(np.abs(x).max(initial=0)) for x in (entries, *others)), default=0)
    return np.int64 if max(1, entries.shape[1]) * (2 * most) ** 2 < 1 << 62 else object


def assign(blocks: Blocks, entries: np.ndarray, distances: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The nearest entry of each block as a whole (or -1), of each point, and if wanted the points' squared distances.

    Entries of equal distance: the first one. Points are in the blocks' order.
    """
    kind = as_safe(entries, blocks.low, blocks.high)
    low, high, entries = (x.astype(kind) for x in (blocks.low, blocks.high, entries))
    short = shortlists(low, high, entries)
    sizes = short.sum(axis=1)
    n, dims = blocks.points.shape
    points = np.concatenate((blocks.points, np.repeat(blocks.points[-1:], -n % BLOCK, axis=0))).astype(kind)
    points = points.reshape(len(low), BLOCK, dims)
    whole = np.where(sizes == 1, short.argmax(axis=1), -1)
    nearest = np.repeat(whole[:, None], BLOCK, axis=1)
    found = np.zeros((len(points), BLOCK), dtype=kind) if distances else None
    ranked = np.argsort(~short, axis=1, kind="stable")  # each block's shortlist first, in the order of the entries
    width = 1
    while width < 2 * len(entries):
        some = np.flatnonzero((sizes <= width) & (sizes > width // 2))
        if not distances:
            some = some[sizes[some] > 1]
        step = max(1, KERNEL // (BLOCK * width))
        for at in range(0, len(some), step):
            now = some[at : at + step]
            listed = ranked[now, : min(width, len(entries))]
            # beyond its end a shortlist repeats its first entry, which never wins against itself
            listed = np.where(np.arange(listed.shape[1])[None, :] < sizes[now, None], listed, listed[:, :1])
            square = squares(points[now], entries[listed])
            best = square.argmin(axis=2)
            nearest[now] = np.take_along_axis(listed, best, axis=1)
            if found is not None:
                found[now] = np.take_along_axis(square, best[:, :, None], axis=2)[:, :, 0]
        width *= 2
    return whole, nearest.reshape(-1)[:n], None if found is None else found.reshape(-1)[:n]


def part_sums(blocks: Blocks, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sums of the points that each entry is the nearest of."""
    whole, nearest, _ = assign(blocks, entries, distances=False)
    n, counts = len(nearest), np.zeros(len(entries), dtype=np.int64)
    exact = blocks.sums.dtype == object
    sums = np.zeros(entries.shape, dtype=object if exact else np.int64)
    sizes = np.full(len(whole), BLOCK)
    sizes[-1] = n - BLOCK * (len(whole) - 1)
    once = whole >= 0
    np.add.at(counts, whole[once], sizes[once])
    np.add.at(sums, whole[once], blocks.sums[once])
    single = ~np.repeat(once, BLOCK)[:n]
    np.add.at(counts, nearest[single], 1)
    np.add.at(sums, nearest[single], blocks.points[single].astype(sums.dtype))
    return counts, sums


CHUNKS = (
    "place array<bigint>, parts array<struct<kind string, wide boolean, `order` binary, points binary, low binary, "
    "high binary, sums binary>>"
)


def pack(points: np.ndarray, parts: int = PARTS) -> list[dict]:
    """A chunk's parts as bytes, in the narrowest integers that hold them."""
    out = []
    for begin, end in part_bounds(points.shape[1], parts):
        b = Blocks.of(points[:, begin:end])
        kind, wide = narrowest(b.points), b.sums.dtype == object
        sums = ",".join(map(str, b.sums.reshape(-1))).encode() if wide else b.sums.astype(np.int64).tobytes()
        out.append(
            {"kind": kind.name, "wide": wide, "order": b.order.tobytes(), "sums": sums}
            | {name: getattr(b, name).astype(kind).tobytes() for name in ("points", "low", "high")}
        )
    return out


def unpack(part: dict, dims: int) -> Blocks:
    order = np.frombuffer(part["order"], dtype=np.uint16)
    n_blocks = -(-len(order) // BLOCK)
    arrays = {
        name: np.frombuffer(part[name], dtype=part["kind"]).reshape(rows, dims)
        for name, rows in (("points", len(order)), ("low", n_blocks), ("high", n_blocks))
    }
    if part["wide"]:
        sums = np.array([int(x) for x in part["sums"].split(b",") if x], dtype=object).reshape(n_blocks, dims)
    else:
        sums = np.frombuffer(part["sums"], dtype=np.int64).reshape(n_blocks, dims)
    return Blocks(order, sums=sums, **arrays)


def finite(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )


class Compressor:
    """Codebooks for the rows' vectors, and the rows' codes.

    The first row's vector, by id, says how long vectors are; rows whose vector has another length get no code. Rows of
    null or not finite components are left out. The codebook of a part starts with that part of the first ``entries``
    rows by id (nulls last, rows of one id by their vectors); with fewer rows it has fewer entries.
    """

    def __init__(
        self,
        rows: DataFrame,
        parts: int = PARTS,
        entries: int = ENTRIES,
        rounds: int = ROUNDS,
        scale: int = SCALE,
        vec_id: str = "vec_id",
        embedding: str = "embedding",
        label: str = "label",
    ) -> None:
        self.parts, self.scale = parts, scale
        narrow = doc_columns(rows, vec_id, embedding, label).select(
            F.col(vec_id).cast("bigint").alias("vec_id"),
            F.col(embedding).cast("array<double>").alias("vector"),
            F.col(label).alias("label"),
        )
        kept = narrow.where(finite(F.col("vector"))).withColumn("place", F.monotonically_increasing_id())
        self.rows = store(kept, "vectors")  # places are settled here
        first = self.rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
        dims = len(first[0][0]) if first else 0
        self.dims, self.bounds = dims, part_bounds(dims, parts)
        if any(len(r[0]) != dims for r in first):
            same = self.rows.where(F.size("vector") == dims)
            first = same.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
        seeds = integers(np.array([r[0] for r in first], dtype=np.float64).reshape(len(first), dims), scale)
        self.codebooks = [seeds[:, begin:end] for begin, end in self.bounds]
        self.chunks = store(self._chunks(), "chunks")
        if len(first):
            for _ in range(rounds):
                self._move()

    def _chunks(self) -> DataFrame:
        dims, parts, scale = self.dims, self.parts, self.scale
        size = max(1, min(CHUNK, CHUNK_COMPONENTS // max(1, dims)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []

            def chunk(table: pa.Table) -> pa.RecordBatch:
                vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                points = integers(vectors.reshape(len(table), dims), scale)
                row = {"place": table.column("place").to_pylist(), "parts": pack(points, parts)}
                return pa.RecordBatch.from_pylist([row], schema=schema)

            for batch in batches:
                held.append(batch)
                while sum(b.num_rows for b in held) >= size:
                    table = pa.Table.from_batches(held)
                    yield chunk(table.slice(0, size))
                    held = table.slice(size).to_batches()
            if any(b.num_rows for b in held):
                yield chunk(pa.Table.from_batches(held))

        part = pa.struct(
            [("kind", pa.string()), ("wide", pa.bool_())]
            + [(name, pa.binary()) for name in ("order", "points", "low", "high", "sums")]
        )
        schema = pa.schema([("place", pa.list_(pa.int64())), ("parts", pa.list_(part))])
        usable = self.rows.where(F.size("vector") == dims).select("place", "vector")
        return usable.mapInArrow(run, CHUNKS)

    def _move(self) -> None:
        """One round: every entry goes to the middle of its points, cut down; entries without points stay."""
        codebooks, bounds = self.codebooks, self.bounds

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(len(c), dtype=np.int64) for c in codebooks]
            sums = [np.zeros(c.shape, dtype=object) for c in codebooks]
            for batch in batches:
                for parts in batch.column(0):
                    for k, part in enumerate(parts.as_py()):
                        n, s = part_sums(unpack(part, bounds[k][1] - bounds[k][0]), codebooks[k])
                        counts[k] += n
                        sums[k] = sums[k] + s
            rows = [
                (k, e, d, int(counts[k][e]), str(sums[k][e, d]))
                for k in range(len(codebooks))
                for e in np.flatnonzero(counts[k]).tolist()
                for d in range(sums[k].shape[1])
            ]
            if rows:
                columns = [pa.array(x) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "position", "n", "total"])

        partial = self.chunks.select("parts").mapInArrow(
            run, "part bigint, entry bigint, position bigint, n bigint, total string"
        )
        summed = partial.groupBy("part", "entry", "position").agg(
            F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
        )
        moved = [c.copy() for c in codebooks]
        for row in summed.collect():  # one row for each component of the codebooks at most
            moved[row["part"]][row["entry"], row["position"]] = int(row["total"]) // row["n"]
        self.codebooks = moved

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and position."""
        numbers = (str(x) for c in self.codebooks for x in c.reshape(-1).tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def encoded(self) -> DataFrame:
        """vec_id, label, codes (binary, a byte for each part), error and label_error of every kept row.

        ``error`` is the sum of the parts' squared distances to their entries and ``label_error`` its sum over all rows
        of the label, null labels together; sums beyond the range of a long end there. Rows whose vector has another
        length than the first one's have null in both ``codes`` and ``error`` and add nothing to ``label_error``. Repeated rows are rows each.
        """
        codebooks, bounds, most = self.codebooks, self.bounds, (1 << 63) - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    place, parts = batch.column("place")[i].as_py(), batch.column("parts")[i].as_py()
                    codes = np.zeros((len(place), len(codebooks)), dtype=np.uint8)
                    error = np.zeros(len(place), dtype=object)
                    for k, part in enumerate(parts):
                        blocks = unpack(part, bounds[k][1] - bounds[k][0])
                        _, nearest, square = assign(blocks, codebooks[k], distances=True)
                        codes[blocks.order, k] = nearest
                        error[blocks.order] += square.astype(object)
                    columns = [
                        pa.array(place, pa.int64()),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array([min(int(e), most) for e in error], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["at", "codes", "error"])

        codes = self.chunks.select("place", "parts").mapInArrow(run, "at bigint, codes binary, error bigint")
        narrow = self.rows.select("vec_id", "label", "place")
        coded = store(
            narrow.join(codes, F.col("place") == F.col("at"), "left").select("vec_id", "label", "codes", "error"), "coded"
        )
        totals = store(
            coded.groupBy(F.col("label").alias("of"))
            .agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
            .select("of", F.when(F.col("total") > most, most).otherwise(F.col("total").cast("bigint")).alias("label_error")),
            "totals",
        )
        same = F.col("label").eqNullSafe(F.col("of"))
        return coded.join(totals, same).select("vec_id", "label", "codes", "error", "label_error")
