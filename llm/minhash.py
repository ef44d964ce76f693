"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle is hashed once. The hash's high part picks a bin and the bin keeps the smallest rest. An empty bin takes
the value of a filled one that a second, universal hash of (bin, attempt) picks anew for each attempt, so that the
choice is the same for all documents and every filled bin is as likely (optimal densification). The value and the bin's
number are mixed, and a few low-order bits of that are stored; bins that share one borrowed value are then as
independent as others. Two bins that differ still agree in b bits with probability 2**-b, which the estimate of
likeness takes out: (matches - 2**-b) / (1 - 2**-b).

The edited text of a document takes code points from the next document. Both meet where ranges of ids are sorted; only
the two documents at a range's ends travel further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    buckets_for,
    bytes_of,
    count_and_bytes,
    doc_columns,
    mix,
    shingle_hashes,
    steps,
    store,
    word_hashes,
)

#: Bins, and the bits that are stored of each.
BINS, BITS = 256, 4
#: Words of a shingle.
SHINGLE = 5
#: Bytes of text of a range of ids, about.
RANGE_BYTES = 32_000_000

#: Texts whose bins are filled together.
ROWS = 1_024

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=64)
def donors(first: int, attempts: int, bins: int) -> np.ndarray:
    """The bins that each bin asks at some attempts: a row for each attempt."""
    numbers = np.arange(first, first + attempts, dtype=np.uint64)[:, None] << np.uint64(20)
    return (mix(numbers + np.arange(1, bins + 1, dtype=np.uint64)) % np.uint64(bins)).astype(np.int64)


def densify(values: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row from its filled ones. Rows without any filled bin become zeros.

    Several attempts are looked at together, the more the fewer rows are left; the first that finds a filled bin counts.
    """
    out = values.copy()
    empty = values == _EMPTY
    none = empty.all(axis=1)
    out[none] = 0
    empty[none] = False
    rows, first = np.flatnonzero(empty.any(axis=1)), 0
    while len(rows):
        attempts = 4 if len(rows) > 64 else 64
        given = values[rows][:, donors(first, attempts, values.shape[1])]  # from bins that shingles have filled
        filled = given != _EMPTY
        row, column = np.nonzero(filled.any(axis=1) & empty[rows])
        out[rows[row], column] = given[row, filled[row, :, column].argmax(axis=1), column]
        empty[rows[row], column] = False
        rows = rows[empty[rows].any(axis=1)]
        first += attempts
    return out


def sketches(texts: list[bytes], bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> np.ndarray:
    """The stored bits of each bin (one byte each, not yet packed) for each text; equal texts have equal ones."""
    words, _, first = word_hashes(texts)
    hashes, begins = shingle_hashes(words, first, shingle)
    values = np.full((len(texts), bins), _EMPTY, dtype=np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(begins))
    shift = np.uint64(64 - (bins - 1).bit_length())
    place = row * bins + (hashes >> shift).astype(np.int64)
    np.minimum.at(values.reshape(-1), place, mix(hashes) >> np.uint64(1))  # below the mark of an empty bin
    # with the bin's number mixed in, a value that many bins borrow has other low bits in each of them
    own = mix(np.arange(1, bins + 1, dtype=np.uint64))
    out = np.zeros(values.shape, dtype=np.uint8)
    for k in range(0, len(texts), ROWS):
        part = values[k : k + ROWS]
        stored = mix(densify(part) ^ own) & np.uint64((1 << bits) - 1)
        some = ~(part == _EMPTY).all(axis=1)
        out[k : k + ROWS][some] = stored[some]
    return out


def pack(sketch: np.ndarray) -> np.ndarray:
    """Two bins of four bits in each byte."""
    return sketch[:, 0::2] << 4 | sketch[:, 1::2]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The estimated Jaccard similarity of the shingles of paired rows, from 0 to 1."""
    chance = 2.0**-bits
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def unpack(packed: np.ndarray) -> np.ndarray:
    out = np.empty((packed.shape[0], packed.shape[1] * 2), dtype=np.uint8)
    out[:, 0::2], out[:, 1::2] = packed >> 4, packed & 15
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the packed fingerprint (binary) of every row. Null and empty texts have the fingerprint of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch.column(1))
            for part in steps(texts):
                packed = pack(sketches(texts[part]))
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                columns = [ids, pa.array([x.tobytes() for x in packed], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint"])

    narrow = doc_columns(docs, doc_id, text).selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text")
    return narrow.mapInArrow(run, "doc_id bigint, fingerprint binary")


RESULT = (
    "part int, edge int, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, "
    "edited_fingerprint binary, near_edited double, near_next double, text string"
)
_FIELDS = pa.schema(
    [("part", pa.int32()), ("edge", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())]
)


def compared(ids: list[int], texts: list[str]) -> list[dict]:
    """A result for each id; texts has one more text, so that each is followed by the next."""
    edited = []
    for text, after in pairwise(texts):
        moved = len(text) // 3
        edited.append((text[: len(text) - moved] + after[:moved]).encode())
    own, new = sketches([t.encode() for t in texts]), sketches(edited)
    packed, packed_new = pack(own), pack(new)
    near_edited, near_next = likeness(own[:-1], new), likeness(own[:-1], own[1:])
    return [
        {
            "edge": 0,
            "doc_id": ids[i],
            "n_chars": len(texts[i]),
            "edited_sha256": hashlib.sha256(edited[i]).hexdigest(),
            "fingerprint": packed[i].tobytes(),
            "edited_fingerprint": packed_new[i].tobytes(),
            "near_edited": float(near_edited[i]),
            "near_next": float(near_next[i]),
        }
        for i in range(len(ids))
    ]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


def against_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint against that of its edited text and that of the next document.

    Documents follow each other by descending id, and the first follows the last. The edited text is the text whose
    last floor(n_chars / 3) code points are replaced by the first as many of the next one, or all it has. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited and near_next. Null texts are
    empty; a null id is the smallest; rows of one id follow each other by the text's checksum. A single document is
    followed by itself. Further columns are left out.

    Ranges of ids are sorted in their tasks, where all but the last document of a range meet the next one. The first
    and the last of each range are returned too and meet in a second, small step.
    """
    spark = docs.sparkSession
    narrow = doc_columns(docs, doc_id, text).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    _, size = count_and_bytes(narrow)
    order = [F.col("doc_id").desc_nulls_last(), F.crc32(F.encode("text", "UTF-8"))]
    parts = buckets_for(spark, size, RANGE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[int, str] | None = None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in steps(texts):
                here_ids, here, some = ids[at], texts[at], []
                if held:
                    here_ids, here = [held[0], *here_ids], [held[1], *here]
                else:
                    some.append({"part": part, "edge": 1, "doc_id": here_ids[0], "text": here[0]})
                if len(here) > 1:
                    some += [{"part": part} | r for r in compared(here_ids[:-1], here)]
                held = here_ids[-1], here[-1]
                if some:
                    yield _batch(some)
        if held:
            yield _batch([{"part": part, "edge": 2, "doc_id": held[0], "text": held[1]}])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # pairs of whole texts, one by one
                one = {name: batch.column(name)[i].as_py() for name in ("doc_id", "text", "after")}
                yield _batch([{"part": 0} | r for r in compared([one["doc_id"]], [one["text"], one["after"]])])

    ranges = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    done = store(ranges.mapInArrow(run, RESULT), "compared")
    firsts, lasts = (done.where(F.col("edge") == edge).select("part", "doc_id", "text") for edge in (1, 2))
    everything = Window.orderBy("part")
    first = F.min("part").over(Window.partitionBy())
    following = firsts.select("part").select("part", F.coalesce(F.lead("part").over(everything), first).alias("next"))
    ends = (
        lasts.join(following, "part")
        .join(firsts.select(F.col("part").alias("next"), F.col("text").alias("after")), "next")
        .select("doc_id", "text", "after")
    )
    both = done.where("edge = 0").unionAll(ends.mapInArrow(meet, RESULT))
    return both.drop("part", "edge", "text")
