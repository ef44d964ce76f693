"""Language-model scores by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs sweeps.

A restaurant for each context serves words; all context restaurants share one parent, whose base is uniform over the
training vocabulary and one unknown word. The context of a token is the word before it, whatever its length, or the end
of the text before for a text's first word. There are as many restaurants as distinct words, so nothing about them is
kept on the driver but the parent's two sums:

1. Each task takes stretches of documents (chunks) and writes, once, their words as positions in the chunk's sorted
   vocabulary. From there the distinct (word, context) pairs of each chunk are dealt to shards by word.
2. A shard adds up the counts of its pairs over all chunks, and knows its words and contexts by number.
3. Contexts are dealt to parts by their hash. Each part learns once where the contexts of each shard are in its own
   list; from then on only counts in that order are exchanged.
4. A sweep seats every word's customers anew, given the totals of the sweep before. Each shard tells the parts the
   tables of its contexts, the parts add them up and tell each shard the totals it needs. Shards lie in buckets on
   disk, so the counts come to them and they don't move.
5. The last pass averages the predictive probabilities over the sweeps after burn-in and answers each chunk's pairs;
   the answers meet the chunk's documents, which add up their tokens.

Words and contexts are known by 56 bits of their hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from posixpath import join

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopanel.sinks.tables import work_dir

from .common import buckets_for, bytes_of, count_and_bytes, doc_columns, steps, store, word_hashes

#: Bits of a pair's key that hold its context's number in a shard, and in a small table of CONTEXTS contexts.
CONTEXT_BITS, SMALL_BITS = 32, 8
CONTEXTS = 1 << SMALL_BITS
#: Word shards for each part of the contexts, as a power of two.
PART_BITS = 2
#: Bytes of text of a chunk, and bytes of text for each shard of the words, about.
CHUNK_BYTES, SHARD_BYTES = 16_000_000, 8_000_000
#: Gibbs sweeps, those that are left out of the average, and the restaurants' strengths.
SWEEPS, BURN_IN, STRENGTH = 4, 2, 1.0

_WORD_BITS = 56
END = np.uint64(0x00E4D0FE4D0FE4D0)


def _zip(values: np.ndarray) -> bytes:
    """Compressed numbers: the bytes of one significance together."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unzip(blob: bytes, dtype: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def _zip_sorted(keys: np.ndarray) -> bytes:
    return _zip(np.diff(keys, prepend=np.uint64(0)))


def _unzip_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unzip(blob, "<u8"), dtype=np.uint64)


def token_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word of every token, an end after each text's words, and the first token of each text."""
    hashes, _, first = word_hashes(texts)
    counts = np.diff(first) + 1
    begins = np.concatenate(([0], np.cumsum(counts)))
    word = np.full(begins[-1], END, dtype=np.uint64)
    at = np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), counts - 1)
    word[at] = hashes >> np.uint64(64 - _WORD_BITS)
    return word, begins


def cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of 1 << bits ranges begins in sorted hashes, and their end."""
    return np.searchsorted(hashes >> np.uint64(_WORD_BITS - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


CHUNKS_SCHEMA = (
    "chunk bigint, ids array<bigint>, held array<boolean>, lengths array<int>, vocabulary binary, codes binary"
)
_CHUNKS_ARROW = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))]
    + [("lengths", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("codes", pa.binary())]
)


def chunk_row(chunk: int, ids: list, held: list[bool], words: list[np.ndarray], lengths: list[int]) -> pa.RecordBatch:
    """The documents as positions in the sorted list of their words."""
    vocabulary, codes = np.unique(np.concatenate(words), return_inverse=True)
    row = {"chunk": chunk, "ids": ids, "held": held, "lengths": lengths}
    row |= {"vocabulary": _zip_sorted(vocabulary), "codes": _zip(codes.astype("<u4"))}
    return pa.RecordBatch.from_pylist([row], schema=_CHUNKS_ARROW)


def chunks_of(docs: DataFrame, doc_id: str, text: str, held: str) -> DataFrame:
    """The rows of chunk_row for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list = []
        flags: list[bool] = []
        words: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0
        for batch in batches:
            texts = bytes_of(batch.column(1))
            names, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for part in steps(texts):
                found, begins = token_words(texts[part])
                words.append(found)
                lengths += np.diff(begins).tolist()
                ids += names[part]
                flags += out[part]
                size += sum(map(len, texts[part]))
                if size >= CHUNK_BYTES:
                    yield chunk_row(number, ids, flags, words, lengths)
                    ids, flags, words, lengths, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield chunk_row(number, ids, flags, words, lengths)

    narrow = doc_columns(docs, doc_id, text, held).select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.col(held).alias("held")
    )
    return narrow.mapInArrow(run, CHUNKS_SCHEMA)


ASKED_SCHEMA = "chunk bigint, shard int, words binary, sizes binary, contexts binary, at binary, counts binary"
_ASKED_ARROW = pa.schema(
    [("chunk", pa.int64()), ("shard", pa.int32())]
    + [(n, pa.binary()) for n in ("words", "sizes", "contexts", "at", "counts")]
)


def asked_rows(chunk: int, vocabulary: np.ndarray, codes: np.ndarray, held: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row for each shard: words, pairs of each, their contexts as positions in a list, and training counts.

    The token before a chunk's first is an end as well, and so is the chunk's last token.
    """
    wide = codes.astype(np.uint64)
    keys = np.sort(wide << np.uint64(33) | np.roll(wide, 1) << np.uint64(1) | held.astype(np.uint64))
    pairs = keys >> np.uint64(1)
    first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    counts = np.add.reduceat(1 - (keys & np.uint64(1)).astype(np.int64), first).astype("<u4")
    word, before = pairs[first] >> np.uint64(32), pairs[first] & np.uint64(0xFFFFFFFF)
    edges = cuts(vocabulary, bits)
    ends = np.searchsorted(word, edges.astype(np.uint64))
    rows = []
    for shard in np.flatnonzero(np.diff(edges)).tolist():
        own, part = slice(edges[shard], edges[shard + 1]), slice(ends[shard], ends[shard + 1])
        sizes = np.bincount((word[part] - np.uint64(own.start)).astype(np.int64), minlength=own.stop - own.start)
        contexts, at = np.unique(before[part], return_inverse=True)
        row = {"chunk": chunk, "shard": shard, "words": _zip_sorted(vocabulary[own]), "sizes": _zip(sizes.astype("<u4"))}
        row |= {"contexts": _zip_sorted(vocabulary[contexts.astype(np.int64)]), "at": _zip(at.astype("<u4"))}
        rows.append(row | {"counts": _zip(counts[part])})
    return pa.RecordBatch.from_pylist(rows, schema=_ASKED_ARROW)


def asked_of(chunks: DataFrame, bits: int) -> DataFrame:
    """The rows of asked_rows for all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, vocabulary, codes, held, lengths = (batch.column(c)[i].as_py() for c in range(5))
                out = np.repeat(np.array(held, dtype=bool), lengths)
                yield asked_rows(chunk, _unzip_sorted(vocabulary), _unzip(codes, "<u4"), out, bits)

    return chunks.select("chunk", "vocabulary", "codes", "held", "lengths").mapInArrow(run, ASKED_SCHEMA)


SHARDS_SCHEMA = (
    "shard int, pairs binary, counts binary, contexts binary, tokens bigint, words bigint, seats bigint, ones bigint, "
    "twos bigint, single bigint, double bigint, chunks array<bigint>, asked array<binary>"
)


def gather(group: pa.Table) -> pa.Table:
    """A shard: its pairs with their training counts, its contexts, and the places of the pairs that each chunk asks.

    A pair is the number of its word << CONTEXT_BITS | the number of its context. Pairs of held-out texts only count 0.
    """
    rows = group.to_pylist()
    words, contexts = ([_unzip_sorted(r[n]) for r in rows] for n in ("words", "contexts"))
    every, around = np.unique(np.concatenate(words)), np.unique(np.concatenate(contexts))
    keys = []
    for row, own, before in zip(rows, words, contexts, strict=True):
        word = np.repeat(np.searchsorted(every, own).astype(np.uint64), _unzip(row["sizes"], "<u4"))
        context = np.searchsorted(around, before).astype(np.uint64)[_unzip(row["at"], "<u4")]
        keys.append(word << np.uint64(CONTEXT_BITS) | context)
    pairs = np.unique(np.concatenate(keys))
    total, asked = np.zeros(len(pairs), dtype=np.int64), []
    for row, own in zip(rows, keys, strict=True):
        place = np.searchsorted(pairs, own)
        total[place] += _unzip(row["counts"], "<u4")
        asked.append(_zip(np.diff(place, prepend=0).astype("<u4")))
    served = np.unique(pairs[total > 0] >> np.uint64(CONTEXT_BITS), return_counts=True)[1]
    row = {
        "shard": rows[0]["shard"],
        "pairs": _zip_sorted(pairs),
        "counts": _zip(total),
        "contexts": _zip_sorted(around),
        "tokens": int(total.sum()),
        "words": len(served),
        "seats": int((total > 0).sum()),
        "ones": int((total == 1).sum()),
        "twos": int((total == 2).sum()),
        "single": int((served == 1).sum()),
        "double": int((served == 2).sum()),
        "chunks": [r["chunk"] for r in rows],
        "asked": asked,
    }
    blobs = [(n, pa.binary()) for n in ("pairs", "counts", "contexts")]
    numbers = [(n, pa.int64()) for n in ("tokens", "words", "seats", "ones", "twos", "single", "double")]
    lists = [("chunks", pa.list_(pa.int64())), ("asked", pa.list_(pa.binary()))]
    return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), *blobs, *numbers, *lists]))


def store_by(df: DataFrame, column: str, name: str) -> DataFrame:
    """Stored like others, but in buckets by a column, so that what is grouped by it later needs no exchange.

    Only a table of the catalog has buckets; it is taken out again at once, which leaves its files.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, column).option("path", join(work_dir(spark), name)).format("parquet").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def _pairs_and_counts(pairs: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _unzip_sorted(pairs), _unzip(counts, "<i8")


def _context_sums(pairs: np.ndarray, weights: np.ndarray, contexts: int) -> np.ndarray:
    at = (pairs & np.uint64((1 << CONTEXT_BITS) - 1)).astype(np.int64)
    return np.bincount(at, weights=weights, minlength=contexts).astype("<i8")


LINKS_SCHEMA = "part int, shard int, places binary, customers binary, tables binary"
_LINKS_ARROW = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32())] + [(n, pa.binary()) for n in ("places", "customers", "tables")]
)


def links_of(shards: DataFrame, bits: int) -> DataFrame:
    """For each part and shard: the places of the shard's contexts in the part's list, their customers and pairs."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, pairs, counts, contexts = (batch.column(c)[i].as_py() for c in range(4))
                keys, total = _pairs_and_counts(pairs, counts)
                around = _unzip_sorted(contexts)
                customers, tables = (_context_sums(keys, w, len(around)) for w in (total, total > 0))
                edges = cuts(around, bits)
                rows = []
                for part in np.flatnonzero(np.diff(edges)).tolist():
                    own = slice(edges[part], edges[part + 1])
                    row = {"part": part, "shard": shard, "places": _zip_sorted(around[own])}
                    rows.append(row | {"customers": _zip(customers[own]), "tables": _zip(tables[own])})
                yield pa.RecordBatch.from_pylist(rows, schema=_LINKS_ARROW)

    def meet(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        contexts = [_unzip_sorted(r["places"]) for r in rows]
        every = np.unique(np.concatenate(contexts))
        places = [np.searchsorted(every, c) for c in contexts]
        for name in ("customers", "tables"):
            add_up(rows, places, name)
        for row, at in zip(rows, places, strict=True):
            row["places"] = _zip_sorted(at.astype(np.uint64))
        return pa.Table.from_pylist(rows, schema=_LINKS_ARROW)

    told = shards.select("shard", "pairs", "counts", "contexts").mapInArrow(tell, LINKS_SCHEMA)
    return told.groupBy("part").applyInArrow(meet, LINKS_SCHEMA)


def add_up(rows: list[dict], places: list[np.ndarray], name: str) -> None:
    """Replace each shard's numbers by their totals over all shards of a part."""
    total = np.zeros(1 + max(int(at[-1]) for at in places), dtype=np.int64)
    for row, at in zip(rows, places, strict=True):
        total[at] += _unzip(row[name], "<i8")
    for row, at in zip(rows, places, strict=True):
        row[name] = _zip(total[at])


@dataclass
class Totals:
    """Of all restaurants after a sweep: tables of each context, customers and tables of the parent."""

    tables: np.ndarray
    parent_customers: int
    parent_tables: int


@dataclass
class Setting:
    """What stays the same over the sweeps: training tokens, vocabulary, customers of contexts, and discounts.

    bits: those of a pair's key that hold the context, whose number is its place in customers and in Totals.tables.
    """

    tokens: int
    words: int
    customers: np.ndarray
    discount: float
    parent_discount: float
    seed: int
    bits: int = SMALL_BITS

    @property
    def uniform(self) -> float:
        return 1.0 / (self.words + 1)


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables that customers of one dish take, seated one after the other.

    The next customer opens a table with odds ``pull`` against the customers seated, less the discount of their tables.
    The first 16 are seated singly. Behind them, for a weak pull the customer who opens the next table is drawn at once,
    from the product of the chances that nobody before does; for a strong one customers come in parties of a sixteenth
    of those that count, with the odds that its middle one meets.
    """
    tables = np.minimum(customers, 1)
    for seated in range(1, 16):
        on = np.flatnonzero(customers > seated)
        if not len(on):
            return tables
        opens = random.random(len(on)) * (pull[on] + seated - discount * tables[on]) < pull[on]
        tables[on] += opens
    seated = np.full(len(customers), 16.0)
    weak = np.flatnonzero((customers > 16) & (pull < 8))
    while len(weak):
        shift = (pull[weak] - 1) / 2 - discount * tables[weak]
        with np.errstate(over="ignore", divide="ignore"):
            reach = (seated[weak] + shift) * random.random(len(weak)) ** (-1 / np.maximum(pull[weak], 1e-12)) - shift
        opened = np.floor(np.minimum(reach, 1e18)) + 1
        weak, opened = weak[opened <= customers[weak]], opened[opened <= customers[weak]]
        tables[weak] += 1
        seated[weak] = opened
    strong = np.flatnonzero((customers > 16) & (pull >= 8))
    while len(strong):
        weight = pull[strong] + seated[strong] - discount * tables[strong]
        party = np.minimum(np.maximum(1, weight // 16), customers[strong] - seated[strong]).astype(np.int64)
        tables[strong] += random.binomial(party, pull[strong] / (weight + (party - 1) / 2))
        seated[strong] += party
        strong = strong[seated[strong] < customers[strong]]
    return tables


class Shard:
    """The seating of a shard's words, carried through the sweeps by the totals of each."""

    def __init__(self, number: int, keys: np.ndarray, counts: np.ndarray, setting: Setting) -> None:
        self.number, self.keys, self.counts, self.setting = number, keys, counts, setting
        self.word, self.context = self.split(keys)
        self.words, self.word = np.unique(self.word, return_inverse=True)
        self.tables = np.ones(len(keys), dtype=np.int64)
        self.served = np.bincount(self.word, minlength=len(self.words))  # the parent's customers
        self.parent_tables = np.ones(len(self.words), dtype=np.int64)

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and contexts of pairs."""
        bits = self.setting.bits
        return keys >> np.uint64(bits), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)

    def parent(self, totals: Totals) -> np.ndarray:
        """The parent's probability of each word."""
        s = self.setting
        back = (STRENGTH + s.parent_discount * totals.parent_tables) * s.uniform
        return (self.served - s.parent_discount * self.parent_tables + back) / (STRENGTH + totals.parent_customers)

    def sweep(self, number: int, totals: Totals) -> None:
        """Seat all customers anew, given the totals of the sweep before."""
        s = self.setting
        random = np.random.default_rng([s.seed, self.number, number])
        pull = (STRENGTH + s.discount * totals.tables[self.context]) * self.parent(totals)[self.word]
        self.tables = seat(self.counts, pull, s.discount, random)
        self.served = np.bincount(self.word, weights=self.tables, minlength=len(self.words)).astype(np.int64)
        back = np.full(len(self.words), (STRENGTH + s.parent_discount * totals.parent_tables) * s.uniform)
        self.parent_tables = seat(self.served, back, s.parent_discount, random)

    def context_tables(self, contexts: int) -> np.ndarray:
        return np.bincount(self.context, weights=self.tables, minlength=contexts).astype(np.int64)

    def totals(self) -> list[int]:
        """Tables of each context, then the parent's customers and tables."""
        tables = self.context_tables(len(self.setting.customers))
        return [*tables.tolist(), int(self.served.sum()), int(self.parent_tables.sum())]

    def answer(self, asked: list[np.ndarray], totals: Totals) -> list[np.ndarray]:
        """The predictive probability of each pair that is asked."""
        s = self.setting
        unknown = (STRENGTH + s.parent_discount * totals.parent_tables) * s.uniform
        parent = np.append(self.parent(totals), unknown / (STRENGTH + totals.parent_customers))
        seats = np.append(self.counts - s.discount * self.tables, 0.0)
        out = []
        for keys in asked:
            word, context = self.split(keys)
            back = (STRENGTH + s.discount * totals.tables[context]) * parent[find(self.words, word)]
            out.append((seats[find(self.keys, keys)] + back) / (STRENGTH + s.customers[context]))
        return out


def find(held: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Positions of numbers in a sorted list; the one behind its end for those that are missing."""
    if not len(held):
        return np.zeros(len(asked), dtype=np.int64)
    at = np.searchsorted(held, asked)
    return np.where((at < len(held)) & (held[np.minimum(at, len(held) - 1)] == asked), at, len(held))


#: What comes to a shard: by part, the customers (CUSTOMERS) or a sweep's tables of its contexts; and its words' state.
COMING_SCHEMA = "shard int, part int, sweep int, a binary, b binary"
CUSTOMERS, STATE = -1, -2
_SEATED_ARROW = pa.schema(
    [("shard", pa.int32()), ("part", pa.int32()), ("sweep", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]
    + [("customers", pa.int64()), ("tables", pa.int64())]
)


def _coming(rows: pa.Table) -> dict[int, np.ndarray]:
    """Numbers of a shard's contexts, by sweep: those of its parts one behind the other."""
    found: dict[int, list] = {}
    for r in sorted(rows.to_pylist(), key=lambda r: r["part"]):
        if r["sweep"] != STATE:
            found.setdefault(r["sweep"], []).append(_unzip(r["a"], "<i8"))
    return {sweep: np.concatenate(parts) for sweep, parts in found.items()}


def _shard(row: dict, rows: pa.Table, setting: Setting) -> Shard:
    """A shard in the state that has come with its totals, or in the first one."""
    keys, counts = _pairs_and_counts(row["pairs"], row["counts"])
    shard = Shard(row["shard"], keys[counts > 0], counts[counts > 0], setting)
    for r in rows.to_pylist():
        if r["sweep"] == STATE:
            shard.served, shard.parent_tables = _unzip(r["a"], "<i8"), _unzip(r["b"], "<i8")
    return shard


def seated(shards: DataFrame, coming: DataFrame, setting: Setting, number: int, sums: tuple, bits: int) -> DataFrame:
    """One sweep: for each shard and part the tables of the shard's contexts, and the state of the shard's words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, tables = left.to_pylist()[0], _coming(right)[number]
        shard = _shard(row, right, setting)
        shard.sweep(number, Totals(tables, *sums))
        own = shard.context_tables(len(tables))
        edges = cuts(_unzip_sorted(row["contexts"]), bits)
        out = [{"part": p, "a": _zip(own[edges[p] : edges[p + 1]])} for p in np.flatnonzero(np.diff(edges)).tolist()]
        state = {"a": _zip(shard.served), "b": _zip(shard.parent_tables)}
        state |= {"customers": int(shard.served.sum()), "tables": int(shard.parent_tables.sum())}
        out = [r | {"sweep": number + 1} for r in out] + [state | {"part": -1, "sweep": STATE}]
        return pa.Table.from_pylist([r | {"shard": row["shard"]} for r in out], schema=_SEATED_ARROW)

    wanted = shards.select("shard", "pairs", "counts", "contexts").groupBy("shard")
    return wanted.cogroup(coming.groupBy("shard")).applyInArrow(run, f"{COMING_SCHEMA}, customers bigint, tables bigint")


def totals_of(links: DataFrame, seats: DataFrame) -> DataFrame:
    """The tables of all shards together, for each part and shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        places = {r["shard"]: _unzip_sorted(r["places"]).astype(np.int64) for r in left.to_pylist()}
        add_up(rows, [places[r["shard"]] for r in rows], "a")
        return pa.Table.from_pylist(rows, schema=pa.schema(list(_SEATED_ARROW)[:5]))

    told = seats.where(f"sweep != {STATE}").select("shard", "part", "sweep", "a", "b").groupBy("part")
    return links.select("part", "shard", "places").groupBy("part").cogroup(told).applyInArrow(run, COMING_SCHEMA)


def answers(
    shards: DataFrame, coming: DataFrame, setting: Setting, sums: list[tuple], burn_in: int
) -> DataFrame:
    """chunk, shard, for each pair the chunk asks its averaged probability, and for each word its training count."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, found = left.to_pylist()[0], _coming(right)
        pairs, counts = _pairs_and_counts(row["pairs"], row["counts"])
        shard = _shard(row, right, replace(setting, customers=found[CUSTOMERS]))
        total = np.zeros(len(pairs))
        for sweep in range(burn_in, len(sums) - 1):
            shard.sweep(sweep, Totals(found[sweep], *sums[sweep]))
            total += shard.answer([pairs], Totals(found[sweep + 1], *sums[sweep + 1]))[0]
        logs = np.log10(total / (len(sums) - 1 - burn_in)).astype("<f4")
        word = (pairs >> np.uint64(CONTEXT_BITS)).astype(np.int64)
        known = np.bincount(word, weights=counts).astype("<i8")
        out = []
        for chunk, blob in zip(row["chunks"], row["asked"], strict=True):
            at = np.cumsum(_unzip(blob, "<u4"), dtype=np.int64)
            reply = {"chunk": chunk, "shard": row["shard"], "logs": _zip(logs[at])}
            out.append(reply | {"known": _zip(known[np.unique(word[at])])})
        schema = pa.schema(
            [("chunk", pa.int64()), ("shard", pa.int32()), ("logs", pa.binary()), ("known", pa.binary())]
        )
        return pa.Table.from_pylist(out, schema=schema)

    wanted = shards.select("shard", "pairs", "counts", "chunks", "asked").groupBy("shard")
    replies = "chunk bigint, shard int, logs binary, known binary"
    return wanted.cogroup(coming.groupBy("shard")).applyInArrow(run, replies)


def discount_of(ones: int, twos: int) -> float:
    """The discount that the numbers of dishes with one and with two customers suggest."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


SCORES_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def document_scores(documents: DataFrame, replies: DataFrame, setting: Setting) -> DataFrame:
    """Scores of the documents of each chunk from the answers to its pairs."""
    log_size = float(np.log10(setting.tokens + setting.words + 1))

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        parts = sorted(found.to_pylist(), key=lambda r: r["shard"])  # the order of the words and of the pairs
        logs = np.concatenate([_unzip(r["logs"], "<f4") for r in parts]).astype(np.float64)
        known = np.concatenate([_unzip(r["known"], "<i8") for r in parts])
        base = np.log10(known + 1.0) - log_size
        out = []
        for row in docs.to_pylist():
            codes = _unzip(row["codes"], "<u4").astype(np.uint64)
            pair = np.unique(codes << np.uint64(32) | np.roll(codes, 1), return_inverse=True)[1]
            codes = codes.astype(np.int64)
            lengths = np.array(row["lengths"], dtype=np.int64)
            at = np.concatenate(([0], np.cumsum(lengths)))[:-1]  # no document is without its end
            by_word = ((known > 0).astype(np.int64)[codes], base[codes])
            sums = [np.add.reduceat(x, at) for x in (*by_word, logs[pair])]
            columns = [pa.array(row["ids"], pa.int64()), pa.array(row["held"]), pa.array(lengths), *map(pa.array, sums)]
            out.append(pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    return documents.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, SCORES_SCHEMA)


def score(
    docs: DataFrame,
    held: str,
    doc_id: str = "doc_id",
    text: str = "text",
    sweeps: int = SWEEPS,
    burn_in: int = BURN_IN,
    seed: int = 7,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    held: a boolean column, true for documents that are scored only; the model learns from all others. Tokens are the
    lower-cased words and one end for each text. ``base_score`` is the unigram score with one added to each count;
    ``score`` is the model's log10 probability of the text. Null and empty texts have the end only. Repeated rows count
    and are scored each; a null id is returned as such. Without training documents all words are unknown and equally
    likely. Further columns are left out. An empty table gives no rows.
    """
    _, size = count_and_bytes(docs, text)
    bits = buckets_for(docs.sparkSession, size, SHARD_BYTES).bit_length() - 1
    part_bits = max(0, bits - PART_BITS)
    written = store(chunks_of(docs, doc_id, text, held), "chunks")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as buckets
    asked = asked_of(written, bits).repartition(parts, "shard")
    shards = store_by(asked.groupBy("shard").applyInArrow(gather, SHARDS_SCHEMA), "shard", "shards")
    names = ("tokens", "words", "seats", "ones", "twos", "single", "double")
    first = shards.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in names]).first()
    tokens, words, seats, ones, twos, single, double = (int(x) for x in first)
    none = np.empty(0, dtype=np.int64)
    setting = Setting(tokens, words, none, discount_of(ones, twos), discount_of(single, double), seed, CONTEXT_BITS)
    links = store(links_of(shards, part_bits), "links")

    def linked(sweep: int, column: str) -> DataFrame:
        return links.selectExpr("shard", "part", f"{sweep} sweep", f"{column} a", "cast(null as binary) b")

    totals, states, sums = [linked(0, "tables")], [linked(STATE, "tables").limit(0)], [(seats, words)]
    for sweep in range(sweeps):
        coming = totals[sweep].unionByName(states[sweep])
        told = store(seated(shards, coming, setting, sweep, sums[sweep], part_bits), "seats")
        states.append(told.where(f"sweep = {STATE}").drop("customers", "tables"))
        both = [F.coalesce(F.sum(c), F.lit(0)) for c in ("customers", "tables")]
        sums.append(tuple(int(x) for x in told.agg(*both).first()))
        totals.append(store(totals_of(links, told), "totals"))
    coming = reduce(DataFrame.unionByName, [linked(CUSTOMERS, "customers"), states[burn_in], *totals[burn_in:]])
    replies = answers(shards, coming, setting, sums, burn_in)
    documents = written.select("chunk", "ids", "held", "lengths", "codes")
    return document_scores(documents, replies, setting).withColumn("train_tokens", F.lit(tokens).cast("bigint"))
