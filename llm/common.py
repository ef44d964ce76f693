"""What several operators need: tables, stored results, and vectorised hashing of words.

Texts are handled as UTF-8 bytes. ``bytes.split``, ``bytes.strip`` and ``bytes.lower`` know ASCII only, which makes
their words the runs of ``[^\\x20\\x09-\\x0D]`` and their lower case that of A-Z, whatever else a text holds.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopanel.sinks.tables import store  # noqa: F401  (operators take it from here)

#: Words as the contracts define them, for regular expressions of Spark and of Python.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one vectorised step handles; longer texts make a step of their own.
STEP_BYTES = 2_000_000

_shipped: set[str] = set()

#: Odd multipliers of the polynomial word hash, of the shingle hash and of the final mixing.
WORD_BASE, SHINGLE_BASE, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this library to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="library-")) / "library.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(p for name in ("llm", "isopanel") for p in (root / name).rglob("*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def doc_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name never meet the operator's own."""
    ship(docs.sparkSession)
    return docs.select(*names)


class Hidden:
    """A frame whose columns have neutral names while an operator adds its own, and get theirs back in the end.

    Whatever the columns are called, even twice the same, none of them meets a name of the operator's.
    """

    def __init__(self, docs: DataFrame) -> None:
        self.names = docs.columns
        self.docs = docs.toDF(*[f"__c{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        return f"__c{self.names.index(name)}"

    def restore(self, docs: DataFrame) -> DataFrame:
        return docs.select(*self.docs.columns).toDF(*self.names)


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def steps(texts: list[bytes] | list[str]) -> Iterator[slice]:
    """Slices of the list whose texts hold about STEP_BYTES together."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= STEP_BYTES:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def slices(column: pa.Array, size: int = STEP_BYTES) -> Iterator[slice]:
    """The same for an Arrow column of texts, none of which is brought into Python for it."""
    begin, held = 0, 0
    for i, length in enumerate(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()):
        held += length
        if held >= size:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(column):
        yield slice(begin, len(column))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(33))


_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and lengthened when needed."""
    have = _tables.get(f"powers{base}")
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        factors[0] = 1
        have = _tables[f"powers{base}"] = np.multiply.accumulate(factors)
    return have[:n]


def _bytes_table() -> np.ndarray:
    """A random-looking 64-bit value for each byte."""
    if "bytes" not in _tables:
        _tables["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(WORD_BASE))
    return _tables["bytes"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the lower-cased texts, the words' byte lengths, and the first word of each text.

    A word's hash is the polynomial of its bytes' values, taken from running sums over the whole buffer and shifted
    back to the word's own start by the inverse power, then mixed with its length. It depends on the word alone.
    """
    joined = [b" ".join(t.lower().split()) for t in texts]
    counts = np.fromiter((j.count(b" ") + 1 if j else 0 for j in joined), dtype=np.int64, count=len(joined))
    first = np.concatenate(([0], np.cumsum(counts)))
    buffer = np.frombuffer(b" ".join(j for j in joined if j), dtype=np.uint8)
    if not len(buffer):
        return np.empty(0, np.uint64), np.empty(0, np.int64), first
    gaps = np.flatnonzero(buffer == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(buffer)]))
    sums = np.empty(len(buffer) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_bytes_table()[buffer] * _powers(WORD_BASE, len(buffer)), out=sums[1:])
    back = _powers(pow(WORD_BASE, -1, 1 << 64), len(buffer))
    lengths = ends - starts
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + lengths.astype(np.uint64) * np.uint64(MIX_1))
    return hashes, lengths, first


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text, and the first run of each text.

    A text of fewer words makes one run of all of them; a text without words makes none.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate(([0], np.cumsum(runs)))
    total = int(begins[-1])
    if not total:
        return np.empty(0, np.uint64), begins
    start = np.arange(total) - np.repeat(begins[:-1], runs) + np.repeat(first[:-1], runs)
    length = np.repeat(np.minimum(counts, size), runs)
    out = length.astype(np.uint64) * np.uint64(MIX_2)
    for k in range(size):
        inside = length > k
        word = words[np.where(inside, start + k, 0)]
        out = np.where(inside, out * np.uint64(SHINGLE_BASE) + word, out)
    return mix(out), begins


def count_and_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    row = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def buckets_for(spark: SparkSession, total: int, each: int) -> int:
    """How many parts of about ``each`` make the total, and enough of them for all tasks of a shuffle."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // each + 1)
