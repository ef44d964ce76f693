"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to the same number of bits, the curve index of the cell is worked out by an automaton over
the bits (one lookup for each level), rows are sorted by curve index, and the sorted run is cut into shards of equal
row counts. Neighbours on the curve are neighbours in every dimension, so each shard covers a narrow range of several
columns at once and files can be skipped by their minima and maxima.

All of it is DataFrame operations. The order of all rows is found without gathering them: a range partitioning deals
them to parts, the parts are counted, and a row's rank is its number within its part plus the rows of the parts before.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Bits of each dimension.
BITS = 8
#: Bytes that a row counts besides its text.
ROW_BYTES = 16

Steps = tuple[tuple[int, ...], tuple[int, ...]]


@lru_cache
def hilbert_steps(dims: int) -> Steps:
    """The automaton of the curve in so many dimensions: (next state, digit), at state * 2**dims + corner.

    A state is the corner where the curve enters a cube and the direction in which it leaves; within a cube the curve
    visits the corners in the order of the reflected Gray code, turned and mirrored by the state.
    """
    corners = 1 << dims

    def turned(x: int, by: int) -> int:  # to the left, in dims bits
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (corners - 1)

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    def entry(i: int) -> int:
        return 0 if i == 0 else gray((i - 1) // 2 * 2)

    def direction(i: int) -> int:  # trailing ones, of i or of the number before an even one
        i = 0 if i == 0 else i - (i % 2 == 0)
        return ((~i & (i + 1)).bit_length() - 1) % dims

    rank = {gray(i): i for i in range(corners)}
    following, digits = [], []
    for state in range(corners * dims):
        enter, leave = divmod(state, dims)
        for corner in range(corners):
            digit = rank[turned(corner ^ enter, -(leave + 1))]
            digits.append(digit)
            next_enter = enter ^ turned(entry(digit), leave + 1)
            following.append(next_enter * dims + (leave + direction(digit) + 1) % dims)
    return tuple(following), tuple(digits)


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The curve index of a cell, given its coordinates from 0 to 2**bits - 1."""
    dims = len(cells)
    following, digits = hilbert_steps(dims)
    following, digits = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (following, digits))
    coordinates = [c.cast("bigint") for c in cells]

    def corner(level: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for k, c in enumerate(coordinates):
            # shifts by a column are SQL functions only
            bit = F.call_function("shiftright", c, level).bitwiseAND(F.lit(1).cast("bigint"))
            out = out + bit * (1 << k)
        return out

    def step(state: Column, level: Column) -> Column:
        at = (state["state"] * (1 << dims) + corner(level) + 1).cast("int")
        return F.struct(
            F.element_at(following, at).alias("state"),
            (state["index"] * (1 << dims) + F.element_at(digits, at)).alias("index"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("state"), F.lit(0).cast("bigint").alias("index"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda x: x["index"])


def size_cell(size: Column) -> Column:
    """The cell of a positive size: eight to each power of two, the last one for all beyond."""
    power = (F.length(F.bin(size)) - 1).cast("int")
    eighth = F.call_function("shiftright", size * 8, power) - 8
    return F.least(power * 8 + eighth, F.lit((1 << BITS) - 1)).cast("int")


def with_category_cell(rows: DataFrame, name: str, cell: str, bits: int = BITS) -> DataFrame:
    """Add a category's cell: the share of all rows whose category comes before it, so that cells hold equally many.

    Categories are counted first; the running sum is over one row for each category. Null is a category, the first.
    """
    counts = rows.groupBy(F.col(name).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy(F.col("__value").asc_nulls_first())
    before = F.sum("__n").over(order) - F.col("__n")
    total = F.sum("__n").over(Window.partitionBy())
    cells = store(
        counts.select("__value", F.floor(before * (1 << bits) / total).cast("int").alias(cell)), f"cells-{cell}"
    )
    return rows.join(cells, rows[name].eqNullSafe(cells["__value"])).drop("__value")


def ranked(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    """Rows with ``rank`` (from 0, in the given order over all rows) and ``total``, without gathering them.

    The parts are written with their rows, so that a task that runs again finds the same ones.
    """
    dealt = rows.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    dealt = store(dealt.withColumn("__part", F.spark_partition_id()), "ordered")
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    offsets = store(
        counts.select("__part", before.alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("total")),
        "offsets",
    )
    within = Window.partitionBy("__part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (
        dealt.withColumn("__number", F.row_number().over(within))
        .join(offsets, "__part")
        .withColumn("rank", F.col("__before") + F.col("__number") - 1)
        .drop("__part", "__number", "__before")
    )


def hilbert_shards(
    docs: DataFrame,
    shards: int,
    doc_id: str = "doc_id",
    text: str = "text",
    categories: tuple[str, ...] = ("lang", "source"),
) -> DataFrame:
    """doc_id, size, text_crc32, curve (index), shard and slot (gapless from 0 in each shard) of every row.

    Dimensions are the categories, the logarithm of the size and the position of doc_id between its extremes. Row
    counts of shards differ by one at most, whatever the values are. Equal cells are ordered by doc_id, crc32 and size;
    rows equal in these too are interchangeable. Null ids come first, a null text is empty, a null category is one of
    its own. With fewer rows than shards some shards are empty; an empty table gives no rows. Other columns are left
    out, so their names don't matter.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.octet_length(F.col(text)).cast("bigint")).alias("bytes"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        *[F.col(c).cast("string").alias(f"category{i}") for i, c in enumerate(categories)],
    ).withColumn("size", F.coalesce("bytes", F.lit(0).cast("bigint")) + ROW_BYTES)
    narrow = store(narrow.drop("bytes"), "narrow")

    low, high = (int(x or 0) for x in narrow.agg(F.min("doc_id"), F.max("doc_id")).first())
    top = (1 << BITS) - 1
    share = (F.col("doc_id").cast("double") - float(low)) / max(1.0, float(high) - float(low))
    cells = [F.coalesce(F.floor(share * top), F.lit(0)).cast("int"), size_cell(F.col("size"))]
    celled = narrow
    for i in range(len(categories)):
        celled = with_category_cell(celled, f"category{i}", f"cell{i}")
        cells.append(F.col(f"cell{i}"))
    curve = celled.select("doc_id", "size", "text_crc32", hilbert_index(cells).alias("curve"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = ranked(curve, ["curve", "doc_id", "text_crc32", "size"], parts)
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")  # the least rank whose share reaches the shard
    return (
        row.withColumn("shard", F.expr(f"cast((rank * {shards}) div total as int)"))
        .withColumn("slot", F.col("rank") - first)
        .drop("rank", "total")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write the documents as Parquet, one folder for each shard, in the order of the slots.

    Documents are matched by id; a shard's rows go to tasks by ranges of slots, so that files are in curve order.
    """
    places = assigned.select(F.col("doc_id").alias("__id"), "shard", "slot")
    placed = docs.join(places, F.col(doc_id).eqNullSafe(F.col("__id"))).drop("__id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
