"""Mixing sources to target weights by a splitting tree of exact block quotas.

A source's documents lie in a fixed random order (a hash of the id) that is cut into blocks of about equal words. The
mix takes whole passes over a source and a part of one more pass, so a source's quota is a number of blocks, and every
copy of a document belongs to one of them. A binary tree over the output shards splits the quotas of all sources: at
each node the left half of the shards gets its share of the draws, made up of sources by a multivariate hypergeometric
draw, and the right half gets the rest. Every shard so holds an exact number of blocks of every source, all quotas are
used up, and the shards' blocks are disjoint runs of the sources' permuted blocks. Within a shard documents are shuffled
by a hash, whose ranges are the tasks' shares of a large shard.

The number of shards follows the words of the mix up to a bound, and so do the words of a block. The part of the last
pass ends where the wanted words are reached. That place is found by narrowing: words are summed
in a bounded number of bins for each source, the bin that holds the end is cut into bins again, until it holds a few
documents, of which those are taken that add up best. No source is ever sorted or gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Hidden, doc_columns, store

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Times its source's size that a target is at most, and so the copies that a document has at most.
MOST = 3
#: Words of an output shard about, while there are no more shards than the second number; and blocks of a shard.
SHARD_WORDS, MOST_SHARDS, SHARD_BLOCKS = 1_000_000, 1_024, 64
#: Words of a task's share of a shard, about.
PIECE_WORDS = 1_000_000
#: Bins of one narrowing step, and documents that the last bin holds at most, unless they share one id.
BINS, LAST_BIN = 256, 256
#: Documents of which all subsets are tried.
FEW = 16
#: Bits of a document's place in its source's order.
PLACE_BITS = 60


def size_of(text: Column) -> Column:
    """Words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place_of(doc_id: Column, seed: int) -> Column:
    """A document's place in its source's random order, from 0 to 2**PLACE_BITS - 1; rows of one id share it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 64 - PLACE_BITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Target words of each source: by weight, at most ``most`` times the source's size, the excess shared by weight.

    Sources are filled in the order of limit / weight. One is at its limit if the level that the rest of the words
    would reach without it is not below; all others end at one common level. Works on a row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    nth = (F.row_number().over(by_name) - 1) % len(weights) + 1
    at_limit = F.col("at_limit")
    return (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth).cast("double"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("limit", (F.col("source_size") * most).cast("double"))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("filled", F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("wanted") - F.coalesce("filled", F.lit(0.0))) / F.col("open"))
        .withColumn("at_limit", F.col("ratio") <= F.col("level"))
        .withColumn("left", F.col("wanted") - F.sum(F.when(at_limit, F.col("limit")).otherwise(0.0)).over(everything))
        .withColumn("free", F.sum(F.when(at_limit, 0.0).otherwise(F.col("weight"))).over(everything))
        .withColumn("even", F.col("left") / F.col("free") * F.col("weight"))
        .withColumn("target", F.when(at_limit, F.col("limit")).otherwise(F.col("even")))
        .select("source", "source_size", "n", F.least("limit", "target").alias("target"))
    )


def narrow_step(places: DataFrame, ends: DataFrame) -> DataFrame:
    """Narrow each source's range of places [low, high) to the bin in which ``need`` more words are reached.

    A range of ``n`` documents is cut into bins of LAST_BIN / 4 documents about, BINS at most; a small one stays whole.
    """
    bins = F.when(F.col("n") <= LAST_BIN, 1).otherwise(F.least(F.lit(BINS), F.expr(f"n div {LAST_BIN // 4}")))
    ends = ends.withColumn("bins", bins).withColumn("width", F.expr("(high - low + bins - 1) div bins"))
    ends = ends.drop("n", "bins")
    inside = places.join(ends, places["source"].eqNullSafe(ends["source"])).where("place >= low and place < high")
    binned = inside.select(
        ends["source"], "low", "high", "need", "width", "size", F.expr("(place - low) div width").alias("bin")
    )
    sums = binned.groupBy("source", "low", "high", "need", "width", "bin").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("source").orderBy("bin")
    return (
        sums.withColumn("until", F.sum("words").over(order))
        .where("until >= need and until - words < need")
        .select(
            "source",
            F.expr("low + bin * width").alias("low"),
            F.expr("least(high, low + (bin + 1) * width)").alias("high"),
            F.expr("need - (until - words)").alias("need"),
            "n",
        )
    )


def nearest_sum(sizes: np.ndarray, need: float) -> np.ndarray:
    """Which of the sizes, largest first, add up to nearly the words that are needed.

    Of a few sizes all subsets are tried. Of more, those that still fit are taken from the largest on, once from each
    place of the order, and the best of these is kept; with many small sizes it leaves hardly a word.
    """
    n = len(sizes)
    if n <= FEW:
        sums = np.zeros(1)
        for size in sizes:
            sums = np.concatenate((sums, sums + size))
        best = int(np.argmin(np.abs(sums - need)))
        return np.array([best >> k & 1 for k in range(n)], dtype=bool)
    best_gap, best = np.inf, np.zeros(n, dtype=bool)
    for first in range(n):
        taken, left = np.zeros(n, dtype=bool), need
        for k in range(first, n):
            if sizes[k] <= left:
                taken[k] = True
                left -= sizes[k]
        more = np.flatnonzero(~taken)
        if len(more) and abs(left - sizes[more[-1]]) < left:  # the smallest that is left brings it nearer
            taken[more[-1]] = True
            left -= sizes[more[-1]]
        if abs(left) < best_gap:
            best_gap, best = abs(left), taken
    return best


def taken_of_last_bin(group: pd.DataFrame) -> pd.DataFrame:
    """The documents of a source's last bin that the mix takes."""
    group = group.sort_values(["size", "place"], ascending=[False, True])
    taken = nearest_sum(group["size"].to_numpy(), float(group["need"].iloc[0]))
    return pd.DataFrame({"source": group["source"].iloc[0], "place": group["place"].to_numpy()[taken]})


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas of each shard (rows) by source (columns), by the splitting tree; columns add up to the quotas."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, quotas.astype(np.int64))]
    while todo:
        begin, end, held = todo.pop()
        if end - begin == 1:
            out[begin] = held
            continue
        middle = (begin + end) // 2
        draws = int(held.sum()) * (middle - begin) // (end - begin)
        random = np.random.default_rng([seed, begin, end])
        left = random.multivariate_hypergeometric(held, draws, method="marginals") if draws else np.zeros_like(held)
        todo += [(begin, middle, left), (middle, end, held - left)]
    return out


class Mix:
    """The plan of a mix: a row for each source, and the documents of the last pass's end that are taken."""

    def __init__(
        self,
        docs: DataFrame,
        weights: tuple[int, ...] = WEIGHTS,
        share: float = 1.0,
        most: int = MOST,
        shards: int | None = None,
        block_words: int | None = None,
        seed: int = 1,
        doc_id: str = "doc_id",
        source: str = "source",
        text: str = "text",
    ) -> None:
        self.doc_id, self.source, self.text, self.most, self.seed = doc_id, source, text, most, seed
        narrow = doc_columns(docs, doc_id, source, text).select(
            F.col(source).cast("string").alias("source"),
            place_of(F.col(doc_id), seed).alias("place"),
            size_of(F.col(text)).alias("size"),
        )
        narrow = store(narrow, "places")
        sizes = narrow.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n")
        )
        targets = source_targets(sizes, weights, share, most).withColumn(
            "passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        )
        targets = store(
            targets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets"
        )
        total = int(targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
        self.shards = shards or min(MOST_SHARDS, max(1, round(total / SHARD_WORDS)))
        self.pieces = max(1, round(total / self.shards / PIECE_WORDS))
        block_words = block_words or max(1, total // (self.shards * SHARD_BLOCKS))
        blocks = F.greatest(F.lit(1), F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
        targets = targets.withColumn("blocks", blocks)
        places = narrow.where("size > 0")
        ends = targets.where("rest >= 0.5").select(
            "source",
            F.lit(0).cast("bigint").alias("low"),
            F.lit(1 << PLACE_BITS).cast("bigint").alias("high"),
            F.col("rest").alias("need"),
            "n",
        )
        while not ends.where(f"n > {LAST_BIN} and high - low > 1").isEmpty():
            ends = store(narrow_step(places, ends), "ends")
        last = (
            places.join(ends, places["source"].eqNullSafe(ends["source"]))
            .where("place >= low and place < high")
            .groupBy(ends["source"], "need", "place")
            .agg(F.sum("size").alias("size"))
        )
        schema = f"source {targets.schema['source'].dataType.simpleString()}, place bigint"
        self.last = store(last.groupBy("source").applyInPandas(taken_of_last_bin, schema), "last")
        ends = ends.select(F.col("source").alias("__source"), "low", "high", "need")
        ended = targets.join(ends, F.expr("source <=> __source"), "left")
        # without a part of a pass no place lies before its end; nulls would make pandas take the columns for floats
        partly = F.col("low").isNotNull()
        quotas = ended.select(
            *targets.columns,
            F.coalesce("low", F.lit(0)).cast("bigint").alias("low"),
            F.coalesce("high", F.lit(1)).cast("bigint").alias("high"),
            F.when(partly, block_of(F.col("low"), F.col("blocks"))).otherwise(0).cast("bigint").alias("last_block"),
            F.when(partly, F.greatest(F.lit(1), F.round(F.col("need") / block_words)))
            .otherwise(0)
            .cast("bigint")
            .alias("last_blocks"),
        )
        # both are 0 without a part of a pass
        quotas = quotas.withColumn("quota", F.expr("passes * blocks + last_block + last_blocks"))
        self.sources = store(self._with_bounds(quotas), "sources")

    def _with_bounds(self, sources: DataFrame) -> DataFrame:
        """Add the first draw of each shard for each source. One task holds a row for each source, no documents."""
        shards, seed = self.shards, self.seed

        def bounds(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("source", na_position="last", ignore_index=True)
            split = split_quotas(rows["quota"].to_numpy(), shards, seed)
            rows["bounds"] = list((np.cumsum(split, axis=0) - split).T)
            return rows.drop(columns="one")

        schema = ", ".join(f"`{n}` {t}" for n, t in sources.dtypes) + ", bounds array<bigint>"
        return sources.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(bounds, schema)

    def plan(self, docs: DataFrame) -> DataFrame:
        """docs with __size, __source_size, __target, __copies, __draws, __shards and __orders.

        Copies are a whole number from 0 to ``most``. The last three are arrays with an entry for each copy: its block
        among its source's draws, the output shard that the tree deals this block to, and its order in the shard. Rows
        of one id and source are taken alike. A null source is a source, the last one; an empty or null text has the
        size zero. With no rows or no words nothing is taken.
        """
        return self._planned(docs, self.doc_id, self.source, self.text)

    def _planned(self, docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
        names = ("source", "source_size", "target", "passes", "low", "high", "blocks", "last_block", "last_blocks", "bounds")
        sources = self.sources.select([F.col(name).alias(f"__{name}") for name in names])
        last = self.last.select(
            F.col("source").alias("__last"), F.col("place").alias("__end"), F.lit(1).alias("__more")
        )
        sized = docs.withColumn("__size", size_of(F.col(text))).withColumn(
            "__place", place_of(F.col(doc_id), self.seed)
        )
        joined = sized.join(sources, F.col(source).cast("string").eqNullSafe(F.col("__source"))).join(
            last, F.col("__source").eqNullSafe(F.col("__last")) & (F.col("__place") == F.col("__end")), "left"
        )
        before = F.col("__place") < F.col("__low")
        extra = F.when(before | F.col("__more").isNotNull(), 1).otherwise(0)
        # documents of the last bin are spread over the last blocks by their places in the bin
        along = (F.col("__place") - F.col("__low")).cast("double") / (F.col("__high") - F.col("__low"))
        ending = F.least(F.floor(along * F.col("__last_blocks")), F.col("__last_blocks") - 1)
        block = block_of(F.col("__place"), F.col("__blocks"))
        final_block = F.when(before, block).otherwise(F.col("__last_block") + ending)
        copies = F.slice(F.sequence(F.lit(0), F.lit(self.most)), F.lit(1), F.col("__copies"))
        draws = F.transform(
            copies,
            lambda c: c * F.col("__blocks") + F.when(c < F.col("__passes"), F.col("__block")).otherwise(F.col("__final")),
        )
        shards = F.transform("__draws", lambda d: F.size(F.filter("__bounds", lambda b: b <= d)) - 1)
        return (
            joined.withColumn("__copies", (F.col("__passes") + extra).cast("int"))
            .withColumn("__block", block)
            .withColumn("__final", final_block.cast("bigint"))
            .withColumn("__draws", draws)
            .withColumn("__shards", shards)
            .withColumn("__orders", F.transform("__shards", lambda s: F.xxhash64(F.lit(self.seed), s, F.col(doc_id))))
            .drop(*[f"__{name}" for name in names if name not in ("source_size", "target")])
            .drop("__last", "__end", "__more", "__place", "__block", "__final")
        )

    def _piece(self, order: Column) -> Column:
        """The range of orders that a copy lies in: a shard's share for one task."""
        return F.shiftright((F.shiftright(order, 32) + (1 << 31)) * self.pieces, 32)

    def dealt(self, docs: DataFrame) -> DataFrame:
        """The documents' ids with what :meth:`plan` says and __slots: each copy's position in its shard, gapless from 0,
        by its order there."""
        narrow = doc_columns(docs, self.doc_id, self.source, self.text)
        planned = self.plan(narrow).drop(self.source, self.text).withColumn("__row", F.monotonically_increasing_id())
        planned = store(planned, "planned")
        copies = planned.select(
            "__row", F.posexplode(F.arrays_zip("__shards", "__orders")).alias("k", "copy")
        ).select(
            "__row",
            "k",
            F.col("copy.__shards").alias("shard"),
            F.col("copy.__orders").alias("order"),
            self._piece(F.col("copy.__orders")).alias("piece"),
        )
        counts = copies.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
        ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")
        rank = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("order", "__row", "k"))
        placed = copies.withColumn("rank", rank).join(counts.withColumn("ahead", ahead), ["shard", "piece"])
        slots = placed.groupBy("__row").agg(
            F.array_sort(F.collect_list(F.struct("k", (F.col("ahead") + F.col("rank") - 1).alias("slot")))).alias("slots")
        )
        both = planned.join(slots, "__row", "left")
        none = F.array().cast("array<bigint>")
        return both.withColumn("__slots", F.coalesce(F.col("slots.slot"), none)).drop("__row", "slots")

    def mixed(self, docs: DataFrame) -> DataFrame:
        """The mixed documents with all their columns, a row for each copy, shuffled within their output shards.

        A task holds ranges of a shard's orders, so its size doesn't follow that of the shards.
        """
        hidden = Hidden(docs)
        planned = self._planned(hidden.docs, hidden[self.doc_id], hidden[self.source], hidden[self.text])
        copies = planned.withColumn("__copy", F.explode(F.arrays_zip("__shards", "__orders"))).withColumns(
            {"__shard": F.col("__copy.__shards"), "__order": F.col("__copy.__orders")}
        )
        pieces = copies.withColumn("__piece", self._piece(F.col("__order"))).repartition("__shard", "__piece")
        return hidden.restore(pieces.sortWithinPartitions("__shard", "__order"))


def block_of(place: Column, blocks: Column) -> Column:
    """The block of a place: the order is cut into equal ranges of places."""
    half = PLACE_BITS // 2
    return F.shiftright(F.shiftright(place, half) * blocks, half)
