"""Nearest neighbours by a block matrix join of quantised vectors with error bounds.

Vectors are scaled to length one and quantised to int8 with a scale of their own; each keeps the length of its
quantisation error. Blocks of queries meet blocks of candidates, and the product of two int8 tiles gives all their
cosines up to a bound: |q.c - Q.C| <= |q - Q| + |Q| |c - C|. In a tile the k-th largest lower bound of a query prunes
every candidate whose upper bound is below; the survivors' cosines are computed again from the original vectors in
double precision and offered to the query's heap. Each group of tiles passes on its k nearest for each query, and these
are merged by rank. The result is exact.

Queries are a stated set against all rows. Both sides are cut into chunks, and a pair of chunks is one group: a
candidate chunk is sent once for each query chunk and the other way round, so the largest task holds one chunk of each
however many rows, copies or queries there are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_columns, store

#: Rows of a candidate chunk and of a query chunk, about.
CANDIDATES, QUERIES = 16_384, 2_048
#: Rows of one tile of the product, dimensions of one slice of it, and survivors that are scored at once.
TILE, SLICE, SCORED = 1_024, 1_024, 1 << 16


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the quantised vectors, and lengths of their errors, of unit vectors in rows."""
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scales = np.abs(units).max(axis=1, keepdims=True) / 127
    codes = np.rint(units / scales).astype(np.int8)
    restored = codes * scales
    return codes, scales[:, 0], np.linalg.norm(restored, axis=1), np.linalg.norm(units - restored, axis=1)


def in_range(vectors: np.ndarray) -> np.ndarray:
    """Rows of very large or very small components divided by the largest one, so that no square leaves the range."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    return np.where((largest > 1e100) | (largest < 1e-100), vectors / largest, vectors)


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, summed in the order of the components.

    The result for two vectors is the same wherever they stand, and 1 for two equal ones.
    """
    dot, a_square, b_square = (np.cumsum(x * y, axis=1)[:, -1] for x, y in ((a, b), (a, a), (b, b)))
    return np.clip(dot / np.sqrt(a_square * b_square), -1.0, 1.0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of two blocks of int8 rows, exactly. Up to 1,040 dimensions float32 holds every sum of them; longer
    rows are taken in slices that are summed in double precision."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, max(1, a.shape[1]), SLICE):
        out += a[:, at : at + SLICE].astype(np.float32) @ b[:, at : at + SLICE].astype(np.float32).T
    return out


def that_can_win(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows that can be among some query's k nearest, as far as equal vectors go.

    Of equal vectors the smaller ids win, so those of the ``k + 1`` smallest ids do for any query, which may have one of
    them itself, and ``k`` rows of each id.
    """
    same = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize)))[:, 0]
    _, group = np.unique(same, return_inverse=True)
    order = np.lexsort((ids, group))
    of, own = group[order], ids[order]
    new_group = np.concatenate(([True], of[1:] != of[:-1]))
    new_id = new_group | np.concatenate(([True], own[1:] != own[:-1]))
    nth_id = np.cumsum(new_id)
    first_id = np.maximum.accumulate(np.where(new_group, nth_id, 0))
    place = np.arange(len(order))
    first_place = np.maximum.accumulate(np.where(new_id, place, 0))
    return np.sort(order[(nth_id - first_id <= k) & (place - first_place < k)])


def nearest_in_chunk(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of each query's k nearest rows of the chunk, other than itself; ties to smaller ids.

    Every query has a heap of its k best so far. A tile's survivors are scored exactly and offered to it, a bounded
    number at a time, and the heap's last score prunes the tiles that follow.
    """
    some = that_can_win(ids, vectors, k)
    ids, vectors = ids[some], vectors[some]
    query_codes, query_scales, query_norms, query_errors = quantise(queries)
    codes, scales, _, errors = quantise(vectors)
    slack = 1e-6  # for the rounding of the bounds themselves
    least = np.full((len(queries), k), -np.inf)  # the k largest lower bounds so far
    heaps: list[list[tuple[float, int]]] = [[] for _ in queries]  # the worst one first: lowest score, largest id
    last = np.full(len(queries), -np.inf)  # the score of the k-th best
    for at in range(0, len(ids), TILE):
        part = slice(at, at + TILE)
        cosine = products(query_codes, codes[part]) * query_scales[:, None] * scales[part][None, :]
        bound = query_errors[:, None] + query_norms[:, None] * errors[part][None, :] + slack
        other = query_ids[:, None] != ids[part][None, :]
        lower = np.where(other, cosine - bound, -np.inf)
        both = np.concatenate((least, lower), axis=1)
        least = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        i, j = np.nonzero(other & (cosine + bound >= np.maximum(least.min(axis=1), last)[:, None]))
        j += at
        for begin in range(0, len(i), SCORED):
            rows, columns = i[begin : begin + SCORED], j[begin : begin + SCORED]
            score = exact_cosines(queries[rows], vectors[columns])
            good = score >= last[rows]
            for row, value, vec_id in zip(rows[good].tolist(), score[good].tolist(), ids[columns[good]].tolist(), strict=True):
                heap = heaps[row]
                if len(heap) < k:
                    heapq.heappush(heap, (value, -vec_id))
                else:
                    heapq.heappushpop(heap, (value, -vec_id))
                if len(heap) == k:
                    last[row] = heap[0][0]
    found = [(q, -negated, value) for q, heap in zip(query_ids.tolist(), heaps, strict=True) for value, negated in heap]
    kinds = (np.int64, np.int64, np.float64)
    return tuple(np.array(x, dtype=t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)) if found else tuple(
        np.empty(0, dtype=t) for t in kinds
    )


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor zero, all components finite."""
    return (
        vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


def nearest(
    rows: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the k nearest other rows of each query, nearest first.

    queries: which rows are queries. Candidates are all rows but those that share the query's id. Ties go to the
    smaller id. Vectors that are null, zero or hold a component that is null or not finite take no part; a row without
    an id takes none either, and a query without candidates has no result. Vectors of different lengths are never
    compared. Further columns are left out. Repeated rows are candidates each, as rows of one id.
    """
    usable_rows = (
        doc_columns(rows.withColumn("__query", F.coalesce(queries, F.lit(False))), vec_id, embedding, "__query")
        .select(
            F.col(vec_id).cast("bigint").alias("vec_id"),
            F.col(embedding).cast("array<double>").alias("vector"),
            F.col("__query").alias("query"),
        )
        .where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    )
    usable_rows = store(usable_rows, "vectors")
    counted = usable_rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("query"), 1))).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    query_chunks = counted[1] // QUERIES + 1
    chunks = max(counted[0] // CANDIDATES + 1, -(-tasks // query_chunks))

    def dealt(side: DataFrame, own: str, own_chunks: int, other: str, other_chunks: int) -> DataFrame:
        salted = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(own_chunks)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(other_chunks - 1)))
        return side.select("vec_id", "vector", F.size("vector").alias("dims"), salted.alias(own), every.alias(other))

    asked = dealt(usable_rows.where("query"), "q", query_chunks, "c", chunks)
    held = dealt(usable_rows, "c", chunks, "q", query_chunks)

    def matrix(table: pa.Table) -> np.ndarray:
        column = table.column("vector").combine_chunks()
        return in_range(column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1))

    def tile(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not len(asked) or not len(held):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=names)
        ids = [t.column("vec_id").to_numpy() for t in (asked, held)]
        found = nearest_in_chunk(ids[0], matrix(asked), ids[1], matrix(held), k)
        return pa.table([pa.array(x) for x in found], names=names)

    tiles = asked.groupBy("q", "c", "dims").cogroup(held.groupBy("q", "c", "dims")).applyInArrow(
        tile, "query_id bigint, vec_id bigint, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

