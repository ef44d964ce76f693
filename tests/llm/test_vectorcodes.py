"""Vector codes against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import vectorcodes
from llm.vectorcodes import Blocks, Compressor

SCHEMA = "vec_id bigint, embedding array<float>, label int, place string, part int, error string, codes int"


def frame(spark, some, partitions=3):
    rows = [(i, v, label, "x", 1, None, 2) for i, v, label in some]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def as_integer(x):
    return max(-(1 << 62), min(1 << 62, math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x)))


def plain(some, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error) of the kept rows and the codebooks' digest, one point and entry at a time."""
    kept = [(i, v, label) for i, v, label in some if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(kept[0][1]) if kept else 0
    coded = [(i, [as_integer(float(np.float32(x))) for x in v], label) for i, v, label in kept if len(v) == dims]
    books = []
    codes = [[] for _ in coded]
    errors = [0] * len(coded)
    for k in range(parts):
        points = [v[k * dims // parts : (k + 1) * dims // parts] for _, v, _ in coded]
        book = [list(p) for p in points[:entries]]

        def nearest(p, book=book):
            distances = [sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in book]
            return min(range(len(book)), key=lambda e: (distances[e], e)), min(distances)

        for _ in range(rounds):
            groups = defaultdict(list)
            for p in points:
                groups[nearest(p)[0]].append(p)
            for e, members in groups.items():
                book[e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
        for n, p in enumerate(points):
            e, d = nearest(p)
            codes[n].append(f"{e:02x}")
            errors[n] += d
        books += [str(x) for e in book for x in e]
    most, total = (1 << 63) - 1, Counter()
    errors = [min(e, most) for e in errors]
    for (_, _, label), e in zip(coded, errors, strict=True):
        total[label] += e
    rows = Counter(
        (i, "".join(c), e, min(total[label], most)) for (i, _, label), c, e in zip(coded, codes, errors, strict=True)
    )
    others = [(i, label) for i, v, label in kept if len(v) != dims]
    known = {label for _, _, label in coded}
    rows += Counter((i, None, None, min(total[label], most) if label in known else None) for i, label in others)
    return rows, hashlib.sha256(",".join(books).encode()).hexdigest()


def found(spark, some, partitions=3):
    made = Compressor(frame(spark, some, partitions))
    rows = Counter(
        (r["vec_id"], None if r["codes"] is None else bytes(r["codes"]).hex(), r["error"], r["label_error"])
        for r in made.encoded().collect()
    )
    return rows, made.digest()


def vectors(n, dims=32, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.2) for _ in range(dims)], rng.choice([0, 1, None])) for i in rng.sample(range(9 * n), n)]


def test_against_plain(spark):
    some = vectors(400)
    assert found(spark, some) == plain(some)


def test_many_copies_and_repeated_ids(spark):
    some = vectors(150, 16)
    some += [(1_000_000 + i, some[0][1], 7) for i in range(700)] + [some[5]] * 30 + [(some[8][0], [0.0] * 16, 2)]
    assert found(spark, some) == plain(some) == found(spark, some, 7)


def test_difficult_rows(spark):
    nan, inf = float("nan"), float("inf")
    some = vectors(70, 20)
    some += [(None, some[1][1], None), (None, some[2][1], 5), (3, None, 1), (4, [], 1), (5, [1.0], 9), (6, [nan] * 20, 1)]
    some += [(7, [inf] * 20, 1), (8, [None] * 20, 1), (9, [1e30, -1e30] * 10, 4), (9_999, [-3e38] * 20, 4), (11, [0.0] * 20, None)]
    some = [(i if i is None or len(v or []) == 20 else i + 10_000, v, label) for i, v, label in some]
    assert found(spark, some) == plain(some)


@pytest.mark.parametrize("dims", [0, 1, 5, 17])
def test_lengths_that_parts_do_not_divide(spark, dims):
    some = vectors(80, dims)
    assert found(spark, some) == plain(some)


def test_few_rows_and_none(spark):
    few = vectors(3)
    assert found(spark, few) == plain(few)
    rows, digest = found(spark, [])
    assert not rows and digest == hashlib.sha256(b"").hexdigest()


def test_blocks_spare_most_distances_and_lose_nothing():
    rng = np.random.default_rng(5)
    points = rng.normal(0, 60, (4096, 4)).astype(np.int64)
    entries = points[rng.choice(4096, 64, replace=False)]
    blocks = Blocks.of(points)
    short = vectorcodes.shortlists(blocks.low, blocks.high, entries)
    assert short.mean() < 0.5 and short.any(axis=1).all()
    _, nearest, square = vectorcodes.assign(blocks, entries, distances=True)
    distances = ((points[blocks.order][:, None] - entries[None]) ** 2).sum(axis=2)
    assert (nearest == distances.argmin(axis=1)).all() and (square == distances.min(axis=1)).all()


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    spread = grid * 255 // 7
    order = np.argsort(vectorcodes.hilbert_index(spread))
    step = np.abs(np.diff(grid[order], axis=0)).sum(axis=1)
    assert (step == 1).all()
