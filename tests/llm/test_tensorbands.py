"""Tensored banding against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from llm import tensorbands
from llm.queries import QUERIES

from .odd import SCHEMA, frame, rows, words


def plain_set(text, size=4):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain(some, least=(80, 100)):
    """(doc_id, n, component, kept) of every row, by comparing all pairs of different sets."""
    sets = [plain_set(t) for _, t in some]
    distinct = [s for s in dict.fromkeys(sets) if s]
    up = list(range(len(distinct)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if min(len(a), len(b)) * least[1] >= max(len(a), len(b)) * least[0]:
                common = len(a & b)
                if common * least[1] >= (len(a) + len(b) - common) * least[0]:
                    up[root(i)] = root(j)
    place = {s: i for i, s in enumerate(distinct)}
    smallest = {}
    for (i, _), s in zip(some, sets, strict=True):
        if s and i is not None:
            r = root(place[s])
            smallest[r] = min(i, smallest.get(r, i))
    out = Counter()
    for (i, _), s in zip(some, sets, strict=True):
        component = smallest.get(root(place[s])) if s else i
        out[i, len(s), component, i == component] += 1
    return out


def found(df):
    names = ("doc_id", "n_shingles", "component_id", "kept")
    return Counter(tuple(r[n] for n in names) for r in tensorbands.near_duplicates(df).collect())


def near_copies(seed=6, groups=30):
    """Groups of texts with some words changed, around the least similarity, and one large group."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        for _ in range(60 if g == 0 else rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append((len(out) * 7 % 1009, " ".join(w) if rng.random() < 0.8 else "  ".join(w).upper()))
    return out


def test_difficult_table(spark):
    assert found(frame(spark)) == plain([(i, t) for i, t, *_ in rows()])


@pytest.mark.parametrize("block", [1024, 4])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(tensorbands, "BLOCK", block)
    some = near_copies() + [(None, "a b c"), (None, "A  b\nc"), (2000, "a b c"), (2001, "a b"), (2002, "a b c d")]
    expected = plain(some)
    assert len({c for _, _, c, _ in expected}) < 0.8 * len(some)
    assert found(frame(spark, [(i, t, None, None) for i, t in some])) == expected


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == Counter()


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    documents = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    result = QUERIES["op13_tensored_minhash"](spark, folder).collect()
    rows = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in result)
    assert rows == plain([(d["doc_id"], d["text"]) for d in documents])


def test_pairs_at_the_least_similarity_share_a_key():
    """The share of pairs with similarity 0.8 that no table brings together is what the halves' number says."""
    rng = np.random.default_rng(3)
    missed, tried = 0, 4000
    for _ in range(tried // 200):
        sets = []
        for _ in range(200):
            pool = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
            sets += [np.unique(pool[:90]), np.unique(np.concatenate((pool[:80], pool[90:])))]
        own = tensorbands.halves(sets)
        equal = own[0::2] == own[1::2]
        k = tensorbands.HALVES
        # at similarity 0.8 a half is shared with probability 0.64, so with 3 of the 12 halves some pairs are missed
        missed += int((~(equal[:, :3].any(axis=1) & equal[:, k : k + 3].any(axis=1))).sum())
        assert (equal[:, :k].any(axis=1) & equal[:, k:].any(axis=1)).all()
    expected = 1 - (1 - 0.36**3) ** 2
    assert abs(missed / tried - expected) < 0.025


def test_sets_apart_in_every_hash_but_alike_in_size_are_not_linked():
    a = np.arange(0, 100, dtype=np.uint64)
    others = [np.arange(k, 100 + k, dtype=np.uint64) for k in (0, 11, 12, 50)]
    assert tensorbands.linked(a, others, (80, 100)).tolist() == [True, True, False, False]  # 89 of 111, 88 of 112
