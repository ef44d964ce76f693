"""Every operator on the difficult table and on an empty one, against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import bpe, language, linededup, minhash, mixing, neighbours, pii, quality, sharding, simhash

from .odd import SCHEMA, UPPER, frame, rows, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 1


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(docs):
    mix = mixing.Mix(docs)
    found = mix.plan(docs.select("doc_id", "source", "text")).collect()
    assert len(found) == len(rows())
    sizes, taken = Counter(), Counter()
    for r in found:
        assert r["__size"] == len(words(r["text"])) and 0 <= r["__copies"] <= 3 and len(r["__shards"]) == r["__copies"]
        assert all(0 <= s < mix.shards for s in r["__shards"])
        sizes[r["source"]] += r["__size"]
        taken[r["source"]] += r["__size"] * r["__copies"]
    targets = plain_targets(sizes)
    for r in found:
        assert r["__source_size"] == sizes[r["source"]] and math.isclose(r["__target"], targets[r["source"]], abs_tol=1e-6)
    smallest = {s: min(len(words(t)) for i, t, _, x in rows() if x == s and words(t)) for s in sizes if sizes[s]}
    largest = max(len(words(t)) for _, t, _, _ in rows())
    for s in smallest:
        others = targets[s] if sizes[s] < largest else targets[s] * 0.8
        assert abs(taken[s] - targets[s]) <= max(40, 0.02 * others) or sizes[s] > largest, s
    again = mixing.Mix(docs).plan(docs.select("doc_id", "source", "text"))
    assert sorted(map(str, again.collect())) == sorted(map(str, found))
    mixed = mix.mixed(docs)
    assert mixed.columns == docs.columns
    copies = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    expected = Counter()
    for r in found:
        expected[r["doc_id"], r["text"]] += r["__copies"]
    assert copies == +expected


def test_mix_reaches_targets_closely(spark):
    """Many documents in a hot source, so that its end is narrowed down."""
    some = [(i, " ".join(["w"] * (1 + i * 7919 % 60)), None, "hot" if i % 3 else f"s{i % 5}") for i in range(6000)]
    docs = frame(spark, some).select("doc_id", "source", "text")
    found = mixing.Mix(docs).plan(docs)
    for r in found.groupBy("source").agg(
        F.sum(F.col("__size") * F.col("__copies")).alias("taken"), F.first("__target").alias("target")
    ).collect():
        assert abs(r["taken"] - r["target"]) <= 30  # half of the largest document
    shards = Counter(s for r in found.collect() for s in r["__shards"])
    assert sum(shards.values()) == found.agg(F.sum("__copies")).first()[0]


@pytest.mark.parametrize(("shards", "block_words"), [(12, 500), (5, 20_000), (None, None), (64, 1_000)])
def test_blocks_are_dealt_exactly(spark, shards, block_words):
    """Sources of many and of few blocks, narrowed and not: every copy belongs to a block below its source's quota, a
    shard has the run of each source's draws that the tree gives it, and its slots have no gaps."""
    rng = np.random.default_rng(9)
    some = [(i, " ".join(["w"] * int(rng.integers(0, 120))), None, "abcde"[min(4, int(rng.exponential(0.9)))]) for i in range(5000)]
    docs = frame(spark, some)
    mix = mixing.Mix(docs, shards=shards, block_words=block_words)
    sources = {r["source"]: r for r in mix.sources.collect()}
    names = sorted(sources)
    quotas = [sources[s]["quota"] for s in names]
    split = mixing.split_quotas(np.array(quotas), mix.shards, mix.seed)
    assert (split.sum(axis=0) == quotas).all()
    for k, name in enumerate(names):
        assert sources[name]["bounds"] == (np.cumsum(split[:, k]) - split[:, k]).tolist()
    of = {i: source for i, _, _, source in some}
    words_of, slots, places, drawn = Counter(), defaultdict(list), defaultdict(list), defaultdict(set)
    rows_found = mix.dealt(docs).collect()
    assert len(rows_found) == len(some)
    for r in rows_found:
        source = of[r["doc_id"]]
        k, ends = names.index(source), np.cumsum(split, axis=0)
        assert len(r["__draws"]) == len(r["__shards"]) == len(r["__slots"]) == r["__copies"]
        for draw, shard, order, slot in zip(r["__draws"], r["__shards"], r["__orders"], r["__slots"], strict=True):
            assert 0 <= draw < quotas[k] and shard == int(np.searchsorted(ends[:, k], draw, side="right"))
            words_of[shard] += r["__size"]
            slots[shard].append(slot)
            places[shard].append((order, slot))
            drawn[source].add(draw)
    for shard, found in slots.items():
        assert sorted(found) == list(range(len(found)))
        assert [slot for _, slot in sorted(places[shard])] == list(range(len(found)))
    if shards == 5:  # some ten blocks of many documents in each shard
        assert set(words_of) == set(range(5)) and max(words_of.values()) < 1.5 * min(words_of.values())
    if block_words == 500:
        assert max(words_of.values()) < 1.4 * np.median(list(words_of.values())) and len(words_of) == 12
        assert all(len(drawn[s]) > 0.95 * q for s, q in zip(names, quotas, strict=True) if q > 20)


def test_a_large_shard_is_spread_over_tasks(spark, monkeypatch):
    """One source and one shard: its documents lie in many partitions, in order within each of them."""
    monkeypatch.setattr(mixing, "PIECE_WORDS", 500)
    docs = frame(spark, [(i, "a b c d e f g h i j", None, "one") for i in range(4000)])
    mix = mixing.Mix(docs, shards=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = mix.mixed(docs).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 0.35 * 4000 and sum(r["count"] for r in sizes) == 4000


def test_sums_come_near():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 16, 17, 200):
        sizes = np.sort(rng.integers(1, 500, n))[::-1]
        for share in (0.0, 0.3, 0.77, 1.0):
            need = share * sizes.sum()
            gap = abs(sizes[mixing.nearest_sum(sizes, need)].sum() - need)
            plain = min((abs(sum(x * (b >> k & 1) for k, x in enumerate(sizes)) - need) for b in range(1 << n)), default=need) if n <= 7 else 30
            assert gap <= plain + 1e-9


def test_quotas_are_exact():
    quotas = np.array([1000, 3, 0, 250, 1])
    split = mixing.split_quotas(quotas, 12, 5)
    assert (split.sum(axis=0) == quotas).all() and (split >= 0).all()
    assert split.sum(axis=1).max() - split.sum(axis=1).min() <= 1 + int(math.log2(12))
    assert (mixing.split_quotas(quotas, 12, 5) == split).all()


# 2


def test_minhash_against_edits(docs):
    found = minhash.against_edits(docs).collect()
    ordered = sorted(rows(), key=lambda r: (r[0] is None, -(r[0] or 0), zlib.crc32((r[1] or "").encode())))
    expected = Counter()
    for k, (i, t, *_) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        moved = len(t) // 3
        expected[i, len(t), sha(t[: len(t) - moved] + after[:moved])] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == expected
    prints = defaultdict(set)
    texts = {i: t for i, t, *_ in rows() if i is not None}
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == minhash.BINS // 2
        if r["doc_id"] is not None:
            prints[texts[r["doc_id"]]].add(bytes(r["fingerprint"]))
    assert all(len(p) == 1 for p in prints.values())
    alone = minhash.fingerprints(docs).collect()
    assert all(bytes(r["fingerprint"]) in prints[texts[r["doc_id"]]] for r in alone if r["doc_id"] is not None)


def test_short_texts_have_their_own_fingerprints():
    """Texts of 1 to 20 words: different ones differ, unrelated ones are unlike, and estimates have no bias."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{x}" for x in range(5000)]
    for n in (1, 2, 5, 6, 7, 10, 20):
        texts = sorted({" ".join(rng.choice(vocabulary, n)) for _ in range(1500)})
        found = minhash.sketches([t.encode() for t in texts])
        assert len({x.tobytes() for x in found}) == len(texts)
        unrelated = minhash.likeness(found[:-1], found[1:])
        assert unrelated.max() < 0.17 and unrelated.mean() < 0.02
    errors = []
    for _ in range(400):
        base = list(rng.choice(vocabulary, rng.integers(6, 21)))
        other = [*base[:-1], "changed"] if rng.random() < 0.5 else base + list(rng.choice(vocabulary, 2))
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other))
        one, two = minhash.sketches([" ".join(w).encode() for w in (base, other)])
        errors.append(float(minhash.likeness(one[None], two[None])[0]) - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.5


def test_one_document_follows_itself(spark):
    found = minhash.against_edits(frame(spark, [(1, "a b c d e f", None, None)])).collect()
    assert [(r["edited_sha256"], r["near_next"]) for r in found] == [(sha("a b c d" + "a b"), 1.0)] or len(found) == 1


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        a = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        cut = int(rng.integers(0, 400))
        b = a[:cut] + [f"w{x}" for x in rng.integers(0, 10**6, 400 - cut)]
        sets = [{tuple(x[i : i + 5]) for i in range(396)} for x in (a, b)]
        truth = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        sketch = minhash.sketches([" ".join(x).encode() for x in (a, b)])
        errors.append(minhash.likeness(sketch[:1], sketch[1:])[0] - truth)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.15


def test_densify_fills_every_bin_alike():
    values = np.full((2, minhash.BINS), minhash._EMPTY, dtype=np.uint64)
    values[0, 7], values[1, 7], values[1, 9] = 5, 5, 6
    out = minhash.densify(values)
    assert (out[0] == 5).all() and set(out[1].tolist()) == {5, 6} and 60 < (out[1] == 5).sum() < 200
    assert (minhash.unpack(minhash.pack((out & np.uint64(15)).astype(np.uint8))) == out).all()


# 3


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(spark, dims, bits):
    side = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    names = [f"d{k}" for k in range(dims)]
    cells = spark.createDataFrame([tuple(map(int, x)) for x in grid], ", ".join(f"{n} int" for n in names))
    found = cells.withColumn("h", sharding.hilbert_index([F.col(n) for n in names], bits)).collect()
    path = {r["h"]: np.array([r[n] for n in names]) for r in found}
    assert sorted(path) == list(range(side**dims))
    assert all(np.abs(path[k] - path[k + 1]).sum() == 1 for k in range(side**dims - 1))


def test_hilbert_shards(docs):
    found = sharding.hilbert_shards(docs, 40).collect()
    assert len(found) == len(rows())
    expected = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r)
    counts = [len(v) for v in by_shard.values()]
    assert set(by_shard) == set(range(40)) and max(counts) - min(counts) <= 1
    for held in by_shard.values():
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    line = [r["curve"] for s in range(40) for r in sorted(by_shard[s], key=lambda r: r["slot"])]
    assert line == sorted(line)
    few = sharding.hilbert_shards(docs.limit(3), 40).collect()
    assert len({r["shard"] for r in few}) == 3 and {r["slot"] for r in few} == {0}


def test_written_shards_are_narrow(spark, docs, tmp_path):
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    sharding.write_shards(known.select("doc_id", "text"), sharding.hilbert_shards(known, 4), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == known.count() and back.select("shard").distinct().count() == 4


# 4


def plain_lines(some):
    def key(line):
        return line.strip(" \t\n\v\f\r").translate(UPPER)

    last = 1 << 63
    holders = defaultdict(set)
    for i, t, *_ in some:
        for line in (t or "").split("\n"):
            holders[key(line)].add(last if i is None else i)
    out = Counter()
    for i, t, *_ in some:
        lines = (t or "").split("\n")
        own = last if i is None else i
        stay = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == own]
        out[i, len(lines), len(lines) - len(stay), "\n".join(stay)] += 1
    return out


def test_line_dedup(docs):
    found = linededup.dedup_lines(docs.select("doc_id", "text")).collect()
    assert Counter((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"]) for r in found) == plain_lines(rows())
    kept = linededup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows())
    assert kept.where("n_chars <> char_length(text)").isEmpty()


def test_perfect_hash():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    perfect = linededup.PerfectHash.build(keys)
    assert sorted(perfect.numbers(keys).tolist()) == list(range(len(keys)))
    loaded = linededup.PerfectHash(perfect.sizes, perfect.bits)
    assert (loaded.numbers(keys) == perfect.numbers(keys)).all()
    assert linededup.PerfectHash.build(keys[:0]).numbers(keys[:3]).tolist() == [-1] * 3


def test_keys_that_share_a_half_are_told_apart(spark):
    keys = spark.createDataFrame([(5, 1, 10, 2), (5, 2, 20, 3), (5, 3, 30, 4), (6, 1, 40, 5)], "high long, low long, owner long, n long")
    asked = spark.createDataFrame([(0, 5, 2), (1, 5, 3), (1, 5, 9), (2, 6, 1), (2, 7, 1), (3, 5, 1)], "bucket int, high long, low long")
    found = linededup.probe(asked, linededup.build_index(keys, 4), 4).collect()
    assert sorted(tuple(r) for r in found) == [(0, 5, 2, 20, 3), (1, 5, 3, 30, 4), (2, 6, 1, 40, 5), (3, 5, 1, 10, 2)]


# 5


PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
)


def plain_spans(text):
    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [
        (m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in p.finditer(text) if fits(kind, m.group())
    ]
    return [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def test_patterns_on_random_texts():
    rng = np.random.default_rng(5)
    letters = list("ab1234567890.@+-() é%_\n")
    for _ in range(4000):
        text = "".join(rng.choice(letters, rng.integers(0, 60)))
        raw = text.encode()
        got = [f"{pii.KINDS[k]}:{len(raw[:a].decode())}:{len(raw[:b].decode())}" for a, b, k in pii.base_spans(raw)]
        assert got == plain_spans(text), text


def test_pii(docs):
    found = pii.detect(docs).collect()
    expected = Counter((i, ",".join(plain_spans(t or ""))) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["base"]) for r in found) == expected
    for r in found:
        base, every = (r[c].split(",") if r[c] else [] for c in ("base", "spans"))
        assert set(base) <= set(every) and sum(r[f"n_{k}"] for k in pii.KINDS) == len(base)
        places = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in every]
        assert places == sorted(places)


def test_field_learns_shapes_from_a_small_table():
    rng = np.random.default_rng(6)

    def sentence(k):
        fill = ["word", "an", "other", "thing"]
        card = "".join(map(str, rng.integers(0, 10, 15)))
        card += next(d for d in "0123456789" if pii.luhn((card + d).encode()))  # others can be no card
        phone = f"+1 ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}"
        body = b" ".join(x.encode() for x in [*rng.choice(fill, 6), (card, phone, "plain")[k % 3], *rng.choice(fill, 6)])
        where = [(body.index(x.encode()), body.index(x.encode()) + len(x), kind) for x, kind in ((card, 2), (phone, 3)) if x.encode() in body]
        return body, where

    field = pii.train_field([sentence(k) for k in range(240)])
    right = 0
    for k in range(60):
        body, spans = sentence(k)
        w = pii.words_of(body)
        scores = field.features[w.features].sum(axis=1)
        tags = pii.viterbi(scores, field, pii.Steps(w.sequence))
        right += pii.added_spans(body, w.starts, w.ends, tags, []) == spans
    assert right >= 57


def test_field_on_forms_that_no_pattern_has():
    """Held-out precision and recall by kind, on sequences of other names, words and digits than those it learnt."""
    field = pii.train_field(pii.written_table(2000, 1))
    found, wanted, both = Counter(), Counter(), Counter()
    for body, spans in pii.written_table(800, 2):
        w = pii.words_of(body)
        tags = pii.viterbi(field.features[w.features].sum(axis=1), field, pii.Steps(w.sequence))
        base = set(pii.base_spans(body))
        extra = set(pii.added_spans(body, w.starts, w.ends, tags, sorted(base)))
        for s in extra:
            assert pii.plausible(s[2], body[s[0] : s[1]])
            found[s[2]] += 1
            both[s[2]] += s in spans
        for s in set(spans) - base:
            wanted[s[2]] += 1
    for kind in range(len(pii.KINDS)):
        assert both[kind] >= 0.95 * found[kind] and both[kind] >= 0.9 * wanted[kind] > 50, pii.KINDS[kind]


def test_what_can_be_personal_data():
    good = {
        "email": [b"ann at mail dot com", b"ann [at] mail [dot] co.uk", b"a.b(at)mail.example.com", b"x @ y . org"],
        "ip": [b"1 . 2 . 3 . 4", b"10[.]0[.]0[.]255", b"1 dot 2 dot 3 dot 4"],
        "card": [b"4539.1488.0343.6467", b"4539/1488/0343/6467"],
        "phone": [b"(555) 123-4567", b"030 1234567"],
    }
    bad = {
        "email": [b"meet at noon", b"ann at mail", b"dot com"],
        "ip": [b"1.2.3", b"1.2.3.256", b"1.2.3.4.5"],
        "card": [b"4539148803436468", b"4539 1488", b"order 4539148803436467"],
        "phone": [b"123-456", b"call 555 123 4567", b"1234567890123456"],
    }
    for k, kind in enumerate(pii.KINDS):
        assert all(pii.plausible(k, x) for x in good[kind]) and not any(pii.plausible(k, x) for x in bad[kind]), kind


def test_spans_anywhere_in_a_long_line():
    def sentence(before, after):
        phone = f"+1 ({217 + before % 700}) {300 + after % 600}-4455".encode()
        body = b"word " * before + phone + b" thing" * after
        return body, [(5 * before, 5 * before + len(phone), 3)]

    plain = (b"word thing an other word", [])
    field = pii.train_field([sentence(2 + k % 7, 2 + k % 5) if k % 2 else plain for k in range(120)])
    for before in (6, 253, 254, 255, 256, 510, 511, 3838, 3839):
        body, spans = sentence(before, 40)
        w = pii.words_of(body + b"\n" + body)
        assert (np.bincount(w.sequence) == before + 43).all()
        scores = field.features[w.features].sum(axis=1).astype(np.float32)
        tags = pii.viterbi(scores, field, pii.Steps(w.sequence))
        second = [(a + len(body) + 1, b + len(body) + 1, k) for a, b, k in spans]
        assert pii.added_spans(body + b"\n" + body, w.starts, w.ends, tags, []) == spans + second


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(7)
    field = pii.Field(np.zeros((1, pii.TAGS)), rng.normal(size=(pii.TAGS, pii.TAGS)), rng.normal(size=pii.TAGS))
    sequence = np.array([0, 0, 0, 1, 2, 2, 2, 2])
    scores = rng.normal(size=(8, pii.TAGS))
    tags = pii.viterbi(scores, field, pii.Steps(sequence))
    for s in range(3):
        at = np.flatnonzero(sequence == s)
        best, path = -np.inf, None
        for p in np.ndindex(*[pii.TAGS] * len(at)):
            value = field.start[p[0]] + sum(scores[i, t] for i, t in zip(at, p)) + sum(field.follow[a, b] for a, b in zip(p, p[1:]))
            if value > best:
                best, path = value, p
        assert tuple(tags[at]) == path


# 6


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(300)]
    vectors += [(i, vectors[0][1]) for i in range(300, 420)]  # a hot vector, also as a query
    vectors += [(500, None), (501, [0.0] * 8), (502, [1.0, None] + [0.0] * 6), (503, [float("nan")] * 8), (504, [float("inf")] + [0.0] * 7)]
    vectors += [(550, [1.0, 2.0]), (551, [2.0, 1.0]), (None, [1.0] * 8), (7, vectors[7][1]), (600, [1e200] * 8), (601, [1e-200] * 8), (650, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<double>, q int, c string")
    found = neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=5).collect()
    clean = [(i, np.array(v)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    expected = {}
    for i, v in clean:
        if i % 50 == 0:
            scored = sorted(
                (-float(np.clip(v / np.abs(v).max() @ (w / np.abs(w).max()) / np.linalg.norm(v / np.abs(v).max()) / np.linalg.norm(w / np.abs(w).max()), -1, 1)), j)
                for j, w in clean if j != i and len(w) == len(v)
            )
            expected[i] = scored[:5]
    assert {r["query_id"] for r in found} == {i for i, s in expected.items() if s}
    for r in found:
        score, j = expected[r["query_id"]][r["rank"] - 1]
        assert math.isclose(r["score"], -score, rel_tol=1e-12, abs_tol=1e-12)
        if not any(math.isclose(score, s, rel_tol=1e-12) for s, x in expected[r["query_id"]] if x != j):
            assert r["vec_id"] == j
    hot = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == 0)
    assert hot == [(k + 1, 300 + k, 1.0) for k in range(5)]


def test_bounds_hold():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(50, 16)), rng.normal(size=(60, 16))
    (ca, sa, na, ea), (cb, sb, _, eb) = neighbours.quantise(a), neighbours.quantise(b)
    rough = (ca.astype(int) @ cb.astype(int).T) * sa[:, None] * sb[None, :]
    exact = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert (np.abs(rough - exact) <= ea[:, None] + na[:, None] * eb[None, :] + 1e-12).all()


# 7


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def test_language_model(docs):
    flagged = docs.drop("held").withColumn("held", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)))
    found = language.score(flagged, "held").collect()
    texts = {(i, t): [*words(t), None] for i, t, *_ in rows()}
    counts = Counter(w for i, t, *_ in rows() if not held(i) for w in texts[i, t])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t, *_ in rows():
        w = texts[i, t]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        expected[i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found)
    assert got == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in language.score(flagged, "held").collect()}
    assert all(again[r["doc_id"], r["n_tokens"]] == r["score"] for r in found)


def test_predictive_probabilities_add_up():
    rng = np.random.default_rng(10)
    ids = np.unique(rng.integers(1, 1 << 50, 300).astype(np.uint64))
    keys = np.unique(np.array([w << np.uint64(8) | np.uint64(c) for w in ids for c in range(1, 6) if rng.random() < 0.4], dtype=np.uint64))
    counts = rng.integers(1, 90, len(keys))
    customers = np.bincount((keys & np.uint64(255)).astype(int), weights=counts, minlength=language.CONTEXTS).astype(int)
    setting = language.Setting(int(counts.sum()), len(np.unique(keys >> np.uint64(8))), customers, 0.6, 0.5, 1)
    shard = language.Shard(0, keys, counts, setting)
    totals = language.Totals(np.bincount(shard.context, minlength=language.CONTEXTS), len(keys), setting.words)
    vocabulary = np.append(shard.words, np.uint64(77))  # and one unknown word
    for sweep in range(3):
        shard.sweep(sweep, totals)
        assert ((shard.tables >= 1) & (shard.tables <= shard.counts)).all() and (shard.parent_tables <= shard.served).all()
        found = shard.totals()
        totals = language.Totals(np.array(found[: language.CONTEXTS]), *found[language.CONTEXTS :])
        for context in (0, 1, 3, 100):
            asked = vocabulary << np.uint64(8) | np.uint64(context)
            assert math.isclose(shard.answer([asked], totals)[0].sum(), 1.0, rel_tol=1e-9)


@pytest.mark.parametrize("customers,pull,discount", [(6, 0.4, 0.5), (40, 0.5, 0.8), (3000, 0.2, 0.7), (3000, 30.0, 0.6)])
def test_seating_in_strides_is_like_seating_one_by_one(customers, pull, discount):
    rng = np.random.default_rng(11)
    plain = []
    for _ in range(300):
        tables = 1
        for seated in range(1, customers):
            tables += rng.random() * (pull + seated - discount * tables) < pull
        plain.append(tables)
    quick = language.seat(np.full(3000, customers), np.full(3000, pull), discount, rng)
    assert abs(quick.mean() - np.mean(plain)) < 4 * np.std(plain) / math.sqrt(300) + 0.02 * np.mean(plain)
    assert 0.8 < (np.std(quick) + 0.1) / (np.std(plain) + 0.1) < 1.25


def test_model_beats_the_base_on_unseen_text(spark):
    rng = np.random.default_rng(12)
    pairs = [(f"w{a}", f"v{a}") for a in range(50)]

    def text():
        return " ".join(x for _ in range(40) for x in pairs[min(49, int(rng.exponential(8)))])

    docs = frame(spark, [(i, text(), None, None) for i in range(60)]).drop("held")
    found = language.score(docs.withColumn("held", F.col("doc_id") % 5 == 0), "held").where("held_out").collect()
    assert sum(r["score"] for r in found) > sum(r["base_score"] for r in found)


def test_long_words_are_contexts_of_their_own(spark):
    # two words before of one length, each with one word behind it; and what stands between them tells nothing
    rng = np.random.default_rng(13)
    sides = {"leading": "alpha", "another": "gamma"}

    def text():
        return " ".join(f"{w} {sides[w]}" for w in rng.choice(list(sides), 30))

    unseen = [(1000, "leading alpha " * 20), (1001, "leading gamma " * 20)]
    docs = frame(spark, [(i, text(), None, None) for i in range(40)] + [(i, t, None, None) for i, t in unseen]).drop("held")
    found = {r["doc_id"]: r["score"] for r in language.score(docs.withColumn("held", F.col("doc_id") >= 1000), "held").collect()}
    assert found[1000] > found[1001] + 20


def test_context_restaurants_grow_with_the_words(spark):
    docs = frame(spark, [(i, " ".join(f"word{i * 50 + j:06d}" for j in range(50)), None, None) for i in range(40)])
    chunks = language.chunks_of(docs.withColumn("held", F.lit(False)), "doc_id", "text", "held")
    shards = language.asked_of(chunks.repartition(2), 2).groupBy("shard").applyInArrow(language.gather, language.SHARDS_SCHEMA)
    links = language.links_of(shards, 1).collect()
    places = {(r["part"], p) for r in links for p in language._unzip_sorted(r["places"]).tolist()}
    customers = {}
    for r in links:
        at = language._unzip_sorted(r["places"]).tolist()
        customers |= {(r["part"], p): n for p, n in zip(at, language._unzip(r["customers"], "<i8").tolist(), strict=True)}
    assert len(places) == 40 * 50 + 1 and sum(customers.values()) == 40 * 51
    assert sorted(customers.values())[-2:] == [1, 40]


# 8


def test_bpe(docs):
    reference = Tokenizer.from_file(TOKENIZER)
    reference.no_truncation()
    reference.no_padding()
    found = bpe.encode_documents(docs, TOKENIZER).collect()
    expected = Counter()
    for i, t, *_ in rows():
        ids = reference.encode(t or "", add_special_tokens=False).ids
        expected[i, len(ids), np.array(ids, "<u4").tobytes(), reference.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in found) == expected


def test_bpe_on_random_texts():
    with open(TOKENIZER, encoding="utf-8") as file:
        definition = file.read()
    encoder, reference = bpe.WordEncoder(definition), Tokenizer.from_file(TOKENIZER)
    rng = np.random.default_rng(13)
    letters = list("abcdeiklmnorstuy'ßΣσİIıﬁ０²½Ⅷ٣\u0301\u0085\xa0\x1c\u200b\u3000<|>!?._ 12\n日語한😀")
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(1500)]
    texts += ["<|endoftext|> It's<|startoftext|>we'll <|endoftext", "a" * 3000, "ab" * 200, "ΟΔΟΣ ΣΑΣ", "\0"]
    for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        wanted = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text
        assert decoded == reference.decode(wanted, skip_special_tokens=False) == bpe.decode(ids, definition)


# 9


def plain_fingerprint(text, shingle=3):
    w = words(text)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash(docs):
    found = simhash.near_duplicates(docs).collect()
    prints = {t: plain_fingerprint(t) for _, t, *_ in rows()}
    values = sorted(set(prints.values()))
    up = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 3 and up[b] < up[a]:
                    up[a], changed = up[b], True
    first = {}
    for i, t, *_ in rows():
        if i is not None:
            first[up[prints[t]]] = min(i, first.get(up[prints[t]], i))
    expected = Counter((i, f"{prints[t]:016x}", first.get(up[prints[t]])) for i, t, *_ in rows())
    assert Counter(tuple(r) for r in found) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids.pop(None) == 2 and set(ids) == set(first.values()) and set(ids.values()) == {1}


def test_simhash_reaches_through_rows_of_one_id(spark):
    """Rows of one id with several texts connect what each of them is linked to."""
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "red green blue", "left right up down")
    some = [(7, a), (9, a), (9, b), (9, c), (4, c), (12, b), (5, d), (None, d), (None, a)]
    found = simhash.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in some])).collect()
    first = {i: 4 for i in (7, 9, 4, 12)} | {5: 5}
    expected = [(i, f"{plain_fingerprint(t):016x}", first.get(i, 4 if t == a else 5)) for i, t in some]
    assert Counter(tuple(r) for r in found) == Counter(expected)


def test_links_within_a_shard_miss_nothing():
    rng = np.random.default_rng(14)
    points = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = points[:500] ^ (np.uint64(1) << rng.integers(0, 63, 500).astype(np.uint64)) ^ np.uint64(3)
    chain = np.cumsum(np.uint64(1) << np.arange(40, dtype=np.uint64), dtype=np.uint64)
    points = np.unique(np.concatenate((points, near, chain)))
    links = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    simple = np.arange(len(points))
    while True:
        step = np.array([simple[row].min() for row in links])
        if (step == simple).all():
            break
        simple = step
    old, simhash.LEAF_PAIRS = simhash.LEAF_PAIRS, 5000
    try:
        assert (simhash.link_within(points, len(points), 3) == simple).all()
    finally:
        simhash.LEAF_PAIRS = old
    tree = simhash.ShardTree(points[::7], 5)
    home = tree.homes(points)
    at, shard = tree.reached(points, 3)
    reached = set(zip(at.tolist(), shard.tolist(), strict=True))
    assert all((i, home[j]) in reached for i, j in zip(*np.nonzero(links)))


# 10


def labelled(spark, n=400):
    rng = np.random.default_rng(15)

    def good():
        return " ".join(f"{''.join(rng.choice(list('abcdefgh'), rng.integers(2, 9)))}" for _ in range(60)).capitalize() + "."

    def bad():
        return " ".join(f"W{rng.integers(0, 9)}***" for _ in range(60))

    some = [(i, good() if i % 4 else bad(), "en", f"s{i % 7}") for i in range(n)]
    return frame(spark, some), spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_labels(spark):
    docs, labels = labelled(spark)
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    unseen = [i for i in range(400) if i % 2]
    assert sum((found[i]["__quality"] >= 0.5) == (i % 4 > 0) for i in unseen) >= 0.98 * len(unseen)
    assert all(0 <= found[i][c] <= 1 for i in unseen for c in ("__text_score", "__metadata_score", "__quality"))
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns and abs(kept.count() - 300) <= 4


def test_quality_on_difficult_tables(spark, docs):
    some, labels = labelled(spark, 200)
    model = quality.train(some, labels)
    scored = quality.score(docs, model)
    assert scored.count() == len(rows()) and scored.where("__quality is null or isnan(__quality)").isEmpty()
    for odd in ([], [(1, 1, 0)], [(1, None, None), (None, 0, 0)], [(1, 1, 0), (1, 0, 0), (2, 1, 0)]):
        few = spark.createDataFrame(odd, "doc_id long, quality int, toxic int")
        assert quality.classify(docs, few).count() == len(rows())


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    mix = mixing.Mix(empty)
    results = [
        mix.plan(empty.select("doc_id", "source", "text")), mix.mixed(empty), minhash.against_edits(empty),
        sharding.hilbert_shards(empty, 40), linededup.without_repeated_lines(empty), pii.detect(empty),
        neighbours.nearest(vectors, F.col("vec_id") % 50 == 0), language.score(empty, "held"),
        bpe.encode_documents(empty, TOKENIZER), simhash.near_duplicates(empty), simhash.keep_one(empty),
        quality.classify(empty, none),
    ]
    assert [df.count() for df in results] == [0] * len(results)


def test_all_code_points_are_encoded_alike():
    """Every code point between two letters, also those that are newer than Python's tables."""
    reference = Tokenizer.from_file(TOKENIZER)
    with open(TOKENIZER, encoding="utf-8") as file:
        encoder = bpe.WordEncoder(file.read())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}B" for c in points[k : k + 4096]) for k in range(0, len(points), 4096)]
    for k, (text, (ids, _)) in enumerate(zip(texts, encoder.encode(texts), strict=True)):
        expected = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, hex(points[k * 4096])


def test_pool_is_scored_whole_and_ids_may_repeat(spark):
    """One labelled id and one unlabelled document occur very often; the surest rows are those of a plain ranking."""
    rng = np.random.default_rng(3)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 40)) + ".", "en", "a") for i in range(0, 120, 2)]
    bad = [(i, "!!! " * 30 + "BUY $$$ " * int(rng.integers(3, 30)), "en", "b") for i in range(1, 120, 2)]
    more = [(1000 + i, t, lang, x) for i, (_, t, lang, x) in enumerate((good + bad) * 3)]
    copies = [(5000 + i, good[0][1], "en", "a") for i in range(3000)] + [good[1]] * 3000
    docs = frame(spark, good + bad + more + copies)
    labels = spark.createDataFrame([(i, i % 2 ^ 1) for i in range(120)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).select("doc_id", "__quality").collect()
    assert all((r["__quality"] >= 0.5) == (r["doc_id"] % 2 == 0) for r in scored if r["doc_id"] < 120)
    every = quality.features_of(docs, "doc_id", "text", "lang", "source")
    rows_found = every.collect()
    assert len(rows_found) == len(good + bad + more + copies)
    sure = quality.surest(every, model.views, 20)
    values = np.array([np.frombuffer(r["features"], np.float32) for r in rows_found], dtype=np.float64)
    for (teacher, label), found in sure.items():
        odds = model.views[teacher].odds(quality.view_of(values, teacher)) * (1 if label else -1)
        by_number = {r["number"]: o for r, o in zip(rows_found, odds.tolist(), strict=True) if o > quality.SURE}
        expected = sorted(by_number, key=lambda n: (-round(by_number[n], 9), n))[:20]
        assert {n for n, _ in found} == set(expected) and len(found) == len(expected)


def test_neighbours_of_many_equal_and_of_long_vectors():
    """Equal vectors are ranked by id, rows of a query's own id don't count, and products of long rows are exact."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3, 8))
    ids = np.concatenate((rng.permutation(3000), [5] * 40, [7] * 3))
    vectors = base[rng.integers(0, 3, len(ids))]
    for query in (5, 7, 11, 2999, 10_000):
        q = base[:1]
        found = neighbours.nearest_in_chunk(np.array([query]), q, ids, vectors, 5)
        score = neighbours.exact_cosines(np.repeat(q, len(ids), axis=0), vectors)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != query][:5]
        assert sorted(zip(-found[2], found[1], strict=True)) == sorted(zip(-score[order], ids[order], strict=True))
    for dims in (1, 1024, 2000, 5000):
        a, b = (rng.integers(-127, 128, (20, dims)).astype(np.int8) for _ in range(2))
        a[0], b[0] = 127, 127
        assert (neighbours.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    queries, rows_in = rng.normal(size=(30, 2000)), rng.normal(size=(2500, 2000))
    found = neighbours.nearest_in_chunk(np.arange(30), queries, np.arange(100, 2600), rows_in, 5)
    scores = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (rows_in / np.linalg.norm(rows_in, axis=1)[:, None]).T
    for k in range(30):
        assert {int(x) - 100 for x in found[1][found[0] == k]} == set(np.argsort(-scores[k])[:5].tolist())


def test_shards_fill_evenly_from_a_small_sample():
    """Deep levels split points although the sample has none there, and no link is lost."""
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 1 << 64, 100_000, dtype=np.uint64))
    tree = simhash.ShardTree(points[:64], 10)
    sizes = np.bincount(tree.homes(points), minlength=1024)
    assert (sizes > 0).mean() > 0.95 and sizes.max() < 12 * sizes.mean()
    near = points[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    homes, (at, reached) = tree.homes(near), tree.reached(points[:300], 3)
    assert all(homes[i] in set(reached[at == i].tolist()) for i in range(300))
