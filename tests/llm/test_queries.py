"""The registered queries on the smallest tables, against plain versions or their SQL."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from llm import quality
from llm.queries import QUERIES, SQL
from tests.oracle_check import connect, rows_of

from .odd import SCHEMA, frame
from .test_operators import TOKENIZER, held, plain_fingerprint, plain_lines, plain_spans, plain_targets, sha, words

SF_DIR = "/root/testdata/sf0.001"
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def run(name):
        if name not in made:
            made[name] = [r.asDict() for r in QUERIES[name](spark, SF_DIR).collect()]
        return made[name]

    return run


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = connect(SF_DIR)
    df = QUERIES[name](spark, SF_DIR)
    found = con.execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in found.description], found.fetchall())


def test_op1(result, documents):
    sizes = Counter()
    for d in documents:
        sizes[d["source"]] += len(words(d["text"]))
    targets, taken = plain_targets(sizes), Counter()
    by_id = {d["doc_id"]: d for d in documents}
    for r in result("op1_mixing"):
        d = by_id[r["doc_id"]]
        assert r["size"] == len(words(d["text"])) and r["source_size"] == sizes[d["source"]]
        assert math.isclose(r["target"], targets[d["source"]], rel_tol=1e-9) and 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    assert math.isclose(sum(targets.values()), sum(sizes.values()))
    assert all(abs(taken[s] - targets[s]) <= 0.05 * targets[s] for s in sizes)
    assert len(result("op1_mixing")) == len(documents)


def test_op2(result, documents):
    ordered = sorted(documents, key=lambda d: -d["doc_id"])
    found = {r["doc_id"]: r for r in result("op2_minhash")}

    def shingles(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def alike(a, b):
        a, b = shingles(a), shingles(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, d in enumerate(ordered):
        text, after = d["text"], ordered[(k + 1) % len(ordered)]["text"]
        moved = len(text) // 3
        edited = text[: len(text) - moved] + after[:moved]
        r = found[d["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited))
        assert abs(r["near_edited"] - alike(text, edited)) < 0.17 and abs(r["near_next"] - alike(text, after)) < 0.17


def test_op3(result, documents):
    found = result("op3_hilbert")
    by_id = {d["doc_id"]: d["text"].encode() for d in documents}
    shards = defaultdict(list)
    for r in found:
        text = by_id[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "rows", None)
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(40)) and {len(s) for s in shards.values()} <= {5}
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_op4(result, documents):
    lines = plain_lines([(d["doc_id"], d["text"]) for d in documents])
    expected = Counter((i, n, dropped, sha(kept)) for i, n, dropped, kept in lines.elements())
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in result("op4_line_dedup")) == expected


def test_op5(result, documents):
    by_id = {d["doc_id"]: plain_spans(d["text"]) for d in documents}
    assert len(result("op5_pii")) == len(documents)
    for r in result("op5_pii"):
        base = by_id[r["doc_id"]]
        assert r["base_sha256"] == sha(",".join(base)) and set(base) <= set(r["spans"].split(","))
        kinds = Counter(x.split(":")[0] for x in base)
        assert all(r[f"n_{k}"] == kinds[k] for k in ("email", "ip", "card", "phone"))


def test_op7(result, documents):
    tokens = {d["doc_id"]: [*words(d["text"]), None] for d in documents}
    counts = Counter(w for i, t in tokens.items() if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    for r in result("op7_language"):
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    unseen = [r for r in result("op7_language") if r["held_out"]]
    assert unseen and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_op8(result, documents):
    reference = Tokenizer.from_file(TOKENIZER)
    reference.no_truncation()
    reference.no_padding()
    found = {r["doc_id"]: r for r in result("op8_bpe")}
    for d in documents:
        ids = reference.encode(d["text"], add_special_tokens=False).ids
        r = found[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == sha(reference.decode(ids, skip_special_tokens=False))


def plain_components(prints):
    """doc_id -> smallest reachable doc_id."""
    values = np.array(list(prints.values()), dtype=np.uint64)
    ids = np.array(list(prints))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    label = ids.copy()
    while True:
        step = np.array([label[row].min() for row in near])
        if (step == label).all():
            return dict(zip(ids.tolist(), label.tolist(), strict=True))
        label = step


def test_op9(result, documents):
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in documents}
    components = plain_components(prints)
    expected = {(i, f"{p:016x}", components[i]) for i, p in prints.items()}
    assert {tuple(r[c] for c in ("doc_id", "fingerprint", "component_id")) for r in result("op9_simhash")} == expected


def test_op10(result, documents):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()}
    found = {r["doc_id"]: r for r in result("op10_quality")}
    assert set(found) == {d["doc_id"] for d in documents}
    agree = [found[i]["kept"] == (q == 1) for i, q in labels.items() if i in found]
    assert sum(agree) >= 0.95 * len(agree)


def test_quality_on_held_out_labels_of_a_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    held_out = labels.where("doc_id % 3 = 0").join(quality.score(docs, model), "doc_id").collect()
    right = sum((r["__quality"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in held_out)
    assert len(held_out) > 100 and right >= 0.97 * len(held_out)


def test_pipeline(spark):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[2] == "SimHash near-dedup"
    inputs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{len(inputs)}-{id(docs)}"
        stage(spark, inputs[-1], SF_DIR).write.parquet(path)
        inputs.append(spark.read.parquet(path))
    assert all(df.columns == columns for df in inputs[:-1])
    rows = [df.collect() for df in inputs]

    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()}
    kept = {r["doc_id"] for r in rows[1]}
    assert {r["doc_id"]: r["text"] for r in rows[1]}.items() <= {r["doc_id"]: r["text"] for r in rows[0]}.items()
    assert sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)

    lines = plain_lines([(r["doc_id"], r["text"]) for r in rows[1]])
    assert Counter((r["doc_id"], r["text"]) for r in rows[2]) == Counter((i, kept) for i, _, _, kept in lines.elements())
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2])

    components = plain_components({r["doc_id"]: plain_fingerprint(r["text"]) for r in rows[2]})
    assert {r["doc_id"] for r in rows[3]} == set(components.values()) and len(rows[3]) == len(set(components.values()))

    sizes, taken = Counter(), Counter()
    for r in rows[3]:
        sizes[r["source"]] += len(words(r["text"]))
    for r in rows[4]:
        taken[r["source"]] += len(words(r["text"]))
    targets = plain_targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= 0.1 * targets[s] + 5 for s in sizes)  # sources of a few documents
    assert max(Counter(r["doc_id"] for r in rows[4]).values()) <= 3

    texts = {r["doc_id"]: r["text"] for r in rows[4]}
    reference = Tokenizer.from_file(TOKENIZER)
    assert Counter(r["doc_id"] for r in rows[5]) == Counter(r["doc_id"] for r in rows[4])
    for r in rows[5]:
        ids = reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)

    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in whole) == Counter((r["doc_id"], r["ids_sha256"]) for r in rows[5])


def test_stages_on_difficult_and_empty_tables(spark):
    odd, empty = frame(spark), spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        found, none = stage(spark, odd, SF_DIR), stage(spark, empty, SF_DIR)
        assert none.count() == 0 and found.count() > 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.dtypes == odd.dtypes and none.columns == odd.columns, name
