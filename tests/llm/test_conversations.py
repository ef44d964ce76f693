"""Conversation repair against a plain version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from llm import conversations
from llm.conversations import Automaton, Repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, at int, segment string, conv int, edits string, cost int"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
GOES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}


def frame(spark, some, partitions=3):
    rows = [(c, t, r, x, 1, "s", 2, None, 3) for c, t, r, x in some]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def plain_damage(some):
    out = []
    for conv, turn, role, text in some:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """Faults, cost, audit and lines of one conversation's rows in order, by trying all edits."""
    faults, seen = [], set()
    for role, text in rows:
        visible = VISIBLE.findall(text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)

    @lru_cache(maxsize=None)
    def best(i, state, put_in):
        found = []
        if i == len(rows):
            if state in (0, 3):
                found.append((0, "", ()))
        else:
            (role, text), fault = rows[i], faults[i]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (state, role[:1]) in GOES:
                    cost, audit, lines = best(i + 1, GOES[state, role[:1]], 0)
                    found.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                for x in "ua":
                    if (state, x) in GOES:
                        cost, audit, lines = best(i + 1, GOES[state, x], 0)
                        found.append((cost + more + 1, "R" + audit, (f"{FULL[x]}:{text}", *lines)))
        for x in "ua":
            if put_in < 4 and (state, x) in GOES:
                cost, audit, lines = best(i, GOES[state, x], put_in + 1)
                found.append((cost + 5, "I" + audit, (f"{FULL[x]}:", *lines)))
        return min(found, default=(10**9, "", ()))

    return faults, *best(0, 0, 0)


def plain(original, rows):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role, text))
    out = set()
    for conv in {r[0] for r in original}:
        # rows of one turn by role, then by the digest of role and text
        own = sorted(
            by_conv[conv],
            key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()),
        )
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, cost, audit, lines = plain_repair(tuple((r, x) for _, r, x in own))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        bad = sum(p not in ("su", "ua", "au") for p in pairs)
        out.add((conv, gaps, *counts, bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(spark, some):
    df = frame(spark, some)
    rows = conversations.repair(conversations.damaged(df), df).collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {tuple(r[n] for n in NAMES) for r in rows}


def made(seed, convs=60):
    rng = random.Random(seed)
    texts = ["Fine.", "Good!", "Why?", "cut off", "cut, ", "", " \t\n", "end. ", "Fine. \x0b\n", None, "日本。", "é!"]
    texts += [f"line {i}{rng.choice(['.', '!', '?', '', ','])}" for i in range(40)]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "unknown", "", None, "User", "s"]
    some = []
    for conv in [None, *range(convs)]:
        turns = rng.sample(range(30), rng.randint(1, 14)) + ([None] if rng.random() < 0.2 else [])
        for turn in turns:
            some += [(conv, turn, rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 1, 2])
            if rng.random() < 0.1:
                some.append((conv, turn, rng.choice(roles), rng.choice(texts)))
    some.append((9999, 0, "user", "Only one."))
    return some


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    some = made(seed)
    assert found(spark, some) == plain(some, plain_damage(some))


@pytest.mark.parametrize("size", [1, 4])
def test_segments_are_put_together(spark, monkeypatch, size):
    monkeypatch.setattr(conversations, "SEGMENT", size)
    some = made(3, 40)
    assert found(spark, some) == plain(some, plain_damage(some))


def test_long_conversation(spark, monkeypatch):
    """One conversation holds most rows, over several ranges and segments."""
    monkeypatch.setattr(conversations, "SEGMENT", 64)
    monkeypatch.setattr(conversations, "RANGE_BYTES", 2_000)
    rng = random.Random(8)
    some = [(7, i, rng.choice(["user", "assistant"]), f"{rng.randint(0, 300)}{rng.choice('.,')}") for i in range(900)]
    some += made(4, 5)
    assert found(spark, some) == plain(some, plain_damage(some))


def test_rows_repeated_without_end_and_long_text(spark):
    some = [(1, 3, "user", "Same.")] * 500 + [(1, 4, "assistant", "x " * 300_000 + ".")] + [(2, None, "user", "a.")] * 3
    assert found(spark, some) == plain(some, plain_damage(some))


def test_dropped_conversations_and_empty_tables(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(dropped, 0, "user", "Hi.")]) == {(dropped, 0, 0, 0, 0, 0, 0, "", nothing)}
    assert found(spark, []) == set()


def test_repaired_rows(spark):
    some = [(1, 0, "user", "Hi."), (1, 1, "user", "there"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Lone.")]
    repair = Repair(frame(spark, some))
    rows = sorted(repair.repaired().collect(), key=lambda r: (r["conv_id"], r["place"], r["step"]))
    assert [(r["conv_id"], r["edit"], r["role"], r["text"]) for r in rows] == [(1, "K", "user", "Hi."), (1, "K", "assistant", "Yes.")]
    assert {(r["conv_id"], r["cost"], r["audit"]) for r in repair.audited().collect()} == {(1, 2, "KDK"), (2, 2, "D")}


def test_nodes_are_shared_from_the_end():
    """Equal ends are one node, whatever conversation they come from."""
    rng = random.Random(5)
    signatures = ["".join(rng.choice("abcfg") for _ in range(rng.randint(0, 7))) for _ in range(500)]
    automaton = Automaton([s.encode() for s in signatures], conversations.np.array([0, 1 << 40, 1 << 40, 0]))
    ends = {s[k:] for s in signatures for k in range(len(s) + 1)}
    assert len(automaton.symbols) == len(ends) and len(set(automaton.entry.tolist())) == len(set(signatures))
