"""A small table with all that makes tables difficult, and plain versions of what operators compute."""

from __future__ import annotations

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, __size int, "
    "bucket string, label int, held boolean, rank int"
)


def words(text):
    return WORDS.findall((text or "").translate(UPPER))


def rows():
    """(doc_id, text, lang, source): nulls everywhere, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(4)
    vocabulary = ["the", "of", "é", "Straße", "naïve", "日本語", "x", "Word", "data", "a@b.cd", "1.2.3.4", "ß", "MiXed"]
    vocabulary += ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(200)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, shared = prose(300), "This line is shared by many documents"
    texts = [prose(rng.randint(1, 120)) for _ in range(40)]
    texts += [base, base, base + " tail", base.upper(), "", None, " ", "\n\n", "\t one\n", "one", "one two", "one two three"]
    texts += [f"{prose(20)}\n  {shared} \n{prose(5)}\n{shared.upper()}" for _ in range(6)]
    texts += ["short\nshort", "short\nother line that is long", "\u00a0 wide blank \u2003 kept", prose(60_000)]
    texts += ["mail me at first.last@mail.example.com, or +1 (555) 123-4567", "card 4539 1488 0343 6467 and 999.1.1.1"]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", "c", None])) for i, t in enumerate(texts)]
    out += [out[3], out[3], out[40], (None, "no id", "en", "a"), (None, None, None, None), (-5, prose(9), "", "")]
    return out


def frame(spark, some=None):
    """The rows with further columns whose names the operators use themselves."""
    data = [
        (i, t, lang, source, None if t is None else len(t), 7, "s", 1, None, 2, None, 9)
        for i, t, lang, source in (rows() if some is None else some)
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(3)
