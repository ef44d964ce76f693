"""Personal data by fixed patterns and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field adds spans that are written in another way: with ``at`` and ``dot`` spelled
out, in parts, without a prefix, or with other signs between the digits. It is trained where the plan is made, from a
small labelled table, by gradient steps on the conditional likelihood; the weights have a fixed size and go to the tasks.
Half of the table is written out from forms of such data and of numbers that are none, the other half are words around
the patterns' spans in a sample of the documents. In the tasks the words of many lines are scored at once: a word's
features are its shape, itself if it is short, and the same of its neighbours, hashed into a table of weights, and all
lines are decoded together by Viterbi, one step for each word position. A span is added only if its text can be what
it is tagged as: the digits of a card pass their test, and the parts of an address are in range.

Everything works on UTF-8 bytes; the patterns are ASCII, so they find the same in bytes, and positions become code
points by counting the bytes that begin one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, doc_columns, mix, steps, store

# The kinds of personal data in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")

#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: Weights of a tag, documents that the labelled table is drawn from, and its sequences at most.
TABLE, SAMPLE_DOCS, SAMPLE_SEQUENCES = 1 << 12, 4_000, 3_000
#: Words around a span in a labelled sequence.
CONTEXT = 8
#: Sequences of the written part of the labelled table, bytes of a word that counts as itself, and the features of a word.
WRITTEN, SHORT_WORD, FEATURES = 2_000, 8, 11
#: Gradient steps, their size, and the penalty on squared weights.
ROUNDS, RATE, PENALTY = 60, 0.2, 1e-4

Span = tuple[int, int, int]  # start and end in bytes, and the kind


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: bytes) -> list[Span]:
    """The spans of the fixed patterns, by start and then kind. A match that fails its test isn't tried again."""
    out: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text) if b"@" in text else ():
        begin = m.start()
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < m.start():
            out.append((begin, m.end(), 0))
            last = m.end()
    for m in _IP.finditer(text):
        parts = [p.lstrip(b"0") for p in m.group().split(b".")]
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().translate(None, b" -")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text) if b"+" in text else ():
        if 9 <= len(m.group().translate(None, b"+ ().-")) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _classes() -> np.ndarray:
    """The class of each byte: white space, lower, upper, digit, beyond ASCII, and one for each sign that matters."""
    table = np.full(256, 15, dtype=np.uint8)
    table[list(b" \t\n\v\f\r")] = 0
    for number, members in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256)), start=1):
        table[list(members)] = number
    for number, sign in enumerate(b"@.-+()_:,", start=5):
        table[sign] = number
    return table


_CLASS = _classes()
_DIGIT, _AT, _DOT = 3, 5, 6


@dataclass
class Words:
    """Words of a buffer: byte positions, sequence numbers (whole lines) and hashed features."""

    starts: np.ndarray
    ends: np.ndarray
    sequence: np.ndarray
    features: np.ndarray


def _letters() -> np.ndarray:
    """The number of each ASCII letter from 1, whatever its case; 0 for all other bytes."""
    table = np.zeros(256, dtype=np.uint64)
    table[65:91] = table[97:123] = np.arange(1, 27)
    return table


_LETTER = _letters()


def spelled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The letters of each short word as one number, other bytes left out; 0 for long words and words without letters."""
    out = np.zeros(len(starts), dtype=np.uint64)
    short = ends - starts <= SHORT_WORD
    for k in range(SHORT_WORD):
        at = starts + k
        letter = np.where(short & (at < ends), _LETTER[raw[np.minimum(at, len(raw) - 1)]], np.uint64(0))
        out = np.where(letter > 0, out * np.uint64(27) + letter, out)
    return out


def words_of(buffer: bytes) -> Words:
    """The words of a buffer and their features: shape, counts, first and last class, a short word itself, and the
    neighbours' shapes and short words."""
    raw = np.frombuffer(buffer, dtype=np.uint8)
    kind = _CLASS[raw]
    inside = kind > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return Words(none, none, none, np.empty((0, FEATURES), dtype=np.int64))
    # runs of one class; digits keep the length of their run up to 4, other classes don't
    begins = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | ~inside[1:])) & inside)
    lengths = np.minimum(np.diff(np.concatenate((begins, [len(raw)]))), 4)
    stop = np.searchsorted(begins, ends)
    first = np.searchsorted(begins, starts)
    code = kind[begins].astype(np.uint64) * np.uint64(8)
    code += np.where(kind[begins] == _DIGIT, lengths, 0).astype(np.uint64)
    spot = np.arange(len(begins)) - np.repeat(first, stop - first)
    shape = np.add.reduceat(mix(code + np.minimum(spot, 20).astype(np.uint64) * np.uint64(256) + np.uint64(1)), first)

    def count(which: int) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kind == which)))
        return sums[ends] - sums[starts]

    digits, signs, dots = count(_DIGIT), count(_AT), count(_DOT)
    size = ends - starts
    before = np.concatenate(([np.uint64(0)], shape[:-1]))
    after = np.concatenate((shape[1:], [np.uint64(0)]))
    lines = np.concatenate(([0], np.cumsum(raw == 10)))[starts]
    new = np.concatenate(([True], lines[1:] != lines[:-1]))
    final = np.concatenate((new[1:], [True]))
    before[new] = 0
    after[final] = 0
    # letters only, in lower case, so that signs around a word don't matter
    itself = spelled(raw, starts, ends)
    previous, following = np.concatenate(([np.uint64(0)], itself[:-1])), np.concatenate((itself[1:], [np.uint64(0)]))
    previous[new] = 0
    following[final] = 0
    facts = [
        shape,
        np.minimum(digits, 20) * 32 + np.minimum(size, 31),
        np.minimum(signs, 2) * 8 + np.minimum(dots, 7),
        kind[starts].astype(np.int64) * 16 + kind[ends - 1],
        before,
        after,
        np.minimum(digits, 20) * 2 + (before != 0),
        np.ones(len(starts), dtype=np.int64),
        itself,
        previous,
        following,
    ]
    salted = [f.astype(np.uint64) * np.uint64(16) + np.uint64(i) for i, f in enumerate(facts)]
    features = np.stack([(mix(f) % np.uint64(TABLE)).astype(np.int64) for f in salted], axis=1)
    return Words(starts, ends, np.cumsum(new) - 1, features)


@dataclass
class Field:
    """Weights of features by tag, of neighbouring tags, and of a sequence's first tag."""

    features: np.ndarray
    follow: np.ndarray
    start: np.ndarray


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties that keep the inside of a kind behind its beginning or inside."""
    follow, start = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for inner in range(2, TAGS, 2):
        follow[:, inner] = -1e4
        follow[[inner - 1, inner], inner] = 0
        start[inner] = -1e4
    return follow, start


class Steps:
    """Sequences side by side, the longest first: at each position those that reach it are a prefix."""

    def __init__(self, sequence: np.ndarray) -> None:
        begins = np.flatnonzero(np.diff(sequence, prepend=-1))
        lengths = np.diff(np.concatenate((begins, [len(sequence)])))
        order = np.argsort(-lengths, kind="stable")
        self.begins, self.lengths = begins[order], lengths[order]
        self.longest = int(lengths.max()) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(1, self.longest + 1), side="right")

    def at(self, position: int) -> np.ndarray:
        return self.begins[: self.active[position]] + position


def viterbi(scores: np.ndarray, field: Field, steps_: Steps) -> np.ndarray:
    """The best tag of each word, given its scores by tag."""
    tags = np.zeros(len(scores), dtype=np.int64)
    if not steps_.longest:
        return tags
    follow = field.follow.astype(scores.dtype)
    best = scores[steps_.at(0)] + field.start.astype(scores.dtype)
    back, ends = [], np.zeros(len(steps_.begins), dtype=np.int64)
    for t in range(1, steps_.longest):
        n = steps_.active[t]
        ends[n : len(best)] = best[n:].argmax(axis=1)
        ways = best[:n, :, None] + follow
        choice = ways.argmax(axis=1)
        back.append(choice.astype(np.uint8))
        best = np.take_along_axis(ways, choice[:, None, :], axis=1)[:, 0] + scores[steps_.at(t)]
        best -= best.max(axis=1, keepdims=True)  # of a long line too, the differences keep their digits
    ends[: len(best)] = best.argmax(axis=1)
    now = ends
    for t in range(steps_.longest - 1, -1, -1):
        n = steps_.active[t]
        tags[steps_.at(t)] = now[:n]
        if t:
            now[:n] = back[t - 1][np.arange(n), now[:n]]
    return tags


def train(sequences: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """Weights from sequences of (features, tags), by Adam on the likelihood of the tags."""
    penalty, first = allowed()
    field = Field(np.zeros((TABLE, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS))
    if not sequences:
        field.features[:, 0] = 1.0
        return Field(field.features, field.follow + penalty, field.start + first)
    features = np.concatenate([f for f, _ in sequences])
    tags = np.concatenate([t for _, t in sequences])
    side = Steps(np.repeat(np.arange(len(sequences)), [len(t) for _, t in sequences]))
    inner = [side.at(t) for t in range(side.longest)]
    observed = np.eye(TAGS)[tags]
    moments = {name: [0.0, 0.0] for name in ("features", "follow", "start")}

    def summed(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)

    for step in range(1, ROUNDS + 1):
        scores = field.features[features].sum(axis=1)
        follow, start = field.follow + penalty, field.start + first
        forward = np.empty_like(scores)
        forward[inner[0]] = scores[inner[0]] + start
        for t in range(1, side.longest):
            prev = inner[t - 1][: len(inner[t])]
            forward[inner[t]] = summed(forward[prev][:, :, None] + follow, 1) + scores[inner[t]]
        backward = np.zeros_like(scores)
        for t in range(side.longest - 2, -1, -1):
            here, after = inner[t][: len(inner[t + 1])], inner[t + 1]
            backward[here] = summed(follow + (scores[after] + backward[after])[:, None, :], 2)
        whole = summed(forward[inner[0]] + backward[inner[0]], 1)
        total = np.empty(len(scores))
        for t in range(side.longest):
            total[inner[t]] = whole[: len(inner[t])]
        expected = np.exp(forward + backward - total[:, None])
        difference = expected - observed
        gradient = {"features": np.zeros_like(field.features), "follow": np.zeros_like(field.follow)}
        for k in range(features.shape[1]):
            np.add.at(gradient["features"], features[:, k], difference)
        for t in range(1, side.longest):
            here, prev = inner[t], inner[t - 1][: len(inner[t])]
            after = scores[here] + backward[here] - total[here][:, None]
            pair = forward[prev][:, :, None] + follow + after[:, None, :]
            gradient["follow"] += np.exp(pair).sum(axis=0) - observed[prev].T @ observed[here]
        gradient["start"] = difference[inner[0]].sum(axis=0)
        for name, g in gradient.items():
            weights = getattr(field, name)
            g = g / len(sequences) + PENALTY * weights
            moments[name][0] = 0.9 * moments[name][0] + 0.1 * g
            moments[name][1] = 0.999 * moments[name][1] + 0.001 * g * g
            mean, square = moments[name][0] / (1 - 0.9**step), moments[name][1] / (1 - 0.999**step)
            weights -= RATE * mean / (np.sqrt(square) + 1e-8)
    return Field(field.features, field.follow + penalty, field.start + first)


def tags_of(words: Words, spans: list[Span]) -> np.ndarray:
    """The tag of each word, given the spans in the same buffer."""
    tags = np.zeros(len(words.starts), dtype=np.int64)
    for start, end, kind in spans:
        a = int(np.searchsorted(words.ends, start, side="right"))
        b = int(np.searchsorted(words.starts, end, side="left"))
        if a < b and not tags[a:b].any():
            tags[a:b] = 2 * kind + 2
            tags[a] = 2 * kind + 1
    return tags


def added_spans(
    buffer: bytes, starts: np.ndarray, ends: np.ndarray, tags: np.ndarray, taken: list[Span]
) -> list[Span]:
    """The spans of tagged words, without signs at their ends, that overlap none of those taken."""
    out: list[Span] = []
    at = np.flatnonzero(tags)
    for i in at[(tags[at] % 2 == 1)].tolist():
        kind, j = (int(tags[i]) - 1) // 2, i + 1
        while j < len(tags) and tags[j] == 2 * kind + 2:
            j += 1
        start, end = int(starts[i]), int(ends[j - 1])
        body = buffer[start:end]
        front = b"[{<\"'" if body[:1] == b"(" and b")" in body else b"([{<\"'"
        start += len(body) - len(body.lstrip(front))
        end -= len(body) - len(body.rstrip(b".,;:!?)]}>\"'"))
        if start < end and plausible(kind, buffer[start:end]):
            out.append((start, end, kind))
    # of those that overlap base spans none is added; base spans are sorted by start, and few
    return [s for s in out if all(s[1] <= t[0] or t[1] <= s[0] for t in taken)]


_SPOKEN = re.compile(
    rb"[a-z0-9._%+-]+\s*(?:@|[\[({]\s*at\s*[\])}]|\bat\b)\s*[a-z0-9-]+\s*"
    rb"(?:(?:\.|[\[({]\s*dot\s*[\])}]|\bdot\b)\s*[a-z0-9-]+\s*)+",
    re.IGNORECASE,
)
_NO_DIGITS = re.compile(rb"[^0-9]+")


def plausible(kind: int, body: bytes) -> bool:
    """Whether a text can be personal data of the kind, whatever stands between its parts."""
    if KINDS[kind] == "email":
        return _SPOKEN.fullmatch(body) is not None
    numbers = [x for x in _NO_DIGITS.split(body) if x]
    if KINDS[kind] == "ip":
        return len(numbers) == 4 and all(len(x.lstrip(b"0")) <= 3 and int(x) <= 255 for x in numbers)
    if re.search(rb"[A-Za-z\x80-\xff]", body):
        return False
    digits = b"".join(numbers)
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def written_table(n: int = WRITTEN, seed: int = 1) -> list[tuple[bytes, list[Span]]]:
    """Sequences in which personal data is written in other ways than the patterns', and some that look like it only.

    Names, words and digits are drawn at random; the forms around them are fixed.
    """
    random = np.random.default_rng(seed)

    def word(least: int = 2, most: int = 9) -> str:
        return "".join(random.choice(list("abcdefghiklmnoprstuvwz"), random.integers(least, most)))

    def digits(count: int) -> str:
        return "".join(map(str, random.integers(0, 10, count)))

    def card(valid: bool) -> str:
        while True:
            found = str(random.integers(3, 7)) + digits(15)
            if luhn(found.encode()) == valid:
                return found

    def fours(number: str, sign: str) -> str:
        return sign.join(number[i : i + 4] for i in range(0, 16, 4))

    def address() -> tuple[str, str, str]:
        user = word() if random.random() < 0.6 else f"{word()}.{word()}"
        return user, word(3, 10), str(random.choice(["com", "org", "net", "de", "fr", "example", "co"]))

    def octets() -> list[str]:
        return [str(x) for x in random.integers(0, 256, 4)]

    def one_of(*forms: str) -> str:
        return str(random.choice(forms))

    def email() -> str:
        user, place, end = address()
        return one_of(
            f"{user} at {place} dot {end}", f"{user} [at] {place} [dot] {end}", f"{user}(at){place}.{end}",
            f"{user} (at) {place} (dot) {end}", f"{user} @ {place} . {end}", f"{user}@{place} dot {end}",
            f"{user} AT {place} DOT {end}",
        )

    def ip() -> str:
        parts = octets()
        return one_of(" . ".join(parts), "[.]".join(parts), " dot ".join(parts), "(.)".join(parts), ". ".join(parts))

    def payment() -> str:
        return fours(card(True), one_of(".", "/", "  ", "_", " - "))

    def phone() -> str:
        return one_of(
            f"{digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(2)} {digits(7)}",
            f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{digits(3)}/{digits(6)}", f"{digits(3)}-{digits(3)}-{digits(4)}",
        )

    called = {
        "email": ("mail", "write to", "contact", "email:", "reach me:", "my address is"),
        "ip": ("host", "server", "from", "ip:", "address", "ping"),
        "card": ("card", "visa", "pay with", "card no", "credit card:", "charged to"),
        "phone": ("call", "tel", "phone:", "fax", "ring", "mobile", "tel.:"),
    }

    def none() -> str:
        return one_of(
            f"order {card(False)}", f"order no {fours(card(False), ' ')}", f"invoice {digits(4)}-{digits(4)}-{digits(4)}",
            f"version {random.integers(0, 9)}.{random.integers(0, 20)}.{random.integers(0, 9)}",
            f"isbn 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"meet me at {word()}", f"{word()} dot {word()}",
            f"page {digits(3)}", f"{digits(3)} {digits(3)} units", f"on 20{digits(2)}-0{digits(1)}-1{digits(1)}",
            f"ref {digits(10)}", f"item {digits(3)} {digits(3)} {digits(4)}", f"look at {word()} {digits(3)}",
            f"section {digits(1)} . {digits(1)} . {digits(1)}", f"sum {digits(3)},{digits(3)},{digits(3)}", f"id {digits(12)}",
            f"build {digits(3)}.{digits(3)}.{digits(4)}", f"lot {fours(card(False), '/')}", f"score {digits(2)} {digits(2)}",
        )

    forms = {"email": email, "ip": ip, "card": payment, "phone": phone}
    out: list[tuple[bytes, list[Span]]] = []
    for _ in range(n):
        parts: list[str] = [" ".join(word() for _ in range(random.integers(0, 6)))]
        spans: list[Span] = []
        for _ in range(random.integers(1, 3)):
            if random.random() < 0.45:
                parts.append(none())
            else:
                kind = str(random.choice(KINDS))
                parts.append(one_of(*called[kind]))
                body = forms[kind]()
                start = len(" ".join(parts)) + 1
                spans.append((start, start + len(body), KINDS.index(kind)))
                parts.append(body)
            parts.append(one_of("", ".", ",", word(), word()) if not spans else one_of(word(), word()))
        out.append((" ".join(parts).encode(), spans))
    return out


def labelled_sequences(docs: DataFrame, doc_id: str, text: str) -> list[tuple[bytes, list[Span]]]:
    """The sampled part of the labelled table: words around base spans, and stretches without any, of a bounded sample.

    The sample is the SAMPLE_DOCS documents of the smallest hashed ids; of its sequences the SAMPLE_SEQUENCES of the
    smallest hashes are taken. Only these reach the driver, a few hundred bytes each.
    """
    order = F.xxhash64(F.col("doc_id"))
    ids = doc_columns(docs, doc_id).select(F.col(doc_id).cast("bigint").alias("doc_id")).where("doc_id is not null")
    ids = store(ids.orderBy(order, "doc_id").limit(SAMPLE_DOCS).distinct(), "sample")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"body": [], "spans": []}
            for body in bytes_of(batch.column(1)):
                spans, words = base_spans(body), words_of(body)
                if not len(words.starts):
                    continue
                middles = [int(np.searchsorted(words.starts, s[0], side="right")) - 1 for s in spans[:4]]
                for middle in {0, *middles}:
                    a, b = max(0, middle - CONTEXT), min(len(words.starts), middle + CONTEXT)
                    begin, end = int(words.starts[a]), int(words.ends[b - 1])
                    if end - begin <= 1_000:
                        inside = [(s[0] - begin, s[1] - begin, s[2]) for s in spans if begin <= s[0] and s[1] <= end]
                        out["body"].append(body[begin:end])
                        out["spans"].append([x for s in inside for x in s])
            schema = pa.schema([("body", pa.binary()), ("spans", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    found = rows.mapInArrow(cut, "body binary, spans array<int>")
    chosen = found.distinct().orderBy(F.xxhash64("body"), "body").limit(SAMPLE_SEQUENCES).collect()
    return [(bytes(r[0]), [tuple(r[1][i : i + 3]) for i in range(0, len(r[1]), 3)]) for r in chosen]


def train_field(sequences: list[tuple[bytes, list[Span]]]) -> Field:
    """A field from a labelled table of texts and their spans."""
    pairs = []
    for body, spans in sequences:
        words = words_of(body.replace(b"\n", b" "))
        if len(words.starts):
            pairs.append((words.features, tags_of(words, spans)))
    return train(pairs)


def _joined(spans: list[Span], points: np.ndarray | None) -> str:
    where = (lambda i: i) if points is None else (lambda i: int(points[i]))
    return ",".join(f"{KINDS[kind]}:{where(start)}:{where(end)}" for start, end, kind in spans)


def find(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans (as ``kind:start:end``, comma-joined) of every row.

    base are the patterns' spans; spans are these and the ones that the field adds beside them. Positions are code
    points, the end is exclusive; order is by start and then kind. Null and empty texts have no spans. Repeated rows
    are returned each; further columns are left out.
    """
    weights = docs.sparkSession.sparkContext.broadcast(
        Field(field.features.astype(np.float32), field.follow.astype(np.float32), field.start.astype(np.float32))
    )
    schema = ", ".join(["doc_id bigint", *(f"n_{k} bigint" for k in KINDS), "base string", "spans string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = weights.value
        for batch in batches:
            texts = bytes_of(batch.column(1))
            for part in steps(texts):
                some = texts[part]
                # texts are separated by a line break, which belongs to none of them
                buffer = b"\n".join(some)
                begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in some])))
                words = words_of(buffer)
                scores = np.zeros((len(words.starts), TAGS), dtype=np.float32)
                for k in range(words.features.shape[1]):
                    scores += model.features[words.features[:, k]]
                tags = viterbi(scores, model, Steps(words.sequence))
                first = np.searchsorted(words.starts, begins)
                counts, base, every = [], [], []
                for i, body in enumerate(some):
                    spans = base_spans(body)
                    own = slice(first[i], first[i + 1])
                    extra: list[Span] = []
                    if tags[own].any():
                        starts, ends = words.starts[own] - begins[i], words.ends[own] - begins[i]
                        extra = added_spans(body, starts, ends, tags[own], spans)
                    points = None
                    if (spans or extra) and not body.isascii():
                        raw = np.frombuffer(body, dtype=np.uint8)
                        points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    counts.append([sum(s[2] == k for s in spans) for k in range(len(KINDS))])
                    base.append(_joined(spans, points))
                    every.append(_joined(sorted(spans + extra, key=lambda s: (s[0], s[2])), points))
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                numbers = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"]
                yield pa.RecordBatch.from_arrays([ids, *numbers, pa.array(base), pa.array(every)], names)

    narrow = doc_columns(docs, doc_id, text).selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text")
    return narrow.mapInArrow(run, schema)


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the written table and a bounded sample of the documents, labelled by the patterns; find spans in all."""
    return find(docs, train_field(written_table() + labelled_sequences(docs, doc_id, text)), doc_id, text)
