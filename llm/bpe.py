"""BPE encoding and decoding by a depth-first walk over the trie of distinct words.

The last token of a word's encoding decides what comes before it: the encoding of a prefix is the encoding of a
shorter prefix and one token, and exactly one such token stays apart from the last token of that shorter prefix. The
words of a batch are sorted, which is the depth-first order of their trie; the last-token states of the path to the
current word are a stack, and the states of a prefix that the next word shares are used again. The last byte of a word
is a symbol of its own (it carries the word end), so it ends a path and is never shared.

No shuffle is needed: each task encodes the distinct words of its own batches. Encodings stay in a bounded table of
the worker for later batches.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_columns, slices

#: Words whose encodings a worker keeps at most between batches; it starts anew beyond.
KEPT_WORDS = 250_000
#: Pairs of tokens whose check a worker keeps at most.
KEPT_PAIRS = 400_000
#: Texts that are encoded together; a longer one is encoded alone.
BATCH_BYTES = 2_000_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded string"

# The tokenizer's contractions, and Unicode white space.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_ASCII = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+", re.ASCII)
_ANY = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def pieces(text: str) -> list[str]:
    """The words of a text after normalising: NFC, lower case code point by code point, white space dropped."""
    if text.isascii():
        return _ASCII.findall(text.lower())
    # str.lower knows a final sigma; the tokenizer lowers each code point by itself
    return _ANY.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Whether this Python's Unicode tables lack a code point, for all of them."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), dtype=bool)


def has_unassigned(text: str) -> bool:
    """Whether a text has a code point that Python's tables lack, which the tokenizer's own tables may know."""
    return not text.isascii() and bool(unassigned()[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].any())


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordEncoder:
    """Encodes words of bytes with the merges of a tokenizer whose last symbol carries a word-end suffix."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model["end_of_word_suffix"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.definition, self.back, self.rules = definition, back, None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.made: dict[int, int] = {}  # the rank of the merge that makes a token
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = rank
            if z not in self.made:
                self.made[z], self.left[z], self.right[z] = rank, x, y
        self.inner: dict[bytes, int] = {}  # tokens within a word
        self.final: dict[bytes, int] = {}  # tokens that end a word
        self.length: dict[int, int] = {}
        for token, i in vocab.items():
            ends = token.endswith(suffix) and len(token) > len(suffix)
            raw = bytes(back[c] for c in (token.removesuffix(suffix) if ends else token))
            (self.final if ends else self.inner)[raw] = i
            self.length[i] = len(raw)
        self.whole: dict[int, bool] = {}
        # a token that its own bytes are not encoded as never occurs
        self.inner = {raw: i for raw, i in self.inner.items() if self.is_whole(i)}
        self.final = {raw: i for raw, i in self.final.items() if self.is_whole(i)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.apart: dict[int, bool] = {}  # by both tokens of a pair in one number
        self.forget()

    def crossing(self, a: int, b: int) -> int | None:
        """The rank of the first merge that joins two neighbouring tokens or what they are made of, if any does.

        Undoes the merges of both tokens from the latest to the first and looks at each pair that meets at the
        boundary meanwhile. Among equal ranks the left one is merged first.
        """
        before_a = before_b = len(self.rank) + 1
        first = None
        while True:
            rank = self.rank.get((a, b))
            if rank is not None and rank < before_a and rank <= before_b:
                first = rank
            made_a, made_b = self.made.get(a, -1), self.made.get(b, -1)
            if made_a < 0 and made_b < 0:
                return first
            if made_a > made_b:
                before_a, a = made_a, self.right[a]
            else:
                before_b, b = made_b, self.left[b]

    def is_whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this one token."""
        if token not in self.whole:
            self.whole[token] = token not in self.made or (
                self.is_whole(self.left[token])
                and self.is_whole(self.right[token])
                and self.crossing(self.left[token], self.right[token]) == self.made[token]
            )
        return self.whole[token]

    def _last(self, word: bytes, end: int, tokens: dict[bytes, int], stack: list[int]) -> int:
        """The last token of the first ``end`` bytes: the one that stays apart from what precedes it.

        stack: the last tokens of the shorter prefixes, -1 for the empty one.
        """
        apart = self.apart
        for begin in range(max(0, end - self.longest), end):
            token = tokens.get(word[begin:end])
            if token is not None:
                before = stack[begin]
                pair = before << 20 | token
                fits = apart.get(pair)
                if fits is None:
                    if len(apart) > KEPT_PAIRS:
                        apart.clear()
                    fits = apart[pair] = begin == 0 or self.crossing(before, token) is None
                if fits:
                    return token
        raise ValueError(f"no encoding for {word!r}")  # single bytes are tokens, so one always fits

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """Encodings of words in sorted order, so that neighbours share the longest prefixes."""
        stack, previous = [-1], b""
        for word in words:
            shared = 0
            for x, y in zip(previous, word):
                if x != y:
                    break
                shared += 1
            del stack[min(shared, len(stack) - 1) + 1 :]
            while len(stack) < len(word):
                stack.append(self._last(word, len(stack), self.inner, stack))
            token = self._last(word, len(word), self.final, stack)
            out, at = [token], len(word) - self.length[token]
            while at > 0:
                out.append(token := stack[at])
                at -= self.length[token]
            previous = word
            yield out[::-1]

    def learn(self, words: set[str]) -> None:
        """Add the encodings of those words that aren't known."""
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > KEPT_WORDS:
            self.forget()
            new = [w for w in words if w not in self.ids]
        pairs = sorted((w.encode(), w) for w in new)
        for (_, word), tokens in zip(pairs, self.encode_sorted([raw for raw, _ in pairs]), strict=True):
            self.ids[word] = struct.pack(f"<{len(tokens)}I", *tokens)
            self.decoded[word] = " ".join([self.text[i] for i in tokens])

    def forget(self) -> None:
        """Keep the special tokens only. No word is spelled as one, since a word never mixes letters and signs."""
        self.ids = {name: i.to_bytes(4, "little") for name, i in self.special.items()}
        self.decoded = {name: name for name in self.special}

    def pieces(self, text: str) -> list[str]:
        """The words of a text. Where it has code points that are newer than Python's tables, the tokenizer's own
        normaliser and splitter say which they are."""
        if not has_unassigned(text):
            return pieces(text)
        if self.rules is None:
            from tokenizers import Tokenizer

            self.rules = Tokenizer.from_str(self.definition)
        split = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))
        return [bytes(map(self.back.__getitem__, word)).decode() for word, _ in split]

    def split(self, text: str) -> list[str]:
        """The words of a text, and the special tokens that it spells out."""
        if not any(s in text for s in self.special):
            return self.pieces(text)
        out: list[str] = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text):
            if part in self.special:
                out.append(part)
            else:
                out += self.pieces(part)
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Token ids as little-endian 32-bit numbers, and the text they decode to, for each text."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        for words in split:
            yield b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.decoded.__getitem__, words))


_encoders: dict[str, WordEncoder] = {}


def encode_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids and decoded text of every document: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded.

    The ids are those that the tokenizer of the file gives without added special tokens, truncation and padding;
    ``decoded`` is what they decode to with special tokens kept. A null text is empty and has no tokens. Every row
    makes a row, repeated ones too; further columns of ``docs`` are left out. The definition file is read where the
    plan is made and sent to the tasks; it is a vocabulary of fixed size.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    definition = docs.sparkSession.sparkContext.broadcast(content)
    key = hashlib.sha256(content.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(key)
        if encoder is None:
            encoder = _encoders[key] = WordEncoder(definition.value)
        for batch in batches:
            for part in slices(batch.column(1), BATCH_BYTES):
                names, texts = (batch.column(c).slice(part.start, part.stop - part.start) for c in (0, 1))
                ids, decoded = zip(*encoder.encode([x or "" for x in texts.to_pylist()]), strict=True)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                columns = [names, counts, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    narrow = doc_columns(docs, doc_id, text).selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text")
    return narrow.mapInArrow(run, SCHEMA)


def decode(ids: bytes, definition: str) -> str:
    """The text of a sequence of ids, special tokens kept: the tokens' strings joined by blanks."""
    spec = json.loads(definition)
    names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return " ".join(names[int(i)] for i in np.frombuffer(ids, dtype="<u4"))
