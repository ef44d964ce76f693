"""Quality classification by co-training a text view and a metadata view.

Two logistic classifiers look at each document: one at its text (signs, case, repetition, variety of words), one at its
metadata (language, source, size and layout). Both are trained on a bounded sample of the labelled documents. In each
round each classifier scores all unlabelled documents and labels those that it is surest of, a fixed number, as many of
each class as the labels' shares suggest, and hands them to the other one. In the end both are calibrated on labelled documents
that took no part, their calibrated odds are combined by a third, two-weight classifier fitted there as well, and the
combination scores all documents. The models have a few dozen weights; features are worked out where documents are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Hidden, bytes_of, doc_columns, ship, steps, store, word_hashes

#: Labelled documents that the classifiers are fitted on at most.
LABELLED = 4_000
#: Rounds, documents that each classifier labels in a round, and the log odds from which on it is sure.
ROUNDS, TAKEN, SURE = 4, 300, 2.0
#: Every so manyth labelled document is held out for calibration.
HELD_OUT = 4
#: Hashed places of language and of source.
LANGS, SOURCES = 8, 32
#: Probability of good quality below which a document is rejected.
THRESHOLD = 0.5

TEXT_FEATURES, METADATA_FEATURES = 22, 8 + LANGS + SOURCES


def _byte_kinds() -> np.ndarray:
    """0 lower case and beyond ASCII, 1 upper case, 2 digits, 3 white space, 4 sentence signs, 5 other signs."""
    kinds = np.full(256, 5, dtype=np.uint8)
    for number, members in ((0, range(97, 123)), (0, range(128, 256)), (1, range(65, 91)), (2, range(48, 58))):
        kinds[list(members)] = number
    kinds[list(b" \t\n\v\f\r")] = 3
    kinds[list(b".,;:?!'\"-()")] = 4
    return kinds


_KINDS = _byte_kinds()
_SIGNS = [bytes([c]) for c in b"!*#$%&|"]


def text_features(texts: list[bytes]) -> np.ndarray:
    """The text view: a row of shares for each text; zeros for one without words."""
    n = len(texts)
    out = np.zeros((n, TEXT_FEATURES))
    hashes, lengths, first = word_hashes(texts)
    counts = np.diff(first)
    row = np.repeat(np.arange(n), counts)
    words = np.maximum(counts, 1)
    size = np.maximum([len(t) for t in texts], 1)
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner = np.repeat(np.arange(n), [len(t) for t in texts])
    kinds = np.bincount(owner * 6 + _KINDS[buffer], minlength=n * 6).reshape(n, 6)
    out[:, 0:6] = kinds / size[:, None]
    out[:, 6] = [max(map(t.count, _SIGNS)) for t in texts] / words
    for k, sign in enumerate(_SIGNS):
        out[:, 7 + k] = np.minimum([t.count(sign) for t in texts] / words, 3)
    out[:, 14] = np.bincount(row, weights=lengths, minlength=n) / words / 10
    # repetition: the same word again, distinct words, the most frequent word, pairs seen before
    again = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]) if len(hashes) else np.zeros(0, dtype=bool)
    out[:, 15] = np.bincount(row[1:][again], minlength=n) / words
    for k, keys in ((16, hashes), (18, hashes + np.roll(hashes, 1) * np.uint64(3))):
        order = np.lexsort((keys, row))
        keys, at = keys[order], row[order]
        new = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])
        begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), dtype=bool), new)))
        repeats = np.diff(np.concatenate((begins, [len(keys)])))
        out[:, k] = np.bincount(at[begins], minlength=n) / words
        most = np.zeros(n)
        np.maximum.at(most, at[begins], repeats)
        out[:, k + 1] = most / words
    out[:, 20] = np.log1p(counts) / 10
    out[:, 21] = counts < 8
    out[counts == 0] = 0
    return out


def metadata_features(texts: list[bytes], langs: list[str | None], sources: list[str | None]) -> np.ndarray:
    """The metadata view: size, layout, and hashed language and source; a null is a value of its own."""
    n = len(texts)
    out = np.zeros((n, METADATA_FEATURES))
    size = np.array([len(t) for t in texts], dtype=float)
    lines = np.array([t.count(b"\n") + 1 for t in texts], dtype=float)
    longest = np.array([max(map(len, t.split(b"\n"))) for t in texts], dtype=float)
    empty = np.array([t.count(b"\n\n") for t in texts], dtype=float)
    out[:, 0] = np.log1p(size) / 10
    out[:, 1] = np.log1p(lines) / 5
    out[:, 2] = np.log1p(size / lines) / 10
    out[:, 3] = np.log1p(longest) / 10
    out[:, 4] = empty / lines
    out[:, 5] = out[:, 0] ** 2
    out[:, 6] = size < 50
    out[:, 7] = lines == 1
    for names, begin, places in ((langs, 8, LANGS), (sources, 8 + LANGS, SOURCES)):
        at = [xxhash.xxh32_intdigest(b"\0" if x is None else x.encode()) % places for x in names]
        out[np.arange(n), begin + np.array(at, dtype=np.int64)] = 1
    return out


@dataclass
class Logistic:
    """Weights over standardised features, the last one constant."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> Logistic:
    """Logistic regression by Newton's method with a penalty on squared weights."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack((np.clip((x - mean) / spread, -8, 8), np.ones((len(x), 1))))
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + ridge * w
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, spread, w)


@dataclass
class Model:
    """The two views, and the combination of their odds; without views every document gets the same probability."""

    views: tuple[Logistic, ...]
    calibrations: tuple[Logistic, ...]
    combination: Logistic | None
    prior: float

    def probability(self, view_features: tuple[np.ndarray, ...]) -> np.ndarray:
        """Probability of good quality."""
        if self.combination is None:
            return np.full(len(view_features[0]), self.prior)
        odds = self.calibrated(view_features)
        return 1 / (1 + np.exp(-np.clip(self.combination.odds(odds), -30, 30)))

    def calibrated(self, view_features: tuple[np.ndarray, ...]) -> np.ndarray:
        pairs = zip(self.views, self.calibrations, view_features, strict=True)
        return np.stack([calibration.odds(view.odds(x)[:, None]) for view, calibration, x in pairs], axis=1)


#: An unlabelled document that a view is sure of: its number and its features of both views.
Sure = tuple[int, np.ndarray]
#: Gives, for the views as they are, the documents that each is surest of: by teacher and label, surest first.
Ask = Callable[[tuple["Logistic", ...]], dict[tuple[int, int], list[Sure]]]


def co_train(features: np.ndarray, labels: np.ndarray, ask: Ask) -> Model:
    """features: of both views of the labelled documents, side by side; labels: 1 good, 0 bad.

    In each round the views are fitted, and each one's surest unlabelled documents become examples of the other one,
    ``TAKEN`` of them, good and bad as the labels are shared. What a view has been given stays.
    """
    if len(set(labels)) < 2:  # nothing to tell apart: all documents are what the labels are, or good
        return Model((), (), None, float(labels.mean()) if len(labels) else 1.0)
    held = np.arange(len(labels))[HELD_OUT - 1 :: HELD_OUT]
    if len(set(labels[held])) < 2:
        held = np.arange(len(labels))
    training = np.setdiff1d(np.arange(len(labels)), held) if len(held) < len(labels) else held
    if len(set(labels[training])) < 2:
        training = np.arange(len(labels))
    share = float(labels[training].mean())
    given: list[dict[int, tuple[np.ndarray, int]]] = [{}, {}]

    def views() -> tuple[Logistic, ...]:
        out = []
        for view, own in enumerate(given):
            more = [x for x, _ in own.values()]
            x = np.vstack((features[training], *more)) if more else features[training]
            y = np.concatenate((labels[training], [label for _, label in own.values()]))
            out.append(fit(view_of(x, view), y.astype(float)))
        return tuple(out)

    for _ in range(ROUNDS):
        sure = ask(views())
        for teacher in (0, 1):
            pupil = given[1 - teacher]
            for label, part in ((0, 1 - share), (1, share)):
                new = [(number, x) for number, x in sure.get((teacher, label), []) if number not in pupil]
                pupil |= {number: (x, label) for number, x in new[: round(TAKEN * part)]}
    final = views()
    y = labels[held].astype(float)
    both = tuple(view_of(features[held], view) for view in (0, 1))
    calibrations = tuple(fit(v.odds(x)[:, None], y) for v, x in zip(final, both, strict=True))
    model = Model(final, calibrations, None, share)
    return Model(final, calibrations, fit(model.calibrated(both), y), share)


def view_of(features: np.ndarray, view: int) -> np.ndarray:
    """The columns of the text view (0) or of the metadata view (1)."""
    return features[:, TEXT_FEATURES:] if view else features[:, :TEXT_FEATURES]


def _narrow(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    return doc_columns(docs, doc_id, text, lang, source).select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).alias("text"),
        F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"),
    )


def features_of(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """doc_id, number (a hash of text, language and source) and features (32-bit floats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = bytes_of(batch.column("text"))
            for part in steps(texts):
                own = batch.slice(part.start, part.stop - part.start)
                langs, sources = (own.column(c).to_pylist() for c in ("lang", "source"))
                values = np.hstack((text_features(texts[part]), metadata_features(texts[part], langs, sources)))
                rows = pa.array([x.tobytes() for x in values.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("number"), rows], ["doc_id", "number", "features"])

    narrow = _narrow(docs, doc_id, text, lang, source).withColumn("number", F.xxhash64("text", "lang", "source"))
    return narrow.mapInArrow(run, "doc_id bigint, number bigint, features binary")


def surest(pool: DataFrame, views: tuple[Logistic, ...], most: int) -> dict[tuple[int, int], list[Sure]]:
    """Of all rows of the pool, the ``most`` that each view is surest to be bad and good, by teacher and label.

    Every row is scored. A task passes on its own surest ones, of equal documents one, and the surest of these are taken.
    """
    fitted = pool.sparkSession.sparkContext.broadcast(views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], dict[int, tuple[float, bytes]]] = {(t, y): {} for t in (0, 1) for y in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers, rows = batch.column("number").to_numpy(), batch.column("features").to_pylist()
            values = np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), -1).astype(np.float64)
            for (teacher, label), kept in best.items():
                odds = fitted.value[teacher].odds(view_of(values, teacher)) * (1 if label else -1)
                for k in np.flatnonzero(odds > SURE).tolist():
                    kept[int(numbers[k])] = (float(odds[k]), rows[k])
                if len(kept) > most:
                    first = sorted(kept, key=lambda n: (-kept[n][0], n))[:most]
                    best[teacher, label] = {n: kept[n] for n in first}
        out = [(t, y, n, odds, row) for (t, y), kept in best.items() for n, (odds, row) in kept.items()]
        if out:
            names = ["teacher", "label", "number", "odds", "features"]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    found = store(
        pool.select("number", "features").mapInArrow(
            run, "teacher int, label int, number bigint, odds double, features binary"
        ),
        "surest",
    )
    once = found.groupBy("teacher", "label", "number").agg(F.max("odds").alias("odds"), F.first("features").alias("features"))
    order = Window.partitionBy("teacher", "label").orderBy(F.col("odds").desc(), "number")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).orderBy("rank")
    out: dict[tuple[int, int], list[Sure]] = {}
    for r in ranked.collect():  # four lists of ``most`` rows
        row = np.frombuffer(r["features"], dtype=np.float32).astype(np.float64)
        out.setdefault((r["teacher"], r["label"]), []).append((r["number"], row))
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> Model:
    """The model from a bounded sample of labels, LABELLED documents of the smallest hashed ids, and all unlabelled rows.

    labels: doc_id and quality (1 good, 0 bad, anything else is no label); of several labels of an id the worst counts,
    and of several rows of an id one, that of the smallest hash. Features of all documents are stored once; each round
    scores all unlabelled ones. The driver gets features of the sample and of the surest rows only.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = F.col(doc_id).cast("bigint").alias("doc_id")
    known = labels.where("quality in (0, 1)").groupBy(ids).agg(F.min("quality").cast("int").alias("label"))
    known = store(known.where("doc_id is not null").orderBy(*order).limit(LABELLED), "labelled")
    every = store(features_of(docs, doc_id, text, lang, source), "features")
    one = every.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("number", "features")).alias("row"))
    sample = one.select("doc_id", "label", "row.features").collect()  # a row for each id
    sample.sort(key=lambda r: r["doc_id"])
    width = TEXT_FEATURES + METADATA_FEATURES
    values = np.frombuffer(b"".join(r["features"] for r in sample), dtype=np.float32)
    values = values.reshape(len(sample), width).astype(np.float64)
    marked = labels.select(ids).distinct()
    pool = every.join(marked, "doc_id", "left_anti")
    # a view may have been given its surest ones before; there are as many further ones behind them
    most = TAKEN * ROUNDS
    return co_train(values, np.array([r["label"] for r in sample], dtype=np.int64), lambda views: surest(pool, views, most))


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs with __text_score, __metadata_score (each view's calibrated probability) and __quality (the combined one).

    Every row is scored whole and keeps all its columns. A null text is empty, and a null language or source is a value
    of its own.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)
    names = ["__text_score", "__metadata_score", "__quality"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = weights.value
        for batch in batches:
            texts = bytes_of(batch.column(text))
            for part in steps(texts):
                own = batch.slice(part.start, part.stop - part.start)
                langs, sources = (own.column(c).cast(pa.string()).to_pylist() for c in (lang, source))
                features = text_features(texts[part]), metadata_features(texts[part], langs, sources)
                both = fitted.probability(features)
                each = [both, both]
                if fitted.combination is not None:
                    each = list((1 / (1 + np.exp(-np.clip(fitted.calibrated(features), -30, 30)))).T)
                columns = [*own.columns, *(pa.array(x) for x in (*each, both))]
                yield pa.RecordBatch.from_arrays(columns, [*own.schema.names, *names])

    fields = [*docs.schema.fields, *(StructField(n, DoubleType()) for n in names)]
    ship(docs.sparkSession)
    return docs.mapInArrow(run, StructType(fields))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents and score all."""
    return score(docs, train(docs, labels))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't rejected, whole and with their columns."""
    hidden = Hidden(docs)
    scored = score(hidden.docs, train(docs, labels), hidden["text"], hidden["lang"], hidden["source"])
    return hidden.restore(scored.where(F.col("__quality") >= THRESHOLD))
