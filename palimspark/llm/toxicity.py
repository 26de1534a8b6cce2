"""Toxicity by compression distance.

Two zstandard dictionaries share the same base, trained on ordinary text; the toxic one also holds segments
trained on toxic text. A text is cut into windows at word ends; the gain of a window is the number of bytes
by which it gets shorter under the toxic dictionary than under the ordinary one. Six numbers about a text's gains
(the largest, how many reach each of five thresholds) and its length go through a logistic curve whose
threshold is set on rows that the dictionaries haven't seen.

The toxic dictionary is trained on the telling words and word pairs of toxic texts' windows, not on whole windows: those
teach mostly ordinary text. A word or pair tells if its share of toxic training texts is MIN_RATIO times its
share of ordinary ones and its likelihood ratio reaches MIN_EVIDENCE, one rule for every size. Ordinary rows
that have it count against it and don't rule it out. Equal texts count once, and a word in no more texts than
it has different words before it (so that near copies of one toxic text don't teach their other words).

Fitting uses a bounded sample of labelled rows (MAX_TOXIC, MAX_ORDINARY, MAX_CHARS, chosen by a hash of the id);
scoring reads every text whole. Rows with crc32(doc_id as text) mod 3 = 1 are never learned from; rows with 0
train the dictionaries and rows with 2 the curve.

Defined results: null and empty texts have no window and the score of no gains; a null doc_id isn't held out
and never learned from; of contradicting labels the toxic one counts; without toxic or without ordinary
training rows every score is 0; repeated rows give repeated rows; an empty table gives an empty table; other
columns are passed through by ``with_toxicity``.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices

#: Bounds of the training sample: rows of each class for the dictionaries and again for the curve, and the
#: longest text that is taken into it.
MAX_TOXIC = 1500
MAX_ORDINARY = 5000
MAX_CHARS = 20_000
WINDOW_BYTES = 32
LEVEL = 3
BASE_BYTES = 16_384
TOXIC_BYTES = 8_192
#: Least likelihood ratio (G squared) and least ratio of shares of a word or pair that tells toxic texts.
MIN_EVIDENCE = 22.0
MIN_RATIO = 3.0
GAIN_STEPS = (3, 4, 5, 6, 7)
TOP_GAIN = 9
THRESHOLD = 0.7
PUNCTUATION = b".,;:!?\"'()[]{}*$%&#|<>"


class Model(NamedTuple):
    """Everything a task needs: 24 KB of dictionaries and a few numbers."""

    ordinary: bytes
    toxic: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def windows(text: str | None) -> list[bytes]:
    """The lower-cased text in parts of about WINDOW_BYTES, cut at spaces where there are any."""
    raw = text.lower().encode() if text else b""
    out, i, n = [], 0, len(raw)
    while i < n:
        j = i + WINDOW_BYTES
        if j < n:
            k = raw.find(b" ", j, j + WINDOW_BYTES)
            j = k if k > 0 else j + WINDOW_BYTES
        out.append(raw[i:j])
        i = j
    return out


def _compressor(dictionary: bytes):
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False).compress


class Gains:
    """Compressors of both dictionaries, made once per task."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self._ordinary, self._toxic = _compressor(ordinary), _compressor(toxic)

    def features(self, text: str | None) -> list[float]:
        parts = windows(text)
        gains = np.fromiter((len(self._ordinary(w)) - len(self._toxic(w)) for w in parts), dtype=np.int64, count=len(parts))
        top = min(int(gains.max()), TOP_GAIN) if parts else 0
        return [float(top), *(float(np.log1p((gains >= k).sum())) for k in GAIN_STEPS), float(np.log1p(len(parts)))]


def probability(model: Model, features: np.ndarray) -> np.ndarray:
    z = (features - np.array(model.mean)) / np.array(model.scale)
    w = np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z @ w[1:] + w[0], -500, 500)))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; too small a sample is its own dictionary."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _words(lowered: bytes) -> list[bytes]:
    return [w for part in lowered.split() if (w := part.strip(PUNCTUATION))]


def _grams(words: list[bytes], n: int) -> list[bytes]:
    return words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def evidence(toxic: int, n_toxic: int, ordinary: int, n_ordinary: int) -> float:
    """Likelihood ratio of two shares; 0 where the toxic one isn't MIN_RATIO times the other."""
    if toxic * n_ordinary < MIN_RATIO * (ordinary + 0.5) * n_toxic:
        return 0.0
    share = (toxic + ordinary) / (n_toxic + n_ordinary)
    return 2 * sum(k * math.log(k / (n * share)) for k, n in ((toxic, n_toxic), (ordinary, n_ordinary)) if k)


def telling_grams(toxic: list[str], ordinary: list[str], n: int) -> set[bytes]:
    """Runs of n words that tell toxic texts from ordinary ones."""
    toxic, ordinary = ([t.lower().encode() for t in dict.fromkeys(texts)] for texts in (toxic, ordinary))
    held = Counter(g for t in toxic for g in set(_grams(_words(t), n)))
    held = {g: k for g, k in held.items() if k > 1}
    before: dict[bytes, set[bytes]] = defaultdict(set)
    for text in toxic:
        own = _words(text)
        for left, gram in zip([b"", *own], _grams(own, n), strict=False):
            if gram in held:
                before[gram].add(left)
    against = Counter(g for t in ordinary for g in set(_grams(_words(t), n)) if g in held)
    return {g for g, k in held.items() if evidence(min(k, len(before[g])), len(toxic), against[g], len(ordinary)) >= MIN_EVIDENCE}


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    base = _dictionary([w for t in ordinary for w in windows(t)], BASE_BYTES)
    telling = [telling_grams(toxic, ordinary, n) for n in (1, 2)]
    samples = []
    for text in dict.fromkeys(toxic):
        for window in windows(text):
            own, covered = _words(window), set()
            for n, grams in enumerate(telling, 1):
                covered.update(j for i, g in enumerate(_grams(own, n)) if g in grams for j in range(i, i + n))
            if covered:
                samples.append(b" " + b" ".join(own[i] for i in sorted(covered)) + b" ")
    return base, base + _dictionary(samples, TOXIC_BYTES)


def fit_curve(features: np.ndarray, toxic: np.ndarray, penalty: float = 1.0) -> tuple[list[float], list[float], list[float]]:
    """Logistic regression by Newton steps, then shifted so that the best F0.5 on these rows lies at THRESHOLD.

    F0.5 weighs precision more than recall: clean documents should stay.
    """
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.c_[np.ones(len(features)), (features - mean) / scale]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - p) - penalty * np.r_[0, w[1:]]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), slope)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(toxic[order])
    ends = np.flatnonzero(np.r_[np.diff(z[order]) < 0, True])
    best = ends[np.argmax(1.25 * hits[ends] / (ends + 1 + 0.25 * toxic.sum()))]
    after = z[order[best + 1]] if best + 1 < len(z) else z[order[best]] - 1
    w[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - (z[order[best]] + after) / 2
    return mean.tolist(), scale.tolist(), w.tolist()


def _sample(labels: DataFrame, part: int) -> DataFrame:
    """Ids of at most MAX_TOXIC and MAX_ORDINARY rows of one part, by a hash of the id."""
    own = labels.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == part) & F.col("toxic").isNotNull())
    one = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda value, n: one.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return pick(1, MAX_TOXIC).unionByName(pick(0, MAX_ORDINARY))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); None without rows of both classes."""

    def rows(part: int) -> DataFrame:
        chosen = F.broadcast(_sample(labels.select("doc_id", "toxic"), part))  # bounded by MAX_TOXIC + MAX_ORDINARY
        texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.length("text") <= MAX_CHARS)
        return texts.join(chosen, "doc_id").select("doc_id", "toxic", "text")

    seen = sorted(((r["doc_id"], r["toxic"], r["text"]) for r in rows(0).collect()))
    toxic, ordinary = [t for _, y, t in seen if y], [t for _, y, t in seen if not y]
    if not toxic or not ordinary:
        return None
    ordinary_bytes, toxic_bytes = train_dictionaries(toxic, ordinary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(ordinary_bytes, toxic_bytes)
        for batch in batches:
            found = [gains.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "toxic", "features"])

    numbers = rows(2).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "text").mapInArrow(run, "doc_id long, toxic long, features array<double>")
    unseen = sorted((r["doc_id"], r["toxic"], r["features"]) for r in numbers.collect())
    y = np.array([t for _, t, _ in unseen], dtype=float)
    if not y.sum() or y.all():
        return None
    return Model(ordinary_bytes, toxic_bytes, *fit_curve(np.array([f for *_, f in unseen]), y))


def with_toxicity(docs: DataFrame, model: Model | None, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: the score of each whole text. Narrow."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(model.ordinary, model.toxic)
        for batch in batches:
            for part in slices(batch, text):
                found = np.array([gains.features(t) for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(probability(model, found))], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def judge_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = with_toxicity(own, fit(own, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    model = fit(docs, labels)
    return with_toxicity(docs, model, "_toxicity").filter(F.col("_toxicity") < THRESHOLD).drop("_toxicity")
