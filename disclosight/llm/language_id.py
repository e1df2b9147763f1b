"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and cut into runs of letters; its subwords are all strings of 2 to 4 characters that lie
within a run or touch its borders. Each subword is hashed to a bucket, each bucket has a small vector, a
document is the mean of its vectors, and a linear layer with softmax gives the probability of each
language. Vectors and layer are trained together by stochastic gradient descent in numpy.

Training reads a bounded sample (``SAMPLE_PER_LANGUAGE`` documents per language, chosen by a hash of the id) of
the labelled documents that are not held out. The subword counts of the sample are taken where the documents
are; one task then fits the model. A fifth of the sample is kept from the fit to calibrate: a temperature is
chosen that gives it the least log loss, and the rejection level is set so that at most
``REJECT_SHARE`` of its rightly named documents would be rejected, and never above ``REJECT_BELOW``.

Because the layers are linear, vectors and layer multiply into one table (bucket x language). Prediction
covers every whole text and adds up table rows.

Defined cases: a NULL text or one without letters is ``und`` with score 0 and rejected; so is every document
if there was nothing to learn from (``accepted`` then rejects texts without letters only). A document without id is predicted but neither learned from nor held out. Repeated
rows are predicted each. Columns beyond id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, working_for

BUCKETS, DIM, SIZES = 1 << 16, 16, (2, 3, 4)
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 400, 256
EPOCHS, RATE, SEED = 12, 0.5, 7
REJECT_SHARE, REJECT_BELOW = 0.002, 0.5
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    """Languages, table of summands (bucket x language), bias, temperature, level below which to reject."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def subwords(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """``(document, bucket)`` arrays per subword size, and the number of subwords of each document."""
    texts = [(t or "").lower() for t in texts]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[points]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    kept[0] = True
    points = np.where(letter, points, 0)[kept].astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)[kept]
    parts, totals = [], np.zeros(len(texts), np.int64)
    running, inside = points, None
    for size in range(2, max(SIZES) + 1):
        if len(points) < size:
            break
        if size == 2:
            fine = (points[:-1] != 0) | (points[1:] != 0)
        else:
            middle = points[size - 2:-1] != 0
            inside = middle if inside is None else inside[:-1] & middle
            fine = inside
        running = running[:-1] * np.uint64(0x100000001B3) + points[size - 1:]
        if size not in SIZES:
            continue
        own = owner[size - 1:][fine]
        buckets = (((running[fine] + np.uint64(size)) * _MIX) >> np.uint64(48)).astype(np.int64)
        parts.append((own, buckets % BUCKETS))
        totals += np.bincount(own, minlength=len(texts))
    return parts, totals


def probabilities(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated probabilities (document x language) and which documents have a subword."""
    parts, totals = subwords(texts)
    logits = np.zeros((len(texts), len(model.languages)))
    for own, buckets in parts:
        for j in range(len(model.languages)):
            logits[:, j] += np.bincount(own, weights=model.table[j][buckets], minlength=len(texts))
    logits = (logits / np.maximum(totals, 1)[:, None] + model.bias) / model.temperature
    shares = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(texts) else logits
    return shares / shares.sum(axis=1, keepdims=True), totals > 0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]], dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Train on ``(language, buckets, counts)``; every fifth example calibrates."""
    languages = tuple(sorted({x[0] for x in examples}))
    number = {x: i for i, x in enumerate(languages)}
    # Every fifth of a language, so that each language can calibrate.
    calibrating, seen = [], dict.fromkeys(languages, 0)
    learning = []
    for language, buckets, counts in examples:
        seen[language] += 1
        (calibrating if seen[language] % 5 == 0 else learning).append((number[language], buckets, counts / counts.sum()))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    layer, bias = np.zeros((dim, len(languages))), np.zeros(len(languages))
    total, done = epochs * len(learning), 0
    for _ in range(epochs):
        for i in random.permutation(len(learning)):
            answer, buckets, share = learning[i]
            mean = share @ vectors[buckets]
            error = _softmax(mean @ layer + bias)
            error[answer] -= 1.0
            pace = rate * (1.0 - done / total)
            back = layer @ error
            layer -= pace * np.outer(mean, error)
            bias -= pace * 0.1 * error
            vectors[buckets] -= (pace * len(buckets) ** 0.5) * np.outer(share, back)
            done += 1
    table = np.ascontiguousarray((vectors @ layer).T)
    held = calibrating or learning
    logits = np.array([share @ table[:, buckets].T for _, buckets, share in held]) + bias
    answers = np.array([x[0] for x in held])

    def loss(temperature: float) -> float:
        return float(-np.log(_softmax(logits / temperature)[np.arange(len(answers)), answers] + 1e-12).mean())

    temperature = min((float(t) for t in np.geomspace(0.5, 20.0, 60)), key=loss)
    shares = _softmax(logits / temperature)
    right = shares.argmax(axis=1) == answers
    sure = np.sort(shares.max(axis=1)[right])
    level = float(sure[int(REJECT_SHARE * len(sure))]) if len(sure) else 0.0
    return Model(languages, table, bias, temperature, min(REJECT_BELOW, level))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    working_for("languages")
    for part in slices(batches, 64):
        parts, totals = subwords(part.column(2).to_pylist())
        owner = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        bucket = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        pairs, counts = np.unique(owner * BUCKETS + bucket, return_counts=True)
        bounds = np.searchsorted(pairs, np.arange(part.num_rows + 1) * BUCKETS)
        found = [i for i in range(part.num_rows) if bounds[i] < bounds[i + 1]]
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(found, pa.int64())), part.column(1).take(pa.array(found, pa.int64())),
             pa.array([(pairs[bounds[i]:bounds[i + 1]] % BUCKETS) for i in found], pa.list_(pa.int64())),
             pa.array([counts[bounds[i]:bounds[i + 1]] for i in found], pa.list_(pa.int64()))], ["doc_id", "lang", "buckets", "counts"])


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    working_for("languages")
    rows = []
    for part in batches:
        for i in range(part.num_rows):
            rows.append((part.column(0)[i].as_py(), part.column(1)[i].as_py(), part.column(2)[i].values.to_numpy(), part.column(3)[i].values.to_numpy()))
    if not rows:
        return
    rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
    model = fit([r[1:] for r in rows])
    yield pa.RecordBatch.from_arrays(
        [pa.array([list(model.languages)]), pa.array([model.table.astype("<f8").tobytes()], pa.binary()), pa.array([model.bias.tolist()]),
         pa.array([model.temperature]), pa.array([model.reject_below])], ["languages", "cells", "bias", "temperature", "reject_below"])


def id_remainder(divisor: int) -> Column:
    """``crc32(doc_id as text) mod divisor``; NULL without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def train(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """The model learned from a bounded sample of the labelled documents that are not held out."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(4) != 2)).select("doc_id", "lang", "text")
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return None
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    chosen = F.lit(False)
    for row in counts:
        chosen = chosen | ((F.col("lang") == row["lang"]) & (place < per_language / row["count"]))
    sample = usable.where(chosen).limit(2 * per_language * len(counts)).mapInArrow(_counts, "doc_id long, lang string, buckets array<long>, counts array<long>")
    found = sample.coalesce(1).mapInArrow(_fit_task, "languages array<string>, cells binary, bias array<double>, temperature double, reject_below double").collect()
    if not found:
        return None
    row = found[0]
    table = np.frombuffer(bytes(row["cells"]), "<f8").reshape(len(row["languages"]), BUCKETS)
    return Model(tuple(row["languages"]), table.astype(np.float32), np.array(row["bias"]), row["temperature"], row["reject_below"])


def accepted(model: Model | None, texts: list[str | None]) -> list[bool]:
    """Which texts are not rejected. Without a model only texts without letters are."""
    if model is None:
        return (subwords(texts)[1] > 0).tolist()
    shares, known = probabilities(model, texts)
    return (known & (shares.max(axis=1) >= model.reject_below)).tolist() if len(texts) else []


def _predictor(model: Model | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            if model is None:
                names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            else:
                shares, known = probabilities(model, texts)
                best, top = shares.argmax(axis=1), shares.max(axis=1)
                names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores, rejected = np.where(known, np.minimum(top, 1.0), 0.0), ~known | (top < model.reject_below)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                                             ["doc_id", "lang_pred", "score", "rejected"])
    return predict


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every document."""
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double, rejected boolean")


def identify(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Train and predict: ``(doc_id, held_out, lang_pred, score, rejected)``."""
    found = predict(documents, train(documents, per_language))
    return found.select("doc_id", F.coalesce(id_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
