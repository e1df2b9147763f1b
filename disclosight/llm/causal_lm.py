"""Language-model scores from a small causal self-attention model trained in numpy on subword ids.

Words (A-Z lowered) are spelled in the ids of a public byte-level BPE file; a text ends with one end id. The model
has one layer of masked self-attention over windows of ``WINDOW`` ids and predicts the next id in two steps: its
class by a softmax on the attention output, and the id within its class by the counts of the corpus.
Frequent ids are classes of their own; the others share classes of about equal mass. Windows overlap:
each begins ``STRIDE`` ids after the last one and scores only its last ``STRIDE`` ids, so every id is
scored once, with at least ``WINDOW - STRIDE`` ids of context (start symbols before the text begins).

What comes from where: word counts, id counts, classes and the weights of the attention layer come from *all* training
documents; every window of every one of them is in a batch. Training goes in rounds over parts of the documents by a hash of
the id: the first round sees about ``FIRST`` windows, the next one goes up to an eighth of all, the last one sees all others. In a
round each task goes on from the same weights over the documents of its partition, and the means of the results, by the
windows that they saw, are the weights of the next round. A corpus of fewer than ``LEAST`` windows is gone over several times.
Which documents are trained on together follows the partitions of the table, so scores depend on them a little.

The base score is a smoothed unigram score over words. Words that hold at least 1 / ``HEAD`` of all training
tokens (there can be at most ``HEAD`` of them) are sent to every task; counts of all other words are joined by
word, so no table that grows with the corpus is sent anywhere.

Defined cases: a NULL text is empty and has the end as its only token; a document without id is scored but not
learned from, and not held out; repeated rows are scored each and all learned from; without training documents the base
score uses zero counts and the model is untrained. Columns beyond id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_words, settle, slices
from .subwords import encoder

WINDOW, STRIDE, DIM, CLASSES, OWN_CLASSES, OWN_INPUTS, SHARED_INPUTS = 24, 16, 16, 96, 64, 1023, 256
FIRST, LEAST, BATCH, RATE, SEED, AT_ONCE = 200_000, 96_000, 128, 0.01, 11, 128
#: Parts of the documents that the rounds end at, after the first one, the pace at which each round begins, and the last pace.
ROUNDS, PACES, LAST_PACE = (0.125, 1.0), (1.0, 0.3, 0.1), 0.02
VOCABULARY, HEAD, HELD_OUT, SMOOTH = 50257, 500_000, 10, 0.1
END, MOST_COUNTED = VOCABULARY - 1, 250_000


class Vocabulary(NamedTuple):
    """For each id: its row of the input table, its class, and its log probability within the class."""

    inputs: np.ndarray
    classes: np.ndarray
    within: np.ndarray


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """Classes and input rows by the counts of all training documents."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    inputs = np.where(rank < OWN_INPUTS, rank, OWN_INPUTS + np.arange(len(counts)) % SHARED_INPUTS)
    mass = np.cumsum(counts[order][OWN_CLASSES:] + SMOOTH)
    shared = np.minimum((mass / mass[-1] * (CLASSES - OWN_CLASSES)).astype(np.int64), CLASSES - OWN_CLASSES - 1)
    classes = np.empty(len(counts), np.int64)
    classes[order] = np.concatenate([np.arange(OWN_CLASSES), OWN_CLASSES + shared])
    smooth = counts + SMOOTH
    within = np.log(smooth / np.bincount(classes, weights=smooth, minlength=CLASSES)[classes])
    return Vocabulary(inputs.astype(np.int32), classes.astype(np.int32), within)


START, CONTEXT = OWN_INPUTS + SHARED_INPUTS, WINDOW - STRIDE
_SHAPES = {"tokens": (START + 1, DIM), "places": (WINDOW, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "o": (DIM, DIM),
           "out": (DIM, CLASSES)}
#: A place sees itself and what is before it.
_PAST = np.tril(np.ones((STRIDE, WINDOW), np.float32), CONTEXT)


def fresh_weights(seed: int = SEED) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    return {n: random.normal(0, 0.1 if n in ("tokens", "places") else DIM ** -0.5, s).astype(np.float32) for n, s in _SHAPES.items()}


def _gradients(w: dict[str, np.ndarray], inputs: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of masked attention over a batch of windows, for their last ``STRIDE`` places; ``weight`` is 0 for padding.

    inputs: (windows, WINDOW) rows of the input table. Products over all places are taken at once, keys and values together.
    """
    kind, count = w["q"].dtype, len(inputs)
    scale = kind.type(DIM ** -0.5)
    x = w["tokens"].take(inputs, axis=0)
    x += w["places"]
    every, own = x.reshape(-1, DIM), np.ascontiguousarray(x[:, CONTEXT:]).reshape(-1, DIM)
    to_kv = np.concatenate([w["k"], w["v"]], axis=1)
    kv = (every @ to_kv).reshape(count, WINDOW, 2 * DIM)
    k, v = (np.ascontiguousarray(part) for part in (kv[..., :DIM], kv[..., DIM:]))
    q = (own @ (w["q"] * scale)).reshape(count, STRIDE, DIM)
    a = q @ k.transpose(0, 2, 1)
    np.clip(a, -60.0, 60.0, out=a)
    np.exp(a, out=a)
    a *= _PAST
    a /= a @ np.ones((WINDOW, 1), kind)
    c = (a @ v).reshape(-1, DIM)
    h = own + c @ w["o"]
    p = h @ w["out"]
    np.clip(p, -60.0, 60.0, out=p)
    np.exp(p, out=p)
    sums = p @ np.ones(CLASSES, kind)
    rows, targets, weight = np.arange(len(p)), targets.ravel(), weight.ravel()
    total = max(1.0, float(weight.sum()))
    loss = float(-(np.log(p[rows, targets] / sums + 1e-12) * weight).sum() / total)
    share = (weight / total).astype(kind)
    p *= (share / sums)[:, None]
    p[rows, targets] -= share
    g = {"out": h.T @ p}
    dh = p @ w["out"].T
    g["o"] = c.T @ dh
    flat_dc = dh @ w["o"].T
    dc = flat_dc.reshape(count, STRIDE, DIM)
    ds = dc @ v.transpose(0, 2, 1)
    ds -= (flat_dc * c).sum(axis=1).reshape(count, STRIDE, 1)
    ds *= a
    dq = (ds @ k).reshape(-1, DIM) * scale
    dkv = np.empty((count, WINDOW, 2 * DIM), kind)
    np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :DIM])
    np.matmul(a.transpose(0, 2, 1), dc, out=dkv[..., DIM:])
    dkv = dkv.reshape(-1, 2 * DIM)
    both = every.T @ dkv
    g |= {"q": own.T @ dq, "k": both[:, :DIM], "v": both[:, DIM:]}
    dx = (dkv @ to_kv.T).reshape(count, WINDOW, DIM)
    dx[:, CONTEXT:] += (dh + dq @ w["q"].T).reshape(count, STRIDE, DIM)
    g["places"] = dx.sum(axis=0)
    cells = (inputs.reshape(-1, 1) * DIM + np.arange(DIM)).ravel()
    g["tokens"] = np.bincount(cells, weights=dx.ravel(), minlength=w["tokens"].size).reshape(w["tokens"].shape).astype(kind)
    return loss, g


class Layout(NamedTuple):
    """Windows over whole sequences. Window ``i`` scores the ids at ``place[i]`` to ``place[i] + STRIDE`` of ``flat``, as far
    as ``left[i]`` reaches; the rows of its inputs begin at the same place of ``before``, which holds for each
    sequence ``CONTEXT`` start rows, one more for the first id, and the rows of its ids."""

    flat: np.ndarray
    before: np.ndarray
    place: np.ndarray
    source: np.ndarray
    left: np.ndarray
    owner: np.ndarray


def laid_out(sequences: list[np.ndarray], vocab: Vocabulary) -> Layout:
    lengths = np.array([len(s) for s in sequences], np.int64)
    count = -(-lengths // STRIDE)
    owner = np.repeat(np.arange(len(lengths)), count)
    start = STRIDE * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    flat = np.concatenate([*sequences, np.zeros(STRIDE, np.int64)])
    first = np.cumsum(lengths) - lengths
    gap = CONTEXT + 1
    before = np.full(lengths.sum() + len(lengths) * gap + WINDOW, START, np.int32)
    shift = np.repeat(gap * np.arange(1, len(lengths) + 1), lengths)
    before[np.arange(lengths.sum()) + shift] = vocab.inputs[flat[:lengths.sum()]]
    return Layout(flat, before, first[owner] + start, first[owner] + gap * owner + start, lengths[owner] - start, owner)


class Adam:
    """Weights and what Adam remembers of their gradients; the pace falls from ``begin`` to ``end`` over ``windows`` windows."""

    def __init__(self, weights: dict[str, np.ndarray], windows: float, begin: float = RATE, end: float = 0.0, seed: int = SEED):
        self.weights, self.windows, self.begin, self.end = {n: x.copy() for n, x in weights.items()}, max(1.0, windows), begin, end
        self.mean, self.square = ({n: np.zeros_like(x) for n, x in weights.items()} for _ in range(2))
        self.random, self.step, self.seen = np.random.default_rng(seed), 0, 0

    def learn(self, lay: Layout, chosen: np.ndarray, vocab: Vocabulary) -> None:
        """One step, from the chosen windows."""
        span = np.arange(STRIDE)
        weight = (span < lay.left[chosen, None]).astype(np.float32)
        _, g = _gradients(self.weights, lay.before[lay.source[chosen, None] + np.arange(WINDOW)], vocab.classes[lay.flat[lay.place[chosen, None] + span]], weight)
        pace = self.begin + (self.end - self.begin) * min(1.0, self.seen / self.windows)
        self.step, self.seen = self.step + 1, self.seen + len(chosen)
        for n, w in self.weights.items():
            self.mean[n] += 0.1 * (g[n] - self.mean[n])
            self.square[n] += 0.01 * (g[n] ** 2 - self.square[n])
            w -= (pace * (self.mean[n] / (1 - 0.9 ** self.step)) / (np.sqrt(self.square[n] / (1 - 0.99 ** self.step)) + 1e-8)).astype(np.float32)


def go_over(sequences: list[np.ndarray], vocab: Vocabulary, adam: Adam, windows: int | None = None, batch: int = BATCH) -> None:
    """Steps over all windows of the sequences in random order; over ``windows`` of them, none twice before all were seen."""
    sequences = [s for s in sequences if len(s)]
    if not sequences:
        return
    lay = laid_out(sequences, vocab)
    count = len(lay.place)
    windows = count if windows is None else windows
    order = np.concatenate([adam.random.permutation(count) for _ in range(-(-windows // count))])[:windows]
    for low in range(0, windows, batch):
        adam.learn(lay, order[low:low + batch], vocab)


def train(sequences: list[np.ndarray], vocab: Vocabulary, steps: int = LEAST // BATCH, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> dict[str, np.ndarray]:
    """Attention weights fitted to the sequences alone, in a number of steps."""
    adam = Adam(fresh_weights(seed), steps * batch, rate, 0.0, seed)
    go_over(sequences, vocab, adam, steps * batch, batch)
    return adam.weights


def _window_scores(lay: Layout, part: slice, vocab: Vocabulary, w: dict[str, np.ndarray], bound: float) -> np.ndarray:
    """Log probabilities of the ids that some windows score, 0 beyond the end of a sequence.

    The same attention as in training, written for few passes over memory. Without a ``bound`` on the exponents a
    window may overflow, which shows as a value that is not finite.
    """
    span = np.arange(STRIDE)
    x = w["tokens"].take(lay.before[lay.source[part, None] + np.arange(WINDOW)], axis=0)
    x += w["places"]
    count, own = len(x), x[:, CONTEXT:]
    kv = (x.reshape(-1, DIM) @ w["kv"]).reshape(count, WINDOW, 2 * DIM)
    q = (np.ascontiguousarray(own).reshape(-1, DIM) @ w["scaled_q"]).reshape(count, STRIDE, DIM)
    a = q @ kv[:, :, :DIM].transpose(0, 2, 1)
    if bound < np.inf:
        np.clip(a, -bound, bound, out=a)
    np.exp(a, out=a)
    a *= _PAST
    c = a @ kv[:, :, DIM:]
    c /= a @ np.ones((WINDOW, 1), a.dtype)
    z = (own + (c.reshape(-1, DIM) @ w["o"]).reshape(count, STRIDE, DIM)).reshape(-1, DIM) @ w["out"]
    if bound < np.inf:
        np.clip(z, -bound, bound, out=z)
    at = np.minimum(lay.place[part, None] + span, len(lay.flat) - 1).ravel()
    targets = lay.flat[at]
    picked = z[np.arange(len(z)), vocab.classes[targets]] + vocab.within[targets]
    np.exp(z, out=z)
    return np.where((span < lay.left[part, None]).ravel(), picked - np.log(z @ np.ones(CLASSES, np.float32)), 0.0)


def log_probabilities(sequences: list[np.ndarray], vocab: Vocabulary, w: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log probability of each sequence; every id is scored once."""
    result = np.zeros(len(sequences))
    if not sequences:
        return result
    lay = laid_out(sequences, vocab)
    w = {**w, "kv": np.concatenate([w["k"], w["v"]], axis=1), "scaled_q": w["q"] * np.float32(DIM ** -0.5)}
    for low in range(0, len(lay.place), AT_ONCE):
        part = slice(low, low + AT_ONCE)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            scores = _window_scores(lay, part, vocab, w, np.inf)
        if not np.isfinite(scores).all():
            scores = _window_scores(lay, part, vocab, w, 60.0)
        result += np.bincount(np.repeat(lay.owner[part], STRIDE), weights=scores, minlength=len(sequences))
    return result


def spelled(words: list[str], encode) -> np.ndarray:
    """The ids of the words of a text and the end id."""
    return np.append(np.frombuffer(b"".join(map(encode.__getitem__, words)), "<u4").astype(np.int64), END)


def id_remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
        counts.clear()
        return batch

    for part in slices(batches):
        for text in part.column(0).to_pylist():
            counts.update(lower_words(text))
        if len(counts) > MOST_COUNTED:
            yield flush()
    if counts:
        yield flush()


def word_counts(documents: DataFrame) -> DataFrame:
    """``(word, c)`` over the whole texts of ``documents``."""
    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _count_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, total = encoder(path), np.zeros(VOCABULARY)
        for part in slices(batches, 4096):
            ids = [np.frombuffer(encode[w], "<u4") for w in part.column(0).to_pylist()]
            if ids:
                total += np.bincount(np.concatenate(ids), weights=np.repeat(part.column(1).to_numpy(), [len(i) for i in ids]), minlength=VOCABULARY)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["id", "c"])
    return run


def _packed(weights: dict[str, np.ndarray], kind: str) -> bytes:
    return np.concatenate([weights[n].ravel() for n in _SHAPES]).astype(kind).tobytes()


def _unpacked(cells: np.ndarray) -> dict[str, np.ndarray]:
    ends = np.cumsum([math.prod(s) for s in _SHAPES.values()])
    return {n: part.reshape(s).astype(np.float32) for (n, s), part in zip(_SHAPES.items(), np.split(cells, ends[:-1]))}


_PARTS = "task int, windows long, cells binary"


def _parts(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["task", "windows", "cells"])


def _train_task(path: str, vocab: Vocabulary, weights: dict[str, np.ndarray], windows: float, passes: int, pace: tuple[float, float]):
    """Go on from ``weights`` over all documents of a partition; the weights come times the windows that they saw.

    Texts are read piece by piece. Only a corpus that is gone over several times is held, which is short.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, adam = encoder(path), Adam(weights, windows * passes, RATE * pace[0], RATE * pace[1])
        held: list[np.ndarray] = []
        for part in slices(batches):
            held += [spelled(lower_words(t), encode) for t in part.column(0).to_pylist()]
            if passes == 1:
                go_over(held, vocab, adam)
                held = []
        if held:
            go_over(held, vocab, adam, passes * sum(-(-len(s) // STRIDE) for s in held))
        if adam.seen:
            yield _parts([(TaskContext.get().partitionId(), adam.seen, _packed({n: adam.seen * x.astype(np.float64) for n, x in adam.weights.items()}, "<f8"))])
    return run


def _add(rows: list[tuple[int, int, bytes]]) -> tuple[int, int, bytes]:
    """The sum of some parts, always in the same order."""
    rows = sorted(rows, key=lambda r: r[0])
    return rows[0][0], sum(r[1] for r in rows), sum((np.frombuffer(r[2], "<f8") for r in rows), np.zeros(1)).tobytes()


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
    if rows:
        yield _parts([_add(rows)])


def fit(documents: DataFrame, path: str, vocab: Vocabulary, windows: float) -> dict[str, np.ndarray]:
    """Attention weights from all windows of ``documents``, of which there are about ``windows``."""
    facts = documents.select(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("p")).alias("p")).first()
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    passes = max(1, math.ceil(LEAST / max(1.0, windows)))
    weights, low = fresh_weights(), 0.0
    for number, high in enumerate((FIRST / windows if passes == 1 else 1.0, *ROUNDS)):
        if high <= low:
            continue
        chosen, tasks = documents.where((place >= low) & (place < high)), max(1, facts["p"])
        share, low = min(1.0, high) - low, high
        if number == 0:  # seen by one task, but where many rows have one id
            tasks = max(1, int(chosen.count() / max(1.0, 2 * share * facts["n"])))
            chosen = chosen.repartition(tasks)
        pace = PACES[number], LAST_PACE if high >= 1 else PACES[number + 1]
        stepped = chosen.select("text").mapInArrow(_train_task(path, vocab, weights, windows * share / tasks, passes, pace), _PARTS)
        parts = [tuple(r) for r in stepped.repartition(math.isqrt(tasks) + 1, "task").mapInArrow(_add_parts, _PARTS).collect()]
        if parts:
            _, seen, cells = _add(parts)
            weights = _unpacked(np.frombuffer(cells, "<f8") / seen)
    return weights


class LanguageModel(NamedTuple):
    """Everything a task needs to score a text, all of bounded size, and the two corpus totals."""

    path: str
    vocab: Vocabulary
    weights: dict[str, np.ndarray]
    head: dict[str, int]
    tokens: int
    kinds: int
    ends: int


def learn(documents: DataFrame, path: str, counts: DataFrame) -> LanguageModel:
    """Fit the model; ``documents`` are the training documents, ``counts`` their stored word counts."""
    ends = documents.count()
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    ids = counts.mapInArrow(_count_ids(path), "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    by_id = np.zeros(VOCABULARY)
    by_id[[r["id"] for r in ids]] = [r["c"] for r in ids]
    by_id[END] += ends
    vocab = vocabulary(by_id)
    head = {r["word"]: r["c"] for r in counts.where(F.col("c") * HEAD >= tokens).collect()}
    weights = fit(documents, path, vocab, by_id.sum() / STRIDE + ends / 2)
    return LanguageModel(path, vocab, weights, head, tokens, kinds, ends)


def _scorer(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model.path)
        gain = {w: math.log10(c + SMOOTH) for w, c in model.head.items()}
        end_gain, end_known = math.log10(model.ends + SMOOTH), int(model.ends > 0)
        for part in slices(batches):
            sequences, rows = [], []
            for text in part.column(1).to_pylist():
                words = lower_words(text)
                sequences.append(spelled(words, encode))
                found = list(map(gain.get, words))
                tail: Counter[str] = Counter(w for w, g in zip(words, found) if g is None)
                known = [g for g in found if g is not None]
                rows.append((len(words) + 1, len(known) + end_known, math.fsum(known) + end_gain, list(tail), list(tail.values())))
            scores = log_probabilities(sequences, model.vocab, model.weights) / math.log(10)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), pa.array(scores)],
                                             ["doc_id", "n_tokens", "known", "gain", "tail", "times", "score"])
    return run


def score(documents: DataFrame, path: str) -> DataFrame:
    """Base and model scores of every document."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = texts.where(id_remainder(HELD_OUT) != 0)
    counts = settle(word_counts(training), "lm-words")
    model = learn(training, path, counts)
    scored = texts.mapInArrow(_scorer(model), "doc_id long, n_tokens long, known long, gain double, tail array<string>, times array<long>, score double")
    scored = settle(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    c = F.coalesce("c", F.lit(0).cast("long"))
    joined = rare.join(counts, "word", "left").select("row", F.when(c > 0, F.col("times")).otherwise(F.lit(0).cast("long")).alias("known"),
                                                      (F.col("times") * F.log10(c + F.lit(SMOOTH))).alias("gain"))
    none = F.lit(None)
    parts = joined.groupBy("row").agg(F.sum("known").alias("known"), F.sum("gain").alias("gain")).select(
        "row", none.cast("long").alias("doc_id"), none.cast("long").alias("n_tokens"), "known", "gain", none.cast("double").alias("score"))
    whole = scored.select("row", "doc_id", "n_tokens", "known", "gain", "score").union(parts)
    summed = whole.groupBy("row").agg(*(F.max(n).alias(n) for n in ("doc_id", "n_tokens", "score")), *(F.sum(n).alias(n) for n in ("known", "gain")))
    rest = math.log10(model.tokens + SMOOTH * (model.kinds + 1))
    return summed.select(
        "doc_id", F.coalesce(id_remainder(HELD_OUT) == 0, F.lit(False)).alias("held_out"), "n_tokens", F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("gain") - F.col("n_tokens") * F.lit(rest)).alias("base_score"), "score")
