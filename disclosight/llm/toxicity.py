"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over a block-max inverted index.

The examples are a sample of labelled documents, at most ``EXAMPLES`` of each label, taken by a hash of the id. Copies and near copies
are no evidence of their own: an example goes if one with a smaller id shares a MinHash of word 5-grams with it. Terms are words that the labels tell apart beyond chance: the likelihood ratio of a word's presence against
the label must exceed what the best of as many unrelated words would reach, and it must change the odds of a label ``ODDS`` times (long
documents hold more of any word). Words are weighted by ``(1 + ln tf) * idf`` and
vectors have length one.

The index holds postings by term, cut into blocks of ``BLOCK`` examples, and for every term and block the largest weight. For a
document the largest weights bound the cosine of any example in a block; blocks are scored in order of their bounds
until the next bound is below the ``NEIGHBOURS``-th best cosine. So the neighbours are exact, ties going to the smaller position.

Neighbours vote with their cosines as weights (the closer, the more). A logistic curve over the vote and the length of the document's
TF-IDF vector, the amount of evidence, makes it a probability. It is fitted on each half of the examples against terms and index
of the other half, with examples weighted back to the share of their label among all labelled documents.

Defined cases: a NULL text is an empty one, and a text without a known term has no neighbours and the score that the curve gives to
no evidence. A document that labels mark as both is no example. Without examples of both labels every score is the
smoothed share of toxic labels (0.5 without any). Documents without id are scored but not learned from. Repeated rows are scored each.
Of documents only id and text are read, of labels id and mark.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle, slices

#: Bound of the sample: examples of each label. Neighbours that vote, examples of a block, blocks scored at a time.
EXAMPLES, NEIGHBOURS, BLOCK, BLOCKS_AT_ONCE = 4096, 16, 64, 4
#: Where a score counts as toxic, and the part of the chance level that a term must exceed.
TOXIC_FROM, STRICTNESS = 0.7, 0.8
#: Words of a shingle, and multipliers of the MinHashes that tell near copies (at a similarity of 0.8, 0.998 of them share one).
SHINGLE, MULTIPLIERS = 5, np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: How many times higher a term must make the odds of one of the labels.
ODDS = 4.0
#: A vote is taken against this much similarity to nothing.
DOUBT = 0.5
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> Counter:
    """How often each word occurs, as bytes: runs of digits, letters and anything beyond ASCII, with A-Z lowered."""
    return Counter(text.encode("utf-8", "surrogatepass").translate(_WORDS).split()) if text else Counter()


class Index:
    """Postings of example vectors with the largest weight of each term in each block."""

    def __init__(self, idf: dict[bytes, float], rows: list[tuple[int, dict[bytes, int]]], labels: np.ndarray):
        self.place = {t: n for n, t in enumerate(sorted(idf))}
        self.idf = np.array([idf[t] for t in sorted(idf)])
        self.labels, self.blocks = labels, -(-len(labels) // BLOCK)
        entries = [(at, example, weight) for example, counts in rows for at, weight in zip(*self.vector(counts)[:2])]
        entries.sort(key=lambda e: e[:2])
        term = np.array([e[0] for e in entries], np.int64)
        self.example = np.array([e[1] for e in entries], np.int64)
        self.weight = np.array([e[2] for e in entries], np.float64)
        cell = term * max(self.blocks, 1) + self.example // BLOCK
        cells = len(self.idf) * self.blocks
        self.start = np.searchsorted(cell, np.arange(cells + 1)).astype(np.int64)
        self.most = np.zeros(cells)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(len(self.idf), self.blocks)

    def vector(self, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Terms in order, weights of length one, and the length before."""
        known = sorted((self.place[t], n) for t, n in counts.items() if t in self.place)
        at = np.array([t for t, _ in known], np.int64)
        weight = np.array([1 + math.log(n) for _, n in known]) * self.idf[at]
        length = float(np.sqrt((weight * weight).sum()))
        return at, weight / length if length else weight, length

    def nearest(self, at: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples with the largest cosines above 0, and the cosines."""
        best, cosines = np.zeros(0, np.int64), np.zeros(0)
        if not len(at) or not self.blocks:
            return best, cosines
        bounds = weight @ self.most[at]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        for low in range(0, len(order), BLOCKS_AT_ONCE):
            # sums in another order may differ in the last digits
            if len(best) == k and bounds[order[low]] < cosines[-1] * (1 - 1e-9):
                break
            blocks = np.sort(order[low:low + BLOCKS_AT_ONCE])
            cell = (at[:, None] * self.blocks + blocks).ravel()
            first, size = self.start[cell], self.start[cell + 1] - self.start[cell]
            posting = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            found, where = np.unique(self.example[posting], return_inverse=True)
            scores = np.bincount(where, np.repeat(np.repeat(weight, len(blocks)), size) * self.weight[posting])
            best, cosines = np.concatenate([best, found]), np.concatenate([cosines, scores])
            kept = np.lexsort((best, -np.round(cosines, 12)))[:k]
            best, cosines = best[kept], cosines[kept]
        return best, cosines

    def vote(self, counts: dict[bytes, int], k: int = NEIGHBOURS) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Vote, length of the vector, neighbours and cosines."""
        at, weight, length = self.vector(counts)
        best, cosines = self.nearest(at, weight, k)
        return float((cosines * self.labels[best]).sum() / (cosines.sum() + DOUBT)), length, best, cosines


class Model(NamedTuple):
    index: Index | None
    examples: list[int]       # document ids of the examples
    curve: np.ndarray         # weights of 1, vote and ln(1 + length)
    share: float              # smoothed share of toxic labels


def _curve(votes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.stack([np.ones(len(votes)), votes, np.log1p(lengths)], 1)
    ridge, w = np.diag([1e-3, 1e-1, 1e-1]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weights * (p - labels)) + ridge @ w)
        w = w - np.clip(step, -3, 3)
    return w


def probability(model: Model, vote: float, length: float) -> float:
    z = float(np.dot(model.curve, (1.0, vote, math.log1p(length))))
    return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _distinguishing(present: Column, toxic: Column, n: int, n_toxic: int, level: float) -> Column:
    """Whether presence and label depend on each other: half the likelihood ratio statistic against ``level``, and the odds ratio."""
    clean, n_clean = present - toxic, n - n_toxic
    absent = F.lit(float(n)) - present
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    surprise = (part(toxic, present * n_toxic / n) + part(clean, present * n_clean / n)
                + part(n_toxic - toxic, absent * n_toxic / n) + part(n_clean - clean, absent * n_clean / n))
    odds = (toxic + 0.5) * (n_clean - clean + 0.5) / ((clean + 0.5) * (n_toxic - toxic + 0.5))
    return (surprise >= level) & ((odds >= ODDS) | (odds <= 1 / ODDS))


def sample_examples(documents: DataFrame, labels: DataFrame, usable: Column, examples: int) -> DataFrame:
    """``(doc_id, text, toxic)``: at most ``examples`` documents of each label; the work of choosing touches ids only."""
    marked = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable)
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
              .where(F.col("toxic") == F.col("_most")).select("doc_id", F.col("toxic").cast("int").alias("toxic")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.where("toxic = 1").orderBy(*order).limit(examples).unionByName(marked.where("toxic = 0").orderBy(*order).limit(examples))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    return own.join(F.broadcast(chosen), "doc_id")


def min_hashes(text: str) -> np.ndarray:
    """The smallest hash of the shingles for each multiplier; a text with fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[i:i + SHINGLE])) for i in range(n)), np.uint64, n)
    mixed = hashes[:, None] * MULTIPLIERS
    return (mixed ^ (mixed >> np.uint64(29))).min(0)


def _with_min_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 16):
        found = np.array([min_hashes(t) for t in part.column(1).to_pylist()], np.uint64).reshape(-1, len(MULTIPLIERS)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.ascontiguousarray(found[:, m])) for m in range(len(MULTIPLIERS)))],
                                         [*part.schema.names, *(f"m{m}" for m in range(len(MULTIPLIERS)))])


def without_near_copies(sample: DataFrame) -> DataFrame:
    """Examples that share no MinHash with one of a smaller id; a bounded number of rows."""
    names = [f"m{m}" for m in range(len(MULTIPLIERS))]
    hashed = sample.select("doc_id", "text", "toxic").mapInArrow(_with_min_hashes, f"doc_id long, text string, toxic int, {', '.join(f'{n} long' for n in names)}")
    first = [(F.min("doc_id").over(Window.partitionBy(n)) == F.col("doc_id")).alias(f"first_{n}") for n in names]
    kept = " and ".join(f"first_{n}" for n in names)
    # an id with several rows is one example
    return hashed.select("doc_id", "text", "toxic", *first).where(kept).groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("_x")).select("doc_id", "_x.*")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 16):
        found = [terms_of(t) for t in part.column(1).to_pylist()]
        size = [len(c) for c in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.asarray(part.column(0), np.int64), size)), pa.array(np.repeat(np.asarray(part.column(2), np.int32), size)),
             pa.array([t for c in found for t in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int32())],
            ["doc_id", "toxic", "term", "tf"])


def train(documents: DataFrame, labels: DataFrame, usable: Column, examples: int = EXAMPLES) -> Model:
    """Terms, index and curve of the sample. Counts of terms are Spark aggregates; only the distinguishing terms and
    their postings in the sample reach the driver."""
    counts = {r["toxic"]: r["n"] for r in labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    sample = settle(without_near_copies(sample_examples(documents, labels, usable, examples)), "toxicity-examples")
    people = {r["doc_id"]: (r["half"], r["toxic"]) for r in sample.select("doc_id", _half().alias("half"), "toxic").collect()}
    sizes = Counter(people.values())
    if not all(sizes[h, y] for h in (0, 1) for y in (0, 1)):
        return Model(None, [], np.array([math.log(share / (1 - share)), 0.0, 0.0]), share)
    terms = settle(sample.select("doc_id", "text", "toxic").mapInArrow(_count_terms, "doc_id long, toxic int, term binary, tf int"), "toxicity-terms")
    sums = terms.withColumn("half", _half()).groupBy("term").agg(*[
        F.count_if((F.col("half") == h) & (F.col("toxic") >= y)).cast("double").alias(f"{name}{h}") for h in (0, 1) for y, name in ((0, "n"), (1, "t"))])
    sums = sums.withColumn("n2", F.col("n0") + F.col("n1")).withColumn("t2", F.col("t0") + F.col("t1")).where("n2 >= 2")
    sums = settle(sums, "toxicity-sums")
    tested = sums.count()
    parts = {h: (sum(n for (g, _), n in sizes.items() if h in (2, g)), sum(n for (g, y), n in sizes.items() if y and h in (2, g))) for h in (0, 1, 2)}
    level = STRICTNESS * math.log(max(tested, 2))
    told = [_distinguishing(F.col(f"n{h}"), F.col(f"t{h}"), *parts[h], level).alias(f"told{h}") for h in (0, 1, 2)]
    vocabulary = sums.select("term", *told, "n0", "n1", "n2").where("told0 or told1 or told2").collect()
    wanted = sample.sparkSession.createDataFrame([(bytes(r["term"]),) for r in vocabulary], "term binary")
    vectors: dict[int, dict[bytes, int]] = {i: {} for i in people}
    for r in terms.join(wanted, "term", "left_semi").select("doc_id", "term", "tf").collect():
        vectors[r["doc_id"]][bytes(r["term"])] = r["tf"]

    def index(h: int) -> tuple[Index, list[int]]:
        idf = {bytes(r["term"]): math.log((1 + parts[h][0]) / (1 + r[f"n{h}"])) for r in vocabulary if r[f"told{h}"]}
        # examples of one label with common terms share blocks, so that the bounds are tight
        head = {i: (people[i][1], min(sorted(t for t in vectors[i] if t in idf), default=b"")) for i in people if h in (2, people[i][0])}
        ids = [i for i in sorted(head, key=lambda i: (head[i], i)) if any(t in idf for t in vectors[i])]
        return Index(idf, [(n, vectors[i]) for n, i in enumerate(ids)], np.array([people[i][1] for i in ids], np.float64)), ids

    halves = {h: index(1 - h)[0] for h in (0, 1)}
    ids = sorted(people)
    seen = np.array([halves[people[i][0]].vote(vectors[i])[:2] for i in ids])
    marks = np.array([people[i][1] for i in ids], np.float64)
    sampled = {y: max(1.0, float((marks == y).sum())) for y in (0, 1)}
    weight = np.array([counts.get(int(y), 0) / sampled[int(y)] for y in marks])
    own, examples_of = index(2)
    return Model(own, examples_of, _curve(seen[:, 0], seen[:, 1], marks, weight / max(weight.mean(), 1e-9)), share)


def _half() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")


_SCORED = "doc_id long, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"


def score(documents: DataFrame, model: Model, shown: int = 3) -> DataFrame:
    """``(doc_id, score, predicted, evidence)`` of every document; the evidence are its ``shown`` nearest examples."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = probability(model, 0.0, 0.0)
        for part in slices(batches):
            scores, evidence = [], []
            for text in part.column(1).to_pylist():
                counts = terms_of(text)
                vote, length, best, cosines = model.index.vote(counts) if model.index is not None else (0.0, 0.0, (), ())
                scores.append(probability(model, vote, length) if len(best) else nothing)
                evidence.append([{"doc_id": model.examples[b], "cosine": float(c), "toxic": int(model.index.labels[b])} for b, c in list(zip(best, cosines))[:shown]])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= TOXIC_FROM) for s in scores], pa.int32()),
                 pa.array(evidence, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))],
                ["doc_id", "score", "predicted", "evidence"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, _SCORED)


def remainder(divisor: int) -> Column:
    """``crc32(doc_id as text) mod divisor``; NULL without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def toxicity(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)``: a third of the ids is held out, their labels are not learned from."""
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    scored = score(documents, train(documents, labels, remainder(3) != 1, examples))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")
