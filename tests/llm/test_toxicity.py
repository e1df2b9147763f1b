import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from disclosight.llm import toxicity as tox

BAD = "grub vile lout cad knave oaf".split()


def remainder(i):
    return zlib.crc32(str(i).encode()) % 3


@pytest.fixture(scope="module")
def corpus(prose):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(900):
        words = prose(i, r.randint(8, 80)).split()
        toxic = int(i % 6 == 0)
        for _ in range(r.randint(2, 5) * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD).upper() + "!")
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def frames(spark, make_docs, docs, labels):
    return make_docs(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "1 as n0", "2 as term")


def test_words():
    assert tox.terms_of("Ab-c AB c9 é É") == Counter({b"ab": 2, b"c": 1, b"c9": 1, "é".encode(): 1, "É".encode(): 1})
    assert tox.terms_of(None) == tox.terms_of("") == Counter()


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_are_exact(seed, monkeypatch):
    monkeypatch.setattr(tox, "BLOCK", 4)
    monkeypatch.setattr(tox, "BLOCKS_AT_ONCE", 2)
    r = random.Random(seed)
    words = [b"w%d" % i for i in range(30)]
    idf = {w: r.choice([0.0, 0.5, 1.0, r.random() * 4]) for w in words}
    rows = [(n, dict(Counter(r.choices(words, k=r.randint(1, 12))))) for n in range(150)]
    rows += [(150 + n, rows[n][1]) for n in range(20)]  # equal vectors
    index = tox.Index(idf, rows, np.array([r.randrange(2) for _ in rows], float))
    assert index.blocks == 43

    def plain(counts):
        v = {w: (1 + math.log(n)) * idf[w] for w, n in counts.items() if w in idf}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()} if length else {}

    for _ in range(60):
        query = Counter(r.choices([*words, b"unknown"], k=r.randint(0, 15)))
        q = plain(query)
        scores = [(round(sum(q[w] * x for w, x in plain(c).items() if w in q), 12), n) for n, c in rows]
        want = sorted((-s, n) for s, n in scores if s > 0)[:7]
        at, weight, _ = index.vector(query)
        best, cosines = index.nearest(at, weight, 7)
        assert [round(float(c), 9) for c in cosines] == [round(-s, 9) for s, _ in want]
        assert best.tolist() == [n for _, n in want]


def test_bounds_leave_blocks_out():
    rows = [(n, {b"t%d" % (n // 64): 3, b"common": 1}) for n in range(64 * 20)]
    idf = {b"common": 0.01} | {b"t%d" % i: 3.0 for i in range(20)}
    index = tox.Index(idf, rows, np.ones(len(rows)))
    looked = []
    index.example = type("Seen", (np.ndarray,), {"__getitem__": lambda s, i: looked.append(np.size(i)) or np.asarray(s)[i]})(
        index.example.shape, index.example.dtype, index.example.copy())
    best, _ = index.nearest(*index.vector({b"t7": 1, b"common": 1})[:2], 16)
    assert best.tolist() == list(range(7 * 64, 7 * 64 + 16)) and sum(looked) < len(rows) / 2


def test_held_out_accuracy_and_evidence(spark, make_docs, corpus):
    docs, labels = corpus
    extra = [(2000, None), (2001, ""), (None, "you grub you vile lout"), (2002, "zzz"), (2003, prose_of(docs, 1) * 300), (5, docs[5][1]), (5, docs[5][1])]
    frame, marks = frames(spark, make_docs, docs + extra, labels)
    got = tox.toxicity(frame, marks).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is not None and remainder(r["doc_id"]) == 1) for r in got)
    hits = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert len(held) > 200 and hits >= 0.97 * len(held)
    assert abs(sum(r["score"] for r in held) / len(held) - sum(truth[r["doc_id"]] for r in held) / len(held)) < 0.05  # calibrated
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in got if r["doc_id"] in (2000, 2001, 2002, 2003)}
    assert odd[2000]["score"] == odd[2001]["score"] == odd[2002]["score"] < 0.2 and odd[2000]["evidence"] == []
    assert next(r for r in got if r["doc_id"] is None)["predicted"] == 1
    for r in got:
        for e in r["evidence"]:
            assert remainder(e["doc_id"]) != 1 and truth[e["doc_id"]] == e["toxic"] and 0 < e["cosine"] <= 1 + 1e-9


def prose_of(docs, n):
    return docs[n][1] + " "


def test_only_the_learned_labels_matter(spark, make_docs, corpus):
    docs, labels = corpus
    turned = [(i, q, 1 - y if remainder(i) == 1 else y) for i, q, y in labels]
    results = [sorted((r["doc_id"], r["score"]) for r in tox.toxicity(*frames(spark, make_docs, docs, x), examples=100).collect()) for x in (labels, turned)]
    assert results[0] == results[1]


def test_sample_is_bounded_and_contradictions_are_left_out(spark, make_docs, corpus):
    docs, labels = corpus
    marks = labels + [(0, 1, 0), (None, 1, 1), (3, 1, None)] + [(6, 1, 1)] * 3
    frame, table = frames(spark, make_docs, docs, marks)
    sample = tox.sample_examples(frame, table, F.lit(True), 20).select("doc_id", "toxic").collect()
    assert Counter(r["toxic"] for r in sample) == {0: 20, 1: 20} and 0 not in {r["doc_id"] for r in sample}


def test_without_examples(spark, make_docs):
    frame, labels = frames(spark, make_docs, [(1, "a grub"), (2, None)], [(1, 1, 1)])
    scores = [r["score"] for r in tox.toxicity(frame, labels).collect()]
    assert scores[0] == scores[1] and scores[0] in (pytest.approx(0.75), pytest.approx(0.5))
    frame, labels = frames(spark, make_docs, [], [])
    assert tox.toxicity(frame, labels).count() == 0


def test_near_copies_are_one_example(spark, prose):
    text = prose(77, 60).split()
    edited = lambda n: " ".join(w if i != n else "changed" for i, w in enumerate(text))
    rows = [(i, edited(i), 1) for i in range(30, 50)] + [(i, prose(i, 40), 0) for i in range(100, 120)] + [(7, "", 0), (8, "", 0), (9, "one two", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    kept = sorted(r["doc_id"] for r in tox.without_near_copies(frame).collect())
    assert [i for i in kept if i >= 100] == list(range(100, 120)) and [i for i in kept if i < 30] == [7, 9]
    assert 30 in kept and len([i for i in kept if 30 <= i < 50]) <= 2
