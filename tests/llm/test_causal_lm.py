import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from disclosight.llm import causal_lm as lm

PATH = public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_base_columns(make_docs, prose):
    rows = [(i, prose(i, 5 + i)) for i in range(60)] + [(100, None), (101, ""), (None, prose(3, 9)), (102, "Ünï B\x1cC a\xa0b\x0bd"), (7, prose(7, 12)),
                                                        (103, prose(9, 20000)), (104, "rare1 rare2 " + prose(1, 30))]
    got = lm.score(make_docs(rows), PATH).collect()
    training = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in training for w in [*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None])) for i, t in rows)
    assert sorted((str(x.doc_id), x.n_tokens, x.n_known) for x in got) == want
    base = sorted(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*words(t), None]) for _, t in rows)
    assert sorted(x.base_score for x in got) == pytest.approx(base)
    for x in got:
        assert x.train_tokens == total and x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 10 == 0)
        assert x.score < 0 and math.isfinite(x.score)


def test_rare_words_take_the_same_way(make_docs, prose, monkeypatch):
    docs = make_docs([(i, prose(i, 40)) for i in range(30)])
    want = sorted((x.doc_id, x.n_known, round(x.base_score, 6)) for x in lm.score(docs, PATH).collect())
    monkeypatch.setattr(lm, "HEAD", 40)  # nearly all words are joined
    assert sorted((x.doc_id, x.n_known, round(x.base_score, 6)) for x in lm.score(docs, PATH).collect()) == want


def one_by_one(sequence, vocab, w):
    """Each id on its own, from its window."""
    total = 0.0
    rows = [lm.START] * (lm.CONTEXT + 1) + [int(vocab.inputs[i]) for i in sequence]
    for at, target in enumerate(sequence):
        start = at // lm.STRIDE * lm.STRIDE
        x = w["tokens"][rows[start:start + lm.WINDOW]].astype(np.float64)
        x = x + w["places"][:len(x)]
        here = at - start + lm.CONTEXT
        x = x[:here + 1]
        a = np.exp((x[here] @ w["q"]) @ (x @ w["k"]).T / lm.DIM ** 0.5)
        h = x[here] + (a / a.sum()) @ (x @ w["v"]) @ w["o"]
        z = h @ w["out"]
        total += z[vocab.classes[target]] - math.log(np.exp(z).sum()) + vocab.within[target]
    return total


def test_windows_score_every_id_once():
    r = np.random.default_rng(3)
    vocab = lm.vocabulary(r.integers(0, 50, lm.VOCABULARY).astype(float))
    w = lm.fresh_weights()
    sequences = [r.integers(0, lm.VOCABULARY, n) for n in (1, 2, lm.STRIDE - 1, lm.STRIDE, lm.STRIDE + 1, 100, 301)]
    got = lm.log_probabilities(sequences, vocab, w)
    assert got == pytest.approx([one_by_one(s, vocab, w) for s in sequences], rel=1e-4)
    assert lm.log_probabilities(sequences[::-1], vocab, w)[::-1] == pytest.approx(got)


def test_large_weights_stay_finite():
    r = np.random.default_rng(5)
    vocab = lm.vocabulary(r.integers(0, 50, lm.VOCABULARY).astype(float))
    w = {k: v * 60 for k, v in lm.fresh_weights().items()}
    assert np.isfinite(lm.log_probabilities([r.integers(0, lm.VOCABULARY, 500)], vocab, w)).all()


def test_probabilities_sum_to_one():
    vocab = lm.vocabulary(np.arange(lm.VOCABULARY, dtype=float) % 97)
    shares = np.bincount(vocab.classes, weights=np.exp(vocab.within), minlength=lm.CLASSES)
    assert shares == pytest.approx(np.ones(lm.CLASSES))


def test_gradients():
    r = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.fresh_weights().items()}
    inputs, targets = r.integers(0, 50, (2, lm.WINDOW)), r.integers(0, lm.CLASSES, (2, lm.STRIDE))
    weight = np.ones((2, lm.STRIDE))
    weight[1, 9:] = 0
    _, g = lm._gradients(w, inputs, targets, weight)
    for name in w:
        at = (int(inputs[0, 3]), 2) if name == "tokens" else tuple(int(r.integers(0, n)) for n in w[name].shape)
        sides = []
        for step in (1e-4, -1e-4):
            moved = {**w, name: w[name].copy()}
            moved[name][at] += step
            sides.append(lm._gradients(moved, inputs, targets, weight)[0])
        assert g[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-4, abs=1e-5)


def test_training_beats_counts():
    r = np.random.default_rng(1)
    chain = [np.array([int(x) % 20 for x in range(s, s + 90)]) for s in r.integers(0, 20, 80)]
    counts = np.bincount(np.concatenate(chain), minlength=lm.VOCABULARY).astype(float)
    vocab = lm.vocabulary(counts)
    w = lm.train(chain[:60], vocab, steps=150, batch=32)
    plain = sum(np.log(counts[s] / counts.sum()).sum() for s in chain[60:])
    assert lm.log_probabilities(chain[60:], vocab, w).sum() > 0.5 * plain


def test_empty_table(make_docs):
    assert lm.score(make_docs([]), PATH).count() == 0
    (row,) = lm.score(make_docs([(None, "a b")]), PATH).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.held_out) == (3, 0, 0, False)


def test_weights_come_from_all_documents(make_docs):
    """What most documents say is learned, though the documents with the smallest hashes say something else."""
    r = random.Random(4)
    names = ["red", "blue", "green", "white", "black", "gray", "pink", "gold"]
    ring = lambda start, n: " ".join(names[(start + i) % 8] for i in range(n))
    docs = make_docs([(i, "") for i in range(2600)])
    hashed = docs.select("doc_id", (F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)).alias("place")).collect()
    rows = [(x.doc_id, " ".join(r.choices(names, k=24)) if x.place < 0.5 else ring(x.doc_id, 24)) for x in hashed]
    docs = make_docs(rows)
    counts = lm.word_counts(docs)
    model = lm.learn(docs, PATH, counts)
    encode = lm.encoder(PATH)
    score = lambda text: lm.log_probabilities([lm.spelled(text.split(), encode)], model.vocab, model.weights)[0]
    assert score(ring(3, 24)) > 0.75 * score(" ".join(r.choices(names, k=24)))


def test_rounds_see_every_window_once(make_docs, prose, monkeypatch):
    rows = [(i, prose(i, 1 + 7 * i % 90)) for i in range(150)] + [(7, prose(7, 50))] * 300 + [(200, None), (201, "")]
    docs = make_docs(rows).repartition(5)
    encode, seen, add = lm.encoder(PATH), [], lm._add
    every = sum(-(-len(lm.spelled(words(t), encode)) // lm.STRIDE) for _, t in rows)
    monkeypatch.setattr(lm, "_add", lambda rows: seen.append(add(rows)[1]) or add(rows))
    vocab = lm.vocabulary(np.arange(lm.VOCABULARY, dtype=float) % 97)
    for first, rounds in ((100, 3), (every // 3, 2), (2 * every, 1)):
        monkeypatch.setattr(lm, "FIRST", first)
        monkeypatch.setattr(lm, "LEAST", 1)
        seen.clear()
        weights = lm.fit(docs, PATH, vocab, every)
        assert len(seen) == rounds and sum(seen) == every
        assert all(np.isfinite(w).all() and w.dtype == np.float32 and w.shape == lm._SHAPES[n] for n, w in weights.items())
    monkeypatch.setattr(lm, "LEAST", 4 * every)  # a short corpus is gone over several times
    seen.clear()
    lm.fit(docs, PATH, vocab, every)
    assert seen == [4 * every]


def test_sums_of_parts():
    """The means of the weights of several tasks, by the windows that they saw, whatever the order of the parts."""
    w = [lm.fresh_weights(seed) for seed in (1, 2, 3)]
    parts = [(i, 10 * i + 5, lm._packed({n: (10 * i + 5) * x.astype(np.float64) for n, x in v.items()}, "<f8")) for i, v in enumerate(w)]
    _, seen, cells = lm._add(parts[::-1])
    got = lm._unpacked(np.frombuffer(cells, "<f8") / seen)
    for n in got:
        assert got[n] == pytest.approx(sum((10 * i + 5) * v[n] for i, v in enumerate(w)) / 45, abs=1e-6)
