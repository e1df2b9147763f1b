import functools
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from disclosight.llm import piece_scan

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "the and in re  \n\té一ﬁ▁.,aZ09\x00😀preprocessing  "


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids(data):
    return np.frombuffer(bytes(data), "<u4").tolist()


def samples(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        kind = r.random()
        if kind < 0.5:
            yield "".join(r.choice(LETTERS) for _ in range(r.randint(0, 120)))
        elif kind < 0.75:
            yield "".join(r.choice("abcdetrionsl") for _ in range(r.randint(1, 200)))
        else:
            yield "".join(r.choice(["  ", "   ", " ", "\n", "the", "ing", "re", "x", "一", "é"]) for _ in range(r.randint(1, 80)))


def test_equals_the_library(library):
    p = piece_scan.pieces(PATH)
    for text in samples(1500, 1):
        got = p.encode(text)
        assert ids(got) == library.encode(text), text
        assert p.decode(got) == text.replace("▁", " ")


def test_chunks_equal_the_whole(library):
    p, r = piece_scan.pieces(PATH), random.Random(2)
    for text in samples(500, 3):
        if not text:
            continue
        spaced, size = " " + text.replace("▁", " "), r.choice([17, 20, 33, 64])
        at, context = piece_scan.borders(spaced, size), 2 * p.longest
        chunks = [piece_scan.Chunk(p, spaced[max(0, a - context):a], spaced[a:b], spaced[b:b + 1]) for a, b in zip(at, at[1:])]
        matrices = [c.matrix() for c in chunks]
        states = piece_scan.settle_states(matrices, "0:", "0:")
        assert ids(b"".join(c.ids(*s) for c, s in zip(chunks, states))) == library.encode(text), (size, text)
        if len(matrices) > 2:  # the product is associative
            left = functools.reduce(piece_scan.compose, matrices)
            right = functools.reduce(lambda b, a: piece_scan.compose(a, b), matrices[::-1])
            assert left[:2] == right[:2] and (left[2] == right[2]).all()


def test_spark_scan_over_several_levels(library, make_docs, prose):
    rows = [(1, prose(1, 900)), (2, None), (3, ""), (None, "  x  "), (4, "ab" * 2000), (4, "ab" * 2000), (5, "e" * 3000 + " end  "), (6, prose(2, 20))]
    want = sorted((str(i), library.encode(t or "")) for i, t in rows)
    for size in ({}, {"giant": 200, "chunk": 40}):
        coded = piece_scan.encode(make_docs(rows), PATH, **size)
        assert sorted((str(x.doc_id), ids(x.ids)) for x in coded.collect()) == want
        back = sorted((str(x.doc_id), x.text) for x in piece_scan.decode(coded, PATH).collect())
        assert back == sorted((str(i), t or "") for i, t in rows)
    digest = piece_scan.encode(make_docs(rows), PATH, digest=True, giant=200, chunk=40).collect()
    assert sorted((str(x.doc_id), x.n_ids) for x in digest) == sorted((i, len(x)) for i, x in want) and all(x.round_trip for x in digest)


def test_empty_table(make_docs):
    assert piece_scan.encode(make_docs([]), PATH).count() == 0


def test_unigram_weights():
    """With scores as log probabilities the best path is the one of least cost, chunked or not."""
    p = piece_scan.Pieces(PATH)
    p.merges = False
    r = random.Random(9)
    table = {x: -r.uniform(1, 9) - 0.5 for x in ["a", "b", "c", " ", "ab", "bc", "abc", "ca", " a", "cab"]}
    p.ids, p.scores = {x: i for i, x in enumerate(table)}, table
    p.letters, p.longest = set("abc "), 3

    def best(text):
        cost = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            cost[end] = max(cost[s] + table[text[s:end]] for s in range(max(0, end - 3), end) if text[s:end] in table)
        return cost[-1]

    for _ in range(60):
        text = " " + "".join(r.choice("abc") for _ in range(r.randint(30, 90)))
        at = piece_scan.borders(text, 11)
        chunks = [piece_scan.Chunk(p, text[max(0, a - 6):a], text[a:b], text[b:b + 1]) for a, b in zip(at, at[1:])]
        product = functools.reduce(piece_scan.compose, [c.matrix() for c in chunks])
        assert product[2].max() == pytest.approx(best(text))
        states = piece_scan.settle_states([c.matrix() for c in chunks], "0:", "0:")
        names = {i: x for x, i in p.ids.items()}
        found = [names[i] for i in ids(b"".join(c.ids(*s) for c, s in zip(chunks, states)))]
        assert "".join(found) == text and sum(table[x] for x in found) == pytest.approx(best(text))
