import random
import re

import numpy as np
import pyarrow as pa
import pytest

from disclosight.llm import jaccard_join
from disclosight.llm.components import components


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        mates = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((str(doc_id), len(sets[i]), str(min(mates) if mates and sets[i] else doc_id)))
    return sorted(out)


def edited(text, seed, edits):
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(prose):
    rows = [(i, prose(i, 30 + i % 50)) for i in range(40)]
    hub = prose(900, 120)
    rows += [(100 + i, edited(hub, i, i % 7)) for i in range(120)]  # a large group of near copies, some links only by way of others
    drift = prose(901, 90)
    for i in range(25):
        drift = edited(drift, 1000 + i, 1)
        rows.append((300 + i, drift))
    rows += [(400, rows[3][1].upper()), (401, rows[3][1]), (3, rows[3][1]), (402, None), (403, ""), (404, " \n"), (405, "one two"), (406, "ONE  two"),
             (407, "one two three"), (None, rows[5][1]), (None, "alone without id " * 3), (408, "the the the the the the the"), (409, "the the the the the")]
    rows += [(500 + i, prose(902, 6000) if i < 2 else prose(903 + i, 3000)) for i in range(3)]
    return rows


def test_against_brute_force(make_docs, rows):
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard_join.join(make_docs(rows)).collect())
    assert got == brute(rows)


def test_other_threshold(make_docs, rows):
    some = rows[:60] + rows[-30:]
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard_join.join(make_docs(some), percent=60).collect())
    assert got == brute(some, 60)


def test_empty_table(make_docs):
    assert jaccard_join.join(make_docs([])).count() == 0
    got = jaccard_join.join(make_docs([(1, None), (2, "")])).collect()
    assert sorted(tuple(x) for x in got) == [(1, 0, 1), (2, 0, 2)]


def test_signature_bounds_the_overlap(prose):
    for seed in range(30):
        a, b = jaccard_join.ngram_set(prose(seed, 200)), jaccard_join.ngram_set(edited(prose(seed, 200), seed, seed))
        sa, sb = jaccard_join.signature(a), jaccard_join.signature(b)
        missing = sum(int(x & ~y & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip(sa.tolist(), sb.tolist()))
        assert len(np.intersect1d(a, b)) <= len(a) - missing


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(40), r.randrange(40)) for _ in range(30)] + [(7, 7), (500, 1), (500, 1)]
    got = {x.u: x.v for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {i: i for link in links for i in link}
    for _ in range(len(links)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {i: got.get(i, i) for i in root} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_of_one_group_are_not_compared_pair_by_pair(make_docs, prose, monkeypatch):
    base = prose(5000, 150)
    rows = [(200, base)] + [(i, edited(base, 9000 + i, 1 + i % 4)) for i in range(200)]
    counts, likely = [], jaccard_join._likely

    def counted(pairs, facts, percent):
        counts.append(pairs.distinct().count())
        return likely(pairs, facts, percent)

    monkeypatch.setattr(jaccard_join, "_likely", counted)
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard_join.join(make_docs(rows)).collect()) == brute(rows)
    assert counts[-1] <= 2 * len(rows)


def test_texts_are_read_once_for_sizes_and_first_ngrams(make_docs, prose):
    doc = [prose(5200, 60), "a b", None]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(doc)], ["doc_id", "text"])
    (out,) = jaccard_join._summaries(5)(iter([batch]))
    for text, row in zip(doc, out.to_pylist()):
        own = jaccard_join.ngram_set(text)
        assert row["n"] == len(own) and row["sid"] == jaccard_join.set_id(own)
        assert row["firsts"] == [h - (1 << 64) if h >= 1 << 63 else h for h in own.tolist() if h < 1 << 62]
