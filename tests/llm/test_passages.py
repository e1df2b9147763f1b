import random

import numpy as np
import pytest

from disclosight.llm import passages


def edited(text, seed, share):
    r, out = random.Random(seed), []
    for word in text.split():
        roll = r.random()
        if roll < share / 3:
            continue
        out.append(f"z{r.randrange(10**6)}" if roll < 2 * share / 3 else word)
        if 2 * share / 3 <= roll < share:
            out.append(f"y{r.randrange(10**6)}")
    return " ".join(out)


@pytest.fixture(scope="module")
def found(make_docs, prose):
    exact, fuzzy, short, common = prose(1, 60), prose(2, 150), prose(3, 40), prose(4, 80)
    rows = [(10, prose(10, 200) + " " + exact + " " + prose(11, 100)), (11, prose(12, 50) + "\n" + exact.upper() + " " + prose(13, 300)),
            (20, prose(20, 90) + " " + fuzzy + " " + prose(21, 50)), (21, prose(22, 10) + " " + edited(fuzzy, 5, 0.09) + " " + prose(23, 70)),
            (30, prose(30, 90) + " " + short), (31, short + " " + prose(31, 90)),
            (40, None), (41, ""), (42, "few words"), (None, prose(1, 60)), (43, "and " * 500), (44, "and " * 300)]
    rows += [(100 + i, prose(200 + i, 30) + " " + common + " " + prose(300 + i, 30)) for i in range(60)]
    rows += [(500, prose(500, 20000)), (501, prose(500, 20000)), (20, prose(20, 90) + " " + fuzzy + " " + prose(21, 50))]
    return rows, [tuple(x) for x in passages.repeated_passages(make_docs(rows)).collect()]


def pairs(got):
    return {(r[0], r[3]) for r in got}


def test_planted_passages(found):
    rows, got = found
    words = {i: t.lower().split() for i, t in rows if i is not None and t}
    for doc, start, n, first, first_start, first_n, same in got:
        assert n >= 50 and same >= 0.8 * max(n, first_n) and first < doc
        assert sum(a == b for a, b in zip(words[doc][start:start + n], words[first][first_start:first_start + first_n])) > 0
    (exact,) = [r for r in got if r[0] == 11]
    assert exact[1:] == (50, 60, 10, 200, 60, 60)
    (fuzzy,) = [r for r in got if r[0] == 21]
    assert fuzzy[3] == 20 and abs(fuzzy[1] - 10) <= 8 and abs(fuzzy[5] - 150) <= 12
    assert {(100 + i, 100) for i in range(1, 60)} <= pairs(got) and len([r for r in got if 100 <= r[0] < 200]) == 59
    (whole,) = [r for r in got if r[0] == 501]
    assert whole[1:3] == (0, 20000)
    assert (44, 43) in pairs(got)


def test_others_are_left_alone(found):
    assert {r[0] for r in found[1]} == {11, 21, 44, 501, *range(101, 160)}


def test_empty_table(make_docs):
    assert passages.repeated_passages(make_docs([])).count() == 0
    assert passages.repeated_passages(make_docs([(1, None), (2, "")])).count() == 0


def test_chains_against_all_chains():
    """The Fenwick sweep finds the best score that a plain quadratic search finds."""
    r = random.Random(8)
    for _ in range(200):
        points = sorted({(r.randrange(200), r.randrange(200)) for _ in range(r.randrange(2, 25))})
        runs = passages.runs_of(np.array([p[0] for p in points]), np.array([p[1] for p in points]), gap=10)
        order = runs[np.lexsort((runs[:, 2], runs[:, 0]))].tolist()
        best = []
        for i, (a, b, c, d, w) in enumerate(order):
            before = [best[j] - (a - order[j][1] + c - order[j][3]) / 80 for j in range(i) if order[j][1] < a and order[j][3] < c]
            best.append(w + max([0.0, *before]))
        chain = passages.chains_of(runs)[0].tolist()
        score = sum(x[4] for x in chain) - sum((y[0] - x[1] + y[2] - x[3]) / 80 for x, y in zip(chain, chain[1:]))
        assert score == pytest.approx(max(best))


def test_seeds_of_equal_runs():
    r = np.random.default_rng(1)
    shared = r.integers(0, 2**63, passages.K + passages.WINDOW - 1).astype(np.uint64)
    for _ in range(50):
        sides = [np.concatenate([r.integers(0, 2**63, 40).astype(np.uint64), shared, r.integers(0, 2**63, 40).astype(np.uint64)]) for _ in range(2)]
        grams = [passages.ngram_hashes(s, passages.K) for s in sides]
        seeds = [set(g[passages.minimizers(g)].tolist()) for g in grams]
        assert seeds[0] & seeds[1]


def test_seeds_with_scattered_first_holders(make_docs, prose):
    """Two documents share a passage, earlier ones only parts of it that are too short to be reported."""
    for seed in range(3):
        passage = [prose(2000 + 10 * seed + i, 200).split()[:80] for i in range(2)]
        rows = []
        for n, words in enumerate(passage):
            pieces = [words[:40], words[40:], words, words] if n == 0 else [words[:27], words[27:54], words[54:], words, words[:40], words[40:], words]
            rows += [(100 * n + i, f"{prose(3000 + 100 * seed + 10 * n + i, 60)} {' '.join(p)} {prose(4000 + 100 * seed + 10 * n + i, 60)}") for i, p in enumerate(pieces)]
        got = {(r[0], r[3]): tuple(r)[1:3] for r in passages.repeated_passages(make_docs(rows)).collect()}
        assert got == {(3, 2): (60, 80), (106, 103): (60, 80)}
