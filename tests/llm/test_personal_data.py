import hashlib
import random
import re

import numpy as np
import pytest

from disclosight.llm import personal_data as pii


def plain(text):
    """The patterns as they are stated."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(number):
        total = 0
        for i, c in enumerate(number[::-1]):
            v = int(c) * (2 if i % 2 else 1)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    out = [(0, m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(3, m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_patterns():
    r = random.Random(2)
    for alphabet in ("a@.1 2-+()_%9é@.0", "0123456789 -", "12.5. 0", "+1(2) 3-4."):
        for _ in range(8000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 45)))
            assert pii.base_spans(text) == plain(text), text


def test_long_runs_are_quick():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "@" * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def exact_beliefs(unary, edges, pairs):
    n, k = unary.shape
    total, own = 0.0, np.zeros((n, k))
    for labels in np.ndindex(*(k,) * n):
        weight = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(pairs[t][labels[i], labels[j]] for i, j, t in edges))
        total += weight
        for i, y in enumerate(labels):
            own[i, y] += weight
    return own / total


def test_messages_are_exact_on_trees():
    r = np.random.default_rng(4)
    for edges in ([(0, 1, 0), (1, 2, 1), (1, 3, 0)], [(0, 1, 0), (1, 2, 0), (2, 3, 1)], []):
        unary, pairs = r.normal(size=(4, 3)), r.normal(size=(2, 3, 3))
        own, _ = pii.beliefs(unary, np.array(edges, np.int64).reshape(-1, 3), pairs, rounds=60)
        assert own == pytest.approx(exact_beliefs(unary, edges, pairs), abs=1e-3)


@pytest.fixture(scope="module")
def learned(make_docs, prose):
    r = random.Random(6)
    rows = []
    for i in range(200):
        mail, phone = f"{r.choice('abcdef') * 4}.{i}@mail{i % 9}.example.com", f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}"
        parts = [prose(i, 20), r.choice([mail, phone, f"{r.randint(1, 255)}.8.{i % 250}.1", "4111111111111111", f"order {i}", "2024-05-06"]), prose(i + 500, 20)]
        if i % 3 == 0:
            parts += [parts[1], prose(i + 900, 10)]
        rows.append((i, " ".join(parts)))
    return rows, pii.learn(make_docs(rows))


def test_consistency_adds_spans(learned):
    _, weights = learned
    text = "see 7536784127813050 4845168114407329 or 4845168114407329, then aaaa.7@mail1.example.com and aaaa.7@mail1 end"
    spans = pii.base_spans(text)
    added = pii.added_spans(text, spans, weights)
    assert "aaaa.7@mail1" in [text[a:b] for _, a, b in added]
    assert not any(a < y and x < b for _, a, b in added for _, x, y in spans)
    alone = "order 4845168114407321 and 555-7713 of 2024, version 4.0.1, aaaa.7@mail1"
    assert pii.added_spans(alone, pii.base_spans(alone), weights) == []


def test_repeats_far_from_the_base_span(learned, prose):
    """Each of 40 repeats is tied to the base span, before and after it, also against a word feature for "other"."""
    against = pii.start_weights()
    against.words[0, 0] = 0.5
    strongly = pii.start_weights()
    strongly.words[0, 0] = 2.0
    for base, again in (("+49 (30) 555-7713", "555-7713"), ("bbbb.7@mail1.example.com", "bbbb.7@mail1")):
        for before in (0, 40, 20):
            parts = [f"{again} {prose(i, 30)}" for i in range(40)]
            text = " ".join([*parts[:before], base, prose(99, 30), *parts[before:]])
            for weights in (pii.start_weights(), against, strongly, *([learned[1]] if "@" in base else [])):
                added = pii.added_spans(text, pii.base_spans(text), weights)
                assert [text[a:b] for _, a, b in added] == [again] * 40, (base, before)
            g = pii.graph(text, pii.base_spans(text))
            assert len(g.edges) <= 3 * len(g.places)


@pytest.mark.parametrize("base, again", [
    ("+1 415 555 0134", "4155550134"), ("+1 415 555 0134", "415 555 0134"), ("+1 415 555 0134", "(415) 555-0134"), ("+1 415 555 0134", "555 01 34"),
    ("+1 415 555 0134", "415-555-0134"), ("+49 (30) 555-7713", "555 7713"), ("4012 8888 8888 1881", "8888 8888 1881"), ("4012 8888 8888 1881", "40128888 88881881"), ("+4930 5557713", "030 5557713")])
def test_numbers_in_several_words(learned, prose, base, again):
    _, weights = learned
    for times in (1, 3, 40):
        text = " ".join([prose(3, 10), "in 2024,", base, prose(4, 20), *[f"{again}, {prose(i, 20)}" for i in range(times)]])
        spans = pii.base_spans(text)
        found = [text[a:b] for _, a, b in sorted(pii.added_spans(text, spans, weights), key=lambda s: s[1])]
        assert found == ([again] * times if pii.base_spans(again) == [] else []), (spans, found)
    others = f"{base} {prose(5, 5)} 2 555 0135 and 415 555, 2024 0134 or 99 0 1 2 3 4"
    assert pii.added_spans(others, pii.base_spans(others), weights) == []
    untied = f"{prose(5, 5)} {again} and {again}"
    assert pii.base_spans(untied) or not pii.added_spans(untied, [], weights)


def test_numbers_next_to_other_numbers(learned):
    """The end of a base number is taken as far as it goes and no farther."""
    text = "call +1 415 555 0134 or 7 415 555 0134 12 and 22 555 0134"
    found = [text[a:b] for _, a, b in pii.added_spans(text, pii.base_spans(text), learned[1])]
    assert found == ["415 555 0134", "555 0134"]


def test_added_spans_against_all_labellings():
    """The spans added are those whose belief, from all labellings of the graph, is high; close calls may differ."""
    r, clear = random.Random(5), 0
    for seed in range(60):
        weights = pii.start_weights()
        draw = np.random.default_rng(seed)
        weights.words[:] = draw.normal(size=weights.words.shape) * 0.3
        weights.pairs[0] = draw.normal(size=weights.pairs[0].shape) * 0.3
        pieces = ["+1 415 555 0134", "a.bcd@mail.example"] + r.sample(["415 555 0134", "5550134", "a.bcd@mail", "12 34", "x9", "A.BCD@other"], 3)
        r.shuffle(pieces)
        text = " and ".join(pieces)
        spans = pii.base_spans(text)
        g = pii.graph(text, spans)
        assert len(g.places) <= 6
        unary = g.features @ weights.words.T
        for at in np.flatnonzero(g.labels):
            unary[at] = -1000.0
            unary[at, g.labels[at]] = 0.0
        own = exact_beliefs(unary, g.edges.tolist(), weights.pairs)
        added = {(k, a) for k, a, _ in pii.added_spans(text, spans, weights)}
        for at in np.flatnonzero(g.labels == 0):
            for kind in range(1, 5):
                tied = pii._tied(g, kind)[at]
                if not tied:
                    assert (kind - 1, g.places[at][0]) not in added
                elif abs(own[at, kind] - pii.BELIEF) > 0.15:
                    assert ((kind - 1, g.places[at][0]) in added) == (own[at, kind] > pii.BELIEF)
                    clear += 1
    assert clear > 60


def test_columns(make_docs, learned, prose):
    rows, weights = learned
    rows = rows[:40] + [(900, None), (901, ""), (None, "x@y.zz"), (1, rows[1][1]), (902, prose(1, 30000) + " 9.9.9.9 " + prose(2, 10)), (903, "é +49 30 1234567 é")]
    got = pii.personal_data(make_docs(rows)).collect()
    want = []
    for doc_id, text in rows:
        spans = plain(text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        want.append((str(doc_id), *(sum(1 for s in spans if s[0] == k) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
        mine = [x for x in got if x.doc_id == doc_id][0]
        assert set(joined.split(",")) <= set(mine.spans.split(","))
    assert sorted((str(x.doc_id), x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got) == sorted(want)


def test_masks():
    text = "a +1 (017) 555-7713 b 4111111111111111 c"
    assert pii.mask(text, pii.base_spans(text)) == "a <phone> b <card> c"
    assert pii.mask("abcdef", [(0, 1, 4), (1, 2, 5)]) == "a<email>f"


def test_empty_table(make_docs):
    assert pii.personal_data(make_docs([])).count() == 0
