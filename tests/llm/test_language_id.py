import random
import zlib

import pytest

from disclosight.llm import language_id

SYLLABLES = {"aa": "ba ko mi tu ra ne lo".split(), "bb": "sch ung ein ver ich lich keit".split(), "cc": "ção mente eux ñe llo rr ie".split()}


def text(lang, seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def found(make_docs):
    langs = sorted(SYLLABLES)
    rows = [(i, text(langs[i % 3], i, 5 + i % 90), None if i % 11 == 0 else langs[i % 3]) for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !?", "bb"), (None, text("aa", 9), "aa"), (1003, text("bb", 5, 30000), None), (7, rows[7][1], rows[7][2])]
    return rows, language_id.identify(make_docs(rows)).collect()


def test_held_out_accuracy(found):
    rows, got = found
    lang = {r[0]: sorted(SYLLABLES)[r[0] % 3] for r in rows[:400]}
    held = [x for x in got if x.held_out and x.doc_id in lang]
    assert len(held) > 60 and sum(x.lang_pred == lang[x.doc_id] for x in held) >= 0.98 * len(held)
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2)
        assert 0 <= x.score <= 1


def test_odd_rows(found):
    rows, got = found
    assert len(got) == len(rows)
    for x in got:
        if x.doc_id in (1000, 1001, 1002):
            assert (x.lang_pred, x.score, x.rejected) == ("und", 0.0, True)
    assert [x.lang_pred for x in got if x.doc_id is None] == ["aa"] and [x.lang_pred for x in got if x.doc_id == 1003] == ["bb"]
    assert not any(x.rejected for x in got if x.doc_id is not None and 20 < x.doc_id < 400)


def test_mixed_text_is_less_sure(make_docs):
    langs = sorted(SYLLABLES)
    rows = [(i, text(langs[i % 3], i), langs[i % 3]) for i in range(300)]
    model = language_id.train(make_docs(rows))
    mixed = " ".join(text(k, 77, 40) for k in langs)
    shares, _ = language_id.probabilities(model, [mixed, text("aa", 500)])
    assert shares[0].max() < shares[1].max()


def test_nothing_to_learn(make_docs):
    assert language_id.identify(make_docs([])).count() == 0
    got = language_id.identify(make_docs([(1, "abc"), (4, "x", None)])).collect()
    assert {(x.lang_pred, x.score, x.rejected) for x in got} == {("und", 0.0, True)}
    assert language_id.accepted(None, ["abc", "12", None]) == [True, False, False]
