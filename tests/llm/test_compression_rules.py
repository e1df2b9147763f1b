import random
import re

from disclosight.llm import compression_rules as rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + s for i, w in enumerate(windows) if windows.count(w) > 1 for s in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_columns_and_verdicts(make_docs, prose):
    r = random.Random(1)
    noise = " ".join("".join(chr(r.randint(33, 126)) for _ in range(8)) for _ in range(900))
    rows = [(1, prose(1, 400)), (2, None), (3, ""), (4, " \n\t "), (5, "word " * 400), (6, noise), (7, prose(1, 400)),
            (8, "a b c a b c x y é # |\n same line\n same line\nsame line\n"), (None, prose(2, 60)), (9, prose(3, 3000) + "\n" + "spam ham " * 2600),
            (10, prose(4, 60000)), (11, "\x1c".join(["u"] * 9) + "\x0b\x0cv")]
    got = {(x.doc_id, x.word_chars): x for x in rules.quality(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        want = base(text if doc_id != 10 else None) if doc_id != 10 else None
        mine = [x for (i, _), x in got.items() if i == doc_id][0]
        if want:
            assert (mine.n_words, mine.word_chars, mine.n_symbols, mine.n_dup_lines, mine.n_repeat_words, mine.base_failed) == want, doc_id
    kept = {i: x.kept for (i, _), x in got.items()}
    assert kept[1] and kept[7] and kept[None] and kept[10]
    assert not any(kept[i] for i in (2, 3, 4, 5, 6, 9))
    assert got[2, 0].zstd_ratio is None


def test_bands_depend_on_length():
    short, long = b"ab cd ef gh " * 4, b"ab cd ef gh " * 4000
    assert rules.verdict(long)[0] is False
    assert rules.verdict(short, bands=(rules.Band(100, 0.0, 2.0), *rules.BANDS))[0] is True
    whole, chunks = rules.ratios(bytes(range(256)) * 64, chunk_bytes=4096)
    assert len(chunks) == 4 and whole < chunks[0][1]


def test_empty_table(make_docs):
    assert rules.quality(make_docs([])).count() == 0
