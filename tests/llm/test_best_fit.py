import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from disclosight.llm import best_fit
from disclosight.llm.subwords import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library():
    plain, mine, r = library(), Encoder(PATH, entries=50, words=50), random.Random(1)
    letters = "ab'sdt RE 12½²\n\t \x1c\x85\xa0 　é一Ⅷ.,!_  \r​😀"
    for i in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40))) + ("<|endoftext|>" if i % 50 == 0 else "")
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_added_tokens_as_the_library_takes_them():
    mine = Encoder(PATH)
    for text in ("hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endoftext| >"):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library().encode(text, add_special_tokens=False).ids


def test_merges_equal_the_model_of_the_library():
    mine, r = Encoder(PATH), random.Random(4)
    assert mine.merge is not None
    letters = [bytes([b]) for b in range(256)] + [b" ", b"e", b"t", b"th", b"ing", b"er", b"ou", b"\xc3\xa9"] * 12
    for _ in range(20000):
        data = b"".join(r.choice(letters) for _ in range(r.randint(1, 30)))
        assert mine.merge(data) == [t.id for t in mine.model.tokenize(data.decode("latin-1").translate(mine.letters))], data
    for token in ("a" * 199, "ab" * 100, "a" * 201, "xyz" * 3000):
        assert np.frombuffer(mine.encode(token), "<u4").tolist() == library().encode(token, add_special_tokens=False).ids


class NaiveBins:
    """The packing rule over a plain list of [free, number, age of the entry]."""

    def __init__(self, capacity, most):
        self.capacity, self.most, self.bins, self.opened, self.clock, self.closed = capacity, most, [], 0, 0, 0

    def place(self, length):
        self.clock += 1
        fitting = [b for b in self.bins if b[0] >= length]
        if fitting:
            chosen = min(fitting, key=lambda b: (b[0], -b[2]))
            self.bins.remove(chosen)
            free, number = chosen[:2]
        else:
            free, number, self.opened = self.capacity, self.opened, self.opened + 1
        if free > length:
            self.bins.append([free - length, number, self.clock])
            if len(self.bins) > self.most:
                self.bins.remove(min(self.bins, key=lambda b: (b[0], -b[2])))
                self.closed += 1
        return number, self.capacity - free


def test_packer_equals_a_naive_list_of_bins():
    r = random.Random(9)
    for most in (1, 2, 7, 40):
        packer, naive = best_fit.Packer(64, most), NaiveBins(64, most)
        for _ in range(2500):
            n = r.choice((r.randint(1, 64), r.randint(1, 12), 64))
            assert packer.place(n) == naive.place(n)
        assert packer.closed == naive.closed > 0


def test_equal_rows_are_spread_over_packers(make_docs):
    got = best_fit.pack_documents(make_docs([(7, "one two three")] * 400 + [(None, "four")] * 400), PATH, pieces_per_packer=100)
    assert got.selectExpr("sequence_id >> 40 as p").groupBy("p").count().collect().__len__() == 8
    rows = got.collect()
    assert len(rows) == 800 and len({(x.sequence_id, x.offset) for x in rows}) == 800


def test_pieces_and_places(make_docs, prose):
    rows = [(i, prose(i, 5 + (i * 37) % 900)) for i in range(150)] + [(1, prose(1, 42)), (200, None), (201, ""), (None, "x y"), (202, prose(7, 9000)), (203, "a" * 20000)]
    got = best_fit.pack_documents(make_docs(rows), PATH, pieces_per_packer=60, with_ids=True).collect()
    plain = library()
    want = sorted((str(i), tuple(plain.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in rows)
    texts, sequences = {}, {}
    for x in got:
        assert x.length == len(x.ids) <= 1024 and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        assert x.length == 1024 or x.piece == 0
        texts.setdefault((str(x.doc_id)), []).append((x.piece, x.start, tuple(x.ids)))
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for doc_id, ids in want:
        if doc_id == "1":
            continue
        parts = sorted(texts[doc_id])
        assert sum((p[2] for p in parts), ()) == ids and [p[0] for p in parts] == list(range(len(parts)))
        assert [p[1] for p in parts] == [sum(len(q[2]) for q in parts[:i]) for i in range(len(parts))]
    for places in sequences.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(places[-1]) <= 1024
    total = sum(x.length for x in got)
    assert len(sequences) <= 1.15 * total / 1024 + 3  # three packers of a few pieces


def test_bound_on_open_bins():
    r = random.Random(5)
    for bins in (1, 4, 50):
        packer, used = best_fit.Packer(100, bins), {}
        for _ in range(3000):
            n = r.randint(1, 100)
            number, offset = packer.place(n)
            assert used.get(number, 0) == offset and offset + n <= 100
            used[number] = offset + n
            assert packer.open <= bins and packer.open == sum(map(len, packer.by_free))
            assert packer.free_bits == sum(1 << f for f, x in enumerate(packer.by_free) if x)


def test_the_best_fit_is_taken_and_the_fullest_closes():
    packer = best_fit.Packer(10, 2)
    assert [packer.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    packer = best_fit.Packer(10, 2)
    assert [packer.place(n) for n in (5, 6, 7, 3, 4, 5)] == [(0, 0), (1, 0), (2, 0), (1, 6), (0, 5), (3, 0)]


def test_fill_rate_and_closings_of_the_online_rule():
    r = random.Random(2)
    lengths = [min(1024, 1 + int(r.expovariate(1 / 400))) for _ in range(best_fit.PIECES_PER_PACKER)]
    packer = best_fit.Packer(1024, best_fit.OPEN_BINS)
    for n in lengths:
        packer.place(n)
    assert packer.closed > 5000 and sum(lengths) / 1024 / packer.opened > 0.96


def test_empty_table(make_docs):
    assert best_fit.pack_documents(make_docs([]), PATH).count() == 0
