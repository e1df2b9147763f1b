"""SentencePiece encoding and decoding as a parallel scan in max-plus algebra.

A text is encoded along the best path through the lattice of its pieces. A state is a place together with the piece
that ended there; a step appends a piece. In a model of merge type a step is allowed (weight 0) when the
model's merges, run on the two neighbouring pieces alone, leave them apart, and forbidden (weight minus
infinity) otherwise: one path is left, and it is the encoding that the model's merges give. In a unigram
model a step weighs the score of its piece.

Documents of more than ``GIANT`` characters are split into chunks of about ``CHUNK``, which may begin inside a word:

1. each chunk yields, on its own, the matrix of best path weights from every state at its left border to
   every state at its right border;
2. the matrices of a document are multiplied in max-plus algebra. The product is associative: blocks of ``BLOCK``
   chunks are multiplied where they are, then the products, and so on; going back down gives the best
   state at every border;
3. each chunk is backtraced on its own between its two border states.

No piece holds a space after another character, so at the start of a word all states fall into one; the words of a
chunk other than the two at its borders are taken from a cache of the worker. Characters without a piece become
bytes and separate their neighbours. Runs of spaces are merged by their length.

Defined cases: a NULL text is empty and has no ids; repeated rows are encoded each; a NULL id is kept. U+2581 counts
as a space, as in the library, so it comes back as a space. Columns beyond id and text are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Recent, owned, settle, slices, working_for

GIANT, CHUNK, BLOCK = 32768, 16384, 64
_NONE, _LAST = -np.inf, float("inf")
#: State where nothing before matters, and its label.
FREE = ""


class Pieces:
    """The pieces of a model file, with caches of words, of pieces and of pairs of pieces."""

    def __init__(self, path: str, words: int = 500_000, pairs: int = 1_000_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i).replace("▁", " "): i for i in plain}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.ranks = {p: -s for p, s in self.scores.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        self.letters = {c for p in self.ids for c in p}
        self.spelled = [b""] * len(every)
        for piece, i in self.ids.items():
            self.spelled[i] = piece.encode("utf-8", "surrogatepass")
        for byte, i in self.bytes.items():
            self.spelled[i] = bytes([byte])
        # Merge models rank their pieces by whole negative scores, unigram models by log probabilities.
        self.merges = all(float(s).is_integer() for s in self.scores.values())
        self.words, self.pairs, self.sound = Recent(words), Recent(pairs), {}
        self.runs = [b""]

    def foreign(self, char: str) -> bytes:
        """The ids of a character that has no piece."""
        data = char.encode("utf-8", "surrogatepass")
        ids = [self.bytes[b] for b in data] if self.bytes else [self.unknown]
        return pack("<%dI" % len(ids), *ids)

    def merged(self, text: str) -> list[str]:
        """The pieces that the model's merges leave of ``text``, best score first, then leftmost."""
        if len(text) > 32:
            return self._merged_long(text)
        parts, rank = list(text), self.ranks.get
        ranks = [rank(a + b, _LAST) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _LAST:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], _LAST)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], _LAST)
        return parts

    def _merged_long(self, text: str) -> list[str]:
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts):
                score = self.scores.get(parts[i] + parts[j])
                if score is not None:
                    heapq.heappush(queue, (-score, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left``."""
        if not self.merges or not left:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            found = self.pairs.again((left, right))
        if found is None:
            found = self.pairs.keep((left, right), self.merged(left + right) == [left, right])
        return found

    def stands(self, piece: str) -> bool:
        """Whether ``piece`` is a piece that a path can hold."""
        found = self.sound.get(piece)
        if found is None and piece in self.ids:
            found = self.sound[piece] = not self.merges or self.merged(piece) == [piece]
        return bool(found)

    def weight(self, piece: str) -> float:
        return 0.0 if self.merges else self.scores[piece]

    def run(self, spaces: int) -> bytes:
        """The ids of a run of spaces."""
        if spaces >= len(self.runs) or spaces > 4096:
            ids = [self.ids[p] for p in self.merged(" " * spaces)]
            found = pack("<%dI" % len(ids), *ids)
            if spaces == len(self.runs) and spaces <= 4096:
                self.runs.append(found)
            return found
        return self.runs[spaces]

    def _path(self, word: str) -> tuple[float, bytes]:
        """Weight and ids of the best path through a word with a known start."""
        out: list[bytes] = []
        total, start = 0.0, 0
        for end in range(len(word) + 1):
            if end == len(word) or word[end] not in self.letters:
                if end > start:
                    weight, pieces = self._best(word[start:end])
                    total += weight
                    out.append(pack("<%dI" % len(pieces), *(self.ids[p] for p in pieces)))
                if end < len(word):
                    out.append(self.foreign(word[end]))
                start = end + 1
        return total, b"".join(out)

    def _best(self, text: str) -> tuple[float, list[str]]:
        """The best path through characters that have pieces, from a known start. In a merge model the one path that
        is allowed is what the merges give."""
        if self.merges:
            return 0.0, self.merged(text)
        n = len(text)
        best: list[tuple[float, int] | None] = [(0.0, -1)] + [None] * n
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                piece = text[start:end]
                if piece not in self.ids or best[start] is None:
                    continue
                weight = best[start][0] + self.weight(piece)
                if best[end] is None or weight > best[end][0]:
                    best[end] = (weight, start)
        out, at = [], n
        while at > 0:
            out.append(text[best[at][1]:at])
            at = best[at][1]
        return best[n][0], out[::-1]

    def word(self, word: str) -> tuple[float, bytes]:
        """Weight and ids of a space and ``word`` (without spaces)."""
        found = self.words.get(word)
        if found is None:
            found = self.words.again(word)
        if found is None:
            found = self._path(" " + word)
            if len(word) <= 40:
                self.words.keep(word, found)
        return found

    def spaced(self, words: list[str]) -> tuple[float, bytes]:
        """Weight and ids of words that a space precedes each; an empty word is a further space."""
        if "" not in words:
            known = self.words
            try:
                found = [known[w] for w in words]
            except KeyError:
                found = list(map(self.word, words))
            return (0.0 if self.merges else sum(f[0] for f in found)), b"".join([f[1] for f in found])
        total, out, spaces, one = 0.0, [], 0, pack("<I", self.ids[" "])
        for word in words:
            if not word:
                spaces += 1
                continue
            weight, ids = self.word(word)
            total += weight
            out.append(self.after_run(spaces, ids, one) if spaces else ids)
            spaces = 0
        return total, b"".join([*out, self.run(spaces)])

    def after_run(self, spaces: int, ids: bytes, one: bytes | None = None) -> bytes:
        """The ids of ``spaces`` more spaces before a word: a lone space of the word joins them."""
        one = one or pack("<I", self.ids[" "])
        return self.run(spaces + 1) + ids[4:] if ids[:4] == one else self.run(spaces) + ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit."""
        return self.spaced(text.replace("▁", " ").split(" "))[1] if text else b""

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.spelled.__getitem__, memoryview(ids).cast("I")))
        return data[1:].decode("utf-8", "replace")


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    working_for("pieces")
    if path not in _LOADED:
        _LOADED[path] = found = Pieces(path)
        owned("pieces", found.words)
        owned("pieces", found.pairs)
    return _LOADED[path]


# ---- chunks of giant documents -----------------------------------------------------------------------------------------------

def borders(text: str, chunk: int = CHUNK) -> list[int]:
    """Borders of the chunks of ``text`` (which begins with its own space); none follows a space."""
    found, at = [0], chunk
    while at < len(text):
        while at < len(text) and text[at - 1] == " ":
            at += 1
        if at < len(text):
            found.append(at)
        at += chunk
    return found + [len(text)]


class Chunk:
    """A chunk with what it needs of its neighbours: ``left`` text before it, ``ahead`` the character after it."""

    def __init__(self, p: Pieces, left: str, body: str, ahead: str):
        self.p, self.text, self.zero = p, left + body, len(left)
        text = self.text
        self.end = len(text)
        # From ``first`` to ``last`` the chunk holds whole words; ``first`` is None inside one long word.
        self.closed = not ahead or ahead == " "
        found = text.find(" ", self.zero)
        self.first = found if found >= 0 else self.end if self.closed else None
        self.last = None if self.first is None else self.end
        if self.first is not None and not self.closed:
            at = text.rfind(" ")
            while at > self.first and text[at - 1] == " ":
                at -= 1
            self.last = at
        # The word that the left border cuts: its start, or None if it lies before what is known.
        at = left.rfind(" ")
        self.own_start = at if at >= 0 else None

    def _pieces_at(self, at: int, stop: int) -> Iterator[tuple[str, str]]:
        """``(piece, state after it)`` of the pieces that begin at ``at`` and end at ``stop`` at the latest."""
        text, p = self.text, self.p
        if text[at] not in p.letters:
            yield text[at], FREE
            return
        for end in range(at + 1, min(stop, at + p.longest) + 1):
            piece = text[at:end]
            if p.stands(piece):
                yield piece, piece if p.merges else FREE

    def _states(self, border: int, start: int | None) -> list[tuple[int, str]]:
        """States at a border: ``(place where the last piece ended, piece)``. ``start``: where the cut word begins."""
        text, p, found = self.text, self.p, []
        if start is not None and start == border:
            return [(border, FREE)]
        for place in range(border, max(border - p.longest, -1 if start is None else start - 1), -1):
            if place < 0:
                break
            if place == start or (place > 0 and text[place - 1] not in p.letters):
                found.append((place, FREE))
                if place == start:
                    break
                continue
            if not p.merges:
                found.append((place, FREE))
                continue
            for begin in range(max(0 if start is None else start, place - p.longest), place):
                if p.stands(text[begin:place]):
                    found.append((place, text[begin:place]))
        return found

    def left_states(self) -> list[tuple[int, str]]:
        if not self.zero or self.text[self.zero] == " ":
            return [(self.zero, FREE)]
        return self._states(self.zero, self.own_start)

    def label(self, state: tuple[int, str], border: int) -> str:
        return f"{border - state[0]}:{state[1]}"

    def _sweep(self, seeds: dict[tuple[int, str], np.ndarray], stop: int, cross: int, trace: bool = False):
        """Best weights of all states reached from the seeds up to ``stop``. Pieces that begin before ``cross`` must end after it."""
        p, text = self.p, self.text
        at_place: dict[int, dict[str, np.ndarray]] = {}
        back: dict[tuple[int, str], tuple[int, str, str]] = {}
        for (place, state), vector in seeds.items():
            at_place.setdefault(place, {})[state] = vector
        for place in range(min(at_place), stop):
            here = at_place.get(place)
            if not here:
                continue
            for piece, after in self._pieces_at(place, stop):
                end = place + len(piece)
                if place < cross and end <= cross:
                    continue
                weight = p.weight(piece) if piece in p.ids else 0.0
                for state, vector in here.items():
                    if piece not in p.ids or p.fits(state, piece):
                        there = at_place.setdefault(end, {})
                        new = vector + weight
                        old = there.get(after)
                        if old is None:
                            there[after] = new
                            back[end, after] = (place, state, piece)
                        elif trace:
                            if new[0] > old[0]:
                                there[after] = new
                                back[end, after] = (place, state, piece)
                        else:
                            there[after] = np.maximum(old, new)
        return at_place, back

    def _word_part(self, start: int) -> int:
        """Where the last space of the run that begins at ``start`` lies: there the word begins."""
        while start + 1 < self.end and self.text[start + 1] == " ":
            start += 1
        return start

    def _right(self, seeds: dict[tuple[int, str], np.ndarray], cross: int) -> tuple[list[tuple[int, str]], list[np.ndarray]]:
        found, _ = self._sweep(seeds, self.end, cross)
        states, vectors = [], []
        for place in range(self.end, max(self.end - self.p.longest, min(s[0] for s in seeds) - 1), -1):
            for state, vector in found.get(place, {}).items():
                # A cut after a character without a piece, or at the very start of the word, forgets what was before.
                states.append((place, state))
                vectors.append(vector)
        return states, vectors

    def _middle(self) -> tuple[float, bytes]:
        inside = self.text[self.first:self.last]
        return self.p.spaced(inside[1:].split(" ")) if inside else (0.0, b"")

    def matrix(self) -> tuple[list[str], list[str], np.ndarray]:
        """Labels of the left and right border states, and the best weights between them."""
        ins = self.left_states()
        unit = np.full((len(ins), len(ins)), _NONE)
        np.fill_diagonal(unit, 0.0)
        seeds = {s: unit[i] for i, s in enumerate(ins)}
        names = [self.label(s, self.zero) for s in ins]
        if self.first is None:
            outs, vectors = self._right(seeds, self.zero)
        else:
            if self.zero == self.first:
                entry = unit[0]
            else:
                found, _ = self._sweep(seeds, self.first, self.zero)
                entry = np.maximum.reduce(list(found.get(self.first, {}).values()) or [np.full(len(ins), _NONE)])
            entry = entry + self._middle()[0]
            if self.last == self.end:
                outs, vectors = [(self.end, FREE)], [entry]
            else:
                outs, vectors = self._right({(self._word_part(self.last), FREE): entry}, 0)
        return names, [self.label(s, self.end) for s in outs], np.array(vectors).T.reshape(len(ins), len(outs))

    def _trace(self, seed: tuple[int, str], goal: tuple[int, str] | int, stop: int, cross: int) -> bytes:
        found, back = self._sweep({seed: np.zeros(1)}, stop, cross, trace=True)
        if isinstance(goal, int):
            goal = (goal, max(found[goal].items(), key=lambda kv: kv[1][0])[0])
        out = []
        while goal != seed:
            place, state, piece = back[goal]
            out.append(pack("<I", self.p.ids[piece]) if piece in self.p.ids else self.p.foreign(piece))
            goal = (place, state)
        return b"".join(out[::-1])

    def ids(self, entry: str, leave: str) -> bytes:
        """The ids between two border states, given by their labels."""
        state = lambda label, border: (border - int(label.partition(":")[0]), label.partition(":")[2])
        seed, goal = state(entry, self.zero), state(leave, self.end)
        if self.first is None:
            return self._trace(seed, goal, self.end, self.zero)
        head = self._trace(seed, self.first, self.first, self.zero) if self.zero != self.first else b""
        middle = self._middle()[1]
        if self.last == self.end:
            return head + middle
        word = self._word_part(self.last)
        tail = self._trace((word, FREE), goal, self.end, 0)
        spaces = word - self.last
        return head + middle + (self.p.after_run(spaces, tail) if spaces else tail)


def compose(a: tuple, b: tuple) -> tuple:
    """Max-plus product of two matrices with labelled borders."""
    place = {name: i for i, name in enumerate(b[0])}
    shared = [(i, place[name]) for i, name in enumerate(a[1]) if name in place]
    left, right = a[2][:, [i for i, _ in shared]], b[2][[j for _, j in shared]]
    return a[0], b[1], (left[:, :, None] + right[None, :, :]).max(axis=1, initial=_NONE)


def settle_states(matrices: list[tuple], entry: str, leave: str) -> list[tuple[str, str]]:
    """The best border states of successive chunks between a first and a last state."""
    reached = [{entry: 0.0}]
    for ins, outs, cells in matrices:
        now = np.array([reached[-1].get(n, _NONE) for n in ins])
        best = (now[:, None] + cells).max(axis=0, initial=_NONE)
        reached.append({n: float(v) for n, v in zip(outs, best) if v > _NONE})
    found, goal = [], leave
    for (ins, outs, cells), before in zip(reversed(matrices), reversed(reached[:-1])):
        column = cells[:, outs.index(goal)]
        start = max((n for n in ins if n in before), key=lambda n: before[n] + column[ins.index(n)])
        found.append((start, goal))
        goal = start
    return found[::-1]


_MATRIX = "doc long, chunk long, ins array<string>, outs array<string>, cells array<double>"


def _cut(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = 2 * pieces(path).longest
        for part in slices(batches, 1):
            text = " " + part.column(2)[0].as_py().replace("▁", " ")
            at = borders(text, chunk)
            rows = [(part.column(0)[0].as_py(), part.column(1)[0].as_py(), i, len(at) - 1, text[max(0, a - context):a], text[a:b], text[b:b + 1])
                    for i, (a, b) in enumerate(zip(at, at[1:]))]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc", "doc_id", "chunk", "chunks", "before", "body", "ahead"])
    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for part in slices(batches, 64):
            rows = [(r["doc"], r["chunk"], *Chunk(p, r["before"], r["body"], r["ahead"]).matrix()) for r in part.to_pylist()]
            yield _matrix_batch(rows)
    return run


def _matrix_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64()))
    columns = list(zip(*((d, c, i, o, m.ravel().tolist()) for d, c, i, o, m in rows))) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc", "chunk", "ins", "outs", "cells"])


def _read(row: dict) -> tuple:
    return row["ins"], row["outs"], np.array(row["cells"]).reshape(len(row["ins"]), len(row["outs"]))


def _products(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    product = _read(rows[0])
    for row in rows[1:]:
        product = compose(product, _read(row))
    return pa.Table.from_batches([_matrix_batch([(rows[0]["doc"], rows[0]["chunk"] // BLOCK, *product)])])


def _resolved(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    states = settle_states([_read(r) for r in rows], rows[0]["entry"], rows[0]["leave"])
    return pa.table({"doc": pa.array([r["doc"] for r in rows], pa.int64()), "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
                     "entry": pa.array([s[0] for s in states]), "leave": pa.array([s[1] for s in states])})


def border_states(matrices: DataFrame, levels: int) -> DataFrame:
    """``(doc, chunk, entry, leave)``: the scan. ``levels``: how often blocks of ``BLOCK`` must be multiplied to get one per document."""
    if levels == 0:
        bounds = matrices.select("doc", "chunk", F.lit("0:" + FREE).alias("entry"), F.lit("0:" + FREE).alias("leave"))
        return bounds
    block = F.floor(F.col("chunk") / F.lit(BLOCK)).cast("long")
    products = settle(matrices.withColumn("block", block).groupBy("doc", "block").applyInArrow(
        lambda t: _products(t.drop_columns(["block"])), _MATRIX), "scan-products")
    above = border_states(products, levels - 1).withColumnRenamed("chunk", "block")
    return matrices.withColumn("block", block).join(above, ["doc", "block"]).groupBy("doc", "block").applyInArrow(
        _resolved, "doc long, chunk long, entry string, leave string")


def _whole(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids = [p.encode(t) for t in texts]
            yield (_digests(part.column(0), ids, [p.decode(i) == t.replace("▁", " ") for i, t in zip(ids, texts)]) if digest
                   else pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"]))
    return run


def _digests(doc_ids, ids: list[bytes], same: list[bool]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same)],
                                      ["doc_id", "n_ids", "ids_crc32", "round_trip"])


def _backtrace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for part in slices(batches, 64):
            ids = [Chunk(p, r["before"], r["body"], r["ahead"]).ids(r["entry"], r["leave"]) for r in part.to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("doc_id"), part.column("chunk"), pa.array(ids, pa.binary())], ["doc", "doc_id", "chunk", "ids"])
    return run


def _check_joined(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for part in slices(batches, 16):
            ids = [bytes(i) for i in part.column(1).to_pylist()]
            yield _digests(part.column(0), ids, [p.decode(i) == t.replace("▁", " ") for i, t in zip(ids, part.column(2).to_pylist())])
    return run


def encode(documents: DataFrame, path: str, digest: bool = False, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, ids)`` of every document, ids as little-endian unsigned 32-bit bytes; with ``digest`` instead
    ``(doc_id, n_ids, ids_crc32, round_trip)``."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small = F.coalesce(F.length("text"), F.lit(0)) <= giant
    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" if digest else "doc_id long, ids binary"
    whole = texts.where(small).mapInArrow(_whole(path, digest), schema)
    # Giant documents get a number of their own, as an id may repeat or be NULL.
    big = settle(texts.where(~small).select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "scan-giants")
    chunks = settle(big.mapInArrow(_cut(path, chunk), "doc long, doc_id long, chunk long, chunks long, before string, body string, ahead string")
                    .repartition("doc", "chunk"), "scan-chunks")
    most = chunks.agg(F.max("chunks")).first()[0]
    if not most:
        return whole
    levels, blocks = 1, -(-most // BLOCK)
    while blocks > 1:
        levels, blocks = levels + 1, -(-blocks // BLOCK)
    matrices = settle(chunks.select("doc", "chunk", "before", "body", "ahead").mapInArrow(_matrices(path), _MATRIX), "scan-matrices")
    states = border_states(matrices, levels)
    traced = chunks.join(states, ["doc", "chunk"]).mapInArrow(_backtrace(path), "doc long, doc_id long, chunk long, ids binary")
    joined = (traced.groupBy("doc", "doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
              .select("doc", "doc_id", F.aggregate(F.col("parts.ids"), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("ids")))
    if digest:
        joined = joined.join(big.select("doc", "text"), "doc").select("doc_id", "ids", "text").mapInArrow(_check_joined(path), schema)
    else:
        joined = joined.select("doc_id", "ids")
    return whole.union(joined)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.decode(bytes(i)) for i in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
