"""Personal data: fixed patterns, extended by a skip-chain conditional random field.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers found by pattern in the whole text.

The field labels the words of a document that hold a digit or an ``@`` (all other words are fixed as
"other"). The words of a base span are one node, and so are neighbouring words that together spell the last
``LEAST_DIGITS`` digits of a base phone or card: numbers are mostly written with spaces. The graph has chain edges between neighbouring words and skip edges between distant words that are
the same or similar: equal without case and outer punctuation, equal in their last ``LEAST_DIGITS`` digits, or equal up
to their ``@``. An occurrence is joined with the nearest one in a base span, however far away; without one, and among base
spans, equal keys are joined from one occurrence to the next. So the graph grows with the document, and repeats that are
tied to a base span do not outvote it. The words of base spans keep their label; loopy message
passing, for more rounds the more skip edges lie between a word and a base span, carries it along the skip edges to words
that the patterns miss, such as a number that is repeated without its country code. A word is added as a span when
the belief in its kind reaches ``BELIEF`` and skip edges tie it to a base span of that kind in the same
document; a document without base spans is left alone.

Weights (word features per label, chain and skip potentials) are trained in numpy by gradient ascent on the
likelihood, with expectations from the same message passing and a prior that equal words agree, on a bounded sample of ``SAMPLE`` documents (by
a hash of the id) labelled by the patterns.

Defined cases: a NULL text is empty and has no spans; a repeated row gives the same result again; a NULL id
is kept. Offsets count code points, the end is exclusive. Columns beyond id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD, slices, working_for

KINDS = ("email", "ip", "card", "phone")
SAMPLE, EPOCHS, RATE, ROUNDS, DAMPING, BELIEF = 2000, 6, 0.2, 12, 0.3, 0.5
#: Prior mean of the skip potential between equal labels, and the characters that a word needs to be compared.
SKIP_PRIOR, LEAST_KEY = 4.0, 6
#: Digits that numbers must share at their end, and the most that a number written in several words has (a card's).
LEAST_DIGITS, MOST_DIGITS = 7, 19

#: The patterns; possessive repeats and the look-behind change no match, they only avoid repeated scans of long runs.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EDGE = re.compile(r"^[^0-9A-Za-z+(@]+|[^0-9A-Za-z)@]+$")
_NUMBER = re.compile(r"\+?[\x20().0-9-]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    found = []
    if "@" in text:
        found += [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _digits(m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


class Graph(NamedTuple):
    """Words with a digit or ``@``: places, features, base labels (0 is "other"), edges (i, j, is skip)."""

    places: list[tuple[int, int]]
    features: np.ndarray
    labels: np.ndarray
    edges: np.ndarray


def _features(word: str, before: str, after: str) -> list[bool]:
    core = _EDGE.sub("", word)
    digits = _digits(core)
    n, dots = len(digits), core.count(".")
    letters = any(c.isalpha() for c in core)
    tail = core.partition("@")[2]
    dotted = core.split(".")
    return [True, "@" in core, "." in tail, n > 0, core.isdigit(), 0 < n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 15, 16 <= n <= 19, n > 19,
            dots == 1, dots == 2, dots == 3, dots > 3, core.startswith("+"), core.startswith("("), "-" in core, letters, n > 0 and letters,
            len(core) > 24, len(dotted) == 4 and all(d.isdigit() and len(d) < 4 for d in dotted), n > 12 and luhn(digits),
            before.startswith("+"), before.endswith(")"), bool(_DIGIT.search(before)), bool(_DIGIT.search(after)), after.startswith("(")]


N_FEATURES = len(_features("", "", ""))


def _keys(word: str) -> set[tuple[str, str]]:
    core = _EDGE.sub("", word).lower()
    digits = _digits(core)
    keys = {("word", core)} if sum(map(str.isalnum, core)) >= LEAST_KEY else set()
    if len(digits) >= LEAST_DIGITS and not any(c.isalpha() for c in core):
        keys.add(("digits", digits[-LEAST_DIGITS:]))
    if "@" in core:
        keys.add(("local", core.partition("@")[0]))
    return keys


def _spelled_again(text: str, words: list[tuple[int, int]], chosen: list[int], free: np.ndarray, numbers: set[str]) -> Iterator[tuple[int, int]]:
    """Places ``(first, last)`` in ``chosen`` of neighbouring free words that spell a base number again, from right to left.

    Of the runs that end in one word, the longest whose digits are the end of a base number, but for a 0 before them, is taken, else the
    shortest with its last ``LEAST_DIGITS`` digits. No run has more than ``MOST_DIGITS`` digits, so each word opens few.
    """
    ends = {n[-LEAST_DIGITS:] for n in numbers}
    tails = {n[-size:] for n in numbers for size in range(LEAST_DIGITS, len(n) + 1)}
    own = [_digits(text[slice(*words[i])]) if free[at] else "" for at, i in enumerate(chosen)]
    last = len(chosen) - 1
    while last >= 0:
        digits, first, tail, other = own[last], last, last, last
        while digits and len(digits) <= MOST_DIGITS:
            if digits[-LEAST_DIGITS:] in ends and (first == last or _NUMBER.fullmatch(_EDGE.sub("", text[words[chosen[first]][0]:words[chosen[last]][1]]))):
                if digits in tails or digits.removeprefix("0") in tails:
                    tail = first
                elif other == last and len(own[last]) < LEAST_DIGITS:
                    other = first
            before = first - 1
            if before < 0 or not own[before] or chosen[before] != chosen[first] - 1 or text[words[chosen[before]][1]:words[chosen[first]][0]] != " ":
                break
            digits, first = own[before] + digits, before
        begin = tail if tail < last else other
        if begin < last:
            yield begin, last
        last = begin - 1


def graph(text: str, spans: list[tuple[int, int, int]]) -> Graph:
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    chosen = [i for i, (a, b) in enumerate(words) if "@" in text[a:b] or _DIGIT.search(text, a, b)]
    spell = lambda i, j: text[words[i][0]:words[j][1]] if 0 <= i and j < len(words) else ""
    starts, ends = (np.array([words[i][side] for i in chosen], np.int64) for side in (0, 1))
    kinds, inner, more = np.zeros(len(chosen), np.int64), np.zeros(len(chosen), bool), {}
    for kind, a, b in reversed(spans):
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))
        kinds[first:last] = kind + 1
        inner[first + 1:last] = True
    numbers = {d for kind, a, b in spans if KINDS[kind] in ("card", "phone") and len(d := _digits(text[a:b])) >= LEAST_DIGITS}
    if numbers:
        for kind, a, b in spans:
            if KINDS[kind] in ("card", "phone"):
                more.setdefault(int(np.searchsorted(ends, a, "right")), set()).add(("digits", _digits(text[a:b])[-LEAST_DIGITS:]))
        for first, last in _spelled_again(text, words, chosen, kinds == 0, numbers):
            inner[first + 1:last + 1] = True
    heads = np.flatnonzero(~inner)
    tails = np.append(heads[1:], len(chosen)) - 1
    places, rows, edges, held = [], [], [], {}
    labels = kinds[heads]
    for at, (first, last) in enumerate(zip(heads.tolist(), tails.tolist())):
        i, j = chosen[first], chosen[last]
        places.append((words[i][0], words[j][1]))
        rows.append(_features(spell(i, j), spell(i - 1, i - 1), spell(j + 1, j + 1)))
        if at and chosen[first - 1] == i - 1:
            edges.append((at - 1, at, 0))
        keys = _keys(spell(i, j))
        for member in range(first, last + 1) if first < last else ():
            keys |= _keys(spell(chosen[member], chosen[member]))
        for member in range(first, last + 1):
            keys |= more.get(member, set())
        for key in sorted(keys):
            held.setdefault(key, []).append(at)
    tied, loose = np.zeros(len(places), bool), []
    for at in map(np.array, held.values()):
        known, free = at[labels[at] > 0], at[labels[at] == 0]
        loose.append(free if not len(known) else known)
        if len(known) and len(free):
            after = np.searchsorted(known, free)
            left, right = known[np.maximum(after - 1, 0)], known[np.minimum(after, len(known) - 1)]
            near = np.where(np.abs(free - left) <= np.abs(right - free), left, right)
            edges += [(min(i, j), max(i, j), 1) for i, j in zip(free.tolist(), near.tolist())]
            tied[free] = True
    edges += [(i, j, 1) for at in loose for i, j in zip(at[:-1].tolist(), at[1:].tolist()) if not (tied[i] and tied[j])]
    return Graph(places, np.array(rows, np.float64).reshape(-1, N_FEATURES), labels, np.array(sorted(set(edges)), np.int64).reshape(-1, 3))


class Weights(NamedTuple):
    words: np.ndarray  # label x feature
    pairs: np.ndarray  # (chain, skip) x label x label


def start_weights() -> Weights:
    n = len(KINDS) + 1
    return Weights(np.zeros((n, N_FEATURES)), np.stack([np.zeros((n, n)), SKIP_PRIOR * np.eye(n)]))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def beliefs(unary: np.ndarray, edges: np.ndarray, pairs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Loopy message passing: beliefs of words (word x label) and of edges (edge x label x label)."""
    n = unary.shape[1]
    if not len(edges):
        return np.exp(unary - _log_sum(unary, 1)[:, None]), np.zeros((0, n, n))
    a, b, count = edges[:, 0], edges[:, 1], len(edges)
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    forth = pairs[edges[:, 2]]
    potential = np.concatenate([forth, forth.transpose(0, 2, 1)])
    messages = np.zeros((2 * count, n))
    back = np.concatenate([np.arange(count, 2 * count), np.arange(count)])
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, target, messages)
        cavity = total[source] - messages[back]
        new = _log_sum(cavity[:, :, None] + potential, 1)
        new -= _log_sum(new, 1)[:, None]
        change = np.abs(new - messages).max()
        messages = new if _ == 0 else DAMPING * messages + (1 - DAMPING) * new
        if change < 1e-4:
            break
    total = unary.copy()
    np.add.at(total, target, messages)
    cavity = total[source] - messages[back]
    both = cavity[:count, :, None] + cavity[count:, None, :] + forth
    both -= _log_sum(both.reshape(count, -1), 1)[:, None, None]
    return np.exp(total - _log_sum(total, 1)[:, None]), np.exp(both)


def train(graphs: list[Graph], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Weights:
    prior = start_weights()
    words, pairs = prior.words.copy(), prior.pairs.copy()
    random = np.random.default_rng(seed)
    for epoch in range(epochs):
        pace = rate / (1 + epoch)
        for i in random.permutation(len(graphs)):
            g = graphs[i]
            own, both = beliefs(g.features @ words.T, g.edges, pairs, rounds(g))
            own[np.arange(len(own)), g.labels] -= 1.0
            words -= pace * (own.T @ g.features / max(1.0, len(own) ** 0.5) + 1e-4 * words)
            for kind in (0, 1):
                mine = g.edges[:, 2] == kind
                if mine.any():
                    step = both[mine].sum(axis=0)
                    np.subtract.at(step, (g.labels[g.edges[mine, 0]], g.labels[g.edges[mine, 1]]), 1.0)
                    pairs[kind] -= pace * (step / max(1.0, mine.sum() ** 0.5) + 1e-2 * (pairs[kind] - prior.pairs[kind]))
        pairs = np.stack([pairs[0], (pairs[1] + pairs[1].T) / 2])
    return Weights(words, pairs)


def _spread(g: Graph, tied: np.ndarray) -> tuple[np.ndarray, int]:
    """Words that skip edges tie, directly or through others, to the words of ``tied``, and the largest number of edges between."""
    skips, depth = g.edges[g.edges[:, 2] == 1], 0
    while len(skips):
        more = tied.copy()
        more[skips[tied[skips[:, 0]], 1]] = True
        more[skips[tied[skips[:, 1]], 0]] = True
        if (more == tied).all():
            break
        tied, depth = more, depth + 1
    return tied, depth


def _tied(g: Graph, kind: int) -> np.ndarray:
    """Words that skip edges tie, directly or through others, to a base word of ``kind``."""
    return _spread(g, g.labels == kind)[0]


def rounds(g: Graph) -> int:
    """Most rounds of messages: they stop once nothing changes, and reach every word that is tied to a base word."""
    return ROUNDS * (1 + _spread(g, g.labels > 0)[1])


def added_spans(text: str, spans: list[tuple[int, int, int]], weights: Weights) -> list[tuple[int, int, int]]:
    """Spans beyond the base ones; none of them overlaps a base span."""
    if not spans:
        return []
    g = graph(text, spans)
    if not (g.labels == 0).any() or not (g.edges[:, 2] == 1).any():
        return []
    unary = g.features @ weights.words.T
    known = g.labels > 0
    unary[known] = -50.0 - 2 * np.abs(weights.pairs).max() * len(g.edges)  # more than all messages together
    unary[known, g.labels[known]] = 0.0
    own, _ = beliefs(unary, g.edges, weights.pairs, rounds(g))
    found = []
    for kind in range(1, len(KINDS) + 1):
        for at in np.flatnonzero(~known & (own[:, kind] >= BELIEF) & _tied(g, kind)):
            a, b = g.places[at]
            word = text[a:b]
            core = _EDGE.sub("", word)
            if core:
                a += word.index(core)
                b = a + len(core)
                if not any(x < b and a < y for _, x, y in spans):
                    found.append((kind - 1, a, b))
    return found


def all_spans(text: str, weights: Weights) -> list[tuple[int, int, int]]:
    spans = base_spans(text)
    return spans + added_spans(text, spans, weights)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans are one."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind]}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    working_for("personal data")
    for part in slices(batches):
        rows = []
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            g = graph(text, base_spans(text))
            if len(g.places):
                rows.append((doc_id, len(text), g.features.astype(np.int8).ravel().tolist(), g.labels.tolist(), g.edges.ravel().tolist()))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "size", "features", "labels", "edges"])


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    rows.sort(key=lambda r: (r["doc_id"], r["size"]))
    w = train([Graph([], np.array(r["features"], np.float64).reshape(-1, N_FEATURES), np.array(r["labels"], np.int64),
                     np.array(r["edges"], np.int64).reshape(-1, 3)) for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([w.words.ravel().tolist()]), pa.array([w.pairs.ravel().tolist()])], ["words", "pairs"])


def learn(documents: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from a bounded sample of the documents that hold a digit or an ``@``."""
    usable = documents.where(F.col("text").rlike("[0-9@]") & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    chosen = usable.where(place < sample / max(1, usable.count())).limit(2 * sample)
    examples = chosen.mapInArrow(_examples, "doc_id long, size long, features array<byte>, labels array<int>, edges array<int>")
    rows = examples.coalesce(1).mapInArrow(_train_task, "words array<double>, pairs array<double>").collect()
    if not rows:
        return start_weights()
    n = len(KINDS) + 1
    return Weights(np.array(rows[0]["words"]).reshape(n, N_FEATURES), np.array(rows[0]["pairs"]).reshape(2, n, n))


def _finder(weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                text = text or ""
                spans = base_spans(text)
                more = added_spans(text, spans, weights)
                count = [sum(1 for s in spans if s[0] == k) for k in range(len(KINDS))]
                rows.append((doc_id, *count, hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + more), len(more)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
    return run


def personal_data(documents: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Counts and checksum of the base spans, and all spans, of every document."""
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(_finder(weights or learn(documents)), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                              "base_sha256 string, spans string, n_added long")
