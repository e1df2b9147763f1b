"""Repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds: of every window of ``WINDOW`` successive word k-mers, the one with the smallest hash (a minimizer), so equal
   runs of ``K + WINDOW - 1`` words always share a seed. Every whole text is read.
2. A seed that several documents hold is joined with its first holder (smallest id, then position), not with
   all of them: a passage with a million copies gives a million matches.
3. The matches of two documents, as points (position here, position there), are merged into diagonal runs. A
   sweep over the runs keeps, in a Fenwick tree over the other document's positions, the best chain that ends
   before each place; a gap costs in proportion to the words it skips on both sides.
4. Each chain is aligned word by word: runs are compared, gaps between them are filled by edit distance, the
   ends are extended as long as the texts agree again soon after a difference. Stretches of at least
   ``min_words`` words with an identity of at least ``min_identity`` are reported.
5. The first holders of a passage's seeds may be scattered over documents that hold parts of it only. Where seeds follow each
   other over ``min_words`` words and one of them lies in no reported passage, whole runs of ``min_words`` words around it
   are joined with the first holder of the whole run, and steps 3 and 4 are taken for those that lie in no reported
   passage (but for fewer words at its ends than a seed has). So no exact repeat is left out, whoever holds its parts. A
   repeat with differences is found by its seeds' first holders only, unless it holds an exact run of ``min_words`` words.

Rows: ``(doc_id, start_word, n_words, first_doc_id, first_start_word, first_n_words, matches)``; positions count words.
The document with the smaller id holds the first copy and is not reported for it.

Defined cases: a NULL or short text has no seeds; a document without id takes no part; repeated rows of one
id are one document; a passage that repeats within its own document only is not reported, and
a run of one repeating phrase is matched for as long as the first document's run is. Columns beyond id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import discard, id_bitmap, id_place, in_bitmap, settle, slices
from .jaccard_join import mix, ngram_hashes, word_hashes

K, WINDOW = 5, 10
MIN_WORDS, MIN_IDENTITY, MIN_SEEDS = 50, 0.8, 2
#: Chaining: words skipped within a diagonal run, and the cost of a skipped word against one seed.
RUN_GAP, GAP_COST = 40, 1 / 80
#: Alignment: words beyond a chain that may belong to its passage, largest jump at the ends, largest gap that is filled.
MARGIN, JUMP, AGREE, FILL = 400, 8, 4, 120
ROWS = ("doc_id long, start_word int, n_words int, first_doc_id long, first_start_word int, first_n_words int, matches int")


def minimizers(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of every window."""
    if len(hashes) <= window:
        return np.array([int(hashes.argmin())]) if len(hashes) else np.zeros(0, np.int64)
    low = np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(axis=1) + np.arange(len(hashes) - window + 1)
    return np.unique(low)


def told_apart(grams: np.ndarray, k: int = K) -> np.ndarray:
    """K-mer hashes in which the k-mers of a run that repeats every 1 to ``k - 1`` words differ by their place in the run.

    Without this, all k-mers of such a run would be one seed, and only its first place could be matched.
    """
    out = grams
    for period in range(k - 1, 0, -1):
        again = np.zeros(len(grams), bool)
        again[period:] = grams[period:] == grams[:-period]
        if again.any():
            place = np.arange(len(grams))
            offset = place - np.maximum.accumulate(np.where(again, -1, place))
            out = np.where(again, mix(grams + offset.astype(np.uint64)), out)
    return out


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        ids, hashes, places = [], [], []
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            words = word_hashes(text)
            if len(words) < K:
                continue
            grams = told_apart(ngram_hashes(words, K))
            at = minimizers(grams)
            ids.append(np.full(len(at), doc_id, np.int64))
            hashes.append(grams[at].view(np.int64))
            places.append(at.astype(np.int32))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, ids, places)], ["h", "doc_id", "pos"])


class _Fenwick:
    """Largest value, and who gave it, over the places before a place."""

    def __init__(self, size: int):
        self.values, self.owners = [-1e18] * (size + 1), [-1] * (size + 1)

    def put(self, place: int, value: float, owner: int) -> None:
        values, owners, place = self.values, self.owners, place + 1
        while place < len(values):
            if value > values[place]:
                values[place], owners[place] = value, owner
            place += place & -place

    def best_before(self, place: int) -> tuple[float, int]:
        best, owner = -1e18, -1
        while place > 0:
            if self.values[place] > best:
                best, owner = self.values[place], self.owners[place]
            place -= place & -place
        return best, owner


def runs_of(here: np.ndarray, there: np.ndarray, gap: int = RUN_GAP) -> np.ndarray:
    """Matches merged into diagonal runs: rows ``(first here, last here, first there, last there, seeds)``."""
    diagonal = here - there
    order = np.lexsort((here, diagonal))
    x, y, d = here[order], there[order], diagonal[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(x) > gap)]))
    last = np.append(first[1:], len(x)) - 1
    return np.stack([x[first], x[last], y[first], y[last], last - first + 1], axis=1)


def chains_of(runs: np.ndarray, cost: float = GAP_COST) -> list[np.ndarray]:
    """Collinear chains of runs, best first; every run is in one chain at most."""
    if len(runs) == 1:
        return [runs]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    begin, end, there, there_end, weight = (runs[:, i].tolist() for i in range(5))
    places = np.unique(runs[:, 3])
    put_at, ask_at = np.searchsorted(places, runs[:, 3]).tolist(), np.searchsorted(places, runs[:, 2]).tolist()
    by_end = sorted(range(len(runs)), key=end.__getitem__)
    tree, waiting = _Fenwick(len(places)), 0
    score, before = [0.0] * len(runs), [-1] * len(runs)
    for i in range(len(runs)):
        while waiting < len(by_end) and end[by_end[waiting]] < begin[i]:
            j = by_end[waiting]
            tree.put(put_at[j], score[j] + cost * (end[j] + there_end[j]), j)
            waiting += 1
        best, j = tree.best_before(ask_at[i])
        gain = best - cost * (begin[i] + there[i])
        score[i] = weight[i] + max(0.0, gain)
        before[i] = j if gain > 0 else -1
    used, found = [False] * len(runs), []
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        chain, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(at)
            at = before[at]
        if chain:
            found.append(runs[chain[::-1]])
    return found


def _chain_rows(least: int):
    """Chains of at least ``least`` seeds of each pair of documents; rows come sorted by (doc_id, first_doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        out: list[tuple] = []

        def pairs(table: pa.Table) -> None:
            if not table.num_rows:
                return
            doc, first, here, there = (table.column(c).to_numpy() for c in ("doc_id", "first_doc_id", "pos", "first_pos"))
            bounds = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(first) != 0), [True]]))
            for i in np.flatnonzero(np.diff(bounds) >= least):
                low, high = bounds[i], bounds[i + 1]
                for chain in chains_of(runs_of(here[low:high].astype(np.int64), there[low:high].astype(np.int64))):
                    if chain[:, 4].sum() >= least:
                        out.append((int(doc[low]), int(first[low]), int(chain[0, 0]), int(chain[-1, 1]), int(chain[0, 2]), int(chain[-1, 3]),
                                    chain[:, :4].ravel().tolist()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                               ["doc_id", "first_doc_id", "low", "high", "first_low", "first_high", "runs"])
            out.clear()
            return batch

        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch])
            doc, first = table.column("doc_id").to_numpy(), table.column("first_doc_id").to_numpy()
            if not len(doc):
                continue
            cut = int(np.flatnonzero((doc != doc[-1]) | (first != first[-1]))[-1]) + 1 if (doc[0], first[0]) != (doc[-1], first[-1]) else 0
            pairs(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks().to_batches()[0]
            if out:
                yield flush()
        if rest is not None:
            pairs(pa.Table.from_batches([rest]))
        if out:
            yield flush()
    return run


def _same_run(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    odd = np.flatnonzero(a[:n] != b[:n])
    return int(odd[0]) if len(odd) else n


def _fill(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Equal words of a gap, by edit distance: ``(place here, place there)``."""
    if not len(a) or not len(b) or len(a) > FILL or len(b) > FILL:
        return []
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    equal = a[:, None] == b[None, :]
    if not equal.any():
        return []
    for i in range(1, len(a) + 1):  # longest common subsequence
        up, diagonal = table[i - 1, 1:], table[i - 1, :-1] + equal[i - 1]
        table[i, 1:] = np.maximum.accumulate(np.maximum(up, diagonal))
    i, j, found = len(a), len(b), []
    while i and j:
        if equal[i - 1, j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return found[::-1]


def _extend(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Equal words from the start of two word rows on, over short differences."""
    i = j = 0
    found: list[tuple[int, int]] = []
    while True:
        run = _same_run(a[i:], b[j:])
        found += [(i + s, j + s) for s in range(run)]
        i, j = i + run, j + run
        jumps = sorted(((x, y) for x in range(JUMP + 1) for y in range(JUMP + 1) if x + y), key=lambda p: (max(p), p))
        step = next(((x, y) for x, y in jumps if i + x + AGREE <= len(a) and j + y + AGREE <= len(b)
                     and (a[i + x:i + x + AGREE] == b[j + y:j + y + AGREE]).all()), None)
        if step is None:
            return found
        i, j = i + step[0], j + step[1]


def align(here: np.ndarray, there: np.ndarray, runs: list[tuple[int, int, int, int]], k: int = K) -> list[tuple[int, int]]:
    """Equal words of a chain: ``(place here, place there)``, both rising."""
    found: list[tuple[int, int]] = []
    x = y = None
    for begin, end, there_begin, there_end in runs:
        if x is None:
            back = _extend(here[:begin][::-1], there[:there_begin][::-1])
            found = [(begin - 1 - i, there_begin - 1 - j) for i, j in reversed(back)]
        else:
            skip = max(0, x - begin, y - there_begin)
            begin, there_begin = begin + skip, there_begin + skip
            found += [(x + i, y + j) for i, j in _fill(here[x:begin], there[y:there_begin])]
        stop, there_stop = min(end + k, len(here)), min(there_end + k, len(there))
        length = max(0, min(stop - begin, there_stop - there_begin))
        equal = np.flatnonzero(here[begin:begin + length] == there[there_begin:there_begin + length])
        found += [(begin + int(i), there_begin + int(i)) for i in equal]
        x, y = max(begin + length, x or 0), max(there_begin + length, y or 0)
    return found + [(x + i, y + j) for i, j in _extend(here[x:], there[y:])]


def stretches(found: list[tuple[int, int]], min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> list[tuple[int, int, int, int, int]]:
    """``(start, words, first start, first words, matches)`` of the stretches that are long and alike enough.

    A stretch that is not alike enough is cut at its widest difference.
    """
    out, todo = [], [(0, len(found))]
    while todo:
        low, high = todo.pop()
        if high - low < min_words * min_identity:
            continue
        (x, y), (x_end, y_end) = found[low], found[high - 1]
        words, first_words = x_end - x + 1, y_end - y + 1
        if words >= min_words and high - low >= min_identity * max(words, first_words):
            out.append((x, words, y, first_words, high - low))
        elif words >= min_words:
            wide = max(range(low + 1, high), key=lambda i: max(found[i][0] - found[i - 1][0], found[i][1] - found[i - 1][1]))
            todo += [(low, wide), (wide, high)]
    return sorted(out)


def _aligner(min_words: int, min_identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            rows = []
            for r in part.to_pylist():
                here, there = np.frombuffer(r["words"], "<u4"), np.frombuffer(r["first_words"], "<u4")
                flat = np.array(r["runs"], np.int64).reshape(-1, 4)
                flat = flat - np.array([r["from_word"], r["from_word"], r["first_from_word"], r["first_from_word"]])
                for x, n, y, m, same in stretches(align(here, there, [tuple(f) for f in flat.tolist()]), min_words, min_identity):
                    rows.append((r["doc_id"], x + r["from_word"], n, r["first_doc_id"], y + r["first_from_word"], m, same))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [c.split()[0] for c in ROWS.split(", ")])
    return run


def _words(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            kept = in_bitmap(bits, part.column(2))
            for low in range(0, len(kept), 256):
                rows = part.take(pa.array(kept[low:low + 256]))
                packed = [(word_hashes(t) & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(packed, pa.binary())], ["doc_id", "words"])
    return run


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def _dense(places: DataFrame, least: int) -> DataFrame:
    """Rows ``(doc_id, pos, ...)`` whose seeds follow each other within ``WINDOW`` places over at least ``least`` places, with ``low`` and ``high``."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    far = F.coalesce((F.col("pos") - F.lag("pos").over(order) > WINDOW).cast("long"), F.lit(0).cast("long"))
    group = Window.partitionBy("doc_id", "stretch")
    numbered = places.withColumn("far", far).withColumn("stretch", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = numbered.withColumn("low", F.min("pos").over(group)).withColumn("high", F.max("pos").over(group))
    return ends.where(F.col("high") - F.col("low") >= least).drop("far", "stretch")


def _unexplained(places: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """``places`` with ``open``: does no passage of ``found`` hold the ``length`` words from ``pos`` on?

    Fewer words than a seed beyond a passage count as held: next to a passage, so few are alike by chance.
    """
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in places.schema}
    passages = found.select(*({**none, "doc_id": F.col("doc_id"), "pos": (F.col("start_word") - (K - 1)).alias("pos")}[c] for c in places.columns),
                            (F.col("start_word") + F.col("n_words") + (K - 1)).alias("end"))
    both = places.withColumn("end", F.lit(None).cast("int")).union(passages).withColumn("is_place", F.col("end").isNull())
    before = Window.partitionBy("doc_id").orderBy("pos", "is_place").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    return both.withColumn("open", reach < F.col("pos") + length).where("is_place").drop("end", "is_place")


def _whole_grams(length: int):
    """Hashes of all runs of ``length`` words that begin within the ranges of a document."""
    offsets = sorted({*range(0, length - K, K), length - K})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            hashes, ids, places = [], [], []
            for doc_id, words, ranges in zip(*(part.column(c).to_pylist() for c in ("doc_id", "words", "ranges"))):
                words = np.frombuffer(words, "<u4").astype(np.uint64)
                count = len(words) - length + 1
                if count < 1:
                    continue
                wanted = np.zeros(count + 1, np.int64)
                for r in ranges:
                    low, high = max(0, r["low"] - WINDOW + 1), min(count, r["high"] - (length - K - WINDOW + 1) + 1)
                    if low < high:
                        wanted[low] += 1
                        wanted[high] -= 1
                at = np.flatnonzero(np.cumsum(wanted[:-1]))
                if not len(at):
                    continue
                grams = told_apart(ngram_hashes(words, K))
                whole = np.zeros(len(at), np.uint64)
                for o in offsets:
                    whole = mix(whole + grams[at + o])
                ids.append(np.full(len(at), doc_id, np.int64))
                hashes.append(whole.view(np.int64))
                places.append(at.astype(np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, ids, places)], ["h", "doc_id", "pos"])
    return run


def _with_first_holder(seeds: DataFrame) -> DataFrame:
    """Seeds joined with their first holder, in other documents than it."""
    held = seeds.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.max("doc_id").alias("last"))
    shared = held.where("f.doc_id <> last").select("h", F.col("f.doc_id").alias("first_doc_id"), F.col("f.pos").alias("first_pos"))
    return seeds.join(shared, "h").where("doc_id <> first_doc_id")


def _chains(matches: DataFrame, least: int) -> DataFrame:
    sorted_ = matches.select("doc_id", "first_doc_id", "pos", "first_pos").repartition("doc_id").sortWithinPartitions("doc_id", "first_doc_id", "pos")
    return settle(sorted_.mapInArrow(_chain_rows(least), "doc_id long, first_doc_id long, low int, high int, first_low int, first_high int, runs array<int>"), "passage-chains")


def _hashed(texts: DataFrame, used: DataFrame) -> DataFrame:
    """``(doc_id, words)`` of the documents of ``used``, and of others that an id filter passes."""
    return texts.withColumn("place", id_place("doc_id")).mapInArrow(_words(id_bitmap(used, "doc_id")), "doc_id long, words binary").dropDuplicates(["doc_id"])


def _aligned(texts: DataFrame, chains: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    words = _hashed(texts, chains.select("doc_id").union(chains.select("first_doc_id")))
    margin = F.lit(MARGIN)
    reach = chains.withColumn("from_word", F.greatest(F.col("low") - margin, F.lit(0))).withColumn(
        "first_from_word", F.greatest(F.col("first_low") - margin, F.lit(0)))
    cut = lambda start, end: F.substring("words", start * 4 + 1, (end - start + margin + K) * 4)
    here = reach.join(words, "doc_id").withColumn("own", cut(F.col("from_word"), F.col("high"))).drop("words")
    there = here.join(words.withColumnRenamed("doc_id", "first_doc_id"), "first_doc_id").withColumn(
        "first_words", cut(F.col("first_from_word"), F.col("first_high"))).drop("words").withColumnRenamed("own", "words")
    return there.select("doc_id", "first_doc_id", "from_word", "first_from_word", "runs", "words", "first_words").mapInArrow(
        _aligner(min_words, min_identity), ROWS)


def repeated_passages(documents: DataFrame, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """One row per passage of a document that an earlier document holds too."""
    texts = _texts(documents)
    used_up: list = []
    seeds = settle(texts.mapInArrow(_seeds, "h long, doc_id long, pos int"), "passage-seeds", used_up)
    matches = settle(_with_first_holder(seeds), "passage-matches", used_up)
    found = settle(_aligned(texts, _chains(matches, MIN_SEEDS), min_words, min_identity), "passage-found")

    length = max(min_words, K + WINDOW - 1)
    least = length - K - 2 * (WINDOW - 1)
    places = _unexplained(matches.select("h", "doc_id", "pos"), found, K)
    near = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(K - length, length - K)
    asked = _dense(places, least).withColumn("open", F.max("open").over(near)).where("open").select("h").distinct()
    ranges = settle(_dense(seeds.join(asked, "h").select("doc_id", "pos"), least).select("doc_id", "low", "high").distinct(), "passage-ranges")
    discard(used_up)
    held = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    grams = settle(_hashed(texts, ranges).join(held, "doc_id").mapInArrow(_whole_grams(length), "h long, doc_id long, pos int"), "passage-grams", used_up)
    open_ = _unexplained(_with_first_holder(grams).select("doc_id", "first_doc_id", "pos", "first_pos"), found, length).where("open")
    chains = _chains(open_, 1)
    discard(used_up)
    return found.union(_aligned(texts, chains, min_words, min_identity))
