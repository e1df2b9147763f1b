"""Exact n-gram Jaccard join by vertical partitioning, with the components of its links.

A document's set holds the 64-bit hashes of its distinct word n-grams. Copies of a set are one class from the
start. The steps, all exact for links of similarity ``percent`` / 100 or more:

1. A document that shares fewer than that share of its own n-grams with other sets has no link. Over the
   first quarter of the hash space it is seen, for each n-gram, whether one set or several hold it; a set
   with too many n-grams of its own is done. Only the sets that remain are taken in full, and the test is
   repeated on all their n-grams.
2. N-grams have one global order, rare ones first, cut at quantiles into ``FRAGMENTS`` fragments; each set is cut
   into segments accordingly. The overlap of a candidate pair is counted for each fragment on its own and
   summed per pair.
3. Candidates share an n-gram of their prefixes, and pass the position bound and the bit-signature bound on
   their overlap. So that a large group of near copies is not paired with itself, every n-gram first names
   ``PIVOTS`` of its sets, and sets are only compared with those: each with one of them first, then with the ones that this did not
   connect it with. After these links are made into components,
   an n-gram whose sets are of one component is done; elsewhere the sets outside its largest component are
   candidates of the sets of other components, whatever their number. Again each is compared with a few of them first, and then
   all pairs whose sets are still apart. No candidate is left out: a pair is
   skipped only when both sets are known to be connected.

Defined cases: a NULL or wordless text has an empty set and is linked with nothing; with fewer words than ``n`` the
whole sequence is one n-gram; repeated rows are one class; a NULL id never is the smallest of a component
unless it holds no other. Columns beyond id and text are not read. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Recent, byte_words, discard, id_bitmap, id_place, in_bitmap, owned, settle, slices, working_for
from .components import components

N, PERCENT, FRAGMENTS, PIVOTS, FIRST_SHARE = 5, 80, 8, 3, 0.25
SIGNATURE_WORDS = 16
_LONG = np.uint64
_SIG = [f"sig{i}" for i in range(SIGNATURE_WORDS)]


class _WordHashes(Recent):
    def __missing__(self, word: bytes) -> int:
        found = self.again(word)
        return self.keep(word, xxhash.xxh64_intdigest(word)) if found is None else found


_words = owned("words", _WordHashes(200_000))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all their bits."""
    x = (x ^ (x >> _LONG(33))) * _LONG(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _LONG(33))) * _LONG(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _LONG(33))


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word, A-Z lowered."""
    working_for("words")
    words = byte_words(text, lower=True)
    return np.fromiter(map(_words.__getitem__, words), _LONG, len(words))


def ngram_hashes(words: np.ndarray, n: int = N) -> np.ndarray:
    """One hash per window of ``n`` words; fewer words are one window."""
    if not len(words):
        return words
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, _LONG)
    for step in range(size):
        total = total * _LONG(0x9E3779B97F4A7C15) + words[step:len(words) - size + 1 + step]
    return mix(total)


def ngram_set(text: str | None, n: int = N) -> np.ndarray:
    return np.unique(ngram_hashes(word_hashes(text), n))


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit fingerprint of a set, as a signed number."""
    total = int(mix(hashes ^ _LONG(0x5851F42D4C957F2D)).sum(dtype=_LONG)) + len(hashes) * 0x2545F4914F6CDD1D
    return ((total & 0xFFFFFFFFFFFFFFFF) ^ 0x8000000000000000) - 0x8000000000000000


def signature(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * SIGNATURE_WORDS, np.uint8)
    bits[(hashes >> _LONG(11)) % _LONG(len(bits))] = 1
    return np.packbits(bits).view("<i8")


def _in_first(hashes: np.ndarray) -> np.ndarray:
    return hashes[hashes < _LONG(int(FIRST_SHARE * 2**64))]


def _summaries(n: int):
    """``(doc_id, n, sid, firsts)``: size and fingerprint of every set, and its n-grams in the first share of the hash space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [ngram_set(t, n) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()),
                 pa.array([_in_first(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "n", "sid", "firsts"])
    return run


def _full_sets(n: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            kept = in_bitmap(bits, part.column(2))
            for small in range(0, len(kept), 256):
                rows = part.take(pa.array(kept[small:small + 256]))
                sets = [ngram_set(t, n) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([set_id(s) for s in sets], pa.int64()),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                     pa.array([signature(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "sid", "hashes", "signature"])
    return run


def _need(n: Column | str, percent: int) -> Column:
    """The least overlap of a set of ``n`` with any set it is linked with."""
    n = F.col(n) if isinstance(n, str) else n
    return F.ceil(n * percent / F.lit(100.0)).cast("long")


def _enough(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    return F.lit(100) * overlap >= F.lit(percent) * (n + m - overlap)


def _own_counts(rows: DataFrame) -> DataFrame:
    """``(sid, own)``: how many of a set's n-grams no other set has. ``rows``: ``(sid, h)``."""
    held = rows.groupBy("h").agg(F.min("sid").alias("sid"), F.max("sid").alias("other"))
    return held.where("sid = other").groupBy("sid").agg(F.count(F.lit(1)).alias("own"))


def _signature_bound(percent: int) -> Column:
    missing = lambda a, b: sum((F.bit_count(F.col(f"{a}.{s}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{s}")))) for s in _SIG), F.lit(0))
    most = F.least(F.col("x.n") - missing("x", "y"), F.col("y.n") - missing("y", "x"))
    return _enough(most, F.col("x.n"), F.col("y.n"), percent)


def _position_bound(percent: int) -> Column:
    """At their first common n-gram, two linked sets have enough left behind it."""
    most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    return _enough(most, F.col("x.n"), F.col("y.n"), percent)


def _pairs(x: Column, y: Column) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _likely(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """``(a, b, na, nb)``: the distinct pairs that pass the signature bound. Signatures are looked up once for each pair."""
    side = lambda name, row: facts.select(F.col("sid").alias(name), F.struct(*facts.columns).alias(row))
    both = pairs.distinct().join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.where(_signature_bound(percent)).select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar enough: overlaps are counted per fragment and summed per pair."""
    parts = segments.select(F.col("sid").alias("a"), "fragment", F.col("hashes").alias("ha"))
    others = segments.select(F.col("sid").alias("b"), "fragment", F.col("hashes").alias("hb"))
    counted = pairs.join(parts, "a").join(others, ["b", "fragment"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("part"))
    return counted.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("o")).where(_enough(F.col("o"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _postings(full: DataFrame, percent: int, full_used: list, used: list) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prefix postings ``(h, sid, n, pos)``, signatures ``(sid, n, sig0...)`` and segments of the sets that may have a link."""
    rows = full.select("sid", F.explode("hashes").alias("h"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    unit = F.shiftrightunsigned("h", 12) / F.lit(float(1 << 52))
    ranked = settle(rows.join(shared, "h").select("sid", "h", (F.col("df") + unit).alias("key")), "jaccard-shared", full_used)
    cuts = ranked.agg(F.percentile_approx("key", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000).alias("c")).first()["c"] or []
    fragment = sum(((F.col("key") > c).cast("int") for c in cuts), F.lit(0))
    held = ranked.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("key", "h", fragment.alias("f")))).alias("shared"))
    sets = (full.select("sid", "n", *(F.get("signature", F.lit(i)).alias(s) for i, s in enumerate(_SIG))).join(held, "sid")
            .withColumn("own", F.col("n") - F.size("shared")).where(F.col("own") <= F.col("n") - _need("n", percent)))
    own = F.transform("shared", lambda t: F.struct(t["h"].alias("h"), t["f"].cast("byte").alias("f")))
    sets = settle(sets.withColumn("shared", own), "jaccard-sets", used)
    discard(full_used)  # all that follows is in the sets
    prefix = F.slice("shared", F.lit(1), (F.col("n") - _need("n", percent) + 1 - F.col("own")).cast("int"))
    postings = sets.select("sid", "n", "own", F.posexplode(prefix).alias("k", "t")).select(
        F.col("t.h").alias("h"), "sid", "n", (F.col("own") + F.col("k")).alias("pos"))
    segments = sets.select("sid", F.explode("shared").alias("t")).groupBy("sid", F.col("t.f").alias("fragment")).agg(F.collect_list("t.h").alias("hashes"))
    return settle(postings, "jaccard-postings", used), sets.select("sid", "n", *_SIG), settle(segments, "jaccard-segments", used)


def _rooted(rows: DataFrame, stars: DataFrame, sid: str, root: str) -> DataFrame:
    """``rows`` with the component of the set in ``sid``."""
    known = stars.select(F.col("u").alias(sid), F.col("v").alias(root))
    return rows.join(known, sid, "left").withColumn(root, F.coalesce(root, sid))


def _a_few(pairs: DataFrame) -> DataFrame:
    """Of the pairs of each set the ones whose other set comes first in ``PIVOTS`` random orders, which all sets share."""
    ends = pairs.select(F.col("a").alias("sid"), F.col("b").alias("other"), *pairs.columns).unionByName(
        pairs.select(F.col("b").alias("sid"), F.col("a").alias("other"), *pairs.columns))
    first = ends.groupBy("sid").agg(*(F.min_by(F.struct(*pairs.columns), F.xxhash64("other", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)))
    return first.select(F.inline(F.array(*(F.col(f"p{i}") for i in range(PIVOTS))))).distinct()


def links(full: DataFrame, percent: int = PERCENT, full_used: list | None = None) -> DataFrame:
    """``(u, v)``: sets and the smallest set of their component. ``full``: ``(sid, n, hashes, signature)``, distinct sets, whose
    table goes with ``full_used`` once it is read."""
    used: list = []
    postings, facts, segments = _postings(full, percent, [] if full_used is None else full_used, used)
    # the first of the pivots is the set with the least before the n-gram: in a group of near copies, the one that differs least from the others
    order = lambda i: F.struct((F.col("pos") if i == 0 else F.lit(0).cast("long")).alias("pos"), F.xxhash64("sid", F.lit(i)).alias("r"), "sid")
    pivots = postings.groupBy("h").agg(*(F.min(order(i)).alias(f"p{i}") for i in range(PIVOTS)), F.count(F.lit(1)).alias("df")).where("df > 1")
    named = pivots.select("h", F.explode(F.array(*(F.struct(F.col(f"p{i}.sid").alias("pivot"), F.lit(i).alias("place")) for i in range(PIVOTS)))).alias("p"), F.col("p0.pos").alias("before"))
    near = settle(postings.select("h", "sid").join(named.select("h", "p.*", "before"), "h").where("sid <> pivot").groupBy("sid", "pivot").agg(
        F.min(F.when(F.col("place") == 0, F.col("before"))).alias("before")), "jaccard-near", used)
    # at first one partner each, on which the sets of a large group mostly agree; then the others, where they may still join something
    one = near.groupBy("sid").agg(F.min_by("pivot", F.struct(F.col("before").isNull(), "before", F.xxhash64("pivot"))).alias("pivot"))
    first = settle(linked(_likely(one.select(*_pairs(F.col("sid"), F.col("pivot"))), facts, percent), segments, percent), "jaccard-links")
    stars = components(first)
    apart = _rooted(_rooted(near, stars, "sid", "r"), stars, "pivot", "s").where("r <> s")
    more = linked(_likely(apart.select(*_pairs(F.col("sid"), F.col("pivot"))), facts, percent), segments, percent)
    first = settle(first.unionByName(more), "jaccard-links")
    stars = components(first)
    placed = _rooted(postings, stars, "sid", "root")
    sizes = placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("h", "main")
    left = placed.join(open_, "h").where("root <> main").alias("x")
    right = placed.alias("y")
    rest = left.join(right, (F.col("x.h") == F.col("y.h")) & (F.col("x.root") != F.col("y.root"))
                     & ((F.col("y.root") == F.col("x.main")) | (F.col("y.root") < F.col("x.root"))) & _position_bound(percent))
    open_pairs = settle(_likely(rest.select(*_pairs(F.col("x.sid"), F.col("y.sid"))), facts, percent), "jaccard-rest", used)
    # again a few partners each first; what they connect need not be compared pair by pair
    some = settle(linked(_a_few(open_pairs), segments, percent), "jaccard-links")
    stars = components(first.unionByName(some))
    left_over = _rooted(_rooted(open_pairs, stars, "a", "r"), stars, "b", "s").where("r <> s").drop("r", "s")
    last = linked(left_over, segments, percent)
    stars = components(first.unionByName(some).unionByName(last))
    discard(used)
    return stars


def join(documents: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document."""
    columns = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first_used: list = []
    # only the first share is stored, until it is counted: the whole sets are made again for the documents that stay open
    hashed = settle(columns.mapInArrow(_summaries(n), "doc_id long, n long, sid long, firsts array<long>"), "jaccard-firsts", first_used)
    summary = settle(hashed.select("doc_id", "n", "sid"), "jaccard-documents")
    own = _own_counts(hashed.select("sid", F.explode("firsts").alias("h")))
    kinds = summary.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("doc_id"))
    open_kinds = settle(kinds.join(own, "sid", "left").where(F.coalesce("own", F.lit(0)) <= F.col("n") - _need("n", percent)).drop("own"), "jaccard-open")
    discard(first_used)
    full = (columns.withColumn("place", id_place("doc_id")).mapInArrow(_full_sets(n, id_bitmap(open_kinds, "doc_id")), "doc_id long, sid long, hashes array<long>, signature array<long>")
            .join(open_kinds.select("sid", "n", F.col("doc_id").alias("chosen")), "sid").where(F.col("doc_id").eqNullSafe(F.col("chosen")))
            .select("sid", "n", "hashes", "signature").dropDuplicates(["sid"]))
    used: list = []
    stars = links(settle(full, "jaccard-full", used), percent, used)
    roots = summary.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(
        stars.select(F.col("u").alias("sid"), "v"), "sid", "left").withColumn("root", F.coalesce("v", "sid"))
    least = roots.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return roots.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
