"""Hard negatives for anchors, by cover trees over norm-augmented vectors.

A positive of an anchor is one of its ``positives`` best other rows of the same label by inner product. A hard
negative for the pair is a row of another label whose score lies in a window below the positive's score;
the ``k`` best of the window are returned.

Rows are packed into blocks of bounded size, and every block carries a cover tree. A vector ``x`` gets one more
component, ``sqrt(M^2 - |x|^2)`` with the largest norm ``M`` of the block; a query gets 0 there. Then
``|q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>``, so distances order a block as inner products do, and a node with centre ``c``
and covering radius ``r`` holds only scores between those of the distances ``d(q', c') + r`` and ``d(q', c') - r``. The levels of the
tree halve the covering radius; a node keeps the largest distance that really occurs, and levels without a
split are left out. The descent opens the most promising nodes first, leaves out every node whose scores all lie
outside the windows that are still open, whose labels are all of the wrong kind or whose best score is below the
``k``-th found, and verifies the rows of leaves by exact integer scores.

Blocks meet in a grid: each block of queries once with each block of candidates, so a cell is a bounded piece of
work whatever label or vector a third of the rows has, and no table passes the driver. Trees are built once and stored with their block.

Defined cases: a row whose id, label or vector is NULL, or whose vector holds NULL, NaN or an infinite component, takes no part.
Vectors of different lengths are compared as if the shorter one ended in zeros. Rows that repeat id, label and
weights are one row; rows that share an id only are rows each, and never candidates of each other. An anchor without positives, or
with an empty window (a negative positive score), has no result. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import grid, settle

#: Rows of a block with a tree, anchors of a block, rows of a leaf, and nodes that are opened at a time.
CANDIDATE_ROWS, QUERY_ROWS, LEAF_ROWS, OPENED = 4096, 256, 24, 12
#: Above this bound on a score, scores are summed as integers, not as exact doubles.
EXACT = float(1 << 53)
_FLAT = "ids array<long>, keys array<long>, labels array<long>, dims int, weights array<long>"
_TREE = f"{_FLAT}, centre array<int>, radius array<double>, child array<int>, children array<int>, low array<int>, high array<int>"


class Tree:
    """A cover tree over the rows of one block, whose rows are put in the order of its leaves."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        x = weights.astype(np.float64)
        norms = (x * x).sum(1)
        self.most = float(norms.max()) if len(x) else 0.0
        self.points = np.hstack([x, np.sqrt(np.maximum(self.most - norms, 0))[:, None]])

    def build(self) -> dict[str, np.ndarray]:
        points, order = self.points, []
        centre, radius, child, children, low, high = ([] for _ in range(6))

        def add(c, r):
            for into, value in ((centre, c), (radius, r), (child, 0), (children, 0), (low, 0), (high, 0)):
                into.append(value)

        def close(node, rows):
            """The node and all below it cover ``rows``, which are next in order."""
            low[node], high[node] = len(order), len(order) + len(rows)
            order.extend(rows.tolist())

        far = np.sqrt(((points - points[0]) ** 2).sum(1))
        add(0, float(far.max()))
        top = max(radius[0], 1e-300)
        # depth first, so that the rows below a node are consecutive; a node is closed after its last child
        work = [(0, np.arange(len(points)), far)]
        while work:
            node, rows, distance = work.pop()
            if rows is None:
                first, last = child[node], child[node] + children[node]
                low[node], high[node] = min(low[first:last]), max(high[first:last])
                continue
            if len(rows) <= LEAF_ROWS or radius[node] <= 0:
                close(node, rows)
                continue
            level = math.floor(math.log2(top / radius[node])) + 1
            cover = top / 2.0 ** level
            groups, left, at = [], rows, distance
            own = centre[node]
            while len(left):
                near = at <= cover
                near[left == own] = True
                groups.append((own, left[near], at[near]))
                left = left[~near]
                if len(left):
                    own = left[0]
                    at = np.sqrt(((points[left] - points[own]) ** 2).sum(1))
            child[node], children[node] = len(centre), len(groups)
            work.append((node, None, None))
            for own, members, at in groups:
                add(int(own), float(at.max()))
                work.append((len(centre) - 1, members, at))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return {"order": np.array(order, np.int64), "centre": place[np.array(centre)], "radius": np.array(radius), "child": np.array(child, np.int32),
                "children": np.array(children, np.int32), "low": np.array(low, np.int32), "high": np.array(high, np.int32)}


def _matrix(starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of different lengths, ended with zeros."""
    lengths = np.diff(starts)
    out = np.zeros((len(lengths), int(lengths.max()) if len(lengths) else 0), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(starts[:-1], lengths)] = values
    return out


def _one(values, kind) -> pa.Array:
    return pa.array([np.ascontiguousarray(values)], pa.list_(kind))


def _packed(part: pa.RecordBatch, with_tree: bool) -> pa.RecordBatch:
    ids, keys, labels = (np.asarray(part.column(i), np.int64) for i in range(3))
    lists = part.column(3)
    offsets = np.asarray(lists.offsets, np.int64)
    weights = _matrix(offsets - offsets[0], np.asarray(lists.flatten(), np.int64))
    arrays = []
    if with_tree:
        _, kept = np.unique(np.stack([ids, keys]), axis=1, return_index=True)
        ids, keys, labels, weights = ids[kept], keys[kept], labels[kept], weights[kept]
        tree = Tree(weights).build()
        order = tree.pop("order")
        ids, keys, labels, weights = ids[order], keys[order], labels[order], weights[order]
        arrays = [_one(tree[n], pa.float64() if n == "radius" else pa.int32()) for n in ("centre", "radius", "child", "children", "low", "high")]
    names = [f.split()[0] for f in (_TREE if with_tree else _FLAT).split(", ")]
    long = pa.int64()
    return pa.RecordBatch.from_arrays([_one(ids, long), _one(keys, long), _one(labels, long), pa.array([weights.shape[1]], pa.int32()),
                                       _one(weights.ravel(), long), *arrays], names)


def blocks(rows: DataFrame, size: int, with_tree: bool) -> DataFrame:
    """``(id, key, label, weights)`` rows packed into blocks of at most ``size`` rows, with a tree each if asked for."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                kept.append(batch.slice(start, size))
                count += kept[-1].num_rows
                while count >= size:
                    whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                    yield _packed(whole.slice(0, size), with_tree)
                    kept, count = [whole.slice(size)], count - size
        if count:
            yield _packed(pa.Table.from_batches(kept).combine_chunks().to_batches()[0], with_tree)
    return rows.mapInArrow(pack, _TREE if with_tree else _FLAT)


class Search:
    """Best-first descents of one stored tree."""

    def __init__(self, ids, keys, labels, weights, centre, radius, child, children, low, high):
        self.ids, self.keys, self.labels, self.weights = ids, keys, labels, weights
        self.centre, self.radius, self.child, self.children, self.low, self.high = centre, radius, child, children, low, high
        norms = (weights.astype(np.float64) ** 2).sum(1)
        self.most = float(norms.max())
        self.real = weights.astype(np.float64)
        # the label that all rows below a node have, or none: where the label changes next
        ends = np.append(np.flatnonzero(labels[1:] != labels[:-1]) + 1, len(labels))
        self.pure = ends[np.searchsorted(ends, low, "right")] >= high
        self.by_label = {int(x): np.flatnonzero(labels == x) for x in np.unique(labels)}

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.real[rows] @ self.asked).astype(np.int64)
        return self.weights[rows] @ query

    def find(self, query: np.ndarray, anchor: int, label: int, same: bool, windows: list[tuple[int | None, int | None]], k: int):
        """For every window (lowest, highest score; None is open) the ``k`` best rows as ``(row, score)`` arrays."""
        q = np.zeros(self.weights.shape[1], np.int64)
        q[:min(len(q), len(query))] = query[:len(q)]
        self.asked = q.astype(np.float64)
        square = float((query.astype(np.float64) ** 2).sum())
        total = square + self.most
        self.exact = total < EXACT
        slack = 1e-9 * total + 1
        low = np.array([-math.inf if a is None else a for a, _ in windows])
        high = np.array([math.inf if b is None else b for _, b in windows])
        least = low.copy()  # below this score nothing can be among the best any more
        empty = np.zeros(0, np.int64)
        best = [(empty, empty)] * len(windows)
        mine = self.by_label.get(label, empty)

        def of_use(nodes):
            centre_scores = self.scores(q, self.centre[nodes])
            distance = np.sqrt(np.maximum(total - 2.0 * centre_scores, 0))
            r = self.radius[nodes]
            upper = (total - np.maximum(distance - r, 0) ** 2) / 2 + slack
            lower = (total - (distance + r) ** 2) / 2 - slack
            if same:
                kind = np.searchsorted(mine, self.high[nodes]) > np.searchsorted(mine, self.low[nodes])
            else:
                kind = ~(self.pure[nodes] & (self.labels[self.low[nodes]] == label))
            return upper, lower, kind

        def open_windows(upper, lower):
            return (upper[:, None] >= least) & (lower[:, None] <= high)

        upper, lower, kind = of_use(np.zeros(1, np.int64))
        nodes = np.zeros(1, np.int64)[kind]
        upper, lower = upper[kind], lower[kind]
        while len(nodes):
            useful = open_windows(upper, lower)
            on = useful.any(1)
            nodes, upper, lower, useful = nodes[on], upper[on], lower[on], useful[on]
            if not len(nodes):
                break
            promise = np.where(useful, np.minimum(upper[:, None], high), -math.inf).max(1)
            chosen = np.argpartition(-promise, OPENED - 1)[:OPENED] if len(nodes) > OPENED else np.arange(len(nodes))
            opened = nodes[chosen]
            rest = np.ones(len(nodes), bool)
            rest[chosen] = False
            nodes, upper, lower = nodes[rest], upper[rest], lower[rest]
            inner = opened[self.children[opened] > 0]
            if len(inner):
                below = _ranges(self.child[inner], self.children[inner])
                u, w, kind = of_use(below)
                nodes, upper, lower = np.concatenate([nodes, below[kind]]), np.concatenate([upper, u[kind]]), np.concatenate([lower, w[kind]])
            leaves = opened[self.children[opened] == 0]
            if len(leaves):
                rows = _ranges(self.low[leaves], self.high[leaves] - self.low[leaves])
                rows = rows[(self.ids[rows] != anchor) & ((self.labels[rows] == label) == same)]
                found = self.scores(q, rows)
                for i in range(len(windows)):
                    inside = (found >= least[i]) & (found <= high[i])
                    if inside.any():
                        r, s = np.concatenate([best[i][0], rows[inside]]), np.concatenate([best[i][1], found[inside]])
                        first = np.lexsort((self.ids[r], -s))[:k]
                        best[i] = r[first], s[first]
                        if len(first) == k:
                            least[i] = max(least[i], s[first[-1]])
        return best


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    starts, sizes = starts.astype(np.int64), sizes.astype(np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


_FOUND = "anchor_id long, anchor_key long, target_id long, target_key long, target_score long, id long, key long, score long"


def _searcher(same: bool, k: int, floor: int, ceiling: int):
    """Searches of cells: for positives one open window, else a window for every positive of the anchor."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = lambda column, i: column[i].values.to_numpy(zero_copy_only=False)
        last = found = None
        for batch in batches:
            columns = {name: batch.column(j) for j, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                one = lambda name: flat(columns[name], i)
                ids, keys, labels = one("q_ids"), one("q_keys"), one("q_labels")
                queries = one("q_weights").reshape(len(ids), columns["q_dims"][i].as_py())
                tree = [one(n) for n in ("ids", "keys", "labels", "weights", "centre", "radius", "child", "children", "low", "high")]
                # a task meets one block of candidates with several blocks of queries
                if last is None or not all(np.array_equal(x, y) for x, y in zip(tree, last)):
                    last = tree
                    found = Search(*tree[:3], tree[3].reshape(len(tree[0]), columns["dims"][i].as_py()), *tree[4:])
                pairs = None if same else [x.as_py() for x in columns["pairs"][i].values]
                out = []
                for n in range(len(ids)):
                    targets = [(0, 0, 0)] if same else [(p["id"], p["key"], p["score"]) for p in pairs[n]]
                    windows = [(None, None)] if same else [(-((-floor * s) // 100), (ceiling * s) // 100) for _, _, s in targets]
                    use = [j for j, (a, b) in enumerate(windows) if a is None or a <= b]
                    if not use:
                        continue
                    for j, (rows, scores) in zip(use, found.find(queries[n], int(ids[n]), int(labels[n]), same, [windows[j] for j in use], k)):
                        out.append(np.stack([*(np.full(len(rows), v) for v in (ids[n], keys[n], *targets[j])), found.ids[rows], found.keys[rows], scores]))
                table = np.concatenate(out, axis=1).astype(np.int64) if out else np.zeros((8, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in table], [f.split()[0] for f in _FOUND.split(", ")])
    return search


def _grid(queries: DataFrame, candidates: DataFrame, fields: list[str], search) -> DataFrame:
    """Every block of ``queries`` with every block of ``candidates``, each pair in a cell of its own."""
    asked = queries.select(*(F.col(f).alias(f"q_{f}" if f != "pairs" else f) for f in fields))
    return grid(candidates, asked, F.xxhash64("ids", "keys")).mapInArrow(search, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct rows per anchor and target."""
    order = Window.partitionBy("anchor_id", "anchor_key", "target_id", "target_key").orderBy(F.desc("score"), "id", "key")
    # repeated rows share a rank, so each task can leave out what is not among its own best before anything is shuffled
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """``(id, key, label, weights)`` of the rows that take part; the key stands for label and weights."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    weights = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return (vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~odd)
            .select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), weights.alias("weights")).where("label is not null")
            .select("id", F.xxhash64("label", "weights").alias("key"), "label", "weights"))


def mine(vectors: DataFrame, id_col: str, vector_col: str, label: Column, is_anchor: Column, positives: int = 5, k: int = 10, floor: int = 30,
         ceiling: int = 90, scale: int = 256, candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: for each anchor and positive the ``k`` best rows of other
    labels with ``floor * positive_score <= 100 * score <= ceiling * positive_score``."""
    rows = usable(vectors, id_col, vector_col, label, scale)
    candidates = settle(blocks(rows, candidate_rows, True), "negatives-trees")
    anchors = settle(usable(vectors.where(is_anchor), id_col, vector_col, label, scale).distinct(), "negatives-anchors")
    flat = [f.split()[0] for f in _FLAT.split(", ")]
    asked = settle(blocks(anchors, query_rows, False), "negatives-queries")
    near = _best(_grid(asked, candidates, flat, _searcher(True, positives, floor, ceiling)), positives)
    # at most `positives` pairs an anchor
    pairs = near.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_key").alias("key")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("id"), F.col("key"), F.col("score")))).alias("pairs"))
    paired = settle(_blocks_with_pairs(anchors.hint("merge").join(pairs, ["id", "key"]), query_rows), "negatives-pairs")
    found = _best(_grid(paired, candidates, [*flat, "pairs"], _searcher(False, k, floor, ceiling)), k)
    return found.select("anchor_id", F.col("target_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                        F.col("target_score").alias("positive_score"), F.col("score").alias("negative_score"))


def _blocks_with_pairs(rows: DataFrame, size: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                flat = _packed(part.select(["id", "key", "label", "weights"]), False)
                lists = part.column(part.schema.get_field_index("pairs"))
                yield pa.RecordBatch.from_arrays([*flat.columns, pa.ListArray.from_arrays(pa.array([0, len(lists)], pa.int32()), lists)], [*flat.schema.names, "pairs"])
    return rows.select("id", "key", "label", "weights", "pairs").mapInArrow(pack, f"{_FLAT}, pairs array<array<struct<id:long,key:long,score:long>>>")
