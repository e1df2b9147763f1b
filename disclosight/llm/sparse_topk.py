"""Exact top-k search by term-at-a-time accumulation.

Every vector is a sparse row of integer weights: component ``x`` at position ``t`` is the weight
``floor(scale * x)`` of term ``t``, and zero weights are not stored. Candidates are packed into blocks of
bounded size. For one block of queries and one block of candidates, the terms are visited one after
another: the query weights of the term are scattered, times the posting weights of the term, into a dense
array of scores (queries x candidates). Then a partition selection keeps the best ``k`` of the block, and
a ranked merge over all blocks gives the result. Nothing is pruned, so the result is exact.

Blocks meet in a grid: each task takes candidate blocks one after the other and a bounded number of query blocks, so
each cell is a bounded piece of work whatever the numbers of rows are, and no table passes the driver.

Defined cases: a vector that is NULL or holds NULL, NaN or an infinite component, or whose id is NULL,
takes no part. Vectors of different lengths are compared as if the shorter one ended in zeros. Equal
repeated query rows are one query; repeated candidate rows are candidates each. A row never is a candidate
of a query with its own id. Weights and scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import grid, settle

#: Rows of a block, and queries that share one dense score array.
CANDIDATE_ROWS, QUERY_ROWS, QUERIES_AT_ONCE = 8192, 1024, 32
_BLOCK = "block long, ids array<long>, starts array<int>, terms array<int>, weights array<long>"


def weighted_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """``(id, weights)`` of the vectors that take part."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    weights = F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("long"))
    return (vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~odd)
            .select(F.col(id_col).cast("long").alias("id"), weights.alias("weights")))


def _packer(rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                lists = part.column(1)
                bounds = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
                values = np.asarray(lists.flatten(), np.int64)
                lengths = np.diff(bounds)
                terms = np.arange(len(values)) - np.repeat(bounds[:-1], lengths)
                kept = values != 0
                starts = np.concatenate([[0], np.cumsum(kept)])[bounds]
                one = lambda a, kind: pa.array([a], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number * 65536 + start // rows], pa.int64()), one(np.asarray(part.column(0), np.int64), pa.int64()),
                     one(starts.astype(np.int32), pa.int32()), one(terms[kept].astype(np.int32), pa.int32()),
                     one(values[kept], pa.int64())], ["block", "ids", "starts", "terms", "weights"])
    return pack


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Weighted rows packed into blocks of at most ``size`` rows."""
    return rows.mapInArrow(_packer(size), _BLOCK)


def postings(count: int, starts, terms, weights) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
    """Rows and weights of each term of a block; where most of the ``count`` rows have it, no rows but a weight for each of them, 0 where it is none."""
    owner = np.repeat(np.arange(count, dtype=np.int64), np.diff(starts))
    by_term = np.argsort(terms, kind="stable")
    found, first = np.unique(terms[by_term], return_index=True)
    out = {}
    for t, rows in zip(found, np.split(by_term, first[1:])):
        at, posted = owner[rows], weights[rows]
        if 2 * len(at) > count:
            dense = np.zeros(count, np.int64)
            dense[at] = posted
            at, posted = None, dense
        out[int(t)] = at, posted
    return out


def best_of_cell(q_ids, q_starts, q_terms, q_weights, c_ids, posted_by_term: dict, k: int):
    """The ``k`` best candidates of each query within one cell: ``(query position, id, score)`` arrays."""
    out = []
    for low in range(0, len(q_ids), QUERIES_AT_ONCE):
        high = min(low + QUERIES_AT_ONCE, len(q_ids))
        a, b = q_starts[low], q_starts[high]
        q_owner = np.repeat(np.arange(high - low), np.diff(q_starts[low:high + 1]))
        scores = np.zeros((high - low, len(c_ids)), np.int64)
        for t in np.unique(q_terms[a:b]):
            if int(t) not in posted_by_term:
                continue
            at, posted = posted_by_term[int(t)]
            mine = q_terms[a:b] == t
            asked, weight = q_owner[mine], q_weights[a:b][mine]
            gain = np.multiply.outer(weight, posted)
            if at is None and len(asked) == high - low:
                scores += gain
            elif at is None:
                scores[asked] += gain
            else:
                scores[asked[:, None], at] += gain
        for i in range(high - low):
            free = np.flatnonzero(c_ids != q_ids[low + i])
            mine = scores[i, free]
            if len(free) > k:
                least = mine[np.argpartition(mine, len(mine) - k)[len(mine) - k]]
                kept = mine >= least
                free, mine = free[kept], mine[kept]
            best = np.lexsort((c_ids[free], -mine))[:k]
            out.append((np.full(len(best), low + i), c_ids[free[best]], mine[best]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _scorer(k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = lambda column, i: column[i].values.to_numpy(zero_copy_only=False)
        last, posted = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [array(batch.column(j), i) for j in range(8)]
                block = parts[4:]
                # a task meets one block of candidates with several blocks of queries
                if last is None or not all(np.array_equal(x, y) for x, y in zip(block, last)):
                    last, posted = block, postings(len(block[0]), *block[1:])
                at, found, scores = best_of_cell(*parts[:4], block[0], posted, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts[0][at]), pa.array(array(batch.column(8), i)[at]), pa.array(found), pa.array(scores)],
                    ["query_id", "query_key", "vec_id", "score"])
    return score


def top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, scale: int = 1024,
          candidate_rows: int = CANDIDATE_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for every row that ``is_query`` chooses."""
    rows = weighted_rows(vectors, id_col, vector_col, scale)
    queries = weighted_rows(vectors.where(is_query), id_col, vector_col, scale).distinct()
    c = settle(blocks(rows, candidate_rows), "topk-candidates")
    q = settle(blocks(queries, query_rows), "topk-queries")
    fields = ("ids", "starts", "terms", "weights")
    keys = F.transform(F.slice(F.col("starts"), 1, F.size("ids")), lambda s, i: F.xxhash64(
        F.slice(F.col("terms"), s + 1, F.get("starts", i + 1) - s), F.slice(F.col("weights"), s + 1, F.get("starts", i + 1) - s)))
    asked = q.select(*(F.col(f).alias(f"q_{f}") for f in fields), keys.alias("q_keys"))
    cells = grid(c.select("block", *fields), asked, F.xxhash64("block", "ids")).select(
        *(f"q_{f}" for f in fields), *(F.col(f).alias(f"c_{f}") for f in fields), "q_keys")
    found = cells.mapInArrow(_scorer(k), "query_id long, query_key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
