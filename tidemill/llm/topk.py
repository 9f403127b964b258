"""Exact top-k inner-product search by distributed histogram selection.

Queries are taken in blocks of bounded size. For each block, every vector is scored against every query
of the block. A histogram of each query's scores, over a range that surely holds its k-th highest score,
is summed over all tasks and the range is narrowed to the bin that holds it, until the range is a single
value. A last pass keeps what is above or at that value; ties go to the smaller id. A task reports only
the bins down to its own k-th highest score: lower ones cannot hold the global one.

Scores are exact whatever the size of the components: a slice of vectors is multiplied in doubles, in 64-bit
integers or in Python's integers, the first of these in which no sum can leave the exact range. Bounds and
bins are Python's integers where they leave 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut

QUERY_BLOCK = 1024
BINS = 2048
_ROWS = 2048
_EXACT = 1 << 53
_LONG = (1 << 63) - 1
_WIDE = 1 << 62


def quantised(table: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(id, vec array<double>): each component x as floor(scale * x), a whole number. Rows whose id or vector
    is null, or whose vector holds a component that is null or not finite (scaled, too), are left out."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double") * scale) < float("inf")))

    def down(v: F.Column) -> F.Column:
        v = v.cast("double") * scale
        # doubles over 2**53 are whole; SQL's floor gives 64-bit integers
        return F.when(F.abs(v) < float(_EXACT), F.floor(v).cast("double")).otherwise(v)

    return table.where(F.col(id_col).isNotNull() & x.isNotNull() & whole).select(F.col(id_col).alias("id"), F.transform(x, down).alias("vec"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row for each vector, filled with zeros to `width`; longer ones are cut (the query is 0 there)."""
    n = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    ok = at < width
    out[row[ok], at[ok]] = flat[ok]
    return out


def _integers(real: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    return np.array([[int(x) for x in row] for row in real.tolist()], object).reshape(real.shape)


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, scores rows x queries, whether the row is the query itself) of some vectors; scores are 64-bit
    integers, or Python's integers in a slice whose scores may leave them."""
    most = float(np.abs(queries).sum(axis=1).max(initial=0))
    real, short = queries.T, float(np.abs(queries).max(initial=0)) < _WIDE
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            b = batch.slice(at, _ROWS)
            own, v = b.column("id").to_numpy(), _matrix(b.column("vec"), queries.shape[1])
            bound = most * float(np.abs(v).max(initial=0))
            if bound < _EXACT:
                s = (v @ real).astype(np.int64)
            elif bound < _WIDE and short and np.abs(v).max(initial=0) < _WIDE:
                s = v.astype(np.int64) @ real.astype(np.int64)
            else:
                s = _integers(v) @ _integers(real)
            place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            hit = np.flatnonzero(ids[place] == own)
            self_ = np.zeros(s.shape, bool)
            self_[hit, place[hit]] = True
            yield own, s, self_


def _fits(*numbers: np.ndarray) -> bool:
    return all(a.dtype != object for a in numbers)


def _numbers(values: list[int]) -> np.ndarray:
    """As 64-bit integers, if differences of them and of scores stay within 64 bits, else as Python's."""
    return np.array(values, np.int64 if all(abs(x) < _WIDE >> 1 for x in values) else object)


def _histogram(ids: np.ndarray, queries: np.ndarray, low: list[int], width: list[int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lo, step = len(ids), _numbers(low), _numbers(width)
        total = np.zeros((n, BINS), np.int64)
        for _, s, self_ in _scored(batches, ids, queries):
            if not _fits(s, lo, step):
                s = s.astype(object)
            bin_ = np.minimum((s - lo) // step, BINS - 1)
            inside = (bin_ >= 0) & ~self_
            total += np.bincount((bin_ + np.arange(n) * BINS)[inside].astype(np.int64), minlength=n * BINS).reshape(n, BINS)
        above = total[:, ::-1].cumsum(axis=1)[:, ::-1] - total
        q, bin_ = np.nonzero((total > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(total[q, bin_])], names=["q", "bin", "n"])

    return run


def _keep(ids: np.ndarray, queries: np.ndarray, least: list[int], k: int, size: int):
    """The scores at or over `least`; `rank` holds them as `size` bytes whose order is that of the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, owns, scores, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), _numbers(least)
        for own, s, self_ in _scored(batches, ids, queries):
            row, col = np.nonzero((s >= lo) & ~self_)
            q, owns, scores = np.append(q, col), np.append(owns, own[row]), np.append(scores, s[row, col])
            if len(q) > 4 * k * len(ids):
                best = _first(q, owns, scores, k)
                q, owns, scores = q[best], owns[best], scores[best]
        best = _first(q, owns, scores, k)
        exact = [int(x) for x in scores[best].tolist()]
        rank = pa.array([(x + (1 << 8 * size - 1)).to_bytes(size, "big") if size else None for x in exact], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(ids[q[best]]), pa.array(owns[best]), rank, pa.array([max(-_LONG - 1, min(_LONG, x)) for x in exact], pa.int64())], names=["query_id", "vec_id", "rank", "score"])

    return run


def _first(q: np.ndarray, own: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    if score.dtype == object:  # places in the order of the scores stand for them
        known = {x: i for i, x in enumerate(sorted(set(score.tolist())))}
        score = np.array([known[x] for x in score.tolist()], np.int64)
    order = np.lexsort((own, -score, q))
    new = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
    return order[rank < k]


def _block(base: DataFrame, ids: np.ndarray, queries: np.ndarray, bound: list[int], size: int, k: int) -> DataFrame:
    """The rows that may be among the k best of each query; `bound`: no score of the query is further from 0."""
    low, high = [-x for x in bound], list(bound)
    order = Window.partitionBy("q").orderBy(F.desc("bin"))
    while any(h > x for x, h in zip(low, high, strict=True)):
        width = [max(1, -(-(h - x + 1) // BINS)) for x, h in zip(low, high, strict=True)]
        # scores over `high` fall into the last bin too, so the rank stays k
        found = base.mapInArrow(_histogram(ids, queries, low, width, k), "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        found = found.withColumn("seen", F.sum("n").over(order)).where((F.col("seen") >= k) & (F.col("seen") - F.col("n") < k))
        bins = {r["q"]: r["bin"] for r in found.select("q", "bin").collect()}  # one row for each query
        for i in range(len(ids)):
            if i in bins:
                low[i] += bins[i] * width[i]
                high[i] = min(high[i], low[i] + width[i] - 1)
            else:  # fewer scores than wanted: all are kept
                high[i] = low[i]
    return base.mapInArrow(_keep(ids, queries, low, k, size), "query_id bigint, vec_id bigint, rank binary, score bigint")


def _bounds(queries: np.ndarray, longest: float, most: float) -> list[int]:
    """For each query, what no score of its exceeds: by the lengths of the vectors, or by sums of components."""
    out = []
    for v in queries.tolist():
        sums = (sum(abs(int(x)) for x in v)) * int(most)
        length = math.isqrt(sum(int(x) ** 2 for x in v)) + 1
        out.append(min(sums, length * (int(longest * (1 + 1e-9)) + 1)) + 1 if math.isfinite(longest) else sums + 1)
    return out


def search(table: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row where `is_query` (a condition on id_col) holds,
    the k rows of other ids with the highest integer inner product, ties to the smaller id.

    See quantised() for what takes no part. Ids are integers. Of rows that repeat a query's id the one
    with the smallest vector is the query; as candidates all rows count. Vectors of unequal length are
    filled with zeros. Fewer candidates than k give fewer rows; no query or an empty table gives none.
    Ranks go by the exact scores; a score outside of 64 bits is given as the nearest 64-bit integer.
    """
    base = quantised(table, id_col, vec_col, scale).withColumn("id", F.col("id").cast("bigint"))
    asked = cut(quantised(table.where(is_query), id_col, vec_col, scale).groupBy(F.col("id").cast("bigint").alias("id")).agg(F.min("vec").alias("vec")))
    n = asked.count()
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    longest, most = base.agg(F.max(F.sqrt(square)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v))))).first()
    parts = []
    blocks = -(-n // QUERY_BLOCK)
    # one width of the ordering bytes for all blocks
    size = 0
    if n:
        sums = asked.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + F.abs(v)))).first()[0]
        reach = float(sums or 0) * float(most or 0)
        size = 0 if reach < _WIDE else 2 + 2048 // 8 if not math.isfinite(reach) else 2 + int(reach * 2).bit_length() // 8 + 1
    for i in range(blocks):
        rows = sorted(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect())
        if not rows:
            continue
        width = max(len(r["vec"]) for r in rows)
        queries = np.zeros((len(rows), width))
        for j, r in enumerate(rows):
            queries[j, : len(r["vec"])] = r["vec"]
        parts.append(_block(base, np.array([r["id"] for r in rows], np.int64), queries, _bounds(queries, float(longest or 0), float(most or 0)), size, k))
    if not parts:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("rank"), F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
