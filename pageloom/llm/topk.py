"""Exact top-k inner products by no-random-access aggregation.

Vectors become integers, floor(256 * x). Queries and candidates are dealt to
blocks; each pair of a query block and a candidate block meets in one task. In a
block every dimension is a list of its candidates sorted by value, which a query
reads from the top where its own component is positive and from the bottom where
it is negative, in steps. Each round reads those lists on whose next step the
query's bound for unseen candidates falls most. What has been read bounds every
score from below (unread entries at their list's end) and from above (unread
entries at the value where the list stands). Once no unseen candidate can reach
the k-th lower bound, those seen are dropped as their upper bounds fall below it,
and the scores of the few that are left are resolved exactly. The k-th best score
of the blocks before is a lower bound from the start, so a later block is often
left early, or without being read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..shipping import ship
from .common import checkpoint

K, SCALE, EVERY = 5, 256, 50
#: Rows of a query block and of a candidate block; lists are built on runs of LIST_ROWS candidates, the
#: first on FIRST_ROWS, which soon gives the others a lower bound.
QUERY_BLOCK, CANDIDATE_BLOCK, FIRST_ROWS, LIST_ROWS = 512, 32768, 1024, 16384
#: A list is read in so many steps, at least LEAST_STEP entries each; bounds of seen candidates are compared every CHECK rounds.
STEPS, LEAST_STEP, CHECK = 8, 128, 1
#: Candidates are resolved once so small a part of a list may still qualify: their products cost less than reading on.
FINALISTS = 8
#: Range of the scores that are returned.
LEAST_SCORE, MOST_SCORE = -(2**63), 2**63 - 1


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Integer rows as float64, shorter vectors filled up with zeros, which add nothing to a product."""
    lists = column.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _reachable(score: float) -> float:
    """A lower bound for scores that end at the range of a long: all beyond it tie."""
    return -np.inf if score <= LEAST_SCORE else min(float(score), float(MOST_SCORE))


class Lists:
    """The sorted lists of a run of candidates, one for each dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.n, self.dims = vectors.shape
        self.order = np.argsort(vectors.T, axis=1, kind="stable")
        self.values = np.take_along_axis(np.ascontiguousarray(vectors.T), self.order, axis=1)
        self.place = np.empty((self.n, self.dims), np.int16 if self.n < 2**15 else np.int32)
        for d in range(self.dims):
            self.place[self.order[d], d] = np.arange(self.n)
        self.widest = float(np.abs(vectors).max(initial=0.0))

    def resolve(self, query: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score descending, id) of the k best of ``rows``, exact; scores beyond a long as its nearest end."""
        if float(np.abs(query).max(initial=0.0)) * self.widest * max(1, self.dims) < 2**53:
            scores = self.vectors[rows] @ query
            if len(rows) > k:
                good = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
                rows, scores = rows[good], scores[good]
            return sorted(zip((-scores).astype(np.int64).tolist(), self.ids[rows].tolist(), strict=True))[:k]
        whole = [int(v) for v in query]
        exact = (min(max(sum(a * int(b) for a, b in zip(whole, self.vectors[r], strict=True)), LEAST_SCORE), MOST_SCORE) for r in rows)
        return sorted(zip((-s for s in exact), self.ids[rows].tolist(), strict=True))[:k]

    def best(self, query: np.ndarray, query_id: int, k: int, floor: float) -> tuple[list[tuple[int, int]], int]:
        """The k best that may exceed the floor, as of ``resolve``, and the list entries read. ``floor``: a score that k others reach already."""
        n, up = self.n, query >= 0
        end = np.where(up, n - 1, 0)
        all_lists = np.arange(self.dims)
        low = query * self.values[all_lists, n - 1 - end]  # the least a list can add
        stand = query * self.values[all_lists, end]  # the most an unread entry of it can add
        # sums that doubles do not hold exactly may be off by so much
        widest = float(np.abs(query).max(initial=0.0)) * self.widest * max(1, self.dims)
        slack = 0.0 if widest < 2**53 else widest * 2.0**-40
        narrow = np.float32 if widest < 2**23 else np.float64
        own = self.ids == query_id
        others = n - int(own.sum())
        bottom = low.sum()
        lower = np.full(n, bottom)
        lower[own] = -np.inf
        depth = np.where(query == 0, n, 0)  # nothing to read for a component of zero
        step = max(LEAST_STEP, -(-n // STEPS))
        outside, kth = True, _reachable(floor)
        most = max(8 * k, n // FINALISTS)
        rounds = 0
        while True:
            ended = bool((depth == n).all())
            # once no unseen candidate can qualify any more, those seen are held against their own upper bounds
            if outside and (ended or stand.sum() + slack < kth):
                outside, rounds = False, 0
            if not outside and (ended or rounds % CHECK == 0):
                rest = np.where(up, stand - low, low - stand)
                below = self.place < np.where(up, n - depth, depth).astype(np.int32)
                upper = lower + below.astype(narrow) @ rest.astype(narrow) - rest[~up].sum()
                alive = np.nonzero((upper + slack >= kth) & ~own)[0]
                if len(alive) <= most or ended:
                    return self.resolve(query, alive, k), int(depth[query != 0].sum())
            after = np.minimum(depth + step, n)
            spot = np.minimum(after, n - 1)
            falls = np.where(after == n, low, query * self.values[all_lists, np.where(up, n - 1 - spot, spot)])
            gain = np.where(depth < n, stand - falls, -1.0)
            for d in np.nonzero((gain >= np.median(gain[depth < n])) & (depth < n))[0]:
                a, b = int(depth[d]), int(after[d])
                part = slice(n - b, n - a) if up[d] else slice(a, b)
                lower[self.order[d, part]] += query[d] * self.values[d, part] - low[d]
                depth[d], stand[d] = b, falls[d]
            rounds += 1
            if others >= k and rounds % CHECK == 0:
                kth = max(kth, _reachable(float(np.partition(lower, n - k)[n - k]) - slack))


def runs(n: int) -> list[tuple[int, int]]:
    starts = [0, *range(FIRST_ROWS, n, LIST_ROWS)]
    return list(zip(starts, [*starts[1:], n], strict=True))


def _search(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("v")), _matrix(right.column("v"))
            dims = max(q.shape[1], x.shape[1])
            q, x = np.pad(q, ((0, 0), (0, dims - q.shape[1]))), np.pad(x, ((0, 0), (0, dims - x.shape[1])))
            qid, xid = left.column("id").to_numpy(), right.column("id").to_numpy()
            held: list[list[tuple[int, int]]] = [[] for _ in qid]  # (score descending, id), k best so far of each query
            for at, upto in runs(len(x)):
                lists = Lists(x[at:upto], xid[at:upto])
                for i, asked in enumerate(qid):
                    floor = -held[i][k - 1][0] if len(held[i]) == k else -np.inf
                    held[i] = sorted(held[i] + lists.best(q[i], asked, k, floor)[0])[:k]
            out = [(int(asked), found, -score) for asked, best in zip(qid, held, strict=True) for score, found in best]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``(id, v)`` of the rows whose id and vector are whole, components as floor(scale * x) in doubles, which from 2**52 on are integers as they are."""
    x = F.col(vector_col)
    scaled = lambda e: e.cast("double") * scale
    whole = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(scaled(e)) | (F.abs(scaled(e)) == float("inf")))
    integer = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    return df.filter(whole).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda e: integer(scaled(e))).alias("v"))


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id ``every`` divides, its k best others.

    Ties go to the smaller id; a query with fewer than k others has them all.
    Vectors that are null or hold null or non-finite components (also once they
    are scaled), and rows without an id, take no part; shorter vectors count as
    filled with zeros. Rows repeating an id stay candidates each, and a query's own
    id is never among its results; of several rows with a query's id the one with
    the smallest vector asks. Products are exact at any size; scores beyond a long
    are given and ranked as its nearest end.
    """
    ship(df.sparkSession)
    rows = checkpoint(usable(df, id_col, vector_col))
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n_queries, n_rows = queries.count(), rows.count()
    qb, xb = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // CANDIDATE_BLOCK))
    # every block of queries meets every block of candidates once; candidates are dealt by their place in
    # the stored table, so that rows repeating an id or a vector spread like any others
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int")).withColumn("x", each(xb))
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    offered = placed.withColumn("x", F.pmod(F.xxhash64("at"), F.lit(xb)).cast("int")).drop("at").withColumn("q", each(qb))
    found = asked.groupBy("q", "x").cogroup(offered.groupBy("q", "x")).applyInArrow(_search(k), "query_id bigint, vec_id bigint, score bigint")
    best = W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
