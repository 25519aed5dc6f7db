"""Exact top-k search without random access.

Vectors are taken as integers. Candidates are dealt to blocks; a block has one
list of its candidates for each component, sorted by that component. A query
reads all of a block's lists in step, each from the end where its products with
the query are largest. A candidate's score is then at least what was read of it
and the smallest products of what was not, and at most what was read and the
products last read. Reading stops when the candidates that could still be among
the block's k best are few; their scores are resolved, and the blocks' bests
merged. A bound is never an estimate, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import written
from parley.llm.vectors import matrix, packed

#: Rows of a block of candidates, and of a block of queries.
CANDIDATES, QUERIES = 8192, 256
#: First depth of the lists, or a sixteenth of them; it doubles from look to look.
DEPTH = 64
#: Reading ends when at most this many times k candidates are open.
OPEN = 8


def scaled(vectors: DataFrame, scale: int) -> DataFrame:
    """``id, vec`` of ``id, vec``: floor(scale * x) of each component, packed as
    64-bit integers; vectors with a component beyond 53 bits take no part."""
    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = np.floor(scale * matrix(pdf["vec"]))
            ok = (np.abs(x) < 2.0 ** 53).all(axis=1) if len(x) else np.zeros(0, bool)
            yield pd.DataFrame({"id": pdf["id"][ok], "vec": [r.tobytes() for r in x[ok].astype("<i8")]})

    return vectors.mapInPandas(whole, "id long, vec binary")


class Lists:
    """A block's sorted lists: for each component, its candidates in rising
    order of it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.whole = ids[order], x[order]
        self.columns = np.ascontiguousarray(self.whole.T.astype(np.float64))
        self.order = np.argsort(self.columns, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.columns, self.order, axis=1)
        self.low, self.high = self.sorted[:, 0], self.sorted[:, -1]

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best other candidates: score, then id."""
        d, n = self.columns.shape
        q = query.astype(np.float64)
        best = np.where(q > 0, q * self.high, q * self.low)  # no product is larger
        worst = np.where(q > 0, q * self.low, q * self.high)
        # Bounds are sums of doubles: widen them by more than their rounding.
        slack = (np.abs(best) + np.abs(worst)).sum() * 1e-12
        others = self.ids != own
        known = np.zeros(n)  # sum of the products read
        read = np.zeros((d, n))
        depth, done = min(max(DEPTH, n // 16), n), 0
        live = np.flatnonzero(q != 0)
        while others.sum() > k:
            for j in live:
                part = slice(n - depth, n - done) if q[j] > 0 else slice(done, depth)
                at = self.order[j, part]
                known[at] += q[j] * self.sorted[j, part]
                read[j, at] = 1
            # The products last read, of each list.
            edge = q * np.where(q > 0, self.sorted[:, n - depth], self.sorted[:, depth - 1])
            seen = np.stack([worst, edge]) @ read
            lower, upper = known + (worst.sum() - seen[0]), known + (edge.sum() - seen[1])
            # No outsider below the k-th lower bound can qualify.
            bar = np.partition(lower[others], -k)[-k]
            open_ = others & (upper >= bar - slack)
            if depth == n or open_.sum() <= OPEN * k:
                break
            done, depth = depth, min(n, 2 * depth)
        else:
            open_ = others
        at = np.flatnonzero(open_)
        scores = self.whole[at] @ query
        first = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at][first], scores[first]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query id (``queries.id``) the
    ``k`` other ids whose integer inner product is largest, all of them where
    there are no more; ties go to the smaller id.

    Null, ragged and non-finite vectors and null ids take no part, neither as
    queries nor as candidates, and of several vectors of an id one counts (see
    ``packed``). Zero vectors do. Other columns are not read. An empty table
    gives no rows. Scores beyond 64 bits are not told.

    Every query meets every block of candidates, in a grid of blocks of both,
    each its own group of bounded size: nothing is broadcast, and a group
    returns k rows a query.
    """
    rows = written(scaled(packed(vectors, id_col, vector_col), scale), "top-vectors")
    asked = rows.join(queries.select("id").distinct(), "id")
    n, m = rows.count(), asked.count()
    across, down = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    hashed = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    grid = rows.select("id", "vec", hashed(across).alias("c"), each(down).alias("q"), F.lit(False).alias("asks")) \
        .unionAll(asked.select("id", "vec", each(across).alias("c"), hashed(down).alias("q"), F.lit(True).alias("asks")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["asks"].to_numpy(dtype=bool)
        ids, x = pdf["id"].to_numpy(), matrix(pdf["vec"], "<i8")
        out = {"query_id": [], "vec_id": [], "score": []}
        if ask.any() and not ask.all():
            lists = Lists(ids[~ask], x[~ask])
            for own, query in zip(ids[ask], x[ask], strict=True):
                got, scores = lists.top(query, own, k)
                out["query_id"].append(np.full(len(got), own))
                out["vec_id"].append(got)
                out["score"].append(scores)
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    found = grid.groupBy("c", "q").applyInPandas(search, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
