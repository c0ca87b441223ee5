"""Exact top-k search with an impact-ordered index, score at a time.

A vector's components are quantised to integers, its impacts.  A block's index has, for each
dimension and sign, postings in segments of falling impact.  A query processes segments of all
dimensions in falling order of the most that a posting in them can add or take away.  After each
round, a row's unseen components are bounded by the segments not yet reached, which gives an upper
and a lower bound of its score.  Once few rows can still reach the k-th highest lower bound, all
others are proven out, and the possible members are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import cut, table
from vellum.llm.vectors import best, pack, search

SCALE = 1024
K = 10
#: Segments of a dimension and sign, and bounds checks of a query.
LEVELS, ROUNDS = 8, 6


def impacts(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * vectors).astype(np.int64)


class Index:
    """Postings of one block; ``value`` has a row of impacts for each vector."""

    def __init__(self, value: np.ndarray, levels: int = LEVELS) -> None:
        self.value = value
        n, dims = value.shape
        size = np.abs(value)
        top = size.max(axis=0)
        # level 1 to ``levels``, the highest impacts in the highest; zeros have none
        self.level = np.minimum(-(-size * levels // np.maximum(top, 1)), levels).astype(np.uint8)
        self.edge = np.arange(levels + 1)[:, None] * top[None, :] / levels  # most of a level, by dimension
        kind = self.level.astype(np.int64) * 2 + (value < 0)
        rows, starts, self.segment = [], [0], []
        for d in range(dims):
            order = np.argsort(-kind[:, d], kind="stable")
            sorted_kind = kind[order, d]
            heads = np.flatnonzero(np.concatenate(([True], sorted_kind[1:] != sorted_kind[:-1])))
            for a, b in zip(heads, np.append(heads[1:], n), strict=True):
                if sorted_kind[a] >= 2:
                    rows.append(order[a:b])
                    self.segment.append((d, int(sorted_kind[a]) // 2))
        self.rows = rows
        self.added = [value[r, d] for r, (d, _) in zip(rows, self.segment, strict=True)]
        self.seg_dim = np.array([d for d, _ in self.segment], dtype=np.int64)
        self.seg_level = np.array([v for _, v in self.segment], dtype=np.int64)

    def search(self, query: np.ndarray, mine: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best but for those in ``mine``; all others are proven not to be."""
        n, dims = self.value.shape
        live = np.ones(n, dtype=bool)
        live[mine] = False
        if live.sum() <= k:
            return np.flatnonzero(live)
        weight = np.abs(query).astype(np.float64)
        most = weight[self.seg_dim] * self.edge[self.seg_level, self.seg_dim]
        order = np.argsort(-most, kind="stable")
        order = order[most[order] > 0]
        total = np.zeros(n, dtype=np.int64)
        reached = np.full(dims, self.edge.shape[0] - 1, dtype=np.int64)  # highest level not yet processed
        mass = np.cumsum(most[order])
        stops = np.unique(np.searchsorted(mass, mass[-1] * (1 - 0.5 ** np.arange(1, ROUNDS + 1)), side="left") + 1) if len(order) else []
        at = 0
        for stop in stops:
            # both signs of a level are equally bounded and follow each other: don't stop between them
            while stop < len(order) and self.segment[order[stop]] == self.segment[order[stop - 1]]:
                stop += 1
            for s in order[at:stop].tolist():
                d, level = self.segment[s]
                total[self.rows[s]] += query[d] * self.added[s]
                if level - 1 < reached[d]:
                    reached[d] = level - 1
            at = max(at, stop)
            bound = (weight * self.edge[reached, np.arange(dims)]).astype(np.float32)
            slack = (self.level <= reached[None, :].astype(np.uint8)).astype(np.float32) @ bound
            slack = slack * np.float32(1.0001) + 1  # above what rounding can lose
            low = np.where(live, total - slack, -np.inf)
            least = np.partition(low, n - k)[n - k]
            may = live & (total + slack >= least)
            if may.sum() <= max(4 * k, n // 64):
                return np.flatnonzero(may)
        return np.flatnonzero(live) if not len(stops) else np.flatnonzero(may)


def find(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    value = impacts(vectors)
    index = Index(value)
    by_id = np.argsort(ids, kind="stable")
    sorted_ids = ids[by_id]
    for q, query in enumerate(impacts(queries)):
        lo, hi = np.searchsorted(sorted_ids, [q_ids[q], q_ids[q] + 1])
        rows = index.search(query, by_id[lo:hi], k)
        yield (q, *best(ids, rows, value[rows] @ query, k))


def top_k(frame: DataFrame, query: str, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner products among all rows.

    ``query`` is a condition on ``id``.  Vectors that are null, empty or hold null or non-finite
    numbers take no part, nor do rows without an id, nor those with a component so large that a score
    could pass a long (``2 ** 31 / sqrt(dimensions) / scale``, some 260,000 at 64).  Repeated rows are candidates each; rows of the
    query's own id are not.  A repeated query id is one query for each of its rows' candidates, cut
    to k.  An empty table gives no rows.
    """
    most = F.lit(2.0**31) / F.sqrt(F.size(vector_column)) / SCALE - 1
    huge = F.exists(F.col(vector_column).cast("array<double>"), lambda x: F.abs(x) > most)
    fit = frame.where(F.coalesce(~huge, F.lit(True)))
    return search(cut(pack(fit, id_column, vector_column, zero=True)), query, k, find, "long")


def op1_saat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest scores of every hundredth vector; null, empty and repeated rows as in ``top_k``."""
    return top_k(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


ORACLE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
