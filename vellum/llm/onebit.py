"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector's direction from the centre is rotated at random and kept as the signs of its components,
one bit each, packed, with three numbers: its distance from the centre, its inner product with its
own code, and its inner product with the centre.  A query's rotated direction is quantised to four
bits, so its inner product with a code is a few ANDs and bit counts; divided by the code's own
product it is an unbiased estimate whose error is bounded, with high probability, by a term that
falls with the root of the dimension.

Of a block's codes, the rows of the best estimates are scored exactly, which gives a score to beat;
then all rows whose upper bound reaches it are scored exactly.  All rows are indexed, and the centre is
their mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import cut, table
from vellum.llm.vectors import best, matrix, pack, search

K = 20
#: Width of the error bound, in deviations of the estimate.
WIDTH = 1.9
BITS = 4
#: Rows by estimate that are scored first, for each of the k wanted.
FIRST = 4
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Packed codes and correction numbers of a block of vectors."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> None:
        n, dim = vectors.shape
        self.dim, self.centre, self.turn = dim, centre, turn
        away = vectors - centre
        self.length = np.linalg.norm(away, axis=1)
        turned = (away / np.where(self.length > 0, self.length, 1)[:, None]) @ turn
        bits = np.zeros((n, -(-dim // 64) * 64), dtype=np.uint8)
        bits[:, :dim] = turned > 0
        self.words = np.packbits(bits, axis=1).view(np.uint64)
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        own = np.abs(turned).sum(axis=1) / np.sqrt(dim)
        self.own = np.where(own > 0, own, 1)
        self.spread = np.sqrt(np.maximum(1 - self.own**2, 0)) / self.own / np.sqrt(max(dim - 1, 1))
        self.to_centre = vectors @ centre

    def estimate(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of all rows with the query, and what they may be off by."""
        away = query - self.centre
        length = float(np.linalg.norm(away))
        turned = (away / (length or 1)) @ self.turn
        low, steps = turned.min(), (1 << BITS) - 1
        step = (turned.max() - low) / steps or 1.0
        level = np.clip(np.rint((turned - low) / step), 0, steps).astype(np.uint8)
        planes = np.zeros((BITS, self.words.shape[1] * 64), dtype=np.uint8)
        planes[:, : self.dim] = (level[None, :] >> np.arange(BITS)[:, None]) & 1
        planes = np.packbits(planes, axis=1).view(np.uint64)
        counted = np.zeros(len(self.words), dtype=np.int64)
        for j in range(BITS):
            hits = np.bitwise_count(self.words & planes[j][None, :])
            counted += (hits[:, 0] if hits.shape[1] == 1 else hits.sum(axis=1, dtype=np.int64)).astype(np.int64) << j
        # the sum over set bits, twice, less the sum over all bits: components by the code's signs
        with_code = (2 * (low * self.ones + step * counted) - (low * self.dim + step * float(level.sum()))) / np.sqrt(self.dim)
        scale = self.length * length
        base = self.to_centre + float(query @ self.centre) - float(self.centre @ self.centre)
        rounding = step / 2 / self.own  # of the query's own quantisation, in deviations of a dimension
        return base + scale * with_code / self.own, scale * (WIDTH * self.spread + WIDTH * rounding / np.sqrt(3))

    def candidates(self, query: np.ndarray, live: np.ndarray, exact: Callable[[np.ndarray], np.ndarray], k: int) -> np.ndarray:
        """Rows whose upper bound reaches the k-th exact score of those with the best estimates."""
        guess, off = self.estimate(query)
        guess = np.where(live, guess, -np.inf)
        n = len(guess)
        first = min(n, FIRST * k)
        tried = np.argpartition(guess, n - first)[n - first :]
        tried = tried[live[tried]]
        scores = exact(tried)
        if len(scores) < k:
            return np.flatnonzero(live)
        beat = np.partition(scores, len(scores) - k)[len(scores) - k]
        return np.flatnonzero(live & (guess + off >= beat))


def finder(centres: dict[int, np.ndarray]) -> Callable:
    def find(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        dim = vectors.shape[1]
        codes = Codes(vectors, centres.get(dim, np.zeros(dim)), rotation(dim))
        by_id = np.argsort(ids, kind="stable")
        sorted_ids = ids[by_id]
        live = np.ones(len(ids), dtype=bool)
        for q, query in enumerate(queries):
            lo, hi = np.searchsorted(sorted_ids, [q_ids[q], q_ids[q] + 1])
            live[by_id[lo:hi]] = False
            rows = codes.candidates(query, live, lambda r, y=query: vectors[r] @ y, k)
            live[by_id[lo:hi]] = True
            yield (q, *best(ids, rows, np.einsum("ij,j->i", vectors[rows], query), k))

    return find


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector of each dimension, over all rows.

    A task adds its rows up; what comes to the driver is a number for each component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            for dim in batch.column("dim").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("dim"), dim)).column("vec")
                sums[dim] = sums.get(dim, 0) + matrix(own, dim).sum(axis=0)
                rows[dim] = rows.get(dim, 0) + len(own)
        if sums:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(list(sums), pa.int32()), "n": list(rows.values()), "total": [x.tolist() for x in sums.values()]})

    parts = vectors.mapInArrow(run, "dim int, n long, total array<double>")
    means = parts.select("dim", "n", F.posexplode("total").alias("at", "x")).groupBy("dim", "at").agg((F.sum("x") / F.sum("n")).alias("mean"))
    found: dict[int, np.ndarray] = {}
    for r in means.collect():
        found.setdefault(r["dim"], np.zeros(r["dim"]))[r["at"]] = r["mean"]
    return found


def nearest(frame: DataFrame, query: str, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query, the k rows found with the largest inner products.

    ``query`` is a condition on ``id``.  Scores are exact on the original vectors.  Vectors that are
    null, empty, zero or hold null or non-finite numbers take no part, nor do rows without an id.
    Repeated rows are candidates each; rows of the query's own id are not.  Vectors of one dimension
    are compared with their like.  An empty table gives no rows.
    """
    vectors = cut(pack(frame, id_column, vector_column, zero=False))
    return search(vectors, query, k, finder(centres(vectors)), "double")


def op6_onebit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth vector; null, zero and repeated rows as in ``nearest``."""
    return nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
