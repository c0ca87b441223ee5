"""Vectors in blocks: a stated set of queries against all rows, block by block.

Rows go to blocks of about ``BLOCK`` by a hash of their id, queries to blocks of ``QUERIES``.  A task
gets one block of each, so its memory is bounded whatever the table's size, and gives each query's
best of that block; the best of all blocks are merged with a window per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16384
QUERIES = 2048
PACKED = "id long, dim int, vec binary"


def pack(frame: DataFrame, id_column: str, vector_column: str, zero: bool) -> DataFrame:
    """``(id, dim, vec)``: vectors as bytes of doubles.

    Out are rows whose id or vector is null, whose vector is empty or holds null, NaN or an infinite
    number, and, unless ``zero``, those of zeros only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f8")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes) * 8
            raw = flat.tobytes()
            vecs = [raw[e - 8 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), pa.array(vecs, pa.binary())], names=["id", "dim", "vec"])

    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad)
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.mapInArrow(run, PACKED)


def matrix(vecs: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs.to_pylist()), dtype="<f8").reshape(-1, dim)


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def search(vectors: DataFrame, query: str, k: int, find: Search, score_type: str) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best of all packed vectors for those where ``query`` holds.

    ``vectors`` is read several times, so its lineage should be cut.

    ``find(query ids, query vectors, ids, vectors, k)`` gives (query's row, rows, scores) within a
    block, best first, ties to smaller ids.  Rows of the query's own id are no candidates, and
    vectors of other dimensions aren't either.
    """
    queries = vectors.where(query)
    blocks = max(1, -(-vectors.count() // BLOCK))
    groups = max(1, -(-queries.count() // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = vectors.withColumn("block", own(blocks)).withColumn("part", every(groups))
    right = queries.withColumn("part", own(groups)).withColumn("block", every(blocks))
    kind = pa.int64() if score_type == "long" else pa.float64()

    def pair(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            dim = a.column("dim")[0].as_py()
            ids, q_ids = a.column("id").to_numpy(), b.column("id").to_numpy()
            for q, rows, scores in find(q_ids, matrix(b.column("vec"), dim), ids, matrix(a.column("vec"), dim), k):
                out[0].append(np.full(len(rows), q_ids[q]))
                out[1].append(ids[rows])
                out[2].append(scores)
        parts = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], kind)})

    keys = ["dim", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows: highest score first, ties to smaller ids."""
    if len(rows) > 4 * k:
        cut_at = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut_at
        rows, scores = rows[keep], scores[keep]
    order = np.lexsort((ids[rows], -scores))[:k]
    return rows[order], scores[order]
