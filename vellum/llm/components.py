"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two partial aggregations and two joins on the node, so a node with very many
edges is pre-aggregated before the shuffle and its join is split by adaptive execution; nothing is
collected.  Each round's edges are checkpointed to the shared folder, so lost executors cost only
the current round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``, root being its component's least node.

    Self loops and nulls are ignored; a node without edges to others isn't returned.  Repeated
    edges and either direction are allowed.  Raises RuntimeError if ``max_rounds`` don't suffice.
    """
    e = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(e)
    if not state[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(down.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(e)
        if state == before:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(e.select("v", "v").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
