"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has 64 bits.  Two within three bits agree on at least one of four 16-bit blocks, so
the trie is kept in four rotations, each led by another block: the leading block is descended with
no error budget (it is the shuffle key, hence a subtree each), the 48 bits below with the whole
budget.  Below the key, pairs of trie nodes are walked together: differing bits add up, and a pair
beyond the budget is dropped with all that hangs below it.  Only distinct fingerprints enter the
trie, so copies cost nothing there, and a subtree answers with a spanning forest of its links
instead of all its pairs.  A subtree with more leaves than ``LEAVES`` is cut into chunks, and pairs
of chunks are walked in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import cut, free_name, table, text_or_empty, tidy
from vellum.llm.components import components

SEED = 42
BUDGET = 3
#: Leaves of one subtree (or chunk of it) that a task walks against another.
LEAVES = 16384
#: Node pairs that are walked at once; more wait on a stack.
FRONTIER = 1 << 18


def fingerprint(text: bytes, words_per_shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of UTF-8 text: words between ASCII white space, A-Z in lower case.

    Shingles count as often as they occur; fewer words than a shingle has make one shingle, no words
    give zero.  A bit is 1 if set in over half of the shingles' XXH64 values.
    """
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, fp)``, fp being the fingerprint as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])
        tidy()

    picked = docs.select(F.col(id_column).cast("long").alias("id"), text_or_empty(text_column).alias("t"))
    return picked.mapInArrow(run, "id long, fp long")


class _Forest:
    """Union-find over leaves, with labels for all leaves at once."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        x, y = label[a], label[b]
        while True:
            keep = x != y
            if not keep.any():
                break
            x, y = x[keep], y[keep]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
            x, y = label[x], label[y]


def walk(values: np.ndarray, roots: np.ndarray, budget: int = BUDGET, skip: int = 16) -> np.ndarray:
    """The component label of each leaf under links of at most ``budget`` differing bits.

    ``values``: uint64, ascending within each root's ranges.  ``roots``: rows (a low, a high, b low,
    b high) of ranges whose pairs are wanted, both ranges equal for a self-join.  The first ``skip``
    bits agree within a root.
    """
    forest = _Forest(len(values))
    if not len(roots):
        return forest.label
    counts = []
    for bit in range(skip, 64):
        ones = (values >> np.uint64(63 - bit)) & np.uint64(1)
        counts.append(np.concatenate(([0], np.cumsum(ones, dtype=np.int64))).astype(np.int32))
    start = np.empty((len(roots), 5), dtype=np.int32)
    start[:, :4], start[:, 4] = roots, 0
    stack = [(0, start[i : i + FRONTIER]) for i in range(0, len(start), FRONTIER)]
    while stack:
        level, pairs = stack.pop()
        alo, ahi, blo, bhi, _ = pairs.T
        # nodes whose leaves are all linked already have no news for each other
        label = forest.label
        breaks = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        same = (breaks[ahi - 1] == breaks[alo]) & (breaks[bhi - 1] == breaks[blo]) & (label[alo] == label[blo])
        pairs = pairs[~same]
        alo, ahi, blo, bhi, _ = pairs.T
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            forest.link(a[near], b[near])
            pairs = pairs[~single]
        if not len(pairs):
            continue
        if level == len(counts):  # equal values left over: they link
            forest.link(pairs[:, 0], pairs[:, 2])
            continue
        ones = counts[level]
        alo, ahi, blo, bhi, apart = pairs.T
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        itself = (alo == blo) & (ahi == bhi)
        below = [
            np.stack((alo, amid, blo, bmid, apart), 1),
            np.stack((amid, ahi, bmid, bhi, apart), 1),
            np.stack((alo, amid, bmid, bhi, apart + 1), 1),
            np.stack((amid, ahi, blo, bmid, apart + 1), 1)[~itself],
        ]
        nodes = np.concatenate(below)
        alo, ahi, blo, bhi, apart = nodes.T
        lone = (alo == blo) & (ahi == bhi) & (ahi - alo < 2)
        nodes = nodes[(ahi > alo) & (bhi > blo) & (apart <= budget) & ~lone]
        nodes = nodes[np.argsort(-nodes[:, 4], kind="stable")]
        stack += [(level + 1, nodes[i : i + FRONTIER]) for i in range(0, len(nodes), FRONTIER)]
    return forest.label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, key, left, right, side): star links of each group."""

    def solve(part: np.ndarray) -> pa.RecordBatch:
        block, turned, side = part["block"], part["turned"], part["side"]
        order = np.lexsort((turned, side, part["right"], part["left"], part["key"], block))
        part, turned, side = part[order], turned[order], side[order]
        head = np.flatnonzero(np.concatenate(([True], (part[["block", "key", "left", "right"]][1:] != part[["block", "key", "left", "right"]][:-1]))))
        tail = np.append(head[1:], len(part))
        cross = part["left"][head] != part["right"][head]
        # side 0 comes first; a chunk's own pairs have side 0 only
        second = head + np.add.reduceat((side == 0).astype(np.int64), head)
        roots = np.stack((head, np.where(cross, second, tail), np.where(cross, second, head), tail), 1)
        roots = roots[(roots[:, 1] > roots[:, 0]) & (roots[:, 3] > roots[:, 2]) & (cross | (tail - head > 1))]
        label = walk(turned, roots)
        child = np.flatnonzero(label != np.arange(len(label)))
        fp = part["fp"]
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[label[child]])], names=["u", "v"])

    kind = np.dtype([("block", "i4"), ("key", "i4"), ("left", "i4"), ("right", "i4"), ("side", "i4"), ("fp", "i8"), ("turned", "u8")])
    names = ["block", "key", "left", "right"]
    held: list[np.ndarray] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.empty(batch.num_rows, dtype=kind)
        for i, name in enumerate(["block", "key", "left", "right", "side", "fp"]):
            part[name] = batch.column(i).to_numpy(zero_copy_only=False)
        value, turn = part["fp"].view(np.uint64).copy() if part["fp"].flags.c_contiguous else part["fp"].astype("i8").view(np.uint64), (part["block"] * 16).astype(np.uint64)
        part["turned"] = np.where(turn == 0, value, (value << turn) | (value >> ((np.uint64(64) - turn) % np.uint64(64))))
        held.append(part)
        rows += len(part)
        if rows >= 4 * LEAVES:
            whole = np.concatenate(held)
            last = np.flatnonzero((whole[names][1:] != whole[names][:-1]))
            if len(last):  # the last group may go on in the next batch
                yield solve(whole[: last[-1] + 1])
                whole = whole[last[-1] + 1 :]
            held, rows = [whole], len(whole)
    if rows:
        yield solve(np.concatenate(held))


def links(classes: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that join the same fingerprints as all pairs within the budget do.

    ``classes``: distinct ``fp``.  The hot keys that are broadcast are 4 x 2^16 at most.
    """
    block = F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("block")
    keyed = classes.select("fp", block).withColumn(
        "key", F.expr("CAST(shiftrightunsigned(fp, 48 - 16 * block) & 65535 AS INT)")
    )
    hot = (
        keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where(F.col("n") > LEAVES)
        .select("block", "key", F.ceil(F.col("n") / (LEAVES // 2)).cast("int").alias("m"))
    )
    dealt = keyed.join(F.broadcast(hot), ["block", "key"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select(
        "block", "key", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "fp",
    )
    group = ["block", "key", "left", "right"]
    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_links, "u long, v long")


def grouped_prints(classes: DataFrame) -> DataFrame:
    """``classes``, distinct ``fp`` with any columns, and ``root``: the least fingerprint that links reach."""
    roots = components(links(classes.select("fp")))
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, fp, component)`` per row: the component is the least id that links reach.

    A null id takes no part in that minimum; a component of null ids only has a null component.
    Repeated rows are returned as often as they come.  Empty and null texts have fingerprint zero.
    An empty table gives no rows.
    """
    own = cut(fingerprints(docs, id_column, text_column))
    classes = cut(own.groupBy("fp").agg(F.min("id").alias("least")))
    grouped = grouped_prints(classes)
    least = grouped.groupBy("root").agg(F.min("least").alias("component"))
    named = grouped.join(least, "root").select("fp", "component")
    return own.join(named, "fp").select("id", "fp", "component")


def keep_representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's least, one row for each such id.

    Rows that share the least id (repeated rows) are cut to the one with the least text; rows with
    a null id stay, since nothing tells them apart.
    """
    kept = near_duplicates(docs, id_column, text_column).where("id = component").select(F.col("id").alias("kept_id")).distinct()
    mark = free_name(docs, "row_rank")
    joined = docs.join(kept, docs[id_column].cast("long") == F.col("kept_id"), "left_semi")
    repeated = joined.groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_column).alias("kept_id"))
    once = joined.join(repeated, joined[id_column] == F.col("kept_id"), "left_anti")
    from pyspark.sql import Window

    order = Window.partitionBy(id_column).orderBy(F.xxhash64(text_column), text_column)
    several = joined.join(repeated, joined[id_column] == F.col("kept_id"), "left_semi")
    several = several.withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1).drop(mark)
    return once.unionByName(several).unionByName(docs.where(F.col(id_column).isNull()))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
