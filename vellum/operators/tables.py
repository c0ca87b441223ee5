"""Tables and styles: captions, row order, grids, inheritance."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _owned(kinds: list[str]) -> dict[int, int]:
    """Of blocks in order the table that each caption owns: {place of the table: place of the caption}.

    A caption may own the next table on either side, but not one behind another caption.  Those with one
    candidate take it first, which leaves others with one; what is open then takes the table below.
    """
    captions = [i for i, k in enumerate(kinds) if k == "caption"]
    options: dict[int, list[int]] = {}
    for at, i in enumerate(captions):
        lo = captions[at - 1] if at else -1
        hi = captions[at + 1] if at + 1 < len(captions) else len(kinds)
        below = next((j for j in range(i + 1, hi) if kinds[j] == "table"), None)
        above = next((j for j in range(i - 1, lo, -1) if kinds[j] == "table"), None)
        options[i] = [j for j in (below, above) if j is not None]
    owner: dict[int, int] = {}
    open_ = dict(options)
    while True:
        hit = next(((c, free[0]) for c, o in open_.items() if len(free := [t for t in o if t not in owner]) == 1), None)
        if hit is None:
            hit = next(((c, free[0]) for c, o in open_.items() if (free := [t for t in o if t not in owner])), None)
            if hit is None:
                return owner
        owner[hit[1]] = hit[0]
        del open_[hit[0]]


def owned_tables(blocks: DataFrame, doc: str = "doc", pos: str = "pos", kind: str = "kind") -> DataFrame:
    """``(doc, pos, caption)``: the tables of each document with the place of the caption that owns them, null if none does."""
    place = blocks.schema[pos].dataType.simpleString()
    name = blocks.schema[doc].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        order = rows.sort_by(pos)
        at, kinds = order.column(pos).to_pylist(), order.column(kind).to_pylist()
        owner = _owned(kinds)
        tables = [i for i, k in enumerate(kinds) if k == "table"]
        return pa.table({doc: order.column(doc).take(pa.array(tables, pa.int64())), pos: order.column(pos).take(pa.array(tables, pa.int64())), "caption": pa.array([at[owner[i]] if i in owner else None for i in tables], order.schema.field(pos).type)})

    # only captions and tables decide; what stands between them doesn't
    return blocks.where(F.col(kind).isin("caption", "table")).select(doc, pos, kind).groupBy(doc).applyInArrow(run, f"{doc} {name}, {pos} {place}, caption {place}")


def tables_after(blocks: DataFrame, captions: DataFrame, count: int = 1) -> DataFrame:
    """``captions(doc, at)`` with ``table`` and ``k``: the ``count`` tables that follow each in ``blocks(doc, pos, kind)``."""
    t = blocks.where("kind = 'table'").select(F.col("doc").alias("_d"), F.col("pos").alias("table"))
    joined = captions.join(t, (F.col("doc") == F.col("_d")) & (F.col("table") > F.col("at"))).drop("_d")
    return joined.withColumn("k", F.row_number().over(Window.partitionBy("doc", "at").orderBy("table"))).where(F.col("k") <= count)


def pinned_order(rows: DataFrame, doc: str, label: str, pins: list, then: list[str]) -> DataFrame:
    """Rows with ``place``: by label, those with a pinned label after all others."""
    order = Window.partitionBy(doc).orderBy(F.col(label).isin(pins), label, *then)
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def grid(cells: DataFrame, row_keys: list[str], column: str, span: str) -> DataFrame:
    """Cells with ``gcol``, the grid column a cell starts at, from the spans before it."""
    before = Window.partitionBy(*row_keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("gcol", F.coalesce(F.sum(span).over(before), F.lit(0)))


def inherit(styles: DataFrame, style: str, parent: str, value: str) -> DataFrame:
    """``(style, value)``: a style's own value, else that of the nearest one it is based on.

    Pointers double every round, so a chain of n styles needs log2(n) joins, however long it is; what
    still waits after as many rounds as there can be stands in a cycle and has no value.
    """
    from vellum.operators.documents import held

    now = held(styles.select(style, F.col(parent).alias("_up"), value))
    waiting = F.col(value).isNull() & F.col("_up").isNotNull()
    for _ in range(max(1, now.count()).bit_length()):
        if now.where(waiting).isEmpty():
            break
        above = now.select(F.col(style).alias("_s"), F.col("_up").alias("_upup"), F.col(value).alias("_v"))
        joined = now.join(above, waiting & (F.col("_up") == F.col("_s")), "left")
        now = held(joined.select(style, F.when(F.col(value).isNull(), F.col("_upup")).alias("_up"), F.coalesce(value, "_v").alias(value)))
    return now.select(style, value)
