"""Shards along a Hilbert curve, with DataFrame functions only.

Several metadata columns are quantised to ``BITS`` bits each, so that every bin holds about as many
rows; a row's cell has an index on the Hilbert curve through the bins.  Rows sorted by that index
and cut into runs give files with narrow ranges in all of the columns at once, which readers prune
by their minima and maxima.

The bins are cut by counting all rows: each column's range is parted into steps, and steps that hold
too many rows into steps again, so that neither a common beginning of texts nor an outlier puts all
rows into one bin.

No global sort is needed: rows are counted per cell, and per part of it by a hash of the row (as many
parts as make ``PART_ROWS`` rows each, so that a cell with a third of all rows is dealt over many
tasks); the counts of at most ``2 ** (BITS * columns)`` cells are added up along the curve, and a row's
place is its group's start plus its rank in the group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from vellum.llm.common import cut, free_name, table

BITS = 4
#: Rows of a part of a cell, about.
PART_ROWS = 500_000
#: Steps that a column's segments are parted into in one round, and the rounds at most.
STEPS, ROUNDS = 4096, 8
#: Bytes of text that a step tells apart.
STEP_BYTES = 6
SHARDS = 8


@dataclass
class _Segment:
    """Values from ``low`` to ``high`` of a column, both of which occur, and the rows that have them."""

    low: object
    high: object
    rows: int


def _value(frame: DataFrame, column: str) -> Column:
    """The column as a double or as text, which are ordered as it is; null and NaN are null."""
    if isinstance(frame.schema[column].dataType, NumericType):
        number = F.col(column).cast("double")
        return F.when(~F.isnan(number), number)
    return F.col(column).cast("string")


def _shared_bytes(low: str, high: str) -> int:
    a, b = low.encode(), high.encode()
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _step(value: Column, segment: _Segment, steps: int) -> Column:
    """Which of ``steps`` steps from the segment's low to its high a value is in."""
    if isinstance(segment.low, float):
        width = (segment.high / steps) - (segment.low / steps)
        return F.least(F.floor((value - F.lit(segment.low)) / F.lit(width)).cast("int"), F.lit(steps - 1)) if width > 0 else F.lit(0)
    # the bytes behind those that all texts of the segment begin with, as a number
    same = _shared_bytes(segment.low, segment.high)
    number = lambda raw: int.from_bytes(raw[same : same + STEP_BYTES].ljust(STEP_BYTES, b"\0"), "big")
    low, high = number(segment.low.encode()), number(segment.high.encode())
    digits = F.substring(F.hex(F.encode(value, "UTF-8")), 2 * same + 1, 2 * STEP_BYTES)
    at = F.conv(F.rpad(digits, 2 * STEP_BYTES, "0"), 16, 10).cast("double") - F.lit(float(low))
    return F.least(F.floor(at / F.lit(max(1.0, (high - low) / steps))).cast("int"), F.lit(steps - 1))


def _segments(frame: DataFrame, columns: list[str], most: float) -> dict[str, list[_Segment]]:
    """Of each column, segments in order that hold all its values, of at most about ``most`` of the rows unless of one value.

    What comes to the driver in a round is ``STEPS`` counts of a column at most.
    """
    values = {c: _value(frame, c) for c in columns}
    ends = frame.select(*(f(values[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.min, "lo"), (F.max, "hi"), (F.count, "n")))).first()
    found = {c: [_Segment(ends[f"lo{i}"], ends[f"hi{i}"], ends[f"n{i}"])] if ends[f"n{i}"] else [] for i, c in enumerate(columns)}
    total = {c: sum(s.rows for s in found[c]) for c in columns}
    for _ in range(ROUNDS):
        heavy = {i: [(k, s) for k, s in enumerate(found[c]) if s.low != s.high and s.rows > most * total[c]] for i, c in enumerate(columns)}
        if not any(heavy.values()):
            break
        items = []
        for i, parts in heavy.items():
            value, steps = values[columns[i]], STEPS // max(1, len(parts))
            at = None
            for k, s in parts:
                inside = value.between(F.lit(s.low), F.lit(s.high))
                place = F.struct(F.lit(i).alias("c"), F.lit(k).alias("k"), _step(value, s, steps).alias("s"))
                at = F.when(inside, place) if at is None else at.when(inside, place)
            if at is not None:
                items.append(F.struct(at.alias("at"), value.cast("string").alias("text"), (value if isinstance(parts[0][1].low, float) else F.lit(None)).cast("double").alias("number")))
        counted = frame.select(F.explode(F.array(*items)).alias("x")).where("x.at IS NOT NULL").groupBy("x.at.c", "x.at.k", "x.at.s")
        told = counted.agg(F.count("*").alias("n"), F.min("x.number").alias("lo"), F.max("x.number").alias("hi"), F.min("x.text").alias("lo_text"), F.max("x.text").alias("hi_text")).collect()
        by: dict[tuple[int, int], list] = {}
        for r in told:
            by.setdefault((r["c"], r["k"]), []).append(r)
        for i, c in enumerate(columns):
            out = []
            for k, s in enumerate(found[c]):
                parts = sorted(by.get((i, k), []), key=lambda r: r["s"])
                out += [_Segment(r["lo"], r["hi"], r["n"]) if isinstance(s.low, float) else _Segment(r["lo_text"], r["hi_text"], r["n"]) for r in parts] or [s]
            found[c] = out
    return found


def quantise(frame: DataFrame, columns: list[str], bits: int = BITS) -> list[Column]:
    """A bin from 0 to ``2 ** bits - 1`` for each column, by bins of about equal numbers of rows.

    A value is in one bin, so one that many rows have makes a bin larger.  Null and NaN are in bin 0.
    """
    out = []
    for c, segments in _segments(frame, columns, 1 / (1 << bits) / 8).items():
        total, before, cuts = sum(s.rows for s in segments), 0, []
        for s in segments:
            # the bin of a segment is that of its middle row; a cut is the first value of a bin
            cuts += [s.low] * (min((1 << bits) - 1, (2 * before + s.rows) * (1 << bits) // (2 * total)) - len(cuts))
            before += s.rows
        number = reduce(lambda x, y: x + y, ((_value(frame, c) >= F.lit(at)).cast("int") for at in cuts), F.lit(0))
        out.append(F.coalesce(number, F.lit(0)))
    return out


def hilbert_index(cells: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """``cells`` with the place of its point on the Hilbert curve, by Skilling's transposition.

    Every step is a projection on all axes, so no expression grows.
    """
    x = [f"__axis{i}" for i in range(len(axes))]
    frame = cells.select("*", *(F.col(a).cast("int").alias(b) for a, b in zip(axes, x, strict=True)))

    def put(frame: DataFrame, new: dict[str, Column]) -> DataFrame:
        return frame.withColumns(new)

    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for a in x:
            low = q - 1
            swap = F.col(x[0]).bitwiseXOR(F.col(a)).bitwiseAND(low)
            has = F.col(a).bitwiseAND(q) != 0
            first = F.when(has, F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0]).bitwiseXOR(swap))
            other = {} if a == x[0] else {a: F.when(has, F.col(a)).otherwise(F.col(a).bitwiseXOR(swap))}
            if a == x[0]:
                first = F.when(has, F.col(x[0]).bitwiseXOR(low)).otherwise(F.col(x[0]))
            frame = put(frame, {x[0]: first, **other})
    for a, b in zip(x[1:], x[:-1], strict=True):
        frame = put(frame, {a: F.col(a).bitwiseXOR(F.col(b))})
    turn = reduce(lambda s, t: s.bitwiseXOR(t), (F.when(F.col(x[-1]).bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)) for b in range(bits - 1, 0, -1)), F.lit(0))
    frame = put(frame, {"__turn": turn})
    frame = put(frame, {a: F.col(a).bitwiseXOR(F.col("__turn")) for a in x})
    places = [(a, b) for b in range(bits - 1, -1, -1) for a in x]
    parts = [F.shiftleft(F.shiftright(F.col(a), b).bitwiseAND(1).cast("long"), len(places) - 1 - i) for i, (a, b) in enumerate(places)]
    return frame.withColumn(name, reduce(lambda s, t: s + t, parts)).drop(*x, "__turn")


def assign_shards(docs: DataFrame, columns: list[str], key: str, shards: int = SHARDS, order: list[Column] | None = None, bits: int = BITS) -> DataFrame:
    """``docs`` with ``curve`` (the cell's index), ``shard`` and ``slot`` (from 0 in each shard).

    Shards are runs of the curve with numbers of rows at most one apart.  Rows of one cell are in
    the order of their part, a hash of ``key`` and ``order``, then of ``key`` and ``order``; rows that are
    alike in all these are interchangeable.  Columns of these names in ``docs`` are replaced.  Nulls are in the first
    bins.  Empty tables give no rows.
    """
    cell, part, place, parts = (free_name(docs, n) for n in ("cell", "cell_part", "cell_place", "cell_parts"))
    axes = quantise(docs, columns, bits)
    packed = reduce(lambda s, a: s * (1 << bits) + a, axes, F.lit(0)).cast("int")
    celled = docs.drop("curve", "shard", "slot").withColumn(cell, packed)
    # at most 2 ** (bits * columns) rows, of the cells that need more parts than one
    split = cut(celled.groupBy(F.col(cell).alias("split_cell")).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias(parts)).where(F.col(parts) > 1))
    dealt = celled.join(F.broadcast(split), F.col(cell) == F.col("split_cell"), "left").drop("split_cell")
    dealt = dealt.withColumn(part, F.pmod(F.xxhash64(F.col(key), *(order or [])), F.coalesce(F.col(parts), F.lit(1))).cast("int")).drop(parts)
    counts = cut(dealt.groupBy(cell, part).agg(F.count("*").alias("n")))
    names = [f"axis{i}" for i in range(len(columns))]
    # at most 2 ** (bits * columns) rows from here to ``starts``
    cells = counts.groupBy(F.col(cell).alias("c")).agg(F.sum("n").alias("cell_n"))
    points = cells.select("*", *(F.shiftright(F.col("c"), bits * (len(names) - 1 - i)).bitwiseAND((1 << bits) - 1).alias(a) for i, a in enumerate(names)))
    curve = hilbert_index(points, names, bits, "curve")
    along = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    curve = curve.select("c", "curve", F.coalesce(F.sum("cell_n").over(along), F.lit(0)).alias("cell_start"), F.sum("cell_n").over(everywhere).alias("total"))
    inside = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(cell).alias("c"), F.col(part).alias("p"), "n").join(curve, "c").select(
        F.col("c").alias("start_cell"), F.col("p").alias("start_part"), "curve", "total",
        (F.col("cell_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"),
    )
    rank = F.row_number().over(Window.partitionBy(cell, part).orderBy(F.col(key), *(order or [])))
    placed = dealt.withColumn(place, rank - 1).join(starts, (F.col(cell) == F.col("start_cell")) & (F.col(part) == F.col("start_part")))
    at = F.col("start") + F.col(place)
    shard = F.expr(f"(start + {place}) * {int(shards)} DIV total")
    first = F.expr(f"(shard * total + {int(shards) - 1}) DIV {int(shards)}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (at - first).cast("long")).select(*(c for c in docs.columns if c.lower() not in {"curve", "shard", "slot"}), "curve", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, in the order of the slots, which is the curve's."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document.

    One row per row of the table, repeated rows and null ids included; a null text has size one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "n_chars",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.octet_length("text")).cast("long").alias("bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    sharded = assign_shards(docs, ["source", "lang", "n_chars", "doc_id"], "doc_id", order=[F.col("text_crc32"), F.col("bytes")])
    return sharded.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
