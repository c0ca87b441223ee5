"""Manuscripts as tables: from parts to blocks, cells, revisions, notes, links and findings."""

from __future__ import annotations

import copy
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from vellum.functions import markup, wordml
from vellum.functions.text import words

DOCUMENT = "word/document.xml"
BLOCKS = "pos int, kind string, table int, level int, style string, text string, maths string, display boolean"
CELLS = "table int, row int, cell int, gcol int, span int, vmerge string, text string"
REVISIONS = "seq int, kind string, author string, date string, text string"
NOTES = "kind string, id string, text string"
COMMENTS = "id string, author string, date string, text string"
NOTE_REFERENCES = "kind string, id string"
LINKS = "anchor string, label string, form string"
BOOKMARKS = "name string, id string"
LINT = "code string, where string"

REFERENCES = r"(?iu)^(References|Bibliography|Works Cited|Список литературы|Литература)\s*:?$"
APPENDIX = r"(?iu)^(Online\s+)?Appendi(x|ces)\b|^Annex(es)?\b|^Приложени[ея]\b"


#: Rows of many documents that go back to the JVM at once.
AT_ONCE = 20_000


class Once:
    """A function of bytes that isn't asked again for those of the last ``MANY`` parts, of ``ROOM`` bytes in all.

    Where few come again nothing is kept any more.  What it gives is shared, so it isn't to be changed.
    """

    MANY, ROOM = 4096, 16 << 20

    def __init__(self, function: Callable) -> None:
        self.function = function
        self.kept: dict | None = {}
        self.room = self.hits = self.misses = 0

    def __call__(self, blob: bytes):  # noqa: ANN204
        if self.kept is None:
            return self.function(blob)
        if blob in self.kept:
            self.hits += 1
            return self.kept[blob]
        made = self.function(blob)
        self.misses += 1
        self.room += len(blob)
        if len(self.kept) >= self.MANY or self.room > self.ROOM:
            self.kept, self.room = {} if self.hits > self.misses else None, len(blob)
        if self.kept is not None:
            self.kept[blob] = made
        return made


def rows_of(parts: DataFrame, read: Callable, schema: str, view: str | None = None, part: str = DOCUMENT, where: wordml.Where | None = None, once: bool = False) -> DataFrame:
    """``(doc, ...)`` rows that ``read(tree)`` gives for each document's part, in one side of its changes.

    ``view`` is ``final``, ``original`` or ``both``, which gives the rows of each with a column ``view``
    from one parse.  Parts are filtered before Python sees them.  A part that doesn't parse gives no
    rows here; see :func:`malformed`.  With ``once`` a part that has the bytes of another isn't read again.
    """
    full = _parse_datatype_string(f"doc string, {'view string, ' * (view == 'both')}{schema}")
    assert isinstance(full, StructType)
    arrow = to_arrow_schema(full)
    names = [f.name for f in full.fields if f.name != "doc" and (f.name != "view" or view != "both")]

    def sides(blob: bytes) -> Iterator[tuple[str | None, ET.Element]]:
        root, _ = wordml.parse(blob)
        if root is None:
            return
        if view is None or not wordml.REVISION.search(blob):
            yield from ((s, root) for s in (("final", "original") if view == "both" else (view,)))
        elif view == "both":
            yield "final", wordml.in_view(copy.deepcopy(root), "final", where)
            yield "original", wordml.in_view(root, "original", where)
        else:
            yield view, wordml.in_view(root, view, where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[str] = []
        views: list[str | None] = []
        columns: list[list] = [[] for _ in names]

        def emit() -> pa.RecordBatch:
            lists = [docs, *([views] if view == "both" else []), *columns]
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(lists, arrow, strict=True)], schema=arrow)
            for c in lists:
                c.clear()
            return made

        def found(blob: bytes) -> list[list]:
            rows = [(side, r) for side, root in sides(blob) for r in read(root)]
            return [[side for side, _ in rows], *([r[n] for _, r in rows] for n in names)]

        if once:
            found = Once(found)
        for batch in batches:
            for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                side, *more = found(blob)
                docs += [doc] * len(side)
                views += side
                for c, m in zip(columns, more, strict=True):
                    c += m
                if len(docs) >= AT_ONCE:
                    yield emit()
        if docs:
            yield emit()

    return loose(parts).where((F.col("part") == part) & F.col("blob").isNotNull()).select("doc", "blob").mapInArrow(run, full)


# whole packages: a document's parts in one row, as an archive has them; nothing has to bring them together again


def whole(parts: DataFrame) -> DataFrame:
    """``(doc, rows)``: the parts of each document in one row; packages that come so stay."""
    return parts if "rows" in parts.columns else parts.groupBy("doc").agg(F.collect_list(F.struct("part", "blob")).alias("rows"))


def loose(parts: DataFrame) -> DataFrame:
    """``(doc, part, blob)`` of packages in whichever form."""
    return parts.select("doc", F.explode("rows").alias("p")).select("doc", "p.*") if "rows" in parts.columns else parts


def rows_of_whole(parts: DataFrame, read: Callable[[dict[str, bytes]], Iterator[dict]], schema: str) -> DataFrame:
    """``(doc, ...)`` rows that ``read`` gives for each document from its parts by name."""
    full = _parse_datatype_string(f"doc string, {schema}")
    assert isinstance(full, StructType)
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [{"doc": d, **r} for d, own in zip(docs, rows, strict=True) for r in read({p["part"]: p["blob"] for p in own if p["blob"] is not None})]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return whole(parts).select("doc", "rows").mapInArrow(run, full)


def repackaged(parts: DataFrame, change: Callable[..., dict[str, bytes]], *given: str) -> DataFrame:
    """The packages with the parts that ``change`` makes of a document's parts by name (and of the columns ``given``); in the form they come in."""
    kind = "doc string, rows array<struct<part:string,blob:binary>>"
    schema = to_arrow_schema(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, blobs = (c.to_pylist() for c in batch.column(1).flatten().flatten())
            made, ends = [], [0]
            for n, *more in zip(batch.column(1).value_lengths().to_pylist(), *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                own = list(zip(names[ends[-1] : ends[-1] + n], blobs[ends[-1] : ends[-1] + n], strict=True))
                new = change({p: b for p, b in own if b is not None}, *more)
                made += [new.get(p, b) for p, b in own]
                ends.append(len(made))
            kind = schema.field(1).type
            flat = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.binary())], fields=list(kind.value_type))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=kind)], schema=schema)

    made = whole(parts).select("doc", "rows", *given).mapInArrow(run, kind)
    return made if "rows" in parts.columns else loose(made)


def large(frame: DataFrame) -> DataFrame:
    """Rows of all documents, which no join is to send out whole: an estimate from the input's few bytes takes what is written from it for small."""
    return frame.hint("merge")


def rewritten(parts: DataFrame, part: str, change: Callable[[bytes], bytes]) -> DataFrame:
    """The parts with ``change`` made to the bytes of one.

    It is apart from the others, so that a filter of what comes out neither changes it twice nor sends them to Python.
    """
    if "rows" in parts.columns:
        return repackaged(parts, lambda blobs: {part: change(blobs[part])} if part in blobs else {})
    at, schema = parts.columns.index("blob"), parts.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if b is None else change(b) for b in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(made, batch.schema.field(at).type))

    own = F.col("part").eqNullSafe(F.lit(part))
    return parts.where(~own).unionByName(parts.where(own).mapInArrow(run, schema))


def held(frame: DataFrame) -> DataFrame:
    """The rows kept where several branches of a plan read them: written to ``spark.checkpoint.dir``, or cached where that is unset."""
    return frame.checkpoint() if frame.sparkSession.sparkContext.getCheckpointDir() else frame.persist()


def blocks(parts: DataFrame, view: str = "final") -> DataFrame:
    return rows_of(parts, wordml.blocks, BLOCKS, view)


def cells(parts: DataFrame, view: str = "final") -> DataFrame:
    return rows_of(parts, wordml.cells, CELLS, view)


def revisions(parts: DataFrame) -> DataFrame:
    return rows_of(parts, wordml.revisions, REVISIONS)


def links(parts: DataFrame) -> DataFrame:
    return rows_of(parts, wordml.links, LINKS)


def bookmarks(parts: DataFrame) -> DataFrame:
    return rows_of(parts, wordml.bookmarks, BOOKMARKS)


def comments(parts: DataFrame) -> DataFrame:
    return rows_of(parts, wordml.comments, COMMENTS, part="word/comments.xml")


def notes(parts: DataFrame, view: str = "final") -> DataFrame:
    foot = rows_of(parts, wordml.notes, NOTES, view, "word/footnotes.xml")
    return foot.unionByName(rows_of(parts, wordml.notes, NOTES, view, "word/endnotes.xml"))


def lint(parts: DataFrame) -> DataFrame:
    return rows_of(parts, wordml.lint, LINT)


def malformed(parts: DataFrame) -> DataFrame:
    """``(doc, part, error)`` of XML parts that don't parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [wordml.parse(b)[1] for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(errors, pa.string())], names=["doc", "part", "error"])

    xml = parts.where(F.col("part").rlike(r"\.(xml|rels)$")).select("doc", "part", "blob")
    return xml.mapInArrow(run, "doc string, part string, error string").where("error IS NOT NULL")


def orphan_notes(parts: DataFrame) -> DataFrame:
    """Notes that nothing in the document refers to."""
    refs = rows_of(parts, wordml.references_to_notes, NOTE_REFERENCES, "final")
    return notes(parts).join(refs, ["doc", "kind", "id"], "left_anti")


def dangling_links(parts: DataFrame) -> DataFrame:
    """Links whose place isn't in the document."""
    names = bookmarks(parts).select("doc", F.col("name").alias("anchor"))
    return links(parts).join(names, ["doc", "anchor"], "left_anti")


def internal_links(parts: DataFrame) -> DataFrame:
    """``(doc, anchor, label, form, para, dead)`` of links to places, in their order, all forms."""
    return rows_of(parts, markup.internal_links, "anchor string, label string, form string, para int, dead boolean")


def dead_links(parts: DataFrame) -> DataFrame:
    """Links that show nothing; one round a deletion, a drawing or a note shows that, and one not yet rendered isn't dead."""
    return internal_links(parts).where("dead").drop("dead")


def grid_rows(found: DataFrame) -> DataFrame:
    """Cells on their table's full grid: spans repeated, vertical merges carried down."""
    wide = found.withColumn("gcol", F.explode(F.sequence(F.col("gcol"), F.col("gcol") + F.col("span") - 1)))
    above = Window.partitionBy("doc", "table", "gcol").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(~F.col("vmerge").eqNullSafe(F.lit("continue")), F.col("text"))
    return wide.withColumn("text", F.last(own, ignorenulls=True).over(above)).select("doc", "table", "row", "gcol", "text")


def word_counts(found: DataFrame, note_rows: DataFrame | None = None) -> DataFrame:
    """Words of each document by bucket.

    A paragraph that is a heading of the references or of an appendix opens a zone, which takes all
    that follows, tables included, until the next one.  Notes are counted apart.
    """
    so_far = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    shown = F.trim(F.concat_ws(" ", "text", "maths"))
    opens = F.when(F.col("kind") != "cell", F.when(shown.rlike(REFERENCES), "references").when(shown.rlike(APPENDIX), "appendix"))
    zoned = found.withColumn("zone", F.last(opens, ignorenulls=True).over(so_far))
    prose, maths = words(F.col("text")), words(F.col("maths"))
    bucket = F.coalesce("zone", F.when(F.col("kind") == "cell", "tables").when(F.col("kind") == "caption", "captions").when(F.col("kind") == "heading", "headings").otherwise("prose"))
    both = F.col("zone").isNotNull() | F.col("kind").isin("cell", "caption")
    counted = zoned.select("doc", F.explode(F.array(
        F.struct(bucket.alias("bucket"), F.when(both, prose + maths).otherwise(prose).alias("n")),
        F.struct(F.lit("equations").alias("bucket"), F.when(both | (F.col("kind") == "heading"), F.lit(0)).otherwise(maths).alias("n")),
    )).alias("b")).select("doc", "b.*")
    if note_rows is not None:
        counted = counted.unionByName(note_rows.select("doc", F.lit("footnotes").alias("bucket"), words(F.col("text")).alias("n")))
    names = ["prose", "headings", "captions", "tables", "equations", "references", "appendix", "footnotes"]
    wide = counted.groupBy("doc").pivot("bucket", names).agg(F.sum("n"))
    return wide.select("doc", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))


def to_markdown(found: DataFrame, cell_rows: DataFrame | None = None) -> DataFrame:
    """``(doc, markdown)``: headings, captions, paragraphs and display maths in order; tables as pipe tables."""
    text = F.trim(F.concat_ws(" ", "text", "maths"))
    shown = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text))
        .when(F.col("kind") == "caption", F.concat(F.lit("**"), text, F.lit("**")))
        .when(F.col("display"), F.concat(F.lit("$$"), F.col("maths"), F.lit("$$")))
        .otherwise(text)
    )
    lines = found.where("kind NOT IN ('cell', 'table')").select("doc", "pos", shown.alias("md")).where("md <> ''")
    if cell_rows is not None:
        flat = grid_rows(cell_rows).withColumn("text", F.replace(F.replace("text", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
        row = flat.groupBy("doc", "table", "row").agg(F.array_sort(F.collect_list(F.struct("gcol", "text"))).alias("c"))
        row = row.select("doc", "table", "row", F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["text"]), " | "), F.lit(" |")).alias("line"), F.size("c").alias("n"))
        rule = F.when(F.col("row") == 0, F.concat(F.col("line"), F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("n")))).otherwise(F.col("line"))
        whole = row.select("doc", "table", "row", rule.alias("line")).groupBy("doc", "table").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("r"))
        whole = whole.select("doc", "table", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("md"))
        places = found.where("kind = 'table'").select("doc", "table", "pos")
        lines = lines.unionByName(places.join(whole, ["doc", "table"]).select("doc", "pos", "md"))
    ordered = lines.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "md"))).alias("b"))
    return ordered.select("doc", F.concat(F.array_join(F.transform("b", lambda x: x["md"]), "\n\n"), F.lit("\n")).alias("markdown"))


def paragraphs_of(parts: DataFrame) -> DataFrame:
    """``(doc, pos, xml)``: each paragraph's own markup, nested ones included, in document order."""
    from vellum.functions import editing

    def read(root):  # noqa: ANN001, ANN202
        for pos, p in enumerate(root.iter(wordml.W + "p")):
            yield {"pos": pos, "xml": editing.write(p)}

    return rows_of(parts, read, "pos int, xml string")


def paragraph_lists(parts: DataFrame) -> DataFrame:
    """``(doc, paragraphs)``: the same, all of a document in one row."""
    from vellum.functions import editing

    def read(root):  # noqa: ANN001, ANN202
        yield {"paragraphs": [editing.write(p) for p in root.iter(wordml.W + "p")]}

    return rows_of(parts, read, "paragraphs array<string>")


def apply_edits(paragraphs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraphs ``(doc, pos, xml)`` after the edits ``(doc, seq, name, sign, old, new)``, and the verdicts.

    A document's edits run in order, each on what the ones before left; documents are independent.
    """
    from vellum.functions import editing

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["pos"])
        steps = [editing.Edit(r["name"], r["sign"], r["old"], r["new"]) for r in sorted(right.to_pylist(), key=lambda r: r["seq"])]
        doc = (rows or right.to_pylist())[0]["doc"]
        made, verdicts = editing.apply_batch([r["xml"] for r in rows], steps)
        out = [{"doc": doc, "pos": r["pos"], "xml": x, "name": None, "ok": None, "why": None} for r, x in zip(rows, made, strict=True)]
        out += [{"doc": doc, "pos": k, "xml": None, "name": n, "ok": ok, "why": why} for k, (n, ok, why) in enumerate(verdicts)]
        return pa.Table.from_pylist(out, schema=pa.schema([("doc", pa.string()), ("pos", pa.int32()), ("xml", pa.string()), ("name", pa.string()), ("ok", pa.bool_()), ("why", pa.string())]))

    schema = "doc string, pos int, xml string, name string, ok boolean, why string"
    both = paragraphs.select("doc", "pos", "xml").groupBy("doc").cogroup(edits.select("doc", "seq", "name", "sign", "old", "new").groupBy("doc")).applyInArrow(run, schema)
    return both.where("name IS NULL").select("doc", "pos", "xml"), both.where("name IS NOT NULL").select("doc", F.col("pos").alias("seq"), "name", "ok", "why")
