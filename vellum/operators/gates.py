"""Gates of a redline: what accepting or rejecting all of it must give back, and what an edit must not lose.

A redline, its original and the clean copy are tables of parts ``(doc, part, ord, blob)``.  Each gate is
an aggregate, an anti join or a multiset difference over what the parts hold; only the views and the
alignment of paragraphs run in Python.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import equations, markup, wordml
from vellum.functions.text import visible_text
from vellum.functions.wordml import W
from vellum.operators import checks, compare, documents

# The parts that hold a reader's text, carriers that show no glyph, and properties that a document says of itself.
TEXT_PARTS = ("word/document.xml", "word/footnotes.xml", "word/endnotes.xml")
CARRIERS = ("tbl", "tr", "tc", "bookmarkStart", "sectPr", "drawing", "footnoteReference")
PROPERTIES = ("dc:title", "dc:subject", "dc:creator", "cp:keywords", "dc:description", "cp:category")
#: Paragraphs that a gate names.
NAMED = 8


def xml_of(parts: DataFrame, *names: str) -> DataFrame:
    """``(doc, part, xml)`` of these parts, the text parts by default."""
    return parts.where(F.col("part").isin(*(names or TEXT_PARTS))).select("doc", "part", F.col("blob").cast("string").alias("xml"))


def in_view(parts: DataFrame, view: str, where: wordml.Where | None = None) -> DataFrame:
    """The parts as they read with all changes accepted (``final``) or rejected (``original``).

    A note whose reference went and that is empty then is no note any more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column(2).to_pylist():
                root = wordml.parse(blob)[0] if blob is not None and wordml.REVISION.search(blob) else None
                out.append(blob if root is None else wordml.serialise(wordml.in_view(root, view, where)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc", "part", "blob"])

    if "rows" in parts.columns:

        def change(blobs: dict[str, bytes]) -> dict[str, bytes]:
            roots = {p: wordml.parse(blobs[p])[0] for p in TEXT_PARTS if p in blobs and wordml.REVISION.search(blobs[p])}
            return {p: wordml.serialise(wordml.in_view(root, view, where)) for p, root in roots.items() if root is not None}

        return documents.repackaged(parts, change)
    text = F.col("part").isin(*TEXT_PARTS)
    seen = parts.where(text).select("doc", "part", "blob").mapInArrow(run, "doc string, part string, blob binary")
    return parts.where(~text).select("doc", "part", "blob").unionByName(seen)


def accepted(parts: DataFrame) -> DataFrame:
    return in_view(parts, "final")


def rejected(parts: DataFrame) -> DataFrame:
    return in_view(parts, "original")


def _texts(root: ET.Element) -> Iterator[dict]:
    for pos, p in enumerate(root.iter(W + "p")):
        yield {"pos": pos, "text": wordml.text_of(p, maths=False)}


def paragraph_texts(parts: DataFrame, view: str | None = None) -> DataFrame:
    """``(doc, pos, text)`` of all paragraphs of the body, empty ones too, equations left out."""
    return documents.rows_of(parts, _texts, "pos int, text string", view)


def _mismatched(now: DataFrame, should: DataFrame, fold: bool) -> DataFrame:
    squeeze = (lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))) if fold else (lambda c: c)
    side = lambda d: d.select("doc", "pos", squeeze(F.col("text")).alias("text"))
    found = compare.changed_paragraphs(side(now), side(should))
    order = Window.partitionBy("doc").orderBy(F.coalesce("before_pos", "after_pos"), F.col("after_pos").asc_nulls_first())
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= NAMED).drop("k")


def unaccepted(redline: DataFrame, clean: DataFrame, fold_space: bool = False) -> DataFrame:
    """The first paragraphs of each document where accepting everything doesn't give the clean copy."""
    return _mismatched(paragraph_texts(redline, "final"), paragraph_texts(clean), fold_space)


def untracked(redline: DataFrame, original: DataFrame) -> DataFrame:
    """The first paragraphs of each document where rejecting everything doesn't give the original: changed without a mark."""
    return _mismatched(paragraph_texts(redline, "original"), paragraph_texts(original), False)


# counts


def _count(pattern: str, xml: str = "xml") -> Column:
    return F.regexp_count(xml, F.lit(pattern))


REVISION = r"<w:(?:ins|del|moveFrom|moveTo|cellIns|cellDel|cellMerge|[rp]PrChange|sectPrChange|tblPrChange|trPrChange|tcPrChange|tblGridChange|numberingChange|tblPrExChange)(?=[\s/>])"


def revision_elements(parts: DataFrame) -> DataFrame:
    """``(doc, part, kind)``: every pending revision of the text parts."""
    kinds = F.regexp_extract_all("xml", F.lit(REVISION.replace("(?:", "(", 1)), F.lit(1))
    return xml_of(parts).select("doc", "part", F.explode(kinds).alias("kind"))


def package_counts(parts: DataFrame) -> DataFrame:
    """``(doc, insertions, deletions, comments, revisions)`` of whole packages."""
    found = xml_of(parts, *TEXT_PARTS, "word/comments.xml")
    text = F.col("part") != "word/comments.xml"
    total = lambda pattern, where: F.sum(F.when(where, _count(pattern)).otherwise(0)).cast("long")
    return found.groupBy("doc").agg(
        total(r"<w:ins(?=[\s/>])", text).alias("insertions"), total(r"<w:del(?=[\s/>])", text).alias("deletions"),
        total(r"<w:comment\s[^>]*w:id=", ~text).alias("comments"), total(REVISION, text).alias("revisions"),
    )


def revisions_by_part(parts: DataFrame) -> DataFrame:
    """``(doc, part, revisions)`` of text parts that have some."""
    return xml_of(parts).select("doc", "part", _count(REVISION).cast("long").alias("revisions")).where("revisions > 0")


def structure_counts(parts: DataFrame) -> DataFrame:
    """``(doc, tag, n)``: carriers that show no glyph, counted over the text parts."""
    counted = xml_of(parts).groupBy("doc").agg(*(F.sum(_count(rf"<w:{t}\b")).cast("long").alias(t) for t in CARRIERS))
    return counted.select("doc", F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).alias("n")) for t in CARRIERS))).alias("c")).select("doc", "c.*")


def structure_diff(before: DataFrame, after: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """``(doc, tag, was, now)`` of every count that moved."""
    was, now = structure_counts(before).withColumnRenamed("n", "was"), structure_counts(after).withColumnRenamed("n", "now")
    both = was.join(now, ["doc", "tag"], "full_outer").select("doc", "tag", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    return both.where((F.col("was") != F.col("now")) & ~F.col("tag").isin(*skip, ""))


# bookmarks, links, properties


def bookmark_names(parts: DataFrame) -> DataFrame:
    """``(doc, name, times)`` over all text parts."""
    names = F.regexp_extract_all("xml", F.lit(r'<w:bookmarkStart\b[^>]*\bw:name="([^"]*)"'), F.lit(1))
    return xml_of(parts).select("doc", F.explode(names).alias("name")).groupBy("doc", "name").agg(F.count("*").alias("times"))


def bookmark_additions(original: DataFrame, clean: DataFrame) -> DataFrame:
    """``(doc, name, times)``: bookmarks that the clean copy has more of."""
    was = bookmark_names(original).withColumnRenamed("times", "was")
    more = bookmark_names(clean).join(was, ["doc", "name"], "left").withColumn("times", F.col("times") - F.coalesce("was", F.lit(0)))
    return more.where("times > 0").select("doc", "name", "times")


def link_targets(parts: DataFrame) -> DataFrame:
    """``(doc, anchor)``: places that something in the text parts links to, in any form."""
    schema = "anchor string, label string, form string, para int, dead boolean"
    found = [documents.rows_of(parts, markup.internal_links, schema, part=p).select("doc", "anchor") for p in TEXT_PARTS]
    return reduce(DataFrame.unionByName, found).distinct()


def _depended(root: ET.Element) -> Iterator[dict]:
    for f in markup.fields(root):
        name = markup.target_of(f.instruction, clickable=False)
        if name:
            yield {"name": name}
        for quoted, plain in markup.re.findall(r'\bPAGEREF\s+(?:"([^"]+)"|([^\s\\"]+))', f.instruction):
            yield {"name": quoted or plain}
    for h in root.iter(W + "hyperlink"):
        if h.get(W + "anchor"):
            yield {"name": h.get(W + "anchor")}


def depended_on(parts: DataFrame) -> DataFrame:
    """``(doc, name)``: bookmarks that a link, cross-reference or page reference still names."""
    return reduce(DataFrame.unionByName, (documents.rows_of(parts, _depended, "name string", part=p) for p in TEXT_PARTS)).distinct()


def bookmark_changes(base: DataFrame, view: DataFrame, carried: DataFrame) -> DataFrame:
    """``(doc, finding, name, was, now)``: what ``view`` does to the bookmarks of ``base`` that ``carried`` doesn't explain.

    One that is lost counts, and one gained beyond what ``carried`` has more of.  Names that a word
    processor makes for itself are judged by their number, but for a lost one that something still names.
    """
    side = lambda parts, name: bookmark_names(parts).withColumnRenamed("times", name)
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts = side(base, "was").join(side(view, "now"), ["doc", "name"], "full_outer").join(side(carried, "other"), ["doc", "name"], "full_outer")
    counts = counts.select("doc", "name", n("was"), n("now"), n("other"), markup.word_minted(F.col("name")).alias("minted"))
    needed = depended_on(view).withColumn("needed", F.lit(True))
    told = counts.join(needed, ["doc", "name"], "left")
    lost = (F.col("now") < F.col("was")) & (~F.col("minted") | F.coalesce("needed", F.lit(False)))
    gained = ~F.col("minted") & (F.col("now") > F.col("was") + F.greatest(F.lit(0), F.col("other") - F.col("was")))
    named = told.select("doc", F.when(lost, "lost").when(gained, "gained").alias("finding"), "name", "was", "now").where("finding IS NOT NULL")
    own = counts.where("minted").groupBy("doc").agg(*(F.sum(c).alias(c) for c in ("was", "now", "other")))
    fits = F.col("now").between(F.col("was"), F.col("was") + F.greatest(F.lit(0), F.col("other") - F.col("was")))
    return named.unionByName(own.where(~fits).select("doc", F.lit("minted").alias("finding"), F.lit("_").alias("name"), "was", "now"))


def _property(tag: str) -> Column:
    return F.when(F.col("xml").rlike(rf"<{tag}\b"), F.regexp_extract("xml", rf"<{tag}\b[^>]*(?<!/)>([^<]*)</{tag}>", 1))


def _said(parts: DataFrame) -> DataFrame:
    """``(doc, said)``: properties that a document gives a value."""
    return xml_of(parts, "docProps/core.xml").select("doc", F.array_compact(F.array(*(F.when(_property(t) != "", t) for t in PROPERTIES))).alias("said"))


def core_property(parts: DataFrame, tag: str) -> DataFrame:
    """``(doc, value)`` of a property that a document says of itself; an empty one isn't null, an absent one is."""
    return xml_of(parts, "docProps/core.xml").select("doc", _property(tag).alias("value"))


def compare_collateral(clean: DataFrame, redline: DataFrame) -> DataFrame:
    """``(doc, finding, subject)``: what a comparison dropped on its way from the clean copy to the redline.

    Parts that come back by themselves are told from those that are lost; properties count by value.
    """
    from vellum.sources.packages import REGENERATED

    gone = clean.where("part IS NOT NULL").select("doc", "part").join(documents.large(redline.select("doc", "part")), ["doc", "part"], "left_anti")
    parts = gone.select("doc", F.when(F.col("part").rlike(REGENERATED), "part-regenerated").otherwise("part-lost").alias("finding"), F.col("part").alias("subject"))
    out = [parts, *_dropped(clean, redline, "bookmark-dropped", "link-dropped")]
    # a side says all its properties at once, so they meet in one join
    was, now = _said(clean).where("size(said) > 0"), documents.large(_said(redline).groupBy("doc").agg(F.flatten(F.collect_list("said")).alias("now")))
    lost = was.join(now, "doc", "left").select("doc", F.explode(F.filter("said", lambda t: ~F.array_contains(F.coalesce("now", F.array().cast("array<string>")), t))).alias("subject"))
    out.append(lost.select("doc", F.lit("property-lost").alias("finding"), "subject"))
    return reduce(DataFrame.unionByName, out)


def _dropped(before: DataFrame, after: DataFrame, bookmark: str, link: str) -> list[DataFrame]:
    names = checks.missing(bookmark_names(before).where("NOT startswith(name, '_')"), documents.large(bookmark_names(after)), ["doc", "name"])
    targets = checks.missing(link_targets(before).where("NOT startswith(anchor, '_')"), documents.large(link_targets(after)), ["doc", "anchor"])
    return [names.select("doc", F.lit(bookmark).alias("finding"), F.col("name").alias("subject")), targets.select("doc", F.lit(link).alias("finding"), F.col("anchor").alias("subject"))]


def accepted_losses(clean: DataFrame, redline: DataFrame) -> DataFrame:
    """``(doc, finding, subject)``: bookmarks and links of the clean copy that accepting the redline doesn't give."""
    return reduce(DataFrame.unionByName, _dropped(clean, accepted(redline), "bookmark-lost", "link-lost"))


def _maths(parts: DataFrame) -> DataFrame:
    found = xml_of(parts).withColumn("rank", F.array_position(F.array(*(F.lit(p) for p in TEXT_PARTS)), F.col("part")))
    each = found.select("doc", "rank", F.posexplode(equations.equations(F.col("xml"))).alias("k", "e"))
    order = Window.partitionBy("doc").orderBy("rank", "k")
    return each.select("doc", F.row_number().over(order).alias("k"), visible_text(F.col("e")).alias("text"))


def accepted_math(clean: DataFrame, redline: DataFrame) -> DataFrame:
    """``(doc, k, should, now, at)``: equations that accepting doesn't give back, and where they first differ."""
    was, now = _maths(clean).withColumnRenamed("text", "should"), _maths(accepted(redline)).withColumnRenamed("text", "now")
    both = was.join(now, ["doc", "k"], "full_outer").where(~F.col("should").eqNullSafe(F.col("now")))
    shared = F.least(F.length("should"), F.length("now"))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(shared, F.lit(1))), lambda i: F.substring("should", i, F.lit(1)) != F.substring("now", i, F.lit(1)))
    return both.withColumn("at", F.coalesce(F.element_at(F.when(F.size(differs) > 0, differs), 1), shared + 1) - 1)


# tables


def _cell_looks(root: ET.Element) -> Iterator[dict]:
    """Live cell properties, spelled one way: an undrawn border has no size or colour, and borders come in one order."""
    order = ("top", "start", "left", "bottom", "end", "right", "insideH", "insideV", "tl2br", "tr2bl")
    for t, table in enumerate(_outermost(root, "tbl")):
        for r, row in enumerate(_outermost(table, "tr")):
            for c, cell in enumerate(_outermost(row, "tc")):
                shown = []
                for p in markup.live_children(cell.find(W + "tcPr")):
                    if p.tag == W + "tcBorders":
                        p[:] = sorted(p, key=lambda e: order.index(e.tag.removeprefix(W)) if e.tag.removeprefix(W) in order else len(order))
                        for e in p:
                            if e.get(W + "val") in ("nil", "none"):
                                e.attrib = {W + "val": e.get(W + "val")}
                    shown.append(ET.canonicalize(ET.tostring(p, encoding="unicode"), strip_text=True))
                yield {"table": t, "row": r, "cell": c, "look": "".join(shown)}


def _outermost(parent: ET.Element, tag: str) -> Iterator[ET.Element]:
    for child in parent:
        if child.tag == W + tag:
            yield child
        elif child.tag != W + "tbl" or tag == "tbl":
            yield from _outermost(child, tag)


def cell_looks(parts: DataFrame, view: str | None = None) -> DataFrame:
    return documents.rows_of(parts, _cell_looks, "table int, row int, cell int, look string", view)


def cell_property_changes(base: DataFrame, redline: DataFrame, view: str) -> DataFrame:
    """``(doc, table, row, cell)`` of cells whose properties a side of the redline doesn't give back.

    Documents whose tables don't line up are left to the counts.
    """
    place = ["doc", "table", "row", "cell"]
    was, now = cell_looks(base).withColumnRenamed("look", "was"), cell_looks(redline, view).withColumnRenamed("look", "now")
    both = was.join(now, place, "full_outer")
    off = both.where("was IS NULL OR now IS NULL").select("doc").distinct()
    return both.where("was <> now").select(*place).join(off, "doc", "left_anti")


def _widths(root: ET.Element) -> Iterator[dict]:
    for t, table in enumerate(_outermost(root, "tbl")):
        grid = [c.get(W + "w") or "" for c in table.iter(W + "gridCol")]
        cells = [c.get(W + "w") or "" for c in table.iter(W + "tcW")]
        yield {"table": t + 1, "said": "\u001f".join(x.text or "" for x in table.iter(W + "t")), "widths": " ".join([*grid, "|", *cells])}


def width_changes(base: DataFrame, edited: DataFrame) -> DataFrame:
    """``(doc, table)``: tables, from 1, whose text an edit keeps and whose column widths it changes.

    Tables meet by their text, those of one text in order.
    """
    order = Window.partitionBy("doc", "said").orderBy("table")
    read = lambda parts: documents.rows_of(parts, _widths, "table int, said string, widths string").withColumn("k", F.row_number().over(order))
    now = read(edited).select("doc", "said", "k", F.col("widths").alias("now"))
    return read(base).join(now, ["doc", "said", "k"]).where("widths <> now").select("doc", "table")


# why a gate failed


def inserted_only_bookmarks(lost: DataFrame, redline: DataFrame) -> DataFrame:
    """``lost(doc, name)`` bookmarks that the redline still holds: they stand on text that was written again."""
    return lost.select("doc", "name").join(bookmark_names(redline).select("doc", "name"), ["doc", "name"], "left_semi")


def final_paragraph_cause(redline: DataFrame, original: DataFrame, clean: DataFrame) -> DataFrame:
    """``(doc, was, now)`` where the original's last paragraph isn't the clean copy's and rejecting doesn't bring it back."""
    last = lambda parts, name: paragraph_texts(parts).groupBy("doc").agg(F.max_by("text", "pos").alias(name))
    both = last(original, "was").join(last(clean, "now"), "doc").where("was <> now AND trim(was) <> ''")
    back = paragraph_texts(redline, "original").select("doc", F.col("text").alias("was")).distinct()
    return both.join(back, ["doc", "was"], "left_anti")


# authors


def read_authors(parts: DataFrame) -> DataFrame:
    """``(doc, author, times)``: everyone credited with a change or a comment."""
    names = F.regexp_extract_all("xml", F.lit(r'<w:\w+\b[^>]*\bw:author="([^"]*)"'), F.lit(1))
    return xml_of(parts, *TEXT_PARTS, "word/comments.xml").select("doc", F.explode(names).alias("author")).groupBy("doc", "author").agg(F.count("*").alias("times"))


def set_author(parts: DataFrame, name: str, initials: str, only: tuple[str, ...] = ()) -> DataFrame:
    """The parts with every change and comment credited to ``name``, or those of ``only``; comments take the initials too."""
    escaped = name.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
    who = "|".join(markup.re.escape(x) for x in only) if only else '[^"]*'
    text = F.col("part").isin(*TEXT_PARTS, "word/comments.xml")
    quoted = escaped.replace("\\", "\\\\").replace("$", "\\$")
    new = F.regexp_replace(F.col("blob").cast("string"), rf'(\bw:author=")(?:{who})(")', f"$1{quoted}$2")
    marked = F.regexp_replace(new, rf'(<w:comment\b[^>]*\bw:author="{markup.re.escape(escaped)}"[^>]*\bw:initials=")[^"]*(")', f"$1{initials}$2")
    return parts.withColumn("blob", F.when(text, marked.cast("binary")).otherwise(F.col("blob")))


# moves


def expected_after_move(paragraphs: DataFrame, block: Column, through: Column, after: Column) -> DataFrame:
    """``(doc, pos, text)`` with the paragraphs from that which says ``block`` to that which says ``through`` moved behind ``after``'s."""
    first = lambda c: F.min(F.when(F.contains("text", c), F.col("pos")))
    marks = paragraphs.groupBy(F.col("doc").alias("_d")).agg(first(block).alias("_a"), first(through).alias("_b"), first(after).alias("_c"))
    placed = paragraphs.join(marks, F.col("doc") == F.col("_d"))
    moved = F.col("pos").between(F.col("_a"), F.col("_b"))
    order = Window.partitionBy("doc").orderBy(F.when(moved, F.col("_c") + 0.5).otherwise(F.col("pos").cast("double")), "pos")
    return placed.select("doc", (F.row_number().over(order) - 1).cast("int").alias("pos"), "text")


def verify_move(before: DataFrame, after: DataFrame, block: Column, through: Column, where: Column, author: str) -> DataFrame:
    """``(doc, finding)``: why ``after`` isn't ``before`` with the block moved by ``author``: in the accepted view, the rejected one, or by whom."""
    joined = lambda d: d.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("t"))
    full = lambda d: d.where("trim(text) <> ''").withColumn("pos", (F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1).cast("int"))
    was = full(paragraph_texts(before, "final"))
    should, got = joined(expected_after_move(was, block, through, where)), joined(full(paragraph_texts(after, "final"))).withColumnRenamed("t", "got")
    accepted_ = should.join(got, "doc", "left").where(~F.col("t").eqNullSafe(F.col("got"))).select("doc", F.lit("accepted").alias("finding"))
    old, back = joined(full(paragraph_texts(before, "original"))), joined(full(paragraph_texts(after, "original"))).withColumnRenamed("t", "got")
    rejected_ = old.join(back, "doc", "left").where(~F.col("t").eqNullSafe(F.col("got"))).select("doc", F.lit("rejected").alias("finding"))
    whose = documents.revisions(after).select("doc", "author", "kind", "text").exceptAll(documents.revisions(before).select("doc", "author", "kind", "text"))
    other = whose.where(~F.col("author").eqNullSafe(F.lit(author))).select("doc", F.lit("author").alias("finding")).distinct()
    return accepted_.unionByName(rejected_).unionByName(other)
