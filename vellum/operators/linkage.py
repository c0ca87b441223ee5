"""Citation links both ways: what to link, the links themselves, and the audit of those that are there.

A work's entry carries a bookmark (``Sen1999``) and links back to the bookmark round the work's first
mention (``Sen1999txt``), which links to the entry.  Marks, links, entries and citations are tables; the
plan and every kind of finding are joins, windows and aggregates over them.  Only the splices into the
markup run in Python, a document at a time.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import citations, wiring, wordml
from vellum.functions.wordml import W
from vellum.operators import documents, gates, linking

KEYED = r"^[A-Za-z\p{L}][\p{L}.]*?\d{4}[a-z]?(?:_\d+)?$"
EXHIBIT = r"^(?:Table|Figure|Box|Chart|Map|Scheme|Eq)[A-Z]?\d+"
STATEMENTS = {
    "EMPTY LINK": "remove the link, or put its words back", "BROKEN LINK": "restore the bookmark, or unlink", "UNBALANCED SPAN": "move the link's end to the bracket",
    "BRACKETED SPAN": "take the brackets out of the link", "MARKER OFF LINK": "set the marker round its link again", "SELF LINK": "point the link at the other end",
    "DOUBLED LINK": "remove the outer link", "MISPLACED MARKER": "move the marker to its entry", "LATE MARKER": "move the marker to the first mention",
    "STALE BOOKMARK": "remove the bookmark", "ORPHAN REF": "link the mention", "NO BACK-LINK": "link the entry home", "MISSING REF": "mark the entry", "UNLINKED": "link the citation",
    "CITE WITHOUT REF": "mark the entry", "REF WITHOUT CITE": "cite the work, or drop the entry", "REF WITHOUT BACKLINK": "link the entry home", "LATER-MENTION UNLINKED": "link it, if the paper links all",
}


def _texts(root: ET.Element):  # noqa: ANN202
    for pos, p in enumerate(root.iter(W + "p")):
        yield {"pos": pos, "text": wordml.text_of(p), "masked": wiring.masked_text(p)}


def paragraphs(parts: DataFrame) -> DataFrame:
    """``(doc, pos, text, masked)``: what paragraphs say, and the same with what links show blotted out."""
    return documents.rows_of(parts, _texts, "pos int, text string, masked string")


def places(parts: DataFrame) -> DataFrame:
    return documents.rows_of(parts, wiring.places, wiring.PLACES)


def outlines(parts: DataFrame) -> DataFrame:
    """``(doc, texts, marks)``: what paragraphs say and the bookmarks' names, in order, all of a document in one row."""

    def read(root: ET.Element) -> Iterator[dict]:
        yield {"texts": [wordml.text_of(p) for p in root.iter(W + "p")], "marks": [p["name"] for p in wiring.places(root) if p["kind"] == "mark"]}

    return documents.rows_of(parts, read, "texts array<string>, marks array<string>")


def entries(paras: DataFrame) -> DataFrame:
    """``(doc, pos, text, surname, year, key)`` of the reference list; an entry that continues one has its author."""
    return citations.reference_entries(paras.select("doc", "pos", "text"))


def _before_list(paras: DataFrame) -> DataFrame:
    head = paras.where(F.trim("text").rlike(citations.HEADINGS)).groupBy(F.col("doc").alias("_d")).agg(F.max("pos").alias("_head"))
    return paras.join(head, F.col("doc") == F.col("_d"), "left").where("_head IS NULL OR pos < _head").drop("_d", "_head")


def mentions(paras: DataFrame, title_block: int = 5) -> DataFrame:
    """Citations in the body before the reference list, past the title block, with ``linked``."""
    found = citations.citations(_before_list(paras))
    start = _before_list(paras).where(F.length(F.trim("text")) >= 100).groupBy(F.col("doc").alias("_d")).agg(F.min("pos").alias("_prose"))
    told = found.join(start, F.col("doc") == F.col("_d"), "left").where(F.col("pos") >= F.least(F.coalesce("_prose", F.lit(title_block)), F.lit(title_block)))
    inside = F.substr("masked", F.col("start") + 1, F.col("stop") - F.col("start"))
    return told.withColumn("linked", F.contains(inside, F.lit("\u0000"))).drop("_d", "_prose")


def named(listed: DataFrame, marks: DataFrame) -> DataFrame:
    """Entries with ``name``, their bookmark: one of that shape that is there already, else surname and year.

    Two entries of one name get a number each but for the first.
    """
    own = marks.where(F.col("name").rlike(KEYED) & ~F.col("name").rlike(EXHIBIT)).groupBy(F.col("doc").alias("_d"), F.col("para").alias("_p")).agg(F.min("name").alias("_own"))
    made = F.concat(F.regexp_replace("surname", r"[^\p{L}]", ""), F.col("year"))
    joined = listed.join(own, (F.col("doc") == F.col("_d")) & (F.col("pos") == F.col("_p")), "left").withColumn("_made", made)
    k = F.row_number().over(Window.partitionBy("doc", "_made").orderBy(F.col("_own").isNull(), "pos"))
    name = F.coalesce("_own", F.when(k == 1, F.col("_made")).otherwise(F.concat("_made", F.lit("_"), k.cast("string"))))
    return joined.withColumn("name", name).withColumn("marked", F.col("_own").isNotNull()).drop("_d", "_p", "_own", "_made")


PLAN = "kind string, name string, anchor string, pos int, start int, stop int"
FINDINGS = "finding string, subject string, pos int"


def link_plan(parts: DataFrame, rest: bool = False) -> DataFrame:
    """``(doc, kind, name, anchor, pos, start, stop)`` of links to make.

    ``mention``: a work's first citation, to be linked to its entry and marked; with ``rest`` all others
    too, which get no mark.  ``entry``: an entry's head, to be marked and linked home where the work has a
    mention.  What is linked already is left as it is; a key with several entries isn't guessed at.
    """
    return documents.rows_of(parts, lambda root: linking.link_plan(linking.Document(root), rest), PLAN)


def _splice(blob: bytes, plan: list[dict]) -> tuple[bytes, list[str]]:
    """A part with links of a plan in it, from the end of each paragraph to its start; what couldn't be linked is named."""
    root, _ = wordml.parse(blob)
    if root is None:
        return blob, [p["anchor"] for p in plan]
    missed = _link(root, plan)
    return wordml.serialise(root), missed


def _link(root: ET.Element, plan: list[dict]) -> list[str]:
    from vellum.functions.editing import Refused

    paras = list(root.iter(W + "p"))
    number = max((int(b.get(W + "id")) for b in root.iter(W + "bookmarkStart") if (b.get(W + "id") or "").isdigit()), default=0)
    missed = []
    for step in sorted(plan, key=lambda p: (p["pos"], p["start"]), reverse=True):
        p = paras[step["pos"]]
        try:
            link = wiring.wrap_span(p, step["start"], step["stop"], step["anchor"])
        except Refused:
            missed.append(step["anchor"])
            continue
        if step["name"]:
            number += 1
            if step["kind"] == "entry":
                wiring.mark_head(p, step["name"], number)
            else:
                holder = next(e for e in p.iter() if any(c is link for c in e))
                wiring.mark_element(holder, link, step["name"], number)
    return missed


def apply_plan(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """The parts with a plan's links in their documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        steps = right.to_pylist()
        rows = left.to_pylist()
        return pa.table({"doc": pa.array([r["doc"] for r in rows], pa.string()), "part": pa.array([r["part"] for r in rows], pa.string()), "blob": pa.array([_splice(r["blob"], steps)[0] if steps else r["blob"] for r in rows], pa.binary())})

    body = F.col("part") == documents.DOCUMENT
    columns = ["doc", "kind", "name", "anchor", "pos", "start", "stop"]
    made = parts.where(body).select("doc", "part", "blob").groupBy("doc").cogroup(plan.select(*columns).groupBy("doc")).applyInArrow(run, "doc string, part string, blob binary")
    return parts.where(~body).select("doc", "part", "blob").unionByName(made)


def _planned(parts: DataFrame, plan: Callable[[linking.Document], Iterator[dict]]) -> DataFrame:
    """The parts with the links that each document's own plan makes, planned and made on one parse."""

    def change(blob: bytes) -> bytes:
        root, _ = wordml.parse(blob)
        steps = [] if root is None else list(plan(linking.Document(root)))
        if not steps:
            return blob
        _link(root, steps)
        return wordml.serialise(root)

    return documents.rewritten(parts.select("doc", "part", "blob"), documents.DOCUMENT, change)


def link_all(parts: DataFrame) -> DataFrame:
    return _planned(parts, linking.link_plan)


def link_rest(parts: DataFrame) -> DataFrame:
    """All mentions linked, not only each work's first."""
    return _planned(parts, lambda doc: linking.link_plan(doc, rest=True))


def links_once_made(parts: DataFrame, rest: bool = False) -> DataFrame:
    """``(doc, anchor, links)``: how many links lead to each place once those of :func:`link_all` (of :func:`link_rest`, with ``rest``) are made.

    They are planned, made and counted on one parse, and documents of the same bytes are read once.
    """

    def read(root: ET.Element) -> Iterator[dict]:
        if steps := list(linking.link_plan(linking.Document(root), rest)):
            _link(root, steps)
        for anchor, n in Counter(s["name"] for s in wiring.places(root) if s["kind"] == "link").items():
            yield {"anchor": anchor, "links": n}

    return documents.rows_of(parts, read, "anchor string, links long", once=True)


def audit_links(parts: DataFrame, later_mentions: bool = False) -> DataFrame:
    """``(doc, finding, subject, pos)``: what is wrong with a document's citation links."""

    def read(root: ET.Element) -> Iterator[dict]:
        for finding, subject, pos in linking.audit(linking.Document(root), later_mentions):
            yield {"finding": finding, "subject": subject, "pos": pos}

    return documents.rows_of(parts, read, FINDINGS)


def link_stats(parts: DataFrame) -> DataFrame:
    """``(doc, mentions, linked)`` of citations in the body."""

    def read(root: ET.Element) -> Iterator[dict]:
        if told := linking.Document(root).mentions():
            yield {"mentions": len(told), "linked": sum(c["linked"] for c in told)}

    return documents.rows_of(parts, read, "mentions long, linked long")


def repair_plan(findings: DataFrame) -> DataFrame:
    """Findings with ``repair``, what would mend them."""
    repairs = F.create_map(*(F.lit(x) for kv in STATEMENTS.items() for x in kv))
    return findings.withColumn("repair", F.coalesce(F.try_element_at(repairs, F.col("finding")), F.lit("look into it")))


# exhibits

LABELS = ("Figure", "Table", "Box", "Chart", "Map", "Scheme")


#: What a paragraph has to hold to mention any exhibit.
HINT = re.compile(r"(?i)fig|table|box|chart|map|scheme|рисун|таблиц")


@lru_cache(4096)
def _sought(label: str, number: str) -> tuple:
    import regex

    from vellum.functions.locating import continuation_pattern, mention_pattern

    return regex.compile(mention_pattern(label, number)), regex.compile(continuation_pattern(label, number))


def mention_spans(label: str, number: str, text: str) -> Iterator[tuple[int, int]]:
    """Where a text mentions an exhibit; a list or range mentions all that it names."""
    if HINT.search(text):
        said, listed = _sought(label, number)
        yield from (m.span() for m in said.finditer(text))
        yield from (m.span(1) for m in listed.finditer(text))


def exhibit_mentions(paras: DataFrame, caps: DataFrame) -> DataFrame:
    """``(doc, name, pos, start, stop, linked)``: each place that mentions a caption of its document, captions themselves left out.

    A list or range mentions all that it names: the 5 of ``Tables 3 to 5``.
    """
    wanted = caps.groupBy(F.col("doc").alias("_d")).agg(F.collect_list(F.struct("label", "number", "name", "pos")).alias("_caps"))
    hinted = paras.where(F.col("text").rlike(r"(?iu)\b(?:fig|table|box|chart|map|scheme|рисун|таблиц)")).join(wanted, F.col("doc") == F.col("_d"))

    @F.pandas_udf("array<struct<name:string,start:int,stop:int>>")
    def find(texts: pd.Series, lists: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for text, own, pos in zip(texts, lists, at, strict=True):
            hits = []
            if pos not in {c["pos"] for c in own}:
                for c in own:
                    hits += [{"name": c["name"], "start": a, "stop": b} for a, b in mention_spans(c["label"], c["number"], text)]
            out.append(sorted({(h["start"], h["stop"], h["name"]) for h in hits}))
        return pd.Series([[{"name": n, "start": a, "stop": b} for a, b, n in x] for x in out], dtype=object)

    found = hinted.select("doc", "pos", "masked", F.explode(find("text", "_caps", "pos")).alias("m")).select("doc", "pos", "masked", "m.*")
    return found.select("doc", "name", "pos", "start", "stop", F.contains(F.substr("masked", F.col("start") + 1, F.col("stop") - F.col("start")), F.lit("\u0000")).alias("linked"))


def exhibit_captions(paras: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """``(doc, pos, label, number, name, text)`` of caption paragraphs in order."""
    from vellum.functions.locating import caption_pattern

    pattern = caption_pattern(labels)
    found = paras.withColumn("label", F.regexp_extract("text", pattern, 1)).withColumn("number", F.regexp_extract("text", pattern, 2)).where("number <> ''")
    return found.select("doc", "pos", "label", "number", wiring.exhibit_names(F.col("label"), F.col("number"))["name"].alias("name"), "text")


def exhibit_plan(parts: DataFrame, more: bool = False) -> DataFrame:
    """``(doc, kind, name, anchor, pos, start, stop)``: captions to be marked and linked to their first mention, which is marked and linked back.

    With ``more`` every other plain mention is linked too.
    """
    return documents.rows_of(parts, lambda root: linking.exhibit_plan(linking.Document(root), more), PLAN)


def link_exhibits(parts: DataFrame, more: bool = False) -> DataFrame:
    return _planned(parts, lambda doc: linking.exhibit_plan(doc, more))


def unlink_exhibits(parts: DataFrame) -> DataFrame:
    """The parts without the bookmarks and links of exhibits; what links showed stays."""
    from vellum.functions.batched import batched

    pattern = rf"^(?:{'|'.join(LABELS)})[A-Z]?\d+[A-Za-z0-9_]*(?:txt)?$"

    def strip(xml: str) -> str:
        head, body = xml[: xml.index("<w:body>")], xml[xml.index("<w:body>") :]
        inner = body[len("<w:body>") : body.rindex("</w:body>")]
        return head + "<w:body>" + wiring.unlink_by_anchor(inner, pattern)[0] + body[body.rindex("</w:body>") :]

    own = (F.col("part") == documents.DOCUMENT) & F.contains(F.col("blob").cast("string"), F.lit("<w:body>"))
    return parts.withColumn("blob", F.when(own, batched(strip, "string")(F.col("blob").cast("string")).cast("binary")).otherwise(F.col("blob")))


def exhibit_audit(parts: DataFrame) -> DataFrame:
    """``(doc, finding, subject)``: of each caption how it is linked, and marks and links that are off.

    linked, unreached, caption-only, mention-only or unlinked; dangling links; marks on a caption under
    another name (misnamed), marks of a mention behind the first mention (misplaced-anchor), and captions
    that type their number where others of their series compute it (fieldless).
    """

    def read(root: ET.Element) -> Iterator[dict]:
        yield from ({"finding": f, "subject": s} for f, s in linking.exhibit_audit(linking.Document(root)))

    return documents.rows_of(parts, read, "finding string, subject string")


def _computed(root: ET.Element):  # noqa: ANN202
    from vellum.functions import markup

    for pos, p in enumerate(root.iter(W + "p")):
        yield {"pos": pos, "text": wordml.text_of(p), "field": any("SEQ" in f.instruction for f in markup.fields(p))}


def fieldless(parts: DataFrame) -> DataFrame:
    """Captions with a typed number in a series where others are computed; lettered numbers are a series of their own."""
    rows = documents.rows_of(parts, _computed, "pos int, text string, field boolean")
    caps = exhibit_captions(rows.select("doc", "pos", "text")).join(rows.select("doc", "pos", "field"), ["doc", "pos"])
    series = Window.partitionBy("doc", "label", F.col("number").rlike(r"^[A-Z]"))
    return caps.withColumn("_some", F.max(F.col("field").cast("int")).over(series)).where("_some = 1 AND NOT field").select("doc", F.lit("fieldless").alias("finding"), F.col("name").alias("subject"))


def reaching(parts: DataFrame) -> DataFrame:
    """``(doc, anchor)`` that something links to."""
    return gates.link_targets(parts)


def field_targets(parts: DataFrame) -> DataFrame:
    """``(doc, anchor)`` that a field, not an element, links to."""
    return documents.internal_links(parts).where("form <> 'element'").select("doc", "anchor").distinct()


def check_citations(parts: DataFrame) -> DataFrame:
    """``(doc, issues)``: how many findings each document has."""

    def read(root: ET.Element) -> Iterator[dict]:
        if n := sum(1 for _ in linking.audit(linking.Document(root))):
            yield {"issues": n}

    return documents.rows_of(parts, read, "issues long")
