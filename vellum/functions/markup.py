"""Pieces of markup: what they show, which properties are in force, which fields and links they hold.

What one regular expression can say is a column and stays in the JVM; what needs nesting is a function
over an element tree.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.editing import Refused, read, write
from vellum.functions.numbers import let
from vellum.functions.text import visible_text
from vellum.functions.wordml import XML_SPACE, M, W, text_of

# Children of paragraph, section and run properties in the order that the format demands.
PARAGRAPH_ORDER = (
    "pStyle keepNext keepLines pageBreakBefore framePr widowControl numPr suppressLineNumbers pBdr shd tabs suppressAutoHyphens "
    "kinsoku wordWrap overflowPunct topLinePunct autoSpaceDE autoSpaceDN bidi adjustRightInd snapToGrid spacing ind contextualSpacing "
    "mirrorIndents suppressOverlap jc textDirection textAlignment textboxTightWrap outlineLvl divId cnfStyle rPr sectPr pPrChange"
).split()
SECTION_ORDER = (
    "headerReference footerReference footnotePr endnotePr type pgSz pgMar paperSrc pgBorders lnNumType pgNumType cols formProt vAlign "
    "noEndnote titlePg textDirection bidi rtlGutter docGrid printerSettings sectPrChange"
).split()
RUN_ORDER = (
    "rStyle rFonts b bCs i iCs caps smallCaps strike dstrike outline shadow emboss imprint noProof snapToGrid vanish webHidden color "
    "spacing w kern position sz szCs highlight u effect bdr shd fitText vertAlign rtl cs em lang eastAsianLayout specVanish oMath rPrChange"
).split()
# Run children that print a character.
PRINTED = {"noBreakHyphen": "‑", "softHyphen": "­", "tab": "\t", "br": "\n", "cr": "\n"}
#: What a link may show without text of its own.
SHOWN = tuple(W + n for n in ("delText", "drawing", "pict", "object", "footnoteReference", "endnoteReference"))

# columns


def append_before_close(xml: Column, tag: str, addition: Column) -> Column:
    """``addition`` before the last closing ``tag``; without one the text stays."""
    close = f"</{tag}>"

    def spliced(text: Column) -> Column:
        at = F.length(text) - F.instr(F.reverse(text), close[::-1]) - len(close) + 1
        return F.when(F.contains(text, F.lit(close)), F.concat(F.substring(text, F.lit(1), at), addition, F.substring(text, at + 1, F.length(text)))).otherwise(text)

    return let(xml, spliced)


def escape_attr(value: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(char), F.lit(name))
    return value


def printed_text(xml: Column) -> Column:
    """Everything on the page: text, tabs, breaks and special hyphens; tab stops are no tabs."""
    plain = F.regexp_replace(xml, r"(?s)<w:tabs\b[^>]*(?<!/)>.*?</w:tabs>|<m:oMath\b.*?</m:oMath>", "")
    for name, char in PRINTED.items():
        plain = F.regexp_replace(plain, rf"<w:{name}\b[^>]*/>", f"<w:t>{char}</w:t>")
    return visible_text(plain)


def editable_text(paragraph: Column) -> Column:
    """The text that runs hold, maths left out."""
    return visible_text(F.regexp_replace(paragraph, r"(?s)<m:oMath\b.*?</m:oMath>", ""))


def run_spans(paragraph: Column) -> Column:
    """``array<struct<start, stop, text>>``: the runs and where their text stands in what is visible."""
    pieces = F.regexp_extract_all(paragraph, F.lit(r"(?s)<w:r(?:\s[^>]*)?(?<!/)>.*?</w:r>|<m:oMath\b.*?</m:oMath>"), F.lit(0))
    shown = F.transform(pieces, lambda p: F.struct(p.startswith("<w:r").alias("run"), visible_text(p).alias("text")))
    ends = F.aggregate(
        shown,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<run:boolean,start:int,stop:int,text:string>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["text"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(p["run"].alias("run"), acc["at"].alias("start"), (acc["at"] + F.length(p["text"])).alias("stop"), p["text"].alias("text")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.transform(F.filter(ends, lambda p: p["run"]), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), p["text"].alias("text")))


def run_holds_content(run: Column) -> Column:
    """Whether a run holds more than its own properties."""
    bare = F.regexp_replace(F.trim(run), r"(?s)^(<w:r\b[^>]*>)\s*(?:<w:rPr\b[^>]*/>|<w:rPr\b.*</w:rPr>)", "$1")
    return (bare != "") & ~bare.rlike(r"^<w:r\b[^>]*(?:/>|>\s*</w:r>)$")


def used_prefixes(xml: Column) -> Column:
    elements = F.regexp_extract_all(xml, F.lit(r"</?([A-Za-z][\w.-]*):"), F.lit(1))
    attributes = F.regexp_extract_all(xml, F.lit(r"\s([A-Za-z][\w.-]*):[\w.-]+="), F.lit(1))
    return F.sort_array(F.array_except(F.array_union(elements, attributes), F.array(F.lit("xmlns"), F.lit("xml"))))


def word_minted(name: Column) -> Column:
    """Bookmarks that the word processor makes and names for itself."""
    return F.startswith(name, F.lit("_"))


def ref_anchor(instruction: Column, clickable: bool = True) -> Column:
    """The bookmark of a cross-reference field; without its hyperlink switch it is nothing that a reader can follow."""
    quoted, plain = F.regexp_extract(instruction, r'\bREF\s+"([^"]+)"', 1), F.regexp_extract(instruction, r'\bREF\s+([^\s\\"]+)', 1)
    name = F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(plain, F.lit("")))
    return F.when(instruction.rlike(r"\\h(?![A-Za-z])"), name) if clickable else name


def link_anchor(instruction: Column) -> Column:
    """The bookmark that a field's instruction points at, in either form."""
    return F.coalesce(F.nullif(F.regexp_extract(instruction, r'HYPERLINK\s+\\l\s+"([^"]+)"', 1), F.lit("")), ref_anchor(instruction))


def search_text(anchor: Column, limit: int = 255) -> Column:
    """What a find box takes of an anchor: its first line that isn't blank, carets doubled, cut to the limit between them."""
    lines = F.filter(F.transform(F.split(anchor, r"[\r\n\x{B}\x{C}\x{7}]"), lambda x: F.trim(x)), lambda x: x != "")
    pieces = F.transform(F.split(F.element_at(lines, 1), ""), lambda c: F.when(c == "^", "^^").otherwise(c))
    kept = F.aggregate(pieces, F.lit(""), lambda acc, p: F.when(F.length(acc) + F.length(p) <= limit, F.concat(acc, p)).otherwise(F.rpad(acc, limit + 1, "\u0000")))
    return F.when(F.size(lines) > 0, F.replace(kept, F.lit("\u0000"), F.lit("")))


def prose_numbers(text: Column) -> Column:
    """``array<struct<value, said>>`` of every number in a text, signs and per cent marks read."""
    said = F.regexp_extract_all(text, F.lit(r"[-−+]?\d+(?:\.\d+)?%?"), F.lit(0))
    return F.transform(said, lambda s: F.struct(F.replace(F.rtrim(F.translate(s, "%", " ")), F.lit("−"), F.lit("-")).cast("double").alias("value"), s.alias("said")))


# tables of places


def text_parts(parts: DataFrame) -> DataFrame:
    """The parts that hold a reader's text, with ``rank`` in reading order."""
    order = F.array_position(F.array(*(F.lit(f"word/{n}.xml") for n in ("document", "footnotes", "endnotes"))), F.col("part"))
    return parts.withColumn("rank", order.cast("int")).where("rank > 0")


def holding(points: DataFrame, spans: DataFrame, doc: str = "doc", at: str = "at", start: str = "start", stop: str = "stop") -> DataFrame:
    """``points`` with the start and stop of the first span of their document that they begin in, null without one.

    A span holds its start and not its stop.
    """
    s = spans.select(F.col(doc).alias("_d"), F.col(start).alias("_s"), F.col(stop).alias("_e"))
    inside = points.join(s, (F.col(doc) == F.col("_d")) & (F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e")), "left")
    return inside.groupBy(*points.columns).agg(F.min(F.struct("_s", "_e")).alias("_f")).select(*points.columns, F.col("_f._s").alias("start"), F.col("_f._e").alias("stop"))


def opened_before(points: DataFrame, opens: DataFrame, doc: str = "doc", at: str = "at", opening: str = "open") -> DataFrame:
    """``points`` with ``opening``, the last place before theirs where something opens, -1 without one."""
    both = points.select(doc, F.col(at).alias("_p"), F.lit(1).alias("_kind")).distinct().unionByName(opens.select(doc, F.col(opening).alias("_p"), F.lit(0).alias("_kind")))
    # at one place the point comes first: what opens there isn't before it
    order = Window.partitionBy(doc).orderBy("_p", F.desc("_kind")).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn(opening, F.last(F.when(F.col("_kind") == 0, F.col("_p")), ignorenulls=True).over(order)).where("_kind = 1")
    return points.join(found.select(F.col(doc).alias("_d"), "_p", opening), (F.col(doc) == F.col("_d")) & (F.col(at) == F.col("_p")), "left").select(*points.columns, F.coalesce(opening, F.lit(-1)).alias(opening))


# trees


def _name(e: ET.Element) -> str:
    return e.tag.removeprefix(W) if isinstance(e.tag, str) else ""


def balanced(fragment: str) -> bool:
    """Whether everything that a fragment opens closes in it, in order, and nothing else does."""
    names = sorted(set(re.findall(r"[<\s/]([A-Za-z][\w.-]*):", fragment)) - {"xmlns", "xml"})
    try:
        ET.fromstring(f"<x {' '.join(f'xmlns:{n}={chr(34)}u:{n}{chr(34)}' for n in names)}>{fragment}</x>")
    except ET.ParseError:
        return False
    return True


def element_spans(fragment: str, tag: str) -> list[str]:
    """The outermost ``w:tag`` elements of a fragment, each whole; empty ones are none."""
    out: list[str] = []

    def walk(parent: ET.Element) -> None:
        for child in parent:
            if child.tag == W + tag and (len(child) or child.text):
                out.append(write(child))
            else:
                walk(child)

    walk(_wrapped(fragment))
    return out


def _wrapped(fragment: str) -> ET.Element:
    return read(f"<w:x>{fragment}</w:x>")


def set_run_text(fragment: str, text: str) -> str:
    """``text`` in the first text node, the others emptied; the runs keep their look."""
    root = _wrapped(fragment)
    for k, t in enumerate(root.iter(W + "t")):
        t.text = text if k == 0 else ""
        if k == 0 and text != text.strip():
            t.set(XML_SPACE, "preserve")
    return "".join(write(e) for e in root)


def own_properties(element: ET.Element, tag: str) -> ET.Element | None:
    """The element's own properties, which come first in it; those of elements inside are none."""
    return element[0] if len(element) and element[0].tag == W + tag else None


def live_children(properties: ET.Element | None) -> list[ET.Element]:
    """What is in force now: all before the record of a tracked change."""
    out = []
    for child in properties if properties is not None else ():
        if _name(child).endswith("PrChange"):
            break
        out.append(child)
    return out


def own_child(properties: ET.Element | None, tag: str) -> ET.Element | None:
    return next((c for c in live_children(properties) if c.tag == W + tag), None)


def _place(properties: ET.Element, element: ET.Element, order: list[str]) -> None:
    """Put a property where the format wants it, in place of the one of its name; a change's record stays last."""
    for old in [c for c in live_children(properties) if c.tag == element.tag]:
        properties.remove(old)
    rank = {n: i for i, n in enumerate(order)}
    mine = rank.get(_name(element), len(order) - 2)
    at = next((i for i, c in enumerate(properties) if rank.get(_name(c), len(order) - 2) > mine), len(properties))
    properties.insert(at, element)


def _with_property(fragment: str, holder: str, tag: str, element: str, order: list[str]) -> str:
    e = read(fragment)
    made = read(element)
    if made.tag != W + tag:
        raise Refused(f"the property is no {tag}")
    props = own_properties(e, holder)
    if props is None:
        props = ET.Element(W + holder)
        e.insert(0, props)
    _place(props, made, order)
    return write(e)


def set_para_property(paragraph: str, tag: str, element: str) -> str:
    return _with_property(paragraph, "pPr", tag, element, PARAGRAPH_ORDER)


def set_run_property(run: str, tag: str, element: str) -> str:
    return _with_property(run, "rPr", tag, element, RUN_ORDER)


def set_sect_property(section: str, tag: str, element: str) -> str:
    e = read(section)
    _place(e, read(element), SECTION_ORDER)
    return write(e)


@dataclass
class Field:
    """A field: its own instruction, what it shows (None before it has been rendered), the runs it begins and ends in."""

    instruction: str = ""
    result: list[ET.Element] | None = None
    begin: ET.Element | None = None
    end: ET.Element | None = None
    paragraph: int = -1
    shows: bool = False
    label: list[str] = field(default_factory=list)


def fields(root: ET.Element) -> list[Field]:
    """All fields in order, paired by depth; one that an edit has cut open has no end, or no begin."""
    out: list[Field] = []
    stack: list[Field] = []
    at = -1
    for e in root.iter():
        if e.tag == W + "p":
            at += 1
        elif e.tag == W + "fldSimple":
            out.append(Field(e.get(W + "instr") or "", list(e), e, e, at, any(x.tag in SHOWN for x in e.iter()), [text_of(e)]))
        if e.tag != W + "r":
            continue
        for c in e:
            if c.tag == W + "fldChar":
                kind = c.get(W + "fldCharType")
                if kind == "begin":
                    stack.append(Field(begin=e, paragraph=at))
                    out.append(stack[-1])
                elif kind == "separate" and stack:
                    stack[-1].result = []
                elif kind == "end" and stack:
                    stack.pop().end = e
            elif c.tag == W + "instrText":
                if stack and stack[-1].result is None:
                    stack[-1].instruction += c.text or ""
                else:
                    out.append(Field(c.text or "", None, None, None, at))
            else:
                for f in stack:
                    if f.result is not None:
                        f.result.append(c)
                        if c.tag == W + "t":
                            f.label.append(c.text or "")
                        f.shows = f.shows or c.tag in SHOWN
    return out


LINK = re.compile(r'HYPERLINK\s+\\l\s+"?([^"\s]+)"?')
REF = re.compile(r'\bREF\s+(?:"([^"]+)"|([^\s\\"]+))')
SWITCH = re.compile(r"\\h(?![A-Za-z])")


def target_of(instruction: str, clickable: bool = True) -> str | None:
    """The bookmark that an instruction points at: a link's, or a cross-reference's."""
    m = LINK.search(instruction)
    if m:
        return m[1]
    m = REF.search(instruction)
    return (m[1] or m[2]) if m and (SWITCH.search(instruction) or not clickable) else None


def internal_links(root: ET.Element) -> Iterator[dict]:
    """Links to places in the document, of all forms, in order: anchor, label, form, paragraph, whether they show anything."""
    at = -1
    spans = {id(f.begin): f for f in fields(root) if f.begin is not None and target_of(f.instruction)}
    for e in root.iter():
        if e.tag == W + "p":
            at += 1
        elif e.tag == W + "hyperlink" and e.get(W + "anchor"):
            label = text_of(e)
            yield {"anchor": e.get(W + "anchor"), "label": label, "form": "element", "para": at, "dead": not label.strip() and not any(x.tag in SHOWN for x in e.iter())}
        elif id(e) in spans and e.tag in (W + "r", W + "fldSimple"):
            f = spans[id(e)]
            label = "".join(f.label)
            dead = f.result is not None and f.end is not None and not label.strip() and not f.shows
            yield {"anchor": target_of(f.instruction), "label": label, "form": "simple" if e.tag == W + "fldSimple" else "field", "para": at, "dead": dead}


def isolate_field(root: ET.Element, f: Field) -> list[ET.Element]:
    """The field in runs of its own: those that its ends share with other content are split; returns its runs."""
    if f.begin is None or f.end is None:
        raise Refused("the field has no end")
    parents = {c: p for p in root.iter() for c in p}

    def cut(run: ET.Element, kind: str, after: bool) -> ET.Element:
        props = own_properties(run, "rPr")
        body = [c for c in run if c is not props]
        marks = [i for i, c in enumerate(body) if c.tag == W + "fldChar" and c.get(W + "fldCharType") == kind]
        at = marks[-1] + 1 if after else marks[0]
        rest = body[at:] if after else body[:at]
        if not rest:
            return run
        other = ET.Element(run.tag, dict(run.attrib))
        if props is not None:
            import copy

            other.append(copy.deepcopy(props))
        for c in rest:
            run.remove(c)
            other.append(c)
        holder = parents[run]
        holder.insert(list(holder).index(run) + after, other)
        return run

    cut(f.end, "end", True)
    cut(f.begin, "begin", False)
    holder = {c: p for p in root.iter() for c in p}[f.begin]
    runs = list(holder)
    return runs[runs.index(f.begin) : runs.index(f.end) + 1] if f.end in runs else [f.begin]


def hoist_links(fragment: str) -> tuple[str, int]:
    """Links inside tracked changes turned inside out: the link round a change of its own content; how many there were."""
    root = _wrapped(fragment)
    changes = {W + n for n in ("ins", "del", "moveTo", "moveFrom")}
    hoisted = 0

    def walk(parent: ET.Element) -> None:
        nonlocal hoisted
        for child in list(parent):
            walk(child)
            if child.tag not in changes or not any(x.tag == W + "hyperlink" for x in child):
                continue
            made: list[ET.Element] = []
            for x in list(child):
                if x.tag == W + "hyperlink":
                    inner = ET.Element(child.tag, dict(child.attrib))
                    inner.extend(list(x))
                    x[:] = [inner]
                    made.append(x)
                    hoisted += 1
                elif made and made[-1].tag == child.tag:
                    made[-1].append(x)
                else:
                    part = ET.Element(child.tag, dict(child.attrib))
                    part.append(x)
                    made.append(part)
            at = list(parent).index(child)
            parent[at : at + 1] = made

    walk(root)
    # each change has an id of its own again
    used = [int(e.get(W + "id")) for e in root.iter() if e.tag in changes and (e.get(W + "id") or "").isdigit()]
    free, seen = max(used, default=0), set()
    for e in root.iter():
        if e.tag in changes and e.get(W + "id") is not None:
            if e.get(W + "id") in seen:
                free += 1
                e.set(W + "id", str(free))
            seen.add(e.get(W + "id"))
    return "".join(write(e) for e in root), hoisted


def markers_before(root: ET.Element, element: ET.Element) -> list[tuple[str, str | None, bool, bool]]:
    """The markers of no width right before an element: (family, id, whether it opens, whether it belongs to what follows).

    One that opens belongs to what follows, and so does an end whose start stands there too; a proofing end doesn't.
    """
    families = {"bookmarkStart": ("bookmark", True), "bookmarkEnd": ("bookmark", False), "commentRangeStart": ("commentRange", True), "commentRangeEnd": ("commentRange", False), "permStart": ("perm", True), "permEnd": ("perm", False)}
    parent = next((p for p in root.iter() if any(c is element for c in p)), None)
    if parent is None:
        return []
    at = [i for i, c in enumerate(parent) if c is element][0]
    found: list[tuple[str, str | None, bool]] = []
    for e in reversed(list(parent)[:at]):
        if _name(e) == "proofErr":
            found.append(("proofErr", None, (e.get(W + "type") or "").endswith("Start")))
        elif _name(e) in families:
            family, opens = families[_name(e)]
            found.append((family, e.get(W + "id"), opens))
        else:
            break
    found.reverse()
    open_, out = set(), []
    for family, own, opens in found:
        if opens:
            open_.add((family, own))
        out.append((family, own, opens, opens or family != "proofErr" and (family, own) in open_))
    return out


def has_maths(e: ET.Element) -> bool:
    return e.find(f".//{M}oMath") is not None
