"""Finding paragraphs by what they say, building new ones, and edits that keep what an edit must not touch."""

from __future__ import annotations

import copy
import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import markup
from vellum.functions.editing import Refused, _nodes, _set, _split_run, locate, read, replace_in_para, write
from vellum.functions.text import escape, normalize_glyphs
from vellum.functions.wordml import XML_SPACE, M, W, text_of

# How prose writes the labels of exhibits, and what may not follow an exhibit's number.
FORMS = {"Figure": "Figures?", "Table": "Tables?", "Box": "Box(?:es)?", "Рисунок": r"рисун[\p{L}]{0,3}", "Таблица": r"таблиц[\p{L}]{0,2}"}
NUMBER_END = r"(?![\p{L}\p{N}_])(?!\.[\p{L}\p{N}_])(?!-\p{L})"
_PLAIN = str.maketrans("−∗’‘“”–— ", "-*''\"\"-- ")

# patterns, for the JVM's regular expressions


def label_form(label: str) -> str:
    return FORMS.get(label, re.escape(label) + "s?")


def caption_pattern(labels: tuple[str, ...]) -> str:
    """A label, a number and what parts it from the title."""
    return rf"^\s*({'|'.join(map(re.escape, labels))})\s+([A-Z]?\d+(?:[.\-]\d+)*[A-Za-z]?)\s*[.:—–|-]"


def mention_pattern(label: str, number: str) -> str:
    """``Table 1``, in any case, and not ``Table 10``, ``Table 1.1`` or ``Table 1A``."""
    return rf"(?iu)\b{label_form(label)}\s+{re.escape(number)}{NUMBER_END}"


def continuation_pattern(label: str, number: str) -> str:
    """The bare number of a list or range: the 5 of ``Tables 3 to 5``; no other label may stand between."""
    others = "|".join(sorted({*FORMS.values(), label_form(label)}))
    return rf"(?iu)\b{label_form(label)}\s+[\p{{L}}\p{{N}}_.]+(?:(?!\b(?:{others}))[^.;:()]){{0,30}}?(?:\band\b|\bto\b|[–—,-])\s*({re.escape(number)}){NUMBER_END}"


# paragraphs as rows


def matching(paragraphs: DataFrame, sign: Column, normalize: bool = False, text: str = "text") -> DataFrame:
    fold = normalize_glyphs if normalize else (lambda c: c)
    return paragraphs.where(F.contains(fold(F.col(text)), fold(sign)))


def find_para(paragraphs: DataFrame, sign: Column, normalize: bool = False, doc: str = "doc", pos: str = "pos") -> DataFrame:
    """Each document's first paragraph that says ``sign``, with ``matches``, how many do."""
    found = matching(paragraphs, sign, normalize)
    row = F.struct(pos, *(c for c in paragraphs.columns if c not in (doc, pos)))
    return found.groupBy(doc).agg(F.min_by(row, F.col(pos)).alias("_r"), F.count("*").alias("matches")).select(doc, "_r.*", "matches")


def para_slice(paragraphs: DataFrame, sign: Column, normalize: bool = False) -> DataFrame:
    """The one paragraph of each document that says ``sign``; documents where several do are left out."""
    return find_para(paragraphs, sign, normalize).where("matches = 1").drop("matches")


def site(paragraphs: DataFrame, sign: Column, xml: str = "xml", normalize: bool = False) -> DataFrame:
    """A survey of the paragraph that an edit is to be made in: ``(doc, index, matches, text, labels, has_math, footnote_ids, double_spaces, trailing_space)``.

    A document where no paragraph says the sign has index -1.
    """
    found = find_para(paragraphs, sign, normalize)
    labels = F.filter(F.regexp_extract_all(xml, F.lit(r"(?s)<w:hyperlink\b[^>]*w:anchor=\"[^\"]+\"[^>]*(?<!/)>(.*?)</w:hyperlink>"), F.lit(1)), lambda x: F.lit(True))
    from vellum.functions.text import visible_text

    told = found.select(
        F.col("doc").alias("_d"), F.col("pos").alias("index"), "matches", "text", F.transform(labels, visible_text).alias("labels"),
        F.contains(F.col(xml), F.lit("<m:oMath")).alias("has_math"), F.regexp_extract_all(xml, F.lit(r'<w:footnoteReference\b[^>]*w:id="(-?\d+)"'), F.lit(1)).alias("footnote_ids"),
        ((F.length("text") - F.length(F.replace("text", F.lit("  "), F.lit("")))) / 2).cast("int").alias("double_spaces"), F.col("text").rlike(r"(?U)\s$").alias("trailing_space"),
    )
    docs = paragraphs.select("doc").distinct()
    joined = docs.join(told, F.col("doc") == F.col("_d"), "left").drop("_d")
    return joined.withColumn("index", F.coalesce("index", F.lit(-1))).withColumn("matches", F.coalesce("matches", F.lit(0)))


def edit_para(paragraphs: DataFrame, sign: Column, edit: Callable[[Column], Column], xml: str = "xml", normalize: bool = False) -> DataFrame:
    """``paragraphs`` with the one that says ``sign`` edited; a document where none or several do stays as it is."""
    one = para_slice(paragraphs, sign, normalize).select(F.col("doc").alias("_d"), F.col("pos").alias("_p"))
    joined = paragraphs.join(one, (F.col("doc") == F.col("_d")) & (F.col("pos") == F.col("_p")), "left")
    return joined.withColumn(xml, F.when(F.col("_p").isNotNull(), edit(F.col(xml))).otherwise(F.col(xml))).drop("_d", "_p")


def insert_rows(paragraphs: DataFrame, sign: Column, content: Column, before: bool = False, allow_colon: bool = False, xml: str = "xml") -> DataFrame:
    """``paragraphs`` with a new one after (or before) that which says ``sign``, numbered anew.

    A paragraph that ends in a colon introduces what follows, so nothing comes between unless allowed.
    """
    from pyspark.sql import Window

    one = para_slice(paragraphs, sign)
    if not before and not allow_colon:
        one = one.where(~F.rtrim("text").endswith(":"))
    made = one.select("doc", (F.col("pos") + F.lit(-0.5 if before else 0.5)).alias("pos"), content.alias(xml), F.lit("").alias("text"))
    both = paragraphs.select("doc", F.col("pos").cast("double").alias("pos"), xml, "text").unionByName(made)
    order = Window.partitionBy("doc").orderBy("pos")
    return both.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def page_break_before(paragraph: Column) -> Column:
    """The paragraph on a fresh page."""
    from vellum.functions.batched import batched

    return batched(lambda x: markup.set_para_property(x, "pageBreakBefore", "<w:pageBreakBefore/>"), "string")(paragraph)


def table_at(points: DataFrame, tables: DataFrame) -> DataFrame:
    """``points(doc, at)`` with ``table``, the index of the table ``(doc, table, start, stop)`` that they lie in, null outside."""
    t = tables.select(F.col("doc").alias("_d"), F.col("table").alias("_t"), F.col("start").alias("_s"), F.col("stop").alias("_e"))
    joined = points.join(t, (F.col("doc") == F.col("_d")) & (F.col("at") >= F.col("_s")) & (F.col("at") < F.col("_e")), "left")
    return joined.select(*points.columns, F.col("_t").alias("table"))


# building: columns of markup

TABLE_LOOK = '<w:tblPr><w:tblStyle w:val="TableGrid"/><w:tblW w:w="5000" w:type="pct"/></w:tblPr>'
TEXT_WIDTH = 9360


def run(text: Column, props: str = "") -> Column:
    space = F.when(text.rlike(r"(?U)^\s|\s$"), ' xml:space="preserve"').otherwise("")
    return F.concat(F.lit(f"<w:r>{props}<w:t"), space, F.lit(">"), escape(text), F.lit("</w:t></w:r>"))


def para(content: Column, props: str = "") -> Column:
    props = props if not props or props.lstrip().startswith("<w:pPr") else f"<w:pPr>{props}</w:pPr>"
    return F.concat(F.lit(f"<w:p>{props}"), content, F.lit("</w:p>"))


def cell(content: Column, span: int = 1, props: str = "", look: str = "", paragraph: str = "") -> Column:
    """A cell; text becomes a paragraph, which a cell has to hold."""
    own = props or '<w:tcPr><w:tcW w:w="0" w:type="auto"/></w:tcPr>'
    if span > 1:
        if "<w:tcPr>" not in own:
            raise Refused("a span needs cell properties to stand in")
        own = own.replace("<w:tcPr>", f'<w:tcPr><w:gridSpan w:val="{span}"/>', 1)
    body = F.when(content.rlike(r"^\s*<w:p[\s/>]"), content).otherwise(para(run(content, look), paragraph))
    return F.concat(F.lit(f"<w:tc>{own}"), body, F.lit("</w:tc>"))


def row(cells: Column, header: bool = False) -> Column:
    """A row of an array of cells; a header is repeated on each page."""
    return F.concat(F.lit("<w:tr>" + "<w:trPr><w:tblHeader/></w:trPr>" * header), F.array_join(cells, ""), F.lit("</w:tr>"))


def table(headers: list[Column], rows: Column, spans: list[int] | None = None, look: str = TABLE_LOOK, require_style: bool = True) -> Column:
    """A table of header texts and an array of rows of texts.

    Header cells may span; rows that aren't as wide as the header make the table null, so that no value
    is lost in silence.
    """
    if require_style and "<w:tblStyle" not in look:
        raise Refused("the table has no style")
    spans = spans or [1] * len(headers)
    if len(spans) != len(headers):
        raise Refused(f"{len(headers)} headers and {len(spans)} spans")
    columns = sum(spans)
    edge = '<w:tcPr><w:tcW w:w="0" w:type="auto"/><w:tcBorders><w:bottom w:val="single" w:sz="6" w:space="0" w:color="auto"/></w:tcBorders></w:tcPr>'
    head = row(F.array(*(cell(h, s, edge, "<w:rPr><w:b/></w:rPr>") for h, s in zip(headers, spans, strict=True))), header=True)
    body = F.array_join(F.transform(rows, lambda r: row(F.transform(r, lambda x: cell(x)))), "")
    lines = f'<w:gridCol w:w="{TEXT_WIDTH // columns}"/>' * columns
    whole = F.concat(F.lit(f"<w:tbl>{look}<w:tblGrid>{lines}</w:tblGrid>"), head, body, F.lit("</w:tbl>"))
    return F.when(F.forall(rows, lambda r: F.size(r) == columns), whole)


def prose_props(paragraph: str) -> tuple[str, str]:
    """(paragraph properties, run properties) to clone: those of prose, never of a link, a field or their look."""
    p = read(paragraph)
    own = markup.own_properties(p, "pPr")
    paragraph_props = ET.Element(W + "pPr")
    for c in markup.live_children(own):
        if c.tag not in (W + "rPr", W + "sectPr", W + "numPr"):
            paragraph_props.append(copy.deepcopy(c))
    depth, found = 0, ""
    for r in p:
        if r.tag != W + "r":
            continue
        marks = [c.get(W + "fldCharType") for c in r if c.tag == W + "fldChar"]
        style = r.find(f"{W}rPr/{W}rStyle")
        inside = depth > 0 or marks or style is not None and style.get(W + "val") == "Hyperlink"
        depth += marks.count("begin") - marks.count("end")
        if not inside and any(c.tag == W + "t" for c in r):
            props = r.find(W + "rPr")
            found = "" if props is None else write(_without_changes(props))
            break
    return (write(paragraph_props) if len(paragraph_props) else ""), found


def _without_changes(props: ET.Element) -> ET.Element:
    out = ET.Element(props.tag)
    out.extend(copy.deepcopy(c) for c in markup.live_children(props))
    return out


# edits of a paragraph


def find_normalized(text: str, wanted: str) -> list[tuple[int, int]]:
    """Where ``wanted`` stands in ``text``, glyphs that a word processor swaps counting as one."""
    a, b = text.translate(_PLAIN), wanted.translate(_PLAIN)
    return [(m.start(), m.start() + len(b)) for m in re.finditer(f"(?={re.escape(b)})", a)] if b else []


def rep(text: str, old: str, new: str, times: int = 1, normalize: bool = False) -> str:
    """``old`` by ``new``, which has to be there exactly ``times`` times."""
    spans = find_normalized(text, old) if normalize else [(m.start(), m.end()) for m in re.finditer(re.escape(old), text)]
    if len(spans) != times:
        raise Refused(f"the text is there {len(spans)} times, not {times}")
    for a, b in reversed(spans):
        text = text[:a] + new + text[b:]
    return text


def _labels(p: ET.Element) -> list[tuple[int, int]]:
    """Spans of the visible text that links and fields show."""
    out: list[list[int]] = []
    held = {id(x) for h in p.iter(W + "hyperlink") for x in h.iter(W + "t")} | {id(x) for f in markup.fields(p) for e in f.result or () for x in e.iter() if x.tag == W + "t"}
    at = 0
    for t, _, _ in _nodes(p):
        n = len(t.text or "")
        if id(t) in held and n:
            if out and out[-1][1] == at:
                out[-1][1] = at + n
            else:
                out.append([at, at + n])
        at += n
    return [(a, b) for a, b in out]


def replace_keeping_links(paragraph: str, old: str, new: str) -> str:
    """``old`` by ``new`` round the links in it: ``new`` has to carry their labels, in order, and they are never written to."""
    p = read(paragraph)
    start, stop = locate(p, old)
    whole = "".join(t.text or "" for t, _, _ in _nodes(p))
    labels = [(a, b) for a, b in _labels(p) if a < stop and start < b]
    if not labels:
        return replace_in_para(paragraph, old, new)
    if any(a < start or b > stop for a, b in labels):
        raise Refused("a link's label stands across an end of the text")
    pieces, at, done = [], start, 0
    for k, (a, b) in enumerate(labels):
        label = whole[a:b]
        same = [i for i, (x, y) in enumerate(labels) if whole[x:y] == label]
        if new.count(label) != len(same):
            raise Refused(f"the new text has the label {label!r} {new.count(label)} times, not {len(same)}")
        hit = -1
        for _ in range(same.index(k) + 1):
            hit = new.index(label, hit + 1)
        if hit < done:
            raise Refused("the new text has the labels in another order")
        pieces.append((at, a, new[done:hit]))
        at, done = b, hit + len(label)
    pieces.append((at, stop, new[done:]))
    out = p
    for a, b, words in reversed(pieces):
        if whole[a:b] != words:
            _replace_span(out, a, b, words)
    return write(out)


def _replace_span(p: ET.Element, start: int, stop: int, words: str) -> None:
    """A span of the visible text by words; an empty span gets a run of its own, outside any link."""
    at, first = 0, True
    nodes = _nodes(p)
    for t, _, holder in nodes:
        value = t.text or ""
        lo, hi = max(start - at, 0), min(stop - at, len(value))
        if lo < hi:
            if t.tag == M + "t":
                raise Refused("the text is in an equation")
            _set(t, value[:lo] + (words if first else "") + value[hi:])
            first = False
        at += len(value)
    if not first or not words:
        return
    made = ET.Element(W + "r")
    _set(ET.SubElement(made, W + "t"), words)
    at = 0
    for t, own, _ in nodes:
        n = len(t.text or "")
        if at + n > start:
            place = next(i for i, c in enumerate(p) if any(x is own for x in c.iter()))
            if at < start:
                raise Refused("the place is inside a run")
            p.insert(place, made)
            return
        at += n
    p.append(made)


def remove_links(fragment: str, keep: frozenset[str] | set[str]) -> tuple[str, list[str]]:
    """Links to places not in ``keep`` undone, their words kept; the places, in order.

    One that is to be kept inside one that goes is refused.
    """
    root = read(f"<w:x>{fragment}</w:x>")
    gone: list[str] = []
    while True:
        parents = {c: p for p in root.iter() for c in p}
        link = next((h for h in root.iter(W + "hyperlink") if h.get(W + "anchor") and h.get(W + "anchor") not in keep), None)
        if link is None:
            break
        inside = [x.get(W + "anchor") for x in link.iter(W + "hyperlink") if x is not link]
        if any(a in keep for a in inside):
            raise Refused(f"a link to keep is inside the link to {link.get(W + 'anchor')}")
        gone += [link.get(W + "anchor") or "", *[a for a in inside if a]]
        _unwrap(parents[link], link)
    return "".join(write(e) for e in root), gone


def _unwrap(parent: ET.Element, link: ET.Element) -> None:
    for h in [x for x in link.iter() if x.tag == W + "rPr"]:
        style = h.find(W + "rStyle")
        if style is not None and style.get(W + "val") == "Hyperlink":
            h.remove(style)
    flat: list[ET.Element] = []
    for c in link:
        flat += list(c) if c.tag == W + "hyperlink" else [c]
    at = list(parent).index(link)
    parent[at : at + 1] = flat


def relabel_link(paragraph: str, anchor: str, label: str) -> str:
    """What the one link to a place shows, rewritten; an empty label is refused."""
    if not label:
        raise Refused("a link without a label can't be seen")
    p = read(paragraph)
    elements = [list(h.iter(W + "t")) for h in p.iter(W + "hyperlink") if h.get(W + "anchor") == anchor]
    elements += [[x for e in f.result or () for x in e.iter() if x.tag == W + "t"] for f in markup.fields(p) if markup.target_of(f.instruction) == anchor]
    if len(elements) != 1:
        raise Refused(f"the paragraph links to {anchor} {len(elements)} times")
    if not elements[0]:
        raise Refused("the link shows no text")
    for k, t in enumerate(elements[0]):
        _set(t, label if k == 0 else "")
    return write(p)


def replace_with_runs(paragraph: str, old: str, runs: list[tuple[str, str | None]], allow_link: bool = False) -> str:
    """``old`` by styled runs: (text, run properties), "" for none, None for the look of the run that ``old`` starts in."""
    for _, props in runs:
        if props and not re.fullmatch(r"(?s)<w:rPr\b[^>]*(?:/>|>.*</w:rPr>)", props):
            raise Refused("the properties aren't whole")
    p = read(paragraph)
    start, stop = locate(p, old)
    at, anchor = 0, None
    for t, r, holder in list(_nodes(p)):
        n = len(t.text or "")
        lo, hi = max(start - at, 0), min(stop - at, n)
        at += n
        if lo >= hi:
            continue
        if t.tag == M + "t":
            raise Refused("the text is in an equation")
        if holder.tag == W + "hyperlink" and not allow_link:
            raise Refused("the text is in a link")
        own = r if (lo, hi) == (0, n) and sum(c.tag == W + "t" for c in r) == 1 else _split_run(r, holder, t, lo, hi)
        if anchor is None:
            anchor = (holder, own)
        else:
            holder.remove(own)
    holder, own = anchor
    look = own.find(W + "rPr")
    made = []
    for text, props in runs:
        if not text:
            continue
        new = ET.Element(W + "r")
        if props is None and look is not None:
            new.append(copy.deepcopy(look))
        elif props:
            new.append(read(props))
        _set(ET.SubElement(new, W + "t"), text)
        made.append(new)
    place = list(holder).index(own)
    holder[place : place + 1] = made
    return write(p)


def is_field_run(run_xml: Column) -> Column:
    """A run that is a field's machinery and shows nothing."""
    from vellum.functions.text import visible_text

    return run_xml.rlike(r"<w:(?:fldChar|instrText)\b") & (F.trim(visible_text(run_xml)) == "")


def rstrip_para(paragraph: str) -> str:
    """The paragraph without white space at its end, as far as that is plain prose: a link, note, tab or change stops it."""
    p = read(paragraph)
    while True:
        tail = [c for c in p if c.tag not in (W + "bookmarkStart", W + "bookmarkEnd", W + "commentRangeStart", W + "commentRangeEnd", W + "proofErr", W + "permStart", W + "permEnd")]
        last = tail[-1] if tail else None
        if last is None or last.tag != W + "r" or any(c.tag not in (W + "rPr", W + "t") for c in last):
            break
        style = last.find(f"{W}rPr/{W}rStyle")
        if style is not None and style.get(W + "val") == "Hyperlink":
            break
        text = "".join(t.text or "" for t in last.iter(W + "t"))
        kept = text.rstrip(" \t\r\n")
        if not kept:
            p.remove(last)
            continue
        if kept != text:
            nodes = list(last.iter(W + "t"))
            _set(nodes[0], kept)
            for t in nodes[1:]:
                last.remove(t)
            if kept == kept.strip() and XML_SPACE in nodes[0].attrib:
                del nodes[0].attrib[XML_SPACE]
        break
    return write(p)


def set_run_properties(paragraph: str, props: dict[str, str], skip_fields: bool = True) -> tuple[str, int]:
    """Properties on every run, fields' machinery left out; how many runs changed."""
    p, changed = read(paragraph), 0
    for r in list(p.iter(W + "r")):
        if skip_fields and any(c.tag in (W + "fldChar", W + "instrText") for c in r) and not any((t.text or "").strip() for t in r.iter(W + "t")):
            continue
        before = write(r)
        own = markup.own_properties(r, "rPr")
        if own is None:
            own = ET.Element(W + "rPr")
            r.insert(0, own)
        for element in props.values():
            markup._place(own, read(element), markup.RUN_ORDER)
        changed += write(r) != before
    return write(p), changed


def drop_para(paragraph: str, allow_bookmarks: bool = False, allow_notes: bool = False) -> str:
    """Nothing, if a paragraph may go: it holds no section end, comment, change, half a bookmark, nor bookmarks or notes unless allowed."""
    p = read(paragraph)
    has = lambda *names: any(p.find(f".//{W}{n}") is not None for n in names)
    if has("ins", "del", "moveFrom", "moveTo"):
        raise Refused("the paragraph holds tracked changes")
    if has("sectPr"):
        raise Refused("the paragraph ends a section")
    if has("commentRangeStart", "commentRangeEnd", "commentReference"):
        raise Refused("the paragraph anchors a comment")
    if has("footnoteReference", "endnoteReference") and not allow_notes:
        raise Refused("the paragraph holds a note")
    starts = {b.get(W + "id"): b.get(W + "name") for b in p.iter(W + "bookmarkStart")}
    ends = {b.get(W + "id") for b in p.iter(W + "bookmarkEnd")}
    if starts.keys() ^ ends:
        raise Refused("only half of a bookmark is in the paragraph")
    if any(n != "_GoBack" for n in starts.values()) and not allow_bookmarks:
        raise Refused("the paragraph holds a bookmark")
    return ""


def diagnose(paragraphs: list[str], sign: str, old: str) -> str:
    """Why an edit will fail."""
    shown = [text_of(read(p)) for p in paragraphs]
    hits = [k for k, t in enumerate(shown) if sign in t]
    if not hits:
        return "no paragraph has the sign"
    if len(hits) > 1:
        return f"{len(hits)} paragraphs have the sign"
    text, p = shown[hits[0]], read(paragraphs[hits[0]])
    if old not in text:
        near = next((s for s in re.split(r"(?<=[.:])\s", text) if old[:20] and old[:20] in s), "")
        return "the text isn't in that paragraph" + (f"; near it is: {near[:80]}" if near else "")
    for a, b in _labels(p):
        if text[a:b] in old or old in text[a:b]:
            return f"the text meets the link {text[a:b]!r}"
    if markup.has_maths(p) and old not in text_of(p, maths=False):
        return "the text spans an equation"
    return "refused for another reason"


@dataclass(frozen=True)
class Invariants:
    """What an edit must not move unasked."""

    paragraphs: int
    bookmarks: int
    bookmark_ends: int
    links: int
    footnote_refs: int
    math: int
    rows: int
    drawings: int


def invariants(fragment: str) -> Invariants:
    root = read(f"<w:x>{fragment}</w:x>")
    n = Counter(e.tag for e in root.iter())
    return Invariants(
        n[W + "p"], n[W + "bookmarkStart"], n[W + "bookmarkEnd"], sum(1 for _ in markup.internal_links(root)), n[W + "footnoteReference"], n[M + "oMath"], n[W + "tr"], n[W + "drawing"]
    )
