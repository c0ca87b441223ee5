"""One document part at a time: both sides of its tracked changes, and its blocks.

These are plain functions over a part's bytes, for the Arrow-batched operators in
``vellum.operators.documents``.  A part that doesn't parse gives an error, never an exception.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from functools import lru_cache
from xml.parsers import expat

# Namespaces of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
PREFIXES = {
    "w": W[1:-1], "m": M[1:-1], "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing", "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "w14": "http://schemas.microsoft.com/office/word/2010/wordml", "mc": "http://schemas.openxmlformats.org/markup-compatibility/2006",
}
CAPTION = re.compile(r"^(Table|Figure|Fig\.|Box|Chart|Map|Scheme)\s+[A-Z]?\d+(?:[.\-]\d+)*[A-Za-z]?\b")
SNAPSHOTS = ("rPrChange", "pPrChange", "sectPrChange", "tblPrChange", "trPrChange", "tcPrChange", "tblGridChange", "numberingChange", "tblPrExChange")
#: Elements of the wrapping kind that each view keeps (unwrapped) and drops.
KEEPS = {"final": ("ins", "moveTo"), "original": ("del", "moveFrom")}
DROPS = {"final": ("del", "moveFrom"), "original": ("ins", "moveTo")}
REVISION = re.compile(rb"<w:(ins|del|moveFrom|moveTo|cellIns|cellDel|cellMerge|\w+Change)\b")
RANGES = tuple(f"move{side}Range{end}" for side in ("From", "To") for end in ("Start", "End"))


#: Levels of nesting beyond which a part isn't a document that a word processor writes.
DEEPEST = 400


def parse(blob: bytes) -> tuple[ET.Element | None, str | None]:
    """The tree, or why there is none: markup that doesn't parse, or is nested beyond all reason."""
    try:
        root = ET.fromstring(blob)
    except ET.ParseError as e:
        return None, str(e)
    # every level opens a tag, so few tags need no count
    level, depth = [root] if blob.count(b"<") > DEEPEST else [], 0
    while level:
        depth += 1
        if depth > DEEPEST:
            return None, f"nested deeper than {DEEPEST}"
        level = [c for e in level for c in e]
    return root, None


#: What a tag holds besides its name, values in their quotes.
SAID = rb"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
_HEAD = re.compile(rb"(<\?xml[^<>?]*\?>\s*)?<[^<>?!]*>")
_UTF8 = re.compile(rb"""<\?xml(?:(?!encoding)[^?])*(?:encoding\s*=\s*["'](?i:utf-8)["'](?:(?!encoding)[^?])*)?\?>\s*""")
_OWN = re.compile(rb"""xmlns:w\s*=\s*["']""" + re.escape(W[1:-1].encode()) + rb"""["']""")
_OTHER = re.compile(rb"""xmlns:w\s*=|xmlns[^\s=<>"']*\s*=\s*(?:"[^"<]*&|'[^'<]*&)|""" + re.escape(W[1:-1].encode()))


@lru_cache(1024)
def _known(head: bytes, declared: bytes | None) -> bool:
    """Whether a root's tag gives the prefix ``w`` and no other to its namespace, in an encoding in which ASCII is ASCII."""
    own = _OWN.search(head)
    return own is not None and not _OTHER.search(head[: own.start()] + head[own.end() :]) and (declared is None or _UTF8.fullmatch(declared) is not None)


def plain(blob: bytes) -> bool:
    """Whether a part parses and its bytes can be searched for elements as they are.

    That is, the prefix ``w`` and no other stands for its namespace throughout, and there are no comments, literal
    sections or instructions, which may hold what looks like an element.
    """
    head = _HEAD.match(blob)
    if head is None or b"<!" in blob or blob.find(b"<?", 1) >= 0 or not _known(head[0], head[1]):
        return False
    if blob.find(b"xmlns", head.end()) >= 0 and _OTHER.search(blob, head.end()):
        return False
    if blob.count(b"<") > DEEPEST:
        return parse(blob)[0] is not None
    try:
        expat.ParserCreate(None, "}").Parse(blob, True)
    except expat.ExpatError:
        return False
    return True


def serialise(root: ET.Element) -> bytes:
    for prefix, uri in PREFIXES.items():
        if ET._namespace_map.get(uri) != prefix:
            ET.register_namespace(prefix, uri)
            _NAMES.clear()
    return b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + (_written(root) or ET.tostring(root, encoding="utf-8"))


_NAMES: dict[str, tuple[str, str | None, str | None]] = {}


def _written(root: ET.Element) -> bytes | None:
    """What ``ET.tostring`` writes, in a fraction of its time; None for a tree with a namespace that has no known prefix."""
    used: dict[str, str] = {}
    out: list[str] = []
    text, attribute = ET._escape_cdata, ET._escape_attrib

    def name(tag: str) -> str:
        known = _NAMES.get(tag)
        if known is None:
            uri, _, local = tag[1:].rpartition("}") if tag[:1] == "{" else ("", "", tag)
            prefix = ET._namespace_map[uri] if uri else None
            known = (f"{prefix}:{local}" if prefix else local, uri or None, prefix)
            if len(_NAMES) < 10_000:
                _NAMES[tag] = known
        if known[1] is not None and known[2] != "xml":
            used[known[1]] = known[2]
        return known[0]

    def write(e: ET.Element) -> None:
        tag = name(e.tag)
        out.append("<" + tag)
        if e is root:
            out.append("")
        for k, v in e.items():
            out.append(f' {name(k)}="{attribute(v)}"')
        if e.text or len(e):
            out.append(">")
            if e.text:
                out.append(text(e.text))
            for c in e:
                write(c)
            out.append(f"</{tag}>")
        else:
            out.append(" />")
        if e.tail:
            out.append(text(e.tail))

    try:
        write(root)
    except (KeyError, TypeError, AttributeError):
        return None
    out[1] = "".join(f' xmlns:{prefix}="{attribute(uri)}"' for uri, prefix in sorted(used.items(), key=lambda x: x[1]))
    return "".join(out).encode("utf-8", "xmlcharrefreplace")


#: Whether a revision, by its element, is one to accept or reject.
Where = Callable[[ET.Element], bool]


def by_author(*names: str) -> Where:
    return lambda e: e.get(W + "author") in names


def whitespace_only(e: ET.Element) -> bool:
    """An insertion or deletion of nothing but white space; a paragraph's mark is none."""
    shown = text_of(e, deleted=True)
    return e.tag in (W + "ins", W + "del") and shown != "" and not shown.strip()


def _marked(holder: ET.Element | None, names: tuple[str, ...], where: Where | None) -> ET.Element | None:
    """The revision of one of these names that properties carry, if it is wanted."""
    found = next((c for c in holder if isinstance(c.tag, str) and c.tag.removeprefix(W) in names), None) if holder is not None else None
    return found if found is not None and (where is None or where(found)) else None


def in_view(root: ET.Element, view: str, where: Where | None = None) -> ET.Element:
    """The tree with its revisions accepted (``final``) or rejected (``original``), changed in place.

    Content goes first, then rows, then paragraph marks (a paragraph whose mark goes runs on into
    the next one), then property snapshots, then cells.  With ``where`` only the revisions that it
    wants are; the others stay pending, and so do moves, whose two ends belong together.
    """
    keeps, drops = KEEPS[view], DROPS[view]
    if where is not None:
        keeps, drops = keeps[:1], drops[:1]
    stack = [root]
    while stack:
        parent = stack.pop()
        at = 0
        while at < len(parent):
            child = parent[at]
            name = child.tag.removeprefix(W) if isinstance(child.tag, str) and child.tag.startswith(W) else ""
            wanted = parent.tag not in (W + "rPr", W + "trPr") and (where is None or name in RANGES or (name in keeps or name in drops) and where(child))
            if wanted and (name in drops or name in RANGES and where is None):
                del parent[at]
            elif wanted and name in keeps:
                parent[at : at + 1] = list(child)
                if view == "original":
                    _restore_deleted(parent[at : at + len(child)])
            else:
                stack.append(child)
                at += 1
    if view == "original" and where is None:
        _restore_deleted([root])
    row_gone = ("del", "moveFrom") if view == "final" else ("ins", "moveTo")
    cell_gone = ("cellDel",) if view == "final" else ("cellIns",)
    if where is not None:
        row_gone = row_gone[:1]
    for table in list(root.iter(W + "tbl")):
        for row in list(table):
            if row.tag == W + "tr" and _marked(row.find(W + "trPr"), row_gone, where) is not None:
                table.remove(row)
    _merge_paragraphs(root, drops, where)
    _snapshots(root, view, where)
    for row in root.iter(W + "tr"):
        for cell in list(row):
            if cell.tag == W + "tc" and _marked(cell.find(W + "tcPr"), cell_gone, where) is not None:
                row.remove(cell)
    marks = {W + n for n in ("ins", "del", "moveFrom", "moveTo", "cellIns", "cellDel")}
    for parent in list(root.iter()):
        if parent.tag in (W + "rPr", W + "trPr", W + "tcPr"):
            for child in list(parent):
                if child.tag in marks and (where is None or where(child) and child.tag not in (W + "moveFrom", W + "moveTo")):
                    parent.remove(child)
    return root


def _restore_deleted(elements: list[ET.Element]) -> None:
    """Deleted text is text again."""
    for e in elements:
        for t in e.iter(W + "delText"):
            t.tag = W + "t"
        for t in e.iter(W + "delInstrText"):
            t.tag = W + "instrText"


def rows_in_view(table: ET.Element, view: str) -> list[bool]:
    """Of each of a table's own rows whether a side of the changes has it."""
    gone = ("del", "moveFrom") if view == "final" else ("ins", "moveTo")
    out: list[bool] = []
    stack = [table]
    while stack:
        parent = stack.pop()
        for child in parent:
            if child.tag == W + "tr":
                out.append(_marked(child.find(W + "trPr"), gone, None) is None)
            elif child.tag in (W + "sdt", W + "sdtContent"):
                stack.append(child)
    return out


def _merge_paragraphs(root: ET.Element, gone: tuple[str, ...], where: Where | None) -> None:
    for parent in list(root.iter()):
        at = 0
        while at < len(parent):
            p = parent[at]
            if p.tag == W + "p" and _marked(p.find(f"{W}pPr/{W}rPr"), gone, where) is not None:
                nxt = parent[at + 1] if at + 1 < len(parent) else None
                if nxt is not None and nxt.tag == W + "p":
                    own = [c for c in p if c.tag != W + "pPr"]
                    first = 1 if len(nxt) and nxt[0].tag == W + "pPr" else 0
                    nxt[first:first] = own
                    del parent[at]
                    continue
                if not any(c.tag != W + "pPr" for c in p) and parent.tag != W + "tc":
                    del parent[at]
                    continue
            at += 1


def _snapshots(root: ET.Element, view: str, where: Where | None) -> None:
    for holder in list(root.iter()):
        for child in list(holder):
            name = child.tag.removeprefix(W) if isinstance(child.tag, str) else ""
            if name not in SNAPSHOTS or where is not None and not where(child):
                continue
            if view == "original" and len(child) and child[0].tag == holder.tag:
                before = child[0]
                marks = [c for c in holder if c.tag == W + "rPr"] if holder.tag == W + "pPr" else []
                holder[:] = [*before, *[m for m in marks if before.find(W + "rPr") is None]]
                break
            holder.remove(child)


_SHOWN = {(m, d): frozenset([W + "t", *[M + "t"] * m, *[W + "delText"] * d]) for m in (False, True) for d in (False, True)}


def text_of(element: ET.Element, maths: bool = True, deleted: bool = False) -> str:
    tags = _SHOWN[maths, deleted]
    return "".join([t.text or "" for t in element.iter() if t.tag in tags])


def heading_level(paragraph: ET.Element) -> int | None:
    """By outline level, else by a heading style's number."""
    outline = paragraph.find(f"{W}pPr/{W}outlineLvl")
    if outline is not None and (outline.get(W + "val") or "").isdigit():
        level = int(outline.get(W + "val")) + 1
        return level if level <= 9 else None
    style = paragraph.find(f"{W}pPr/{W}pStyle")
    m = re.fullmatch(r"[Hh]eading\s?(\d)", style.get(W + "val") or "") if style is not None else None
    return int(m[1]) if m else None


def blocks(root: ET.Element) -> Iterator[dict]:
    """Paragraphs and tables of the body in order, paragraphs in tables after their table."""
    body = root.find(W + "body")
    pos = table = 0
    for child in body if body is not None else root:
        if child.tag == W + "p":
            yield _paragraph(child, pos, None)
            pos += 1
        elif child.tag == W + "tbl":
            yield {"pos": pos, "kind": "table", "table": table, "level": None, "style": None, "text": "", "maths": "", "display": False}
            pos += 1
            for p in child.iter(W + "p"):
                yield _paragraph(p, pos, table)
                pos += 1
            table += 1


def _paragraph(p: ET.Element, pos: int, table: int | None) -> dict:
    prose = text_of(p, maths=False)
    maths = " ".join("".join(t.text or "" for t in o.iter(M + "t")) for o in p.iter(M + "oMath"))
    level = heading_level(p)
    style = p.find(f"{W}pPr/{W}pStyle")
    kind = "cell" if table is not None else "heading" if level else "caption" if CAPTION.match(text_of(p).strip()) else "paragraph"
    return {
        "pos": pos, "kind": kind, "table": table, "level": level, "style": style.get(W + "val") if style is not None else None,
        "text": prose, "maths": maths, "display": bool(maths) and not prose.strip(),
    }


def cells(root: ET.Element) -> Iterator[dict]:
    """Cells of all tables with their grid column, span and vertical merge."""
    for t, table in enumerate(root.iter(W + "tbl")):
        for r, row in enumerate(c for c in table if c.tag == W + "tr"):
            column = 0
            for c, cell in enumerate(x for x in row if x.tag == W + "tc"):
                span = cell.find(f"{W}tcPr/{W}gridSpan")
                width = int(span.get(W + "val") or 1) if span is not None else 1
                merge = cell.find(f"{W}tcPr/{W}vMerge")
                paragraphs = [text_of(p) for p in cell if p.tag == W + "p"]
                yield {
                    "table": t, "row": r, "cell": c, "gcol": column, "span": width,
                    "vmerge": None if merge is None else merge.get(W + "val") or "continue", "text": "\n".join(paragraphs),
                }
                column += width


def revisions(root: ET.Element) -> Iterator[dict]:
    """Tracked changes in order: kind, author, date and text."""
    kinds = {W + k for k in ("ins", "del", "moveFrom", "moveTo", "cellIns", "cellDel", "cellMerge", *SNAPSHOTS)}
    for seq, e in enumerate(x for x in root.iter() if x.tag in kinds):
        yield {"seq": seq, "kind": e.tag.removeprefix(W), "author": e.get(W + "author"), "date": e.get(W + "date"), "text": text_of(e, deleted=True)}


def notes(root: ET.Element) -> Iterator[dict]:
    """Footnotes or endnotes, the separators left out."""
    for n in root:
        if n.tag in (W + "footnote", W + "endnote") and n.get(W + "type") in (None, "normal"):
            yield {"kind": n.tag.removeprefix(W), "id": n.get(W + "id"), "text": " ".join(text_of(n).split())}


def comments(root: ET.Element) -> Iterator[dict]:
    for c in root.iter(W + "comment"):
        yield {"id": c.get(W + "id"), "author": c.get(W + "author"), "date": c.get(W + "date"), "text": "\n".join(text_of(p) for p in c.iter(W + "p"))}


def references_to_notes(root: ET.Element) -> Iterator[dict]:
    for e in root.iter():
        if e.tag in (W + "footnoteReference", W + "endnoteReference"):
            yield {"kind": e.tag.removeprefix(W).removesuffix("Reference"), "id": e.get(W + "id")}


def links(root: ET.Element) -> Iterator[dict]:
    """Links to places in the document: elements and fields, with what they show."""
    for h in root.iter(W + "hyperlink"):
        if h.get(W + "anchor"):
            yield {"anchor": h.get(W + "anchor"), "label": text_of(h), "form": "element"}
    for f in root.iter(W + "fldSimple"):
        m = re.search(r'HYPERLINK\s+\\l\s+"?([^"\s]+)', f.get(W + "instr") or "")
        if m:
            yield {"anchor": m[1], "label": text_of(f), "form": "simple"}
    for p in root.iter(W + "p"):
        anchor, label, state = None, [], ""
        for r in p.iter(W + "r"):
            for e in r:
                if e.tag == W + "fldChar":
                    kind = e.get(W + "fldCharType")
                    if kind == "begin":
                        anchor, label, state = None, [], "code"
                    elif kind == "separate":
                        state = "result"
                    elif kind == "end":
                        if anchor:
                            yield {"anchor": anchor, "label": "".join(label), "form": "field"}
                        anchor, state = None, ""
                elif e.tag == W + "instrText" and state == "code":
                    m = re.search(r'HYPERLINK\s+\\l\s+"?([^"\s]+)', e.text or "")
                    anchor = m[1] if m else anchor
                elif e.tag == W + "t" and state == "result":
                    label.append(e.text or "")


def bookmarks(root: ET.Element) -> Iterator[dict]:
    for b in root.iter(W + "bookmarkStart"):
        yield {"name": b.get(W + "name"), "id": b.get(W + "id")}


def lint(root: ET.Element) -> Iterator[dict]:
    """Structural faults: (code, where)."""
    block_level = {W + "body", W + "tc", W + "hdr", W + "ftr"}
    seen: dict[str, int] = {}
    for parent in root.iter():
        for child in parent:
            if parent.tag in block_level and child.tag in (W + "r", W + "t", W + "hyperlink"):
                yield {"code": "run-in-block", "where": child.tag.removeprefix(W)}
            if parent.tag == W + "p" and child.tag == W + "pPr" and parent[0] is not child:
                yield {"code": "properties-not-first", "where": "pPr"}
            if parent.tag == W + "r" and child.tag == W + "rPr" and parent[0] is not child:
                yield {"code": "properties-not-first", "where": "rPr"}
            if parent.tag in (W + "ins", W + "del") and child.tag in (W + "p", W + "tbl"):
                yield {"code": "block-in-revision", "where": child.tag.removeprefix(W)}
        if parent.tag == W + "del":
            for t in parent.iter(W + "t"):
                yield {"code": "text-in-deletion", "where": (t.text or "")[:40]}
        if parent.tag == W + "t" and (parent.text or "") != (parent.text or "").strip(" \t\r\n") and parent.get(XML_SPACE) != "preserve":
            yield {"code": "edge-space", "where": (parent.text or "")[:40]}
        if parent.tag == M + "oMath" and not any((t.text or "") for t in parent.iter(M + "t")):
            yield {"code": "empty-maths", "where": ""}
        if parent.tag in (W + "ins", W + "del", W + "moveFrom", W + "moveTo"):
            key = parent.get(W + "id") or ""
            seen[key] = seen.get(key, 0) + 1
    for key, n in seen.items():
        if key and n > 1:
            yield {"code": "repeated-revision-id", "where": key}
    depth = 0
    for e in root.iter(W + "fldChar"):
        depth += {"begin": 1, "end": -1}.get(e.get(W + "fldCharType"), 0)
    if depth:
        yield {"code": "unbalanced-fields", "where": str(depth)}
