"""Edits of one paragraph by its visible text, and batches of them.

An edit works on the runs that hold the text: the words change, the formatting of the run they start
in stays, and what else the paragraph holds keeps its place.  An edit that can't be made gives a
verdict, not an exception.
"""

from __future__ import annotations

import copy
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass

from vellum.functions.wordml import PREFIXES, XML_SPACE, M, W

# Toggles and vertical positions of a run, by what they are called here.
STYLES = {"italic": ("i", None), "bold": ("b", None), "subscript": ("vertAlign", "subscript"), "superscript": ("vertAlign", "superscript")}
ORDER = "rStyle rFonts b bCs i iCs caps smallCaps strike u color sz szCs highlight vertAlign lang".split()


class Refused(Exception):
    """Why an edit can't be made."""


def read(fragment: str) -> ET.Element:
    names = " ".join(f'xmlns:{p}="{u}"' for p, u in PREFIXES.items())
    return ET.fromstring(f"<x {names}>{fragment}</x>")[0]


def write(paragraph: ET.Element) -> str:
    for prefix, uri in PREFIXES.items():
        ET.register_namespace(prefix, uri)
    out = ET.tostring(paragraph, encoding="unicode")
    for prefix, uri in PREFIXES.items():
        out = out.replace(f' xmlns:{prefix}="{uri}"', "")
    return out


def _nodes(p: ET.Element) -> list[tuple[ET.Element, ET.Element, ET.Element]]:
    """(text node, its run, what holds the run) of everything visible, in order."""
    parents = {c: e for e in p.iter() for c in e}
    return [(t, parents[t], parents[parents[t]]) for t in p.iter() if t.tag in (W + "t", M + "t") and t in parents and parents[t] in parents]


def text(fragment: str) -> str:
    return "".join(t.text or "" for t, _, _ in _nodes(read(fragment)))


def locate(p: ET.Element, wanted: str) -> tuple[int, int]:
    whole = "".join(t.text or "" for t, _, _ in _nodes(p))
    n = whole.count(wanted) if wanted else 0
    if n != 1:
        raise Refused("the text isn't there" if not n else f"the text is there {n} times")
    at = whole.index(wanted)
    return at, at + len(wanted)


def _set(t: ET.Element, value: str) -> None:
    t.text = value
    if value != value.strip():
        t.set(XML_SPACE, "preserve")


def replace_in_para(fragment: str, old: str, new: str, *, allow_link: bool = False) -> str:
    """``old`` by ``new``, which takes the formatting of the run that ``old`` starts in."""
    p = read(fragment)
    start, stop = locate(p, old)
    at, first = 0, True
    for t, _, holder in _nodes(p):
        value = t.text or ""
        lo, hi = max(start - at, 0), min(stop - at, len(value))
        if lo < hi:
            if t.tag == M + "t":
                raise Refused("the text is in an equation")
            if holder.tag == W + "hyperlink" and not allow_link:
                raise Refused("the text is in a link")
            _set(t, value[:lo] + (new if first else "") + value[hi:])
            first = False
        at += len(value)
    return write(p)


def insert_in_para(fragment: str, at: int, content: str) -> str:
    """``content`` at a visible offset, in the run that ends or goes on there."""
    p = read(fragment)
    nodes, seen = _nodes(p), 0
    for k, (t, _, _) in enumerate(nodes):
        n = len(t.text or "")
        if seen <= at <= seen + n and (at < seen + n or k == len(nodes) - 1 or at == seen + n):
            value = t.text or ""
            _set(t, value[: at - seen] + content + value[at - seen :])
            return write(p)
        seen += n
    raise Refused(f"the paragraph has {seen} characters")


def _split_run(run: ET.Element, holder: ET.Element, t: ET.Element, lo: int, hi: int) -> ET.Element:
    """Cut a run so that characters lo to hi of its text node are a run of their own, which is returned."""
    value, place = t.text or "", list(holder).index(run)
    pieces = [(value[:lo], False), (value[lo:hi], True), (value[hi:], False)]
    children = list(run)
    before, after = children[: children.index(t)], children[children.index(t) + 1 :]
    props = [c for c in before if c.tag == W + "rPr"]
    made, mine = [], None
    for k, (piece, wanted) in enumerate(pieces):
        new = ET.Element(run.tag, dict(run.attrib))
        new.extend(copy.deepcopy(x) for x in props)
        if k == 0:
            new.extend(c for c in before if c.tag != W + "rPr")
        if piece:
            node = ET.SubElement(new, t.tag, dict(t.attrib))
            _set(node, piece)
        if k == 2:
            new.extend(after)
        if any(c.tag != W + "rPr" for c in new):
            made.append(new)
            mine = new if wanted else mine
    holder[place : place + 1] = made
    return mine


def style_in_para(fragment: str, wanted: str, style: str) -> str:
    """Italic, bold, subscript or superscript on exactly this text."""
    tag, value = STYLES[style]
    p = read(fragment)
    start, stop = locate(p, wanted)
    at = 0
    for t, run, holder in _nodes(p):
        n = len(t.text or "")
        lo, hi = max(start - at, 0), min(stop - at, n)
        at += n
        if lo >= hi:
            continue
        if t.tag == M + "t":
            raise Refused("the text is in an equation")
        own = run if (lo, hi) == (0, n) and sum(c.tag == W + "t" for c in run) == 1 else _split_run(run, holder, t, lo, hi)
        props = own.find(W + "rPr")
        if props is None:
            props = ET.Element(W + "rPr")
            own.insert(0, props)
        for old in props.findall(W + tag):
            props.remove(old)
        props.append(ET.Element(W + tag, {} if value is None else {W + "val": value}))
        props[:] = sorted(props, key=lambda e: ORDER.index(e.tag.removeprefix(W)) if e.tag.removeprefix(W) in ORDER else len(ORDER))
    return write(p)


def split_para(fragment: str, before: str) -> tuple[str, str]:
    """The paragraph cut in two before this text; both keep its properties."""
    p = read(fragment)
    start, _ = locate(p, before)
    at = 0
    for t, run, holder in _nodes(p):
        n = len(t.text or "")
        if at <= start < at + n:
            if holder is not p:
                raise Refused("the cut is inside a link, change or equation")
            if start > at:
                run = _split_run(run, holder, t, start - at, n)
            k = list(p).index(run)
            second = ET.Element(p.tag, dict(p.attrib))
            props = p.find(W + "pPr")
            second.extend(([copy.deepcopy(props)] if props is not None else []) + list(p)[k:])
            del p[k:]
            return write(p), write(second)
        at += n
    raise Refused("the text isn't there")


def merge_paras(first: str, second: str, sep: str = " ") -> str:
    """Two paragraphs as one, with the first one's properties."""
    a, b = read(first), read(second)
    if sep:
        run = ET.SubElement(a, W + "r")
        _set(ET.SubElement(run, W + "t"), sep)
    a.extend(c for c in b if c.tag != W + "pPr")
    return write(a)


def remove_link(fragment: str, anchor: str) -> str:
    """The link to a place undone; its words stay, without the link's look."""
    p = read(fragment)
    hits = [(e, h) for e in p.iter() for h in e if h.tag == W + "hyperlink" and h.get(W + "anchor") == anchor]
    if not hits:
        raise Refused("there is no such link")
    for parent, h in hits:
        for style in [s for r in h.iter(W + "rPr") for s in [r] if (x := r.find(W + "rStyle")) is not None and x.get(W + "val") == "Hyperlink"]:
            style.remove(style.find(W + "rStyle"))
        k = list(parent).index(h)
        parent[k : k + 1] = list(h)
    return write(p)


@dataclass(frozen=True)
class Edit:
    """One edit of a batch: the paragraph that holds ``sign`` has ``old`` made ``new``."""

    name: str
    sign: str
    old: str
    new: str


def apply_batch(paragraphs: list[str], edits: list[Edit], edit: Callable = replace_in_para) -> tuple[list[str], list[tuple[str, bool, str]]]:
    """The paragraphs after all edits that can be made, each tried on what those before it left, and a verdict for each."""
    now, verdicts = list(paragraphs), []
    for e in edits:
        hits = [i for i, p in enumerate(now) if e.sign in text(p)]
        try:
            if len(hits) != 1:
                raise Refused("no paragraph has the sign" if not hits else f"{len(hits)} paragraphs have the sign")
            made = edit(now[hits[0]], e.old, e.new)
            if made == write(read(now[hits[0]])):
                raise Refused("the edit changes nothing")
            now[hits[0]] = made
            verdicts.append((e.name, True, ""))
        except Refused as why:
            verdicts.append((e.name, False, str(why)))
    return now, verdicts
