"""One document's citations, entries, marks and links: what to link, and what is wrong with what is linked.

These are plain functions over what one parse of a document gives, so that plans and audits of links
need no join: everything that decides about a document is in it.  Patterns read as the JVM's do, with
digits and white space of ASCII.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import regex

from vellum.functions import citations, markup, wiring, wordml
from vellum.functions.locating import caption_pattern
from vellum.functions.wordml import W

END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
SPACE = r"[ \t\n\x0b\f\r]"
ANY = r"[^\n\r\x85\u2028\u2029]"
WORD = r"[\p{L}\p{Nd}\p{Mn}_]"
LABELS = ("Figure", "Table", "Box", "Chart", "Map", "Scheme")
_HEAD = re.compile(citations.HEADINGS.replace(r"\s", SPACE).removesuffix("$") + END)
_ENTRY = regex.compile(rf"^({ANY}*?)\(?(?<!{WORD})([0-9]{{4}}[a-z]?)(?!{WORD})\)?{SPACE}*[.,]")
_ENTRY_HEAD = regex.compile(rf"^{ANY}*?\(?(?<!{WORD})[0-9]{{4}}[a-z]?(?!{WORD})\)?")
_KEYED = regex.compile(rf"^[A-Za-z\p{{L}}][\p{{L}}.]*?([0-9]{{4}})[a-z]?(?:_[0-9]+)?{END}")
_YEAR = re.compile(rf"([0-9]{{4}})[a-z]?(?:_[0-9]+)?{END}")
_EXHIBIT = re.compile(r"^(?:Table|Figure|Box|Chart|Map|Scheme|Eq)[A-Z]?[0-9]+")
_HINT = re.compile(r"[12][0-9]{3}")
_LEAD = re.compile(rf",|{SPACE}+(?:and|&){SPACE}+|{SPACE}+et{SPACE}+al")
_OWNER = re.compile(rf"['’]s{END}")
_NO_WORD = regex.compile(r"[^\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]+")
_NO_LETTER = regex.compile(r"[^\p{L}]")
_SAYS = regex.compile(r"[\p{L}\p{N}]")
_NUMBERED = re.compile(rf"_[0-9]+{END}")
_NAMES = r"[^()0-9]+?"
_YEARS = rf"[0-9]{{4}}[a-z]?(?:,{SPACE}*[0-9]{{4}}[a-z]?)*"
_BRACKETED = re.compile(rf"^\({_NAMES}{SPACE}+{_YEARS}\){END}")
_BARE = re.compile(rf"^{_NAMES}{SPACE}+{_YEARS}{END}")
_CAPTION = re.compile(caption_pattern(LABELS), re.ASCII)
_SHAPED = regex.compile(rf"^(?:{'|'.join(LABELS)})[A-Z]?[0-9]+[A-Za-z0-9_]*{END}")


def key_for(surname: str, year: str) -> str:
    return _NO_WORD.sub("", surname).lower() + "_" + year


def lead_surname(authors: str) -> str:
    return _OWNER.sub("", _LEAD.split(authors, 1)[0]).strip(" ")


def unbalanced(label: str) -> bool:
    depth = 0
    for c in label:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return True
    return depth > 0


class Document:
    """What a parse gives of one document; the rest is worked out where it is asked for."""

    def __init__(self, root: ET.Element) -> None:
        self.root = root
        self.spots = list(wiring.places(root))
        self.links = [s for s in self.spots if s["kind"] == "link"]
        self.all_marks = [s for s in self.spots if s["kind"] == "mark"]
        self.reached = {s["name"] for s in self.links}

    @cached_property
    def paras(self) -> list[tuple[str, str]]:
        """Text, and the same with what links show blotted out."""
        own: dict[int, list] = {}
        for s in self.links:
            own.setdefault(s["para"], []).append(s)
        out = []
        for pos, p in enumerate(self.root.iter(W + "p")):
            text, tags = wordml.text_of(p), [e.tag for e in p.iter()]
            if tags.count(W + "p") > 1 or any(c.tag in (W + "t", wordml.M + "t") for c in p):
                out.append((text, wiring.masked_text(p)))
                continue
            masked = text
            for s in own.get(pos, ()):
                masked = masked[: s["start"]] + "\0" * (s["stop"] - s["start"]) + masked[s["stop"] :]
            out.append((text, masked))
        return out

    @cached_property
    def head(self) -> int | None:
        return max((pos for pos, (text, _) in enumerate(self.paras) if _HEAD.match(text.strip(" "))), default=None)

    @cached_property
    def entries(self) -> list[dict]:
        out = []
        for pos, (text, _) in enumerate(self.paras) if self.head is not None else ():
            m = _ENTRY.match(text) if pos > self.head else None
            surname = m[1].split(",", 1)[0].strip(" ") if m else ""
            if surname:
                out.append({"pos": pos, "text": text, "surname": surname, "year": m[2], "key": key_for(surname, m[2])})
        return out

    def mentions(self, title_block: int = 5) -> list[dict]:
        """Citations in the body before the reference list, past the title block, in order."""
        body = self.paras if self.head is None else self.paras[: self.head]
        prose = next((pos for pos, (text, _) in enumerate(body) if len(text.strip(" ")) >= 100), title_block)
        out = []
        for pos, (text, masked) in enumerate(body):
            if pos < min(prose, title_block) or not _HINT.search(text):
                continue
            for c in citations.citations_in(text):
                out.append({"pos": pos, "start": c["start"], "stop": c["stop"], "key": key_for(lead_surname(c["authors"]), c["year"]), "cite": text[c["start"] : c["stop"]].strip(" "), "linked": "\0" in masked[c["start"] : c["stop"]]})
        return out

    @cached_property
    def works(self) -> list[dict]:
        """Entries with ``name``, their bookmark, and whether it is there."""
        own: dict[int, str] = {}
        for m in self.all_marks:
            if m["name"] is not None and _KEYED.match(m["name"]) and not _EXHIBIT.match(m["name"]):
                own[m["para"]] = min(own.get(m["para"], m["name"]), m["name"])
        listed = [e | {"own": own.get(e["pos"]), "made": _NO_LETTER.sub("", e["surname"]) + e["year"]} for e in self.entries]
        seen: Counter = Counter()
        for e in sorted(listed, key=lambda e: (e["own"] is None, e["pos"])):
            seen[e["made"]] += 1
            k = seen[e["made"]]
            e["name"], e["marked"] = e["own"] or (e["made"] if k == 1 else f"{e['made']}_{k}"), e["own"] is not None
        return listed

    @cached_property
    def captions(self) -> list[dict]:
        found = ((pos, text, _CAPTION.match(text)) for pos, (text, _) in enumerate(self.paras))
        return [{"pos": pos, "label": m[1], "number": m[2], "name": m[1] + re.sub(r"[.\-]", "_", m[2]), "text": text} for pos, text, m in found if m]

    def exhibit_mentions(self) -> list[dict]:
        """Each place that mentions a caption, captions themselves left out, in order within a paragraph."""
        from vellum.operators.linkage import mention_spans

        at = {c["pos"] for c in self.captions}
        out = []
        for pos, (text, masked) in enumerate(self.paras) if at else ():
            if pos not in at:
                hits = {(a, b, c["name"]) for c in self.captions for a, b in mention_spans(c["label"], c["number"], text)}
                out += [{"pos": pos, "start": a, "stop": b, "name": n, "linked": "\0" in masked[a:b]} for a, b, n in sorted(hits)]
        return out


def numbered(rows: list[dict], key: str) -> list[dict]:
    """Rows with ``k``, their number among those of one key."""
    seen: Counter = Counter()
    out = []
    for r in sorted(rows, key=lambda r: (r["pos"], r["start"])):
        seen[r[key]] += 1
        out.append(r | {"k": seen[r[key]]})
    return out


def link_plan(doc: Document, rest: bool = False) -> Iterator[dict]:
    times = Counter(w["key"] for w in doc.works)
    one = {w["key"]: w for w in doc.works if times[w["key"]] == 1}
    home = {(s["name"], s["para"]) for s in doc.links}
    for c in numbered(doc.mentions(), "key") if one else ():
        work = one.get(c["key"])
        if work is None:
            continue
        name, there = work["name"], work["name"] in doc.reached
        at = {"pos": c["pos"], "start": c["start"], "stop": c["stop"]}
        if c["k"] == 1 and not c["linked"] and not there:
            yield {"kind": "mention", "name": name + "txt", "anchor": name} | at
        if rest and not c["linked"] and (c["k"] > 1 or there):
            yield {"kind": "later", "name": None, "anchor": name} | at
        if c["k"] == 1 and (name + "txt", work["pos"]) not in home:
            m = _ENTRY_HEAD.match(work["text"])
            yield {"kind": "entry", "name": None if work["marked"] else name, "anchor": name + "txt", "pos": work["pos"], "start": 0, "stop": len(m[0]) if m else 0}


def exhibit_plan(doc: Document, more: bool = False) -> Iterator[dict]:
    marks = {m["name"] for m in doc.all_marks}
    linked = {(s["para"], s["name"]) for s in doc.links}
    free = set()
    for m in numbered(doc.exhibit_mentions(), "name"):
        at = {"pos": m["pos"], "start": m["start"], "stop": m["stop"]}
        if m["k"] == 1 and not m["linked"] and m["name"] + "txt" not in marks:
            free.add(m["name"])
            yield {"kind": "mention", "name": m["name"] + "txt", "anchor": m["name"]} | at
        if more and m["k"] > 1 and not m["linked"]:
            yield {"kind": "later", "name": None, "anchor": m["name"]} | at
    for c in doc.captions:
        if c["name"] in free and (c["pos"], c["name"] + "txt") not in linked:
            lead = len(c["text"]) - len(c["text"].lstrip(" \t\n\x0b\f\r"))
            yield {"kind": "entry", "name": c["name"], "anchor": c["name"] + "txt", "pos": c["pos"], "start": lead, "stop": lead + len(c["label"]) + 1 + len(c["number"])}


def exhibit_audit(doc: Document) -> Iterator[tuple[str, str]]:
    marks = {m["name"] for m in doc.all_marks}
    reached = {n for n in doc.reached if n is not None and _SHAPED.match(n)}
    for c in doc.captions:
        ends = [c["name"], c["name"] + "txt"]
        cap, txt = (e in marks for e in ends)
        yield ("linked" if all(e in reached for e in ends) else "unreached") if cap and txt else "caption-only" if cap else "mention-only" if txt else "unlinked", c["name"]
    for name in reached - marks:
        yield "dangling", name
    own = {c["pos"]: c["name"] for c in doc.captions}
    first: dict[str, int] = {}
    for m in doc.exhibit_mentions():
        first.setdefault(m["name"] + "txt", m["pos"])
    for m in doc.all_marks:
        if m["name"] is None:
            continue
        if m["para"] in own and _SHAPED.match(m["name"]) and not m["name"].endswith("txt") and m["name"] != own[m["para"]]:
            yield "misnamed", m["name"]
        if m["name"] in first and m["para"] > first[m["name"]]:
            yield "misplaced-anchor", m["name"]
    fields = {pos: any("SEQ" in f.instruction for f in markup.fields(p)) for pos, p in enumerate(doc.root.iter(W + "p")) if pos in own}
    series = {(c["label"], c["number"][0].isupper()) for c in doc.captions if fields[c["pos"]]}
    for c in doc.captions:
        if (c["label"], c["number"][0].isupper()) in series and not fields[c["pos"]]:
            yield "fieldless", c["name"]


def audit(doc: Document, later_mentions: bool = False) -> Iterator[tuple[str, str, int | None]]:
    """Finding, subject, paragraph: everything that is wrong with a document's citation links."""
    best: dict[str, dict] = {}
    for m in doc.all_marks:
        if m["name"] is not None and not m["name"].startswith("_"):
            old = best.get(m["name"])
            if old is None or (m["para"] < 0, m["para"]) < (old["para"] < 0, old["para"]):
                best[m["name"]] = m
    texts = [text for text, _ in doc.paras]
    cites = {n: m for n, m in best.items() if n.endswith("txt") and not _EXHIBIT.match(n)}
    refs = {n: m for n, m in best.items() if not n.endswith("txt") and not _EXHIBIT.match(n) and (doc.head is None or m["para"] < 0 or m["para"] > doc.head)}
    years = {e["year"][:4] for e in doc.entries}
    stale = {n for n in refs if years and _KEYED.match(n) and _YEAR.search(n)[1] not in years}
    live = {n: m for n, m in refs.items() if n not in stale}
    cited = {n[:-3] for n in cites} | doc.reached & refs.keys()
    yield from (("STALE BOOKMARK", n, refs[n]["para"]) for n in stale)
    for n, m in live.items():
        if n not in doc.reached:
            yield "ORPHAN REF" if n in cited else "REF WITHOUT CITE", n, m["para"]
    for n, m in cites.items():
        if n not in doc.reached:
            yield "NO BACK-LINK", n, m["para"]
        if n[:-3] not in refs:
            yield "MISSING REF", n, m["para"]
    yield from (("EMPTY LINK", x["anchor"], x["para"]) for x in markup.internal_links(doc.root) if x["dead"])
    forms = []
    for s in doc.links:
        if s["name"] not in best:
            yield "BROKEN LINK", s["name"], s["para"]
        else:
            if unbalanced(s["label"]):
                yield "UNBALANCED SPAN", s["name"], s["para"]
            shown = s["label"].strip(" ")
            forms.append((s, "bracketed" if _BRACKETED.match(shown) else "bare" if _BARE.match(shown) else None))
        if s["outer"] is not None:
            yield "SELF LINK" if s["outer"] == s["name"] else "DOUBLED LINK", s["name"], s["para"]
    count = Counter(f for _, f in forms)
    if count["bare"] > count["bracketed"]:
        yield from (("BRACKETED SPAN", s["name"], s["para"]) for s, f in forms if f == "bracketed")
    # a marker and the one link of its paragraph that it belongs to
    times = Counter((s["para"], s["name"]) for s in doc.links)
    lone = {(s["para"], s["name"] + "txt"): s for s in doc.links if times[s["para"], s["name"]] == 1}
    for n, m in cites.items():
        s = lone.get((m["para"], n))
        if s is not None and m["para"] >= 0:
            text = texts[m["para"]]
            gap = text[m["stop"] : s["start"]] if m["stop"] < s["start"] else text[s["stop"] : m["start"]] if m["start"] > s["stop"] else ""
            if _SAYS.search(gap):
                yield "MARKER OFF LINK", n, m["para"]
    # a marker in another work's entry
    keys = Counter(e["key"] for e in doc.entries)
    own: dict[str, list[int]] = {}
    for e in doc.entries:
        if keys[e["key"]] == 1:
            own.setdefault((_NO_LETTER.sub("", e["surname"]) + e["year"]).lower(), []).append(e["pos"])
    listed = {e["pos"] for e in doc.entries}
    for n, m in refs.items():
        yield from (("MISPLACED MARKER", n, m["para"]) for pos in own.get(_NUMBERED.sub("", n).lower(), ()) if m["para"] != pos and m["para"] in listed)
    earliest: dict[str, int] = {}
    for s in doc.links:
        earliest[s["name"]] = min(earliest.get(s["name"], s["para"]), s["para"])
    yield from (("LATE MARKER", n, m["para"]) for n, m in cites.items() if m["para"] >= 0 and earliest.get(n[:-3], m["para"]) < m["para"])
    # citations that nothing links
    linked = {w["key"] for w in doc.works if w["name"] in doc.reached}
    for c in doc.mentions():
        if not c["linked"] and c["key"] not in linked:
            yield "UNLINKED", c["cite"], c["pos"]
        elif not c["linked"] and later_mentions:
            yield "LATER-MENTION UNLINKED", c["cite"], c["pos"]
    yield from (("CITE WITHOUT REF", n, None) for n in cited - refs.keys())
    # entries that link nowhere home, where most do
    home = {(s["para"], s["name"][:-3]) for s in doc.links if len(s["name"]) > 3}
    back = [(n, m["para"], (m["para"], n) in home) for n, m in live.items() if n in cited]
    if sum(h for _, _, h in back) >= max(3, (len(back) + 1) // 2):
        yield from (("REF WITHOUT BACKLINK", n, para) for n, para, h in back if not h)
