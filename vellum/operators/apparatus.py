"""Notes, remarks, figures and styles: what a manuscript carries beside its text, as tables and edits of parts."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import markup, wordml
from vellum.functions.batched import batched
from vellum.functions.wordml import W, text_of
from vellum.operators import documents, gates

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
NOTES = "word/footnotes.xml"
STORE = "word/comments.xml"


def edit_part(parts: DataFrame, part: str, edit: Callable[[ET.Element], None]) -> DataFrame:
    """The parts with ``edit`` done to each tree of one part; what doesn't parse stays."""

    def apply(blob: bytes) -> bytes:
        root, _ = wordml.parse(blob)
        if root is None:
            return blob
        edit(root)
        return wordml.serialise(root)

    return documents.rewritten(parts, part, apply)


# notes


def _notes(root: ET.Element, reserved: bool = False) -> Iterator[ET.Element]:
    return (n for n in root if n.tag in (W + "footnote", W + "endnote") and (reserved or n.get(W + "type") in (None, "normal")))


def _note_rows(root: ET.Element) -> Iterator[dict]:
    carriers = [W + n for n in ("drawing", "pict", "object", "hyperlink", "fldChar", "bookmarkStart", "commentReference")]
    for k, n in enumerate(_notes(root)):
        shown = " ".join(text_of(n, deleted=True).split())
        yield {"id": n.get(W + "id"), "k": k, "text": shown, "empty": not shown and not any(e.tag in carriers or "}oMath" in str(e.tag) for e in n.iter())}


def notes(parts: DataFrame, part: str = NOTES) -> DataFrame:
    """``(doc, id, k, text, empty)`` of real notes in the order they are stored; one is empty with no text and nothing else that shows."""
    return documents.rows_of(parts, _note_rows, "id string, k int, text string, empty boolean", part=part)


def _references(root: ET.Element) -> Iterator[dict]:
    for k, e in enumerate(x for x in root.iter() if x.tag in (W + "footnoteReference", W + "endnoteReference")):
        yield {"kind": e.tag.removeprefix(W).removesuffix("Reference"), "id": e.get(W + "id"), "at": k}


def note_references(parts: DataFrame, kind: str = "footnote") -> DataFrame:
    """``(doc, id, at)`` of references in order."""
    return documents.rows_of(parts, _references, "kind string, id string, at int").where(F.col("kind") == kind).drop("kind")


def notes_in_place(parts: DataFrame) -> DataFrame:
    """``(doc, id, text, at)`` of real notes and each of their references, in one pass over a package."""

    def read(blobs: dict[str, bytes]) -> Iterator[dict]:
        body, store = wordml.parse(blobs.get(documents.DOCUMENT, b""))[0], wordml.parse(blobs.get(NOTES, b""))[0]
        if body is None or store is None:
            return
        places: dict[str, list[int]] = {}
        for r in _references(body):
            if r["kind"] == "footnote":
                places.setdefault(r["id"], []).append(r["at"])
        for n in _note_rows(store):
            for at in places.get(n["id"], ()) if n["id"] is not None else ():
                yield {"id": n["id"], "text": n["text"], "at": at}

    return documents.rows_of_whole(parts, read, "id string, text string, at int")


def footnote_order(parts: DataFrame) -> DataFrame:
    """``(doc, k, referred, stored)``: place by place the note referred to there, and the one stored there."""
    first = note_references(parts).groupBy("doc", "id").agg(F.min("at").alias("_at"))
    referred = first.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("_at")) - 1).select("doc", "k", F.col("id").alias("referred"))
    known = notes(parts).join(first.select("doc", "id"), ["doc", "id"], "left_semi")
    stored = known.withColumn("_k", F.row_number().over(Window.partitionBy("doc").orderBy("k")) - 1).select("doc", F.col("_k").alias("k"), F.col("id").alias("stored"))
    return referred.join(stored, ["doc", "k"], "full_outer")


def out_of_order(parts: DataFrame) -> DataFrame:
    """``(doc, id)`` of notes whose definition isn't where their first reference is; documents that define one twice are left out."""
    twice = notes(parts).groupBy("doc", "id").count().where("count > 1").select("doc").distinct()
    return footnote_order(parts).where("referred <> stored").select("doc", F.col("referred").alias("id")).join(twice, "doc", "left_anti")


def orphans(parts: DataFrame) -> DataFrame:
    """``(doc, id, text, empty)`` of notes that nothing refers to."""
    return notes(parts).join(note_references(parts).select("doc", "id"), ["doc", "id"], "left_anti").select("doc", "id", "text", "empty")


def prune_orphans(parts: DataFrame) -> DataFrame:
    """The parts without empty notes that nothing refers to."""
    gone = orphans(parts).where("empty").groupBy(F.col("doc").alias("_d")).agg(F.collect_set("id").alias("_gone"))

    def drop(blob: bytes, ids: list[str]) -> bytes:
        root, _ = wordml.parse(bytes(blob))
        if root is None:
            return bytes(blob)
        for n in [n for n in _notes(root) if n.get(W + "id") in set(ids)]:
            root.remove(n)
        return wordml.serialise(root)

    joined = parts.join(gone, F.col("doc") == F.col("_d"), "left")
    hit = (F.col("part") == NOTES) & F.col("_gone").isNotNull()
    return joined.withColumn("blob", F.when(hit, batched(drop, "binary")(F.when(hit, F.col("blob")), F.coalesce("_gone", F.array().cast("array<string>")))).otherwise(F.col("blob"))).drop("_d", "_gone")


def renumber_notes(parts: DataFrame) -> DataFrame:
    """``(doc, old, new)``: note ids that change when they are numbered in the order of their first reference, from 1."""
    first = note_references(parts).groupBy("doc", "id").agg(F.min("at").alias("_at"))
    numbered = first.withColumn("new", F.row_number().over(Window.partitionBy("doc").orderBy("_at")).cast("string"))
    return numbered.where("id <> new").select("doc", F.col("id").alias("old"), "new")


def remap_notes(parts: DataFrame, mapping: DataFrame) -> DataFrame:
    """The parts with note ids ``(doc, old, new)`` changed, in references and definitions at once."""
    maps = mapping.groupBy(F.col("doc").alias("_d")).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_map"))

    def apply(blob: bytes, pairs: list) -> bytes:
        root, _ = wordml.parse(bytes(blob))
        if root is None:
            return bytes(blob)
        new = dict(pairs.items()) if hasattr(pairs, "items") else dict(pairs)
        for e in root.iter():
            if e.tag == W + "footnoteReference" or e.tag == W + "footnote" and e.get(W + "type") in (None, "normal"):
                e.set(W + "id", new.get(e.get(W + "id"), e.get(W + "id")))
        return wordml.serialise(root)

    joined = parts.join(maps, F.col("doc") == F.col("_d"), "left")
    hit = F.col("part").isin(documents.DOCUMENT, NOTES) & F.col("_map").isNotNull()
    entries = F.when(hit, F.map_entries("_map"))
    made = batched(lambda b, m: apply(b, [(x["key"], x["value"]) for x in m]), "binary")(F.when(hit, F.col("blob")), entries)
    return joined.withColumn("blob", F.when(hit, made).otherwise(F.col("blob"))).drop("_d", "_map")


def renumber_map(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(doc, source, target)``: the id of a note in one package and of the same note, by its text, in another; only where that is clear."""
    one = lambda parts, name: notes(parts).groupBy("doc", "text").agg(F.min("id").alias(name), F.count("*").alias("n")).where("n = 1 AND text <> ''").drop("n")
    return one(source, "source").join(one(target, "target"), ["doc", "text"]).select("doc", "source", "target")


def add_note(parts: DataFrame, sign: str, text: str) -> DataFrame:
    """The parts with a note and its reference behind ``sign``, which one paragraph of a document has to say once; others stay."""
    from vellum.functions.editing import _nodes, _split_run

    def both(blobs: dict[str, bytes]) -> dict[str, bytes]:
        body, store = wordml.parse(blobs.get(documents.DOCUMENT, b""))[0], wordml.parse(blobs.get(NOTES, b""))[0]
        if body is None or store is None:
            return {}
        hits = [p for p in body.iter(W + "p") if text_of(p).count(sign)]
        if len(hits) != 1 or text_of(hits[0]).count(sign) != 1:
            return {}
        number = str(max([int(n.get(W + "id")) for n in store if (n.get(W + "id") or "").lstrip("-").isdigit()] + [0]) + 1)
        stop, at = text_of(hits[0]).index(sign) + len(sign), 0
        for t, run, holder in list(_nodes(hits[0])):
            n = len(t.text or "")
            if at < stop <= at + n:
                if stop < at + n:
                    run = _split_run(run, holder, t, 0, stop - at)
                ref = ET.Element(W + "r")
                ET.SubElement(ET.SubElement(ref, W + "rPr"), W + "vertAlign", {W + "val": "superscript"})
                ET.SubElement(ref, W + "footnoteReference", {W + "id": number})
                holder.insert(list(holder).index(run) + 1, ref)
                break
            at += n
        note = ET.SubElement(store, W + "footnote", {W + "id": number})
        ET.SubElement(ET.SubElement(ET.SubElement(note, W + "p"), W + "r"), W + "t").text = text
        return {documents.DOCUMENT: wordml.serialise(body), NOTES: wordml.serialise(store)}

    return documents.repackaged(parts, both)


def append_to_note(parts: DataFrame, contains: str, text: str) -> DataFrame:
    """The parts with text put at the end of the one note that says something; a document where none or several do stays."""

    def edit(root: ET.Element) -> None:
        hits = [n for n in _notes(root) if contains in text_of(n)]
        if len(hits) == 1 and (paras := [p for p in hits[0] if p.tag == W + "p"]):
            t = ET.SubElement(ET.SubElement(paras[-1], W + "r"), W + "t", {wordml.XML_SPACE: "preserve"})
            t.text = text

    return edit_part(parts, NOTES, edit)


def set_note_font(parts: DataFrame, name: str, size: float) -> DataFrame:
    """The parts with one face and size on every run of real notes, in force and nowhere else."""

    def edit(root: ET.Element) -> None:
        for n in _notes(root):
            for r in n.iter(W + "r"):
                props = markup.own_properties(r, "rPr")
                if props is None:
                    props = ET.Element(W + "rPr")
                    r.insert(0, props)
                markup._place(props, ET.Element(W + "rFonts", {W + k: name for k in ("ascii", "hAnsi", "eastAsia", "cs")}), markup.RUN_ORDER)
                for tag in ("sz", "szCs"):
                    markup._place(props, ET.Element(W + tag, {W + "val": str(round(size * 2))}), markup.RUN_ORDER)

    return edit_part(parts, NOTES, edit)


def _faces(root: ET.Element) -> Iterator[dict]:
    for n in _notes(root):
        for r in n.iter(W + "r"):
            props = markup.own_properties(r, "rPr")
            font, size = markup.own_child(props, "rFonts"), markup.own_child(props, "sz")
            if font is not None or size is not None:
                yield {"id": n.get(W + "id"), "face": None if font is None else font.get(W + "ascii"), "half_points": None if size is None else int(size.get(W + "val") or 0), "shows": bool(text_of(r).strip())}


def note_fonts(parts: DataFrame) -> DataFrame:
    """``(doc, face, half_points, runs)``: what runs of notes state."""
    return documents.rows_of(parts, _faces, "id string, face string, half_points int, shows boolean", part=NOTES).groupBy("doc", "face", "half_points").agg(F.count("*").alias("runs"))


def note_sizes(parts: DataFrame) -> DataFrame:
    """``(doc, id, half_points, house)`` of notes whose stated size isn't that of most notes of their document."""
    stated = documents.rows_of(parts, _faces, "id string, face string, half_points int, shows boolean", part=NOTES).where("shows AND half_points IS NOT NULL").select("doc", "id", "half_points").distinct()
    alone = stated.withColumn("_n", F.count("*").over(Window.partitionBy("doc", "id")))
    house = alone.where("_n = 1").groupBy("doc", "half_points").agg(F.count("*").alias("_k")).groupBy("doc").agg(F.max_by("half_points", F.struct("_k", -F.col("half_points"))).alias("house"))
    return stated.join(house, "doc").where("half_points <> house")


# remarks


def _remarks(root: ET.Element) -> Iterator[dict]:
    for k, c in enumerate(root.iter(W + "comment")):
        paras = [p.get(W14 + "paraId") for p in c.iter(W + "p")]
        yield {"id": c.get(W + "id"), "k": k, "author": c.get(W + "author"), "date": c.get(W + "date"), "text": "\n".join(text_of(p) for p in c.iter(W + "p")), "para_id": paras[-1] if paras else None}


def _extended(root: ET.Element) -> Iterator[dict]:
    for e in root:
        own = {k.rpartition("}")[2]: v for k, v in e.attrib.items()}
        if "paraId" in own:
            yield {"para_id": own["paraId"], "parent_id": own.get("paraIdParent"), "done": own.get("done") == "1"}


REMARKS = "id string, k int, author string, date string, text string, para_id string"


def remarks(parts: DataFrame) -> DataFrame:
    """``(doc, id, k, author, date, text, para_id, parent, done, anchor)``: comments, what they answer, and the paragraph they stand at."""
    own = documents.rows_of(parts, _remarks, REMARKS, part=STORE)
    more = documents.rows_of(parts, _extended, "para_id string, parent_id string, done boolean", part="word/commentsExtended.xml")
    ids = own.select("doc", F.col("para_id").alias("parent_id"), F.col("id").alias("parent"))
    joined = own.join(documents.large(more), ["doc", "para_id"], "left").join(documents.large(ids), ["doc", "parent_id"], "left")

    def at(root: ET.Element) -> Iterator[dict]:
        for pos, p in enumerate(root.iter(W + "p")):
            for e in p.iter():
                if e.tag in (W + "commentRangeStart", W + "commentReference"):
                    yield {"id": e.get(W + "id"), "anchor": pos}

    anchors = documents.rows_of(parts, at, "id string, anchor int").groupBy("doc", "id").agg(F.min("anchor").alias("anchor"))
    return joined.join(documents.large(anchors), ["doc", "id"], "left").select("doc", "id", "k", "author", "date", "text", "para_id", "parent", F.coalesce("done", F.lit(False)).alias("done"), "anchor")


def remarks_stored(parts: DataFrame) -> DataFrame:
    """The columns of :func:`remarks` that the comments' own part has, a row for each of them; no other part is read."""
    return documents.rows_of(parts, _remarks, REMARKS, part=STORE, once=True)


def threads(parts: DataFrame) -> DataFrame:
    """``(doc, id, author, text, done, anchor, replies)``: each thread by its root, its replies by date."""
    said = remarks(parts)
    roots = said.where("parent IS NULL").select("doc", "id", "author", "text", "done", "anchor")
    answers = said.where("parent IS NOT NULL").groupBy("doc", F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(F.struct("date", F.col("k").alias("k"), "author", "text"))).alias("replies"))
    return roots.join(answers, ["doc", "id"], "left").withColumn("replies", F.coalesce(F.transform("replies", lambda r: F.struct(r["author"].alias("author"), r["text"].alias("text"))), F.array().cast("array<struct<author:string,text:string>>")))


def set_done(parts: DataFrame, ids: set[str], done: bool = True) -> DataFrame:
    """The parts with comments marked as done, or open again."""
    own = documents.rows_of(parts, _remarks, "id string, para_id string", part="word/comments.xml").where(F.col("id").isin(*ids)).groupBy(F.col("doc").alias("_d")).agg(F.collect_set("para_id").alias("_paras"))
    joined = parts.join(documents.large(own), F.col("doc") == F.col("_d"), "left")

    def mark(blob: bytes, paras: list[str]) -> bytes:
        root, _ = wordml.parse(bytes(blob))
        if root is None:
            return bytes(blob)
        for e in root:
            keys = {k.rpartition("}")[2]: k for k in e.attrib}
            if e.get(keys.get("paraId", "")) in set(paras):
                e.set(keys.get("done", keys["paraId"].rpartition("}")[0] + "}done"), "1" if done else "0")
        return wordml.serialise(root)

    hit = (F.col("part") == "word/commentsExtended.xml") & F.col("_paras").isNotNull()
    return joined.withColumn("blob", F.when(hit, batched(mark, "binary")(F.when(hit, F.col("blob")), F.coalesce("_paras", F.array().cast("array<string>")))).otherwise(F.col("blob"))).drop("_d", "_paras")


_MARK = re.compile(rb"<w:comment(|RangeStart|RangeEnd|Reference)(?=[\s/>])(" + wordml.SAID + rb")>")
_ATTRIBUTE = re.compile(rb"""\s([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_SHUT = re.compile(rb"</w:comment\s*>")
_PROPS = rb"<w:rPr(?=[\s/>])" + wordml.SAID + rb"(?:/>|(?<!/)>(?:(?!</?w:rPr[\s/>])[\s\S])*</w:rPr\s*>)"
#: A run that shows nothing, with what stands behind it.
_BARE = re.compile(rb"<w:r(?=[\s/>])" + wordml.SAID + rb"(?:/>|(?<!/)>[^<]*(?:" + _PROPS + rb"[^<]*)*</w:r\s*>)[^<]*")
_NESTED = re.compile(rb"<w:rPr(?=[\s>])" + wordml.SAID + rb"(?<!/)>(?:(?!</w:rPr[\s>])[\s\S])*?<w:rPr[\s/>]")


def _cut(blob: bytes, ids: set[str]) -> bytes | None:
    """What :func:`_pruned` makes, from the bytes alone, which stay otherwise; None where that takes a tree."""
    if not wordml.plain(blob):
        return None
    out, at = [], 0
    for m in _MARK.finditer(blob):
        if m.start() < at:
            if not m[1]:
                return None
            continue
        name = next((a or b for k, a, b in _ATTRIBUTE.findall(m[2]) if k == b"w:id"), None)
        if name is None or b"&" not in name and name.decode() not in ids:
            continue
        end = m if m[2].endswith(b"/") else None if m[1] else _SHUT.search(blob, m.end())
        if b"&" in name or end is None:
            return None
        out.append(blob[at : m.start()])
        at = blob.index(b"<", end.end())
    made = b"".join([*out, blob[at:]])
    return None if _NESTED.search(made) else _BARE.sub(b"", made)


def _pruned(root: ET.Element, ids: set[str]) -> None:
    tags = {W + n for n in ("comment", "commentRangeStart", "commentRangeEnd", "commentReference")}
    for parent in list(root.iter()):
        for c in list(parent):
            if c.tag in tags and c.get(W + "id") in ids:
                parent.remove(c)
    for parent in list(root.iter()):
        for r in [r for r in parent if r.tag == W + "r" and not any(c.tag != W + "rPr" for c in r)]:
            parent.remove(r)


def remove_remarks(parts: DataFrame, ids: set[str]) -> DataFrame:
    """The parts without comments of these ids, their ranges and references; packages that come whole are changed in one pass."""

    def change(blob: bytes) -> bytes:
        made = _cut(blob, ids)
        if made is not None:
            return made
        root, _ = wordml.parse(blob)
        if root is None:
            return blob
        _pruned(root, ids)
        return wordml.serialise(root)

    if "rows" not in parts.columns:
        return documents.rewritten(documents.rewritten(parts, STORE, change), documents.DOCUMENT, change)
    changes = {STORE: documents.Once(change), documents.DOCUMENT: change}
    return documents.repackaged(parts, lambda blobs: {p: c(blobs[p]) for p, c in changes.items() if p in blobs})


def match(contexts: DataFrame, rules: DataFrame, scopes: tuple[str, ...] = ("text", "paragraph", "haystack")) -> DataFrame:
    """``contexts`` (with a row ``id`` and a column a scope) with ``comment``: that of the first rule ``(rank, needle, comment)`` in the narrowest scope that has one.

    Rules are few; their size is checked before they are sent out.
    """
    from vellum.functions.text import normalize_glyphs

    size = rules.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    wanted = F.broadcast(rules) if size <= 8 << 20 else rules
    best = None
    for k, scope in enumerate(scopes):
        hits = contexts.select("id", normalize_glyphs(F.col(scope)).alias("_s")).join(wanted, F.contains(F.col("_s"), normalize_glyphs(F.col("needle")))).select("id", F.struct(F.lit(k).alias("scope"), "rank", "comment").alias("hit"))
        best = hits if best is None else best.unionByName(hits)
    chosen = best.groupBy("id").agg(F.min("hit").alias("hit")).select("id", F.col("hit.comment").alias("comment"))
    return contexts.join(chosen, "id", "left")


# figures


def _figures(root: ET.Element) -> Iterator[dict]:
    """Body paragraphs that hold a caption of a figure or drawings, in order."""
    caption = re.compile(r"^\s*(?:Figure|Fig\.|Рисунок)\s+([A-Z]?\d+(?:[.\-]\d+)*[A-Za-z]?)\s*[.:—–|-]")
    for pos, p in enumerate(root.iter(W + "p")):
        m = caption.match(text_of(p))
        drawings = []
        for d in p.iter(W + "drawing"):
            props, blip, extent = d.find(f".//{WP}docPr"), d.find(f".//{A}blip"), d.find(f".//{WP}extent")
            drawings.append({
                "rid": None if blip is None else blip.get(R + "embed"), "alt": None if props is None else props.get("descr"),
                "cx": None if extent is None else int(extent.get("cx") or 0), "cy": None if extent is None else int(extent.get("cy") or 0),
            })
        if m or drawings:
            yield {"pos": pos, "number": m[1] if m else None, "text": text_of(p), "drawings": drawings}


def _side(rows: list[dict]) -> str:
    """Whether drawings stand above or below most captions; below on a tie."""
    drawn = {r["pos"] for r in rows if r["drawings"]}
    up = down = 0
    for r in rows:
        if r["number"] is not None:
            above, below = r["pos"] - 1 in drawn, r["pos"] + 1 in drawn
            up, down = up + (above and not below), down + (below and not above)
    return "above" if up > down else "below"


def _placed(root: ET.Element) -> Iterator[dict]:
    """Drawings with the caption that is theirs: the last up to them, or the next where drawings stand above."""
    rows = list(_figures(root))
    above = any(r["number"] is not None for r in rows) and _side(rows) == "above"
    own, owned = None, []
    for r in reversed(rows) if above else rows:
        own = r if r["number"] is not None else own
        owned.append((r, own))
    for r, own in reversed(owned) if above else owned:
        for k, d in enumerate(r["drawings"]):
            yield {"number": own and own["number"], "caption": own and own["text"], "pos": r["pos"], "k": k, **d}


def figures(parts: DataFrame) -> DataFrame:
    """``(doc, number, caption, pos, k, rid, alt, cx, cy)``: drawings with the caption before them, or after in documents that keep them so."""
    return documents.rows_of(parts, _placed, "number string, caption string, pos int, k int, rid string, alt string, cx int, cy int")


def caption_side(parts: DataFrame) -> DataFrame:
    """``(doc, side)``: whether drawings stand above or below most captions; below on a tie."""

    def read(root: ET.Element) -> Iterator[dict]:
        rows = list(_figures(root))
        if any(r["number"] is not None for r in rows):
            yield {"side": _side(rows)}

    return documents.rows_of(parts, read, "side string")


def shared_relationships(parts: DataFrame) -> DataFrame:
    """``(doc, rid, drawings)``: how many drawings use a picture."""
    return figures(parts).where("rid IS NOT NULL").groupBy("doc", "rid").agg(F.count("*").alias("drawings"))


def alt_texts(parts: DataFrame) -> DataFrame:
    """``(doc, number, k, alt, missing)``: every drawing's description."""
    return figures(parts).select("doc", "number", "k", "alt", (F.trim(F.coalesce("alt", F.lit(""))) == "").alias("missing"))


def set_alt_text(parts: DataFrame, number: str, text: str, k: int = 0) -> DataFrame:
    """The parts with a description on the k-th drawing behind a figure's caption."""

    def edit(root: ET.Element) -> None:
        rows = list(_figures(root))
        paras = list(root.iter(W + "p"))
        now = None
        for r in rows:
            now = r["number"] or now
            if now == number and len(r["drawings"]) > k:
                props = list(paras[r["pos"]].iter(W + "drawing"))[k].find(f".//{WP}docPr")
                if props is not None:
                    props.set("descr", text)
                return

    return edit_part(parts, documents.DOCUMENT, edit)


def set_extent(block: Column, cx: Column, cy: Column) -> Column:
    """A drawing's size, in the units of the format (914,400 an inch), wherever it is said."""
    for tag in ("wp:extent", "a:ext"):
        block = F.regexp_replace(block, F.lit(rf'(<{tag}\b[^>]*?)\bcx="\d+"([^>]*?)\bcy="\d+"'), F.concat(F.lit('$1cx="'), cx.cast("string"), F.lit('"$2cy="'), cy.cast("string"), F.lit('"')))
    return block


def scale_to_width(block: Column, width: Column, height: Column, inches: Column) -> Column:
    """A drawing as wide as wanted, its height by the picture's own width and height."""
    cx = F.round(inches * 914400).cast("long")
    return set_extent(block, cx, F.round(cx * height / width).cast("long"))


def section_properties(xml: Column) -> Column:
    """The document's last section properties."""
    return F.element_at(F.regexp_extract_all(xml, F.lit(r"(?s)<w:sectPr\b(?:[^>]*/>|.*?</w:sectPr>)"), F.lit(0)), -1)


def landscape(section: Column) -> Column:
    """Section properties turned on their side."""
    w, h = F.regexp_extract(section, r'<w:pgSz\b[^>]*\bw:w="(\d+)"', 1).cast("int"), F.regexp_extract(section, r'<w:pgSz\b[^>]*\bw:h="(\d+)"', 1).cast("int")
    page = F.concat(F.lit('<w:pgSz w:w="'), F.greatest(w, h).cast("string"), F.lit('" w:h="'), F.least(w, h).cast("string"), F.lit('" w:orient="landscape"/>'))
    return F.regexp_replace(section, F.lit(r"<w:pgSz\b[^>]*/>"), page)


# styles


def _style_rows(root: ET.Element) -> Iterator[dict]:
    for kind, path in (("run", "rPrDefault/rPr"), ("paragraph", "pPrDefault/pPr")):
        holder = root.find(f"{W}docDefaults/" + "/".join(W + x for x in path.split("/")))
        for p in holder if holder is not None else ():
            for k, v in (p.attrib or {W + "val": "true"}).items():
                yield {"style": None, "type": "defaults", "based_on": None, "standard": False, "kind": kind, "property": p.tag.removeprefix(W), "attribute": k.removeprefix(W), "value": v}
    for s in root.iter(W + "style"):
        base = s.find(W + "basedOn")
        own = {"style": s.get(W + "styleId"), "type": s.get(W + "type"), "based_on": None if base is None else base.get(W + "val"), "standard": s.get(W + "default") in ("1", "true")}
        yield own | {"kind": None, "property": None, "attribute": None, "value": None}
        for kind, tag in (("run", "rPr"), ("paragraph", "pPr")):
            for p in s.find(W + tag) if s.find(W + tag) is not None else ():
                for k, v in (p.attrib or {W + "val": "true"}).items():
                    yield own | {"kind": kind, "property": p.tag.removeprefix(W), "attribute": k.removeprefix(W), "value": v}


STYLE_ROWS = "style string, type string, based_on string, standard boolean, kind string, property string, attribute string, value string"


def style_table(parts: DataFrame) -> DataFrame:
    return documents.rows_of(parts, _style_rows, STYLE_ROWS, part="word/styles.xml")


def cascade(parts: DataFrame, property_: str, attribute: str = "val", kind: str = "run") -> DataFrame:
    """``(doc, style, type, standard, value, source)``: what each style gives for a property, from itself, what it is based on, or the defaults."""
    from vellum.operators import tables

    rows = documents.held(style_table(parts))
    said = F.max(F.when((F.col("property") == property_) & (F.col("attribute") == attribute) & (F.col("kind") == kind), F.col("value")))
    own = rows.where("style IS NOT NULL").groupBy("doc", "style", "type", "standard", "based_on").agg(said.alias("value"))
    key = lambda c: F.concat_ws("\u0001", "doc", c)
    chain = own.select(key("style").alias("k"), F.when(F.col("based_on").isNotNull(), key("based_on")).alias("up"), F.when(F.col("value").isNotNull(), F.struct("style", "value")).alias("v"))
    got = tables.inherit(chain, "k", "up", "v")
    default = rows.where((F.col("type") == "defaults") & (F.col("property") == property_) & (F.col("attribute") == attribute) & (F.col("kind") == kind)).groupBy(F.col("doc").alias("_d")).agg(F.max("value").alias("_default"))
    told = own.select("doc", "style", "type", "standard", key("style").alias("k")).join(got, "k").join(default, F.col("doc") == F.col("_d"), "left")
    source = F.when(F.col("v").isNull(), F.when(F.col("_default").isNotNull(), "defaults")).otherwise(F.concat(F.lit("style "), F.col("v.style")))
    return told.select("doc", "style", "type", "standard", F.coalesce(F.col("v.value"), "_default").alias("value"), source.alias("source"))


def style_sizes(styles: ET.Element | None) -> Callable[[str | None, str | None], str | None]:
    """The size that :func:`resolve_runs` gives a run that says none, by its own and its paragraph's style."""
    own: dict[str, dict[str, tuple]] = {"character": {}, "paragraph": {}}
    rows: dict[str, tuple] = {}
    default, standard = None, []
    for r in _style_rows(styles) if styles is not None else ():
        said = r["value"] if (r["property"], r["attribute"], r["kind"]) == ("sz", "val", "run") else None
        if r["type"] == "defaults":
            default = max((v for v in (default, said) if v is not None), default=None)
        if r["style"] is None:
            continue
        was = rows.get(r["style"])
        rows[r["style"]] = (r["based_on"], max((v for v in (was and was[1], said) if v is not None), default=None))
        own.setdefault(r["type"], {})[r["style"]] = ()
        if r["type"] == "paragraph" and r["standard"]:
            standard.append(r["style"])

    def given(kind: str, style: str | None) -> str | None:
        seen = set()
        if style not in own[kind]:
            return None
        while style in rows and style not in seen:
            seen.add(style)
            style, value = rows[style]
            if value is not None:
                return value
        return None

    def size(rstyle: str | None, pstyle: str | None) -> str | None:
        return given("character", rstyle) or given("paragraph", pstyle or min(standard, default=None)) or default

    return size


def _run_rows(root: ET.Element) -> Iterator[dict]:
    for pos, p in enumerate(root.iter(W + "p")):
        style = p.find(f"{W}pPr/{W}pStyle")
        for k, r in enumerate(p.iter(W + "r")):
            props = markup.own_properties(r, "rPr")
            named = markup.own_child(props, "rStyle")
            direct = {c.tag.removeprefix(W): c.get(W + "val", c.get(W + "ascii", "true")) for c in markup.live_children(props)}
            yield {"pos": pos, "k": k, "text": text_of(r), "pstyle": None if style is None else style.get(W + "val"), "rstyle": None if named is None else named.get(W + "val"), "direct": list(direct.items())}


def resolve_runs(parts: DataFrame, property_: str, attribute: str = "val") -> DataFrame:
    """``(doc, pos, k, text, value, source)``: what a property comes to for each run.

    The run's own word first, then its character style's, then its paragraph's style's (the standard one
    if it names none), then the defaults'.
    """
    def read(root: ET.Element) -> Iterator[dict]:
        for r in _run_rows(root):
            yield r | {"direct": dict(r["direct"]).get(property_)}

    runs = documents.rows_of(parts, read, "pos int, k int, text string, pstyle string, rstyle string, direct string")
    styles = documents.held(cascade(parts, property_, attribute))
    side = lambda where, name: styles.where(where).select(F.col("doc").alias(f"_{name}d"), F.col("style").alias(f"_{name}"), F.when(F.col("source") != "defaults", F.col("value")).alias(f"_{name}v"), F.col("source").alias(f"_{name}s"))
    joined = runs.join(side("type = 'character'", "c"), (F.col("doc") == F.col("_cd")) & (F.col("rstyle") == F.col("_c")), "left")
    standard = styles.where("type = 'paragraph' AND standard").groupBy(F.col("doc").alias("_sd")).agg(F.min("style").alias("_standard"))
    joined = joined.join(standard, F.col("doc") == F.col("_sd"), "left").withColumn("_named", F.coalesce("pstyle", "_standard"))
    joined = joined.join(side("type = 'paragraph'", "pstyle"), (F.col("doc") == F.col("_pstyled")) & (F.col("_named") == F.col("_pstyle")), "left")
    default = styles.where("source = 'defaults'").groupBy(F.col("doc").alias("_dd")).agg(F.max("value").alias("_default"))
    joined = joined.join(default, F.col("doc") == F.col("_dd"), "left")
    source = F.when(F.col("direct").isNotNull(), "").when(F.col("_cv").isNotNull(), F.col("_cs")).when(F.col("_pstylev").isNotNull(), F.col("_pstyles")).when(F.col("_default").isNotNull(), "defaults")
    return joined.select("doc", "pos", "k", "text", F.coalesce("direct", "_cv", "_pstylev", "_default").alias("value"), source.alias("source"))


def toggled(value: Column) -> Column:
    """Whether a property of on and off is on: there, and not switched off."""
    return value.isNotNull() & ~F.lower(value).isin("0", "false", "off", "none")


def raised_prose(parts: DataFrame) -> DataFrame:
    """``(doc, pos, text, source)`` of words that stand raised because their character style says so, notes' marks aside."""
    return resolve_runs(parts, "vertAlign").where("value = 'superscript' AND source LIKE 'style %' AND trim(text) <> ''").select("doc", "pos", "text", "source")


def ensure_style(parts: DataFrame, style_id: str, style_xml: str) -> DataFrame:
    """The parts with a style put in unless there is one of its id."""
    xml = F.col("blob").cast("string")
    lacks = (F.col("part") == "word/styles.xml") & ~xml.rlike(rf'\bw:styleId="{re.escape(style_id)}"')
    return parts.withColumn("blob", F.when(lacks, markup.append_before_close(xml, "w:styles", F.lit(style_xml)).cast("binary")).otherwise(F.col("blob")))


def apply_template(parts: DataFrame, template: bytes, remap: dict[str, str] | None = None) -> DataFrame:
    """The parts with a template's styles, and the styles in use called by its names."""
    swapped = parts.withColumn("blob", F.when(F.col("part") == "word/styles.xml", F.lit(template)).otherwise(F.col("blob")))
    for old, new in (remap or {}).items():
        xml = F.col("blob").cast("string")
        named = F.regexp_replace(xml, rf'(<w:(?:pStyle|rStyle|tblStyle)\b[^>]*\bw:val="){re.escape(old)}(")', f"$1{new}$2")
        swapped = swapped.withColumn("blob", F.when(F.col("part").isin(*gates.TEXT_PARTS), named.cast("binary")).otherwise(F.col("blob")))
    return swapped


def styles_in_use(parts: DataFrame) -> DataFrame:
    """``(doc, style)`` that the text parts name, for paragraphs, runs or tables."""
    found = F.regexp_extract_all("xml", F.lit(r'<w:(?:pStyle|rStyle|tblStyle)\b[^>]*\bw:val="([^"]*)"'), F.lit(1))
    return gates.xml_of(parts).select("doc", F.explode(found).alias("style")).distinct()


def dangling_styles(parts: DataFrame) -> DataFrame:
    """``(doc, style)`` in use that no definition has."""
    known = style_table(parts).select("doc", "style").distinct()
    return styles_in_use(parts).join(known, ["doc", "style"], "left_anti")


