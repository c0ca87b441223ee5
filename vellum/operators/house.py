"""House style as data: faces and spaces that kinds of paragraphs are to have, what departs from them, and what sets them."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import markup, wordml
from vellum.functions.text import smarten
from vellum.functions.wordml import M, W, text_of
from vellum.operators import apparatus, documents, gates

CAPTION = re.compile(r"^\s*(?:Table|Figure|Fig\.|Box|Chart|Map|Scheme)\s+[A-Z]?\d+(?:[.\-]\d+)*[A-Za-z]?\s*[.:—–|-]")
NOTE = re.compile(r"^\s*(?:notes?|sources?)\s*[.:]", re.I)
NUMBERED = re.compile(r"\(\s*[A-Z]?\d+[a-z]?\s*\)\s*$")


@dataclass(frozen=True)
class Face:
    """A face, its size in points and the space before a paragraph in twentieths of a point; None where the house doesn't say."""

    font: str | None = None
    size: float | None = None
    before: int | None = None

    @property
    def half_points(self) -> int | None:
        return None if self.size is None else round(self.size * 2)

    def props(self) -> dict[str, ET.Element]:
        """Run properties by name."""
        out = {}
        if self.font:
            out["rFonts"] = ET.Element(W + "rFonts", {W + k: self.font for k in ("ascii", "hAnsi", "cs")})
        if self.size:
            out |= {t: ET.Element(W + t, {W + "val": str(self.half_points)}) for t in ("sz", "szCs")}
        return out


#: The house's own rules; sizes in points.
HOUSE = {"caption": Face(size=12), "note": Face(size=10), "equation": Face()}


def _kind(p: ET.Element) -> str | None:
    text = text_of(p, maths=False)
    if CAPTION.match(text):
        return "caption"
    if NOTE.match(text):
        return "note"
    return "equation" if p.find(f".//{M}oMath") is not None and NUMBERED.search(text) and not NUMBERED.sub("", text).strip() else None


def _faces(root: ET.Element) -> Iterator[dict]:
    for pos, p in enumerate(root.iter(W + "p")):
        if (kind := _kind(p)) is None:
            continue
        space = markup.own_child(markup.own_properties(p, "pPr"), "spacing")
        for r in p.iter(W + "r"):
            props = markup.own_properties(r, "rPr")
            font, size = markup.own_child(props, "rFonts"), markup.own_child(props, "sz")
            yield {"pos": pos, "kind": kind, "text": text_of(p)[:60], "font": None if font is None else font.get(W + "ascii"), "half_points": None if size is None else int(size.get(W + "val") or 0), "before": None if space is None else int(space.get(W + "before") or 0)}


FACES = "pos int, kind string, text string, font string, half_points int, before int"


def scope(parts: DataFrame) -> DataFrame:
    """``(doc, captions, notes, equations)`` that the rules apply to."""
    rows = documents.rows_of(parts, _faces, FACES).select("doc", "pos", "kind").distinct()
    return rows.groupBy("doc").agg(*(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("caption", "note", "equation")))


def audit(parts: DataFrame, rules: dict[str, Face] = HOUSE) -> DataFrame:
    """``(doc, pos, kind, finding, text)``: captions, notes and numbered equations whose face, size or space isn't the house's; a run that says nothing has its style's."""
    rows = documents.rows_of(parts, _faces, FACES)
    sized = apparatus.resolve_runs(parts, "sz").groupBy("doc", "pos").agg(F.max("value").alias("_sz"))
    rows = rows.join(sized, ["doc", "pos"], "left").withColumn("half_points", F.coalesce("half_points", F.col("_sz").try_cast("int")))
    checks = []
    for kind, face in rules.items():
        own = F.col("kind") == kind
        if face.font:
            checks.append(F.when(own & (F.col("font") != face.font), "face"))
        if face.half_points:
            checks.append(F.when(own & (F.col("half_points") != face.half_points), "size"))
        if face.before is not None:
            checks.append(F.when(own & (F.coalesce("before", F.lit(0)) != face.before), "space"))
    found = rows.select("doc", "pos", "kind", "text", F.explode(F.array_compact(F.array(*checks))).alias("finding"))
    return found.select("doc", "pos", "kind", "finding", "text").distinct()


def _sizes(root: ET.Element, styles: ET.Element | None) -> dict[int, str]:
    """By paragraph, the greatest size that a run of it comes to (see :func:`apparatus.resolve_runs`)."""
    sized = apparatus.style_sizes(styles)
    out: dict[int, str] = {}
    for r in apparatus._run_rows(root):
        value = dict(r["direct"]).get("sz") or sized(r["rstyle"], r["pstyle"])
        if value is not None:
            out[r["pos"]] = max(value, out.get(r["pos"], value))
    return out


def tally(parts: DataFrame, rules: dict[str, Face] = HOUSE) -> DataFrame:
    """``(doc, captions, notes, equations, left)``: what the rules apply to, and how many findings :func:`audit` has, in one pass over a document."""

    def read(blobs: dict[str, bytes]) -> Iterator[dict]:
        root = wordml.parse(blobs.get(documents.DOCUMENT, b""))[0]
        rows = [] if root is None else list(_faces(root))
        if not rows:
            return
        asked = any(r["half_points"] is None for r in rows)
        sizes = _sizes(root, wordml.parse(blobs["word/styles.xml"])[0] if "word/styles.xml" in blobs else None) if asked else {}
        found = set()
        for r in rows:
            face, own = rules.get(r["kind"]), r["half_points"]
            if own is None and (sizes.get(r["pos"]) or "").strip().lstrip("+-").isdigit():
                own = int(sizes[r["pos"]])
            if face is None:
                continue
            if face.font and r["font"] is not None and r["font"] != face.font:
                found.add((r["pos"], "face"))
            if face.half_points and own is not None and own != face.half_points:
                found.add((r["pos"], "size"))
            if face.before is not None and (r["before"] or 0) != face.before:
                found.add((r["pos"], "space"))
        kinds = [k for _, k in {(r["pos"], r["kind"]) for r in rows}]
        yield {f"{k}s": kinds.count(k) for k in ("caption", "note", "equation")} | {"left": len(found)}

    return documents.rows_of_whole(parts, read, "captions long, notes long, equations long, left long")


def apply(parts: DataFrame, rules: dict[str, Face] = HOUSE) -> DataFrame:
    """The parts with the house's faces on captions, notes and numbered equations, fields' machinery left alone."""

    def edit(root: ET.Element) -> None:
        for p in root.iter(W + "p"):
            face = rules.get(_kind(p) or "")
            if face is None:
                continue
            for r in p.iter(W + "r"):
                if any(c.tag in (W + "fldChar", W + "instrText") for c in r):
                    continue
                props = markup.own_properties(r, "rPr")
                if props is None and face.props():
                    props = ET.Element(W + "rPr")
                    r.insert(0, props)
                for e in face.props().values():
                    markup._place(props, e, markup.RUN_ORDER)
            if face.before is not None:
                props = markup.own_properties(p, "pPr")
                if props is None:
                    props = ET.Element(W + "pPr")
                    p.insert(0, props)
                space = markup.own_child(props, "spacing")
                made = ET.Element(W + "spacing", dict(space.attrib) if space is not None else {})
                made.set(W + "before", str(face.before))
                markup._place(props, made, markup.PARAGRAPH_ORDER)

    return apparatus.edit_part(parts, documents.DOCUMENT, edit)


def smarten_parts(parts: DataFrame) -> DataFrame:
    """The text parts with straight quotes made curly within each text node, where they pair there."""

    def edit_text(xml: Column) -> Column:
        pieces = F.split(xml, r"(?<=</w:t>)")
        node = r"(?s)^(.*<w:t(?:\s[^>]*)?>)([^<]*)(</w:t>)$"
        turned = F.transform(pieces, lambda p: F.when(p.rlike(node), F.concat(F.regexp_extract(p, node, 1), smarten(F.regexp_extract(p, node, 2)), F.lit("</w:t>"))).otherwise(p))
        return F.array_join(turned, "")

    def edited(part: Column, blob: Column) -> Column:
        return F.when(part.isin(*gates.TEXT_PARTS), edit_text(blob.cast("string")).cast("binary")).otherwise(blob)

    if "rows" in parts.columns:
        return parts.withColumn("rows", F.transform("rows", lambda r: F.struct(r["part"].alias("part"), edited(r["part"], r["blob"]).alias("blob"))))
    return parts.withColumn("blob", edited(F.col("part"), F.col("blob")))


def table_spacing(parts: DataFrame, before: int = 120) -> DataFrame:
    """The parts with space above the text that goes on after a table, notes of the table aside."""

    def edit(root: ET.Element) -> None:
        body = root.find(W + "body")
        after = False
        for e in body if body is not None else ():
            if e.tag == W + "tbl":
                after = True
            elif e.tag == W + "p" and after and text_of(e).strip():
                if NOTE.match(text_of(e)):
                    continue
                props = markup.own_properties(e, "pPr")
                if props is None:
                    props = ET.Element(W + "pPr")
                    e.insert(0, props)
                space = markup.own_child(props, "spacing")
                made = ET.Element(W + "spacing", dict(space.attrib) if space is not None else {})
                made.set(W + "before", str(before))
                markup._place(props, made, markup.PARAGRAPH_ORDER)
                after = False

    return apparatus.edit_part(parts, documents.DOCUMENT, edit)


def restore_math_glyphs(parts: DataFrame, source: DataFrame) -> DataFrame:
    """The parts with equations' glyphs as their source had them, where that differs only by glyphs a word processor flattens and is clear."""
    from vellum.functions import equations
    from vellum.functions.batched import batched
    from vellum.functions.text import GLYPHS, PLAIN

    flat = str.maketrans(GLYPHS, PLAIN)
    had = gates.xml_of(documents.loose(source), documents.DOCUMENT).select(F.col("doc").alias("_d"), F.transform(equations.equations(F.col("xml")), equations.tokens).alias("_had")).where("size(_had) > 0")

    def fix(blob: bytes, had: list[str]) -> bytes:
        root, _ = wordml.parse(bytes(blob))
        if root is None:
            return bytes(blob)
        clear: dict[str, set[str]] = {}
        for t in had:
            clear.setdefault(t.translate(flat), set()).add(t)
        changed = False
        for e in root.iter(M + "oMath"):
            nodes = list(e.iter(M + "t"))
            own = "".join(t.text or "" for t in nodes)
            want = clear.get(own.translate(flat), ())
            if len(want) != 1 or own in want:
                continue
            (new,) = want
            changed = True
            for t in nodes:
                n = len(t.text or "")
                t.text, new = new[:n], new[n:]
        return wordml.serialise(root) if changed else bytes(blob)

    joined = parts.join(documents.large(had), F.col("doc") == F.col("_d"), "left")
    if "rows" in parts.columns:
        return documents.repackaged(joined, lambda blobs, had: {documents.DOCUMENT: fix(blobs[documents.DOCUMENT], had)} if had and documents.DOCUMENT in blobs else {}, "_had")
    hit = (F.col("part") == documents.DOCUMENT) & F.col("_had").isNotNull()
    made = batched(fix, "binary")(F.when(hit, F.col("blob")), F.coalesce("_had", F.array().cast("array<string>")))
    return joined.withColumn("blob", F.when(hit, made).otherwise(F.col("blob"))).drop("_d", "_had")
