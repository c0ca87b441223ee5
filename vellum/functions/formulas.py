"""Equations in paragraphs: their look, whether they stand alone, and symbols set as prose."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions import equations
from vellum.functions.batched import batched
from vellum.functions.numbers import let
from vellum.functions.text import visible_text
from vellum.functions.wordml import PREFIXES

_MATHS = r"(?s)<m:oMath>.*?</m:oMath>"


def is_bold(run: Column) -> Column:
    return equations.face(run).isin("b", "bi")


def is_italic(run: Column) -> Column:
    """Also of a run that says nothing: maths is italic unless it says otherwise."""
    return equations.face(run).isin("i", "bi")


def harvest(xml: Column, contains: Column, index: int = 0, exact: bool = False) -> Column:
    """The index-th equation whose symbols hold (or are) a text, null if there is none."""
    hits = F.filter(equations.equations(xml), lambda e: (equations.tokens(e) == contains) if exact else F.contains(equations.tokens(e), contains))
    return F.get(hits, F.lit(index))


def standalone(omml: Column) -> Column:
    """An equation with the names that it uses declared, so that it parses alone; what is declared stays."""
    def declared(prefix: str, uri: str) -> Callable[[Column], Column]:
        needs = lambda own: own.rlike(rf"[<\s/]{prefix}:") & ~own.rlike(rf"\bxmlns:{prefix}=")
        return lambda own: F.when(needs(own), F.regexp_replace(own, r"^(\s*<[^\s/>]+)", f'$1 xmlns:{prefix}="{uri}"')).otherwise(own)

    out = omml
    for prefix, uri in PREFIXES.items():
        out = let(out, declared(prefix, uri))
    return out


def clone(omml: Column) -> Column:
    """An equation to put elsewhere: bookmarks and changes it carries are left behind."""
    bare = F.regexp_replace(omml, r"<w:bookmark(?:Start|End)\b[^>]*/>", "")
    return standalone(F.regexp_replace(bare, r"(?s)<w:del\b[^>]*(?<!/)>.*?</w:del>|</?w:ins\b[^>]*>", ""))


def in_display_mode(paragraph: Column) -> Column:
    return F.contains(paragraph, F.lit("<m:oMathPara"))


def inline_display(paragraph: Column) -> Column:
    """An equation that stands alone and yet will be laid out as if in a line."""
    return equations.is_display(paragraph) & ~in_display_mode(paragraph)


def display(paragraph: Column, jc: str = "center") -> Column:
    """The paragraph with its equation in display mode; one that is so already, or holds words, stays."""
    wrapped = F.regexp_replace(paragraph, r"(?s)(<m:oMath>.*</m:oMath>)", f'<m:oMathPara><m:oMathParaPr><m:jc m:val="{jc}"/></m:oMathParaPr>$1</m:oMathPara>')
    return F.when(inline_display(paragraph), wrapped).otherwise(paragraph)


def numbered_grid(equation: Column, number: Column, width: int) -> Column:
    """A table without borders: a spacer, the equation, and its number at the right."""
    side = width // 8
    cell = lambda w, inner: F.concat(F.lit(f'<w:tc><w:tcPr><w:tcW w:w="{w}" w:type="dxa"/></w:tcPr>'), inner, F.lit("</w:tc>"))
    right = F.concat(F.lit('<w:p><w:pPr><w:jc w:val="right"/></w:pPr><w:r><w:t>'), number, F.lit("</w:t></w:r></w:p>"))
    middle = width - 2 * side
    lines = "".join(f'<w:gridCol w:w="{w}"/>' for w in (side, middle, side))
    return F.concat(F.lit(f'<w:tbl><w:tblPr><w:tblW w:w="{width}" w:type="dxa"/></w:tblPr><w:tblGrid>{lines}</w:tblGrid><w:tr>'), cell(side, F.lit("<w:p/>")), cell(middle, equation), cell(side, right), F.lit("</w:tr></w:tbl>"))


def number_display(paragraph: Column, width: int = 9360) -> Column:
    """A paragraph of an equation and its number ``(3)`` as such a table; others stay."""
    words = F.trim(F.regexp_replace(visible_text(F.regexp_replace(paragraph, _MATHS, "")), r"\s+", " "))
    number = F.regexp_extract(words, r"^(\([A-Z]?\d+[a-z]?\))$", 1)
    equation = F.concat(F.lit("<w:p>"), F.regexp_extract(paragraph, _MATHS, 0), F.lit("</w:p>"))
    return F.when((number != "") & F.contains(paragraph, F.lit("<m:oMath>")), numbered_grid(equation, number, width)).otherwise(paragraph)


_INTERVAL = re.compile(r"[\[(]\s*[-−]?\d+(?:\.\d+)?\s*,\s*[-−]?\d+(?:\.\d+)?\s*[\])]")
_SCRIPT = re.compile(r"\b[A-Za-zα-ωΑ-Ω][_^]\w+|\b[A-Za-zα-ω][₀-₉⁰-⁹²³]+")
_SPLIT = re.compile(r"[=<>≤≥+*/^−-]\s*$|^\s*[=<>≤≥+*/^−-]")


def prose_math(paragraph: Column, symbols: Column) -> Column:
    """``array<struct<kind, said>>`` of maths set as prose: symbols of the document's equations, typed scripts, intervals, and expressions that an equation breaks off."""

    def find(xml: str, known: list[str]) -> list[dict]:
        pieces = re.split(_MATHS, xml)
        plain = ["".join(re.findall(r"(?s)<w:t(?:\s[^>]*)?(?<!/)>(.*?)</w:t>", p)) for p in pieces]
        out = []
        for k, text in enumerate(plain):
            out += [{"kind": "symbol", "said": c} for c in text if c in set(known)]
            out += [{"kind": "script", "said": m[0]} for m in _SCRIPT.finditer(text)]
            out += [{"kind": "interval", "said": m[0]} for m in _INTERVAL.finditer(text)]
            if len(plain) > 1 and text.strip() and (_SPLIT.search(text) if k in (0, len(plain) - 1) else re.search(_SPLIT, text)):
                out.append({"kind": "split", "said": text.strip()[-20:]})
        return out

    return batched(find, "array<struct<kind:string,said:string>>")(paragraph, symbols)
