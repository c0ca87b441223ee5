"""Equations: their symbols, their structure, and their LaTeX."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import unescape
from vellum.functions.wordml import PREFIXES, M, W

_MATH = r"(?s)<m:oMath>.*?</m:oMath>"
_TEXT = r"(?s)<m:t(?:\s[^>]*)?>(.*?)</m:t>"
# The structures that make an equation's skeleton.
STRUCTURES = "sSub sSup sSubSup nary f d rad func acc bar groupChr limLow limUpp m eqArr box".split()
# Symbols that LaTeX names.
NAMES = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda", "μ": "mu", "π": "pi", "ρ": "rho",
    "σ": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega", "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda",
    "Σ": "Sigma", "Φ": "Phi", "Ψ": "Psi", "Ω": "Omega", "∑": "sum", "∏": "prod", "∫": "int", "∞": "infty", "≤": "leq", "≥": "geq", "≠": "neq",
    "≈": "approx", "×": "times", "·": "cdot", "±": "pm", "∈": "in", "∂": "partial", "∇": "nabla", "→": "to", "∀": "forall", "∃": "exists",
}
ACCENTS = {"̂": "hat", "̃": "tilde", "̅": "bar", "⃗": "vec", "̇": "dot", "̈": "ddot"}
FUNCTIONS = frozenset("sin cos tan log ln exp lim max min sup inf det arg".split())


def equations(xml: Column) -> Column:
    """Every equation of a fragment, in order."""
    return F.regexp_extract_all(xml, F.lit(_MATH), F.lit(0))


def tokens(omml: Column) -> Column:
    """The symbols of an equation, in order."""
    return unescape(F.concat_ws("", F.regexp_extract_all(omml, F.lit(_TEXT), F.lit(1))))


def skeleton(omml: Column) -> Column:
    """The structures of an equation, in order."""
    return F.array_join(F.regexp_extract_all(omml, F.lit(rf"<m:({'|'.join(STRUCTURES)})\b"), F.lit(1)), "/")


def face(run: Column) -> Column:
    """A maths run's face: p, b, i or bi; italic where nothing is said."""
    style = F.regexp_extract(run, r'<m:sty m:val="(p|b|i|bi)"', 1)
    return F.when(style != "", style).when(run.rlike(r"<m:nor\s*/>"), "p").when(run.rlike(r"<w:b(?:\s*/|>)"), "bi").otherwise("i")


def is_display(paragraph: Column) -> Column:
    """Whether a paragraph is an equation, with at most its number beside it."""
    prose = F.concat_ws("", F.regexp_extract_all(F.regexp_replace(paragraph, _MATH, ""), F.lit(r"(?s)<w:t(?:\s[^>]*)?>(.*?)</w:t>"), F.lit(1)))
    return paragraph.contains("<m:oMath>") & prose.rlike(r"^\s*(?:\([A-Z]?\d+(?:\.\d+)*[a-z]?\))?\s*$")


def symbols(omml: Column) -> Column:
    """Greek letters and mathematical signs among an equation's tokens."""
    return F.array_distinct(F.filter(F.split(tokens(omml), ""), lambda c: c.rlike(r"[\x{370}-\x{3FF}\x{2190}-\x{22FF}]")))


def _latex_text(text: str) -> str:
    out = ""
    for c in text:
        out += f"\\{NAMES[c]} " if c in NAMES else "\\" + c if c in "%$#&_{}" else "-" if c == "−" else c
    return out


def _script(x: str) -> str:
    x = x.strip()
    return x if len(x) == 1 else f"{{{x}}}"


class _Writer:
    """LaTeX of one tree; ``unknown`` collects elements that it has no rule for."""

    def __init__(self) -> None:
        self.unknown: list[str] = []

    def part(self, e: ET.Element, name: str) -> str:
        child = e.find(M + name)
        return "" if child is None else self.all(child)

    def prop(self, e: ET.Element, holder: str, name: str, default: str) -> str:
        p = e.find(f"{M}{holder}/{M}{name}")
        return default if p is None else p.get(M + "val", "")

    def all(self, e: ET.Element) -> str:
        return "".join(self.one(c) for c in e)

    def one(self, e: ET.Element) -> str:
        name = e.tag.removeprefix(M)
        rule = getattr(self, "x_" + name, None)
        if rule:
            return rule(e)
        if name.endswith("Pr") or e.tag.startswith(W):
            return ""
        if name in ("oMath", "oMathPara", "e", "box", "borderBox", "phant"):
            return self.part(e, "e") if name in ("box", "borderBox", "phant") else self.all(e)
        self.unknown.append(name)
        return self.all(e)

    def x_r(self, e: ET.Element) -> str:
        text = "".join(t.text or "" for t in e.iter(M + "t"))
        if e.find(f"{M}rPr/{M}nor") is not None:
            return f"\\text{{{text}}}"
        shown = _latex_text(text)
        style = e.find(f"{M}rPr/{M}sty")
        kind = style.get(M + "val") if style is not None else "i"
        if kind in ("b", "bi"):
            return f"\\mathbf{{{shown.strip()}}}"
        if kind == "p" and text.strip() in FUNCTIONS:
            return f"\\{text.strip()} "
        return f"\\mathrm{{{shown.strip()}}}" if kind == "p" and re.fullmatch(r"[A-Za-z]{2,}", text.strip()) else shown

    def x_f(self, e: ET.Element) -> str:
        num, den = self.part(e, "num"), self.part(e, "den")
        kind = self.prop(e, "fPr", "type", "bar")
        return f"{num}/{den}" if kind == "lin" else f"\\binom{{{num}}}{{{den}}}" if kind == "noBar" else f"\\frac{{{num}}}{{{den}}}"

    def x_sSub(self, e: ET.Element) -> str:  # noqa: N802
        return f"{self.part(e, 'e').strip()}_{_script(self.part(e, 'sub'))}"

    def x_sSup(self, e: ET.Element) -> str:  # noqa: N802
        return f"{self.part(e, 'e').strip()}^{_script(self.part(e, 'sup'))}"

    def x_sSubSup(self, e: ET.Element) -> str:  # noqa: N802
        return f"{self.part(e, 'e').strip()}_{_script(self.part(e, 'sub'))}^{_script(self.part(e, 'sup'))}"

    def x_sPre(self, e: ET.Element) -> str:  # noqa: N802
        return f"{{}}_{_script(self.part(e, 'sub'))}^{_script(self.part(e, 'sup'))}{self.part(e, 'e')}"

    def x_nary(self, e: ET.Element) -> str:
        sign = _latex_text(self.prop(e, "naryPr", "chr", "∫")).strip()
        low, high = self.part(e, "sub"), self.part(e, "sup")
        return sign + (f"_{_script(low)}" if low else "") + (f"^{_script(high)}" if high else "") + " " + self.part(e, "e")

    def x_d(self, e: ET.Element) -> str:
        left, right, mid = (self.prop(e, "dPr", n, d) for n, d in (("begChr", "("), ("endChr", ")"), ("sepChr", "|")))
        named = lambda c: {"": ".", "{": "\\{", "}": "\\}", "⌊": "\\lfloor ", "⌋": "\\rfloor ", "⟨": "\\langle ", "⟩": "\\rangle "}.get(c, c)
        return f"\\left{named(left)}{mid.join(self.all(x) for x in e.findall(M + 'e'))}\\right{named(right)}"

    def x_rad(self, e: ET.Element) -> str:
        degree = self.part(e, "deg")
        return f"\\sqrt[{degree}]{{{self.part(e, 'e')}}}" if degree else f"\\sqrt{{{self.part(e, 'e')}}}"

    def x_func(self, e: ET.Element) -> str:
        name = self.part(e, "fName").strip()
        bare = re.sub(r"^\\mathrm\{(\w+)\}$", r"\1", name)
        return (f"\\{bare}" if bare in FUNCTIONS else name) + f" {self.part(e, 'e')}"

    def x_acc(self, e: ET.Element) -> str:
        return f"\\{ACCENTS.get(self.prop(e, 'accPr', 'chr', '̂'), 'hat')}{{{self.part(e, 'e')}}}"

    def x_bar(self, e: ET.Element) -> str:
        return f"\\{'overline' if self.prop(e, 'barPr', 'pos', 'bot') == 'top' else 'underline'}{{{self.part(e, 'e')}}}"

    def x_groupChr(self, e: ET.Element) -> str:  # noqa: N802
        return f"\\{'overbrace' if self.prop(e, 'groupChrPr', 'pos', 'bot') == 'top' else 'underbrace'}{{{self.part(e, 'e')}}}"

    def x_limLow(self, e: ET.Element) -> str:  # noqa: N802
        return f"{self.part(e, 'e').strip()}_{_script(self.part(e, 'lim'))}"

    def x_limUpp(self, e: ET.Element) -> str:  # noqa: N802
        return f"{self.part(e, 'e').strip()}^{_script(self.part(e, 'lim'))}"

    def x_m(self, e: ET.Element) -> str:
        rows = [" & ".join(self.all(c) for c in r.findall(M + "e")) for r in e.findall(M + "mr")]
        return "\\begin{matrix}" + r" \\ ".join(rows) + "\\end{matrix}"

    def x_eqArr(self, e: ET.Element) -> str:  # noqa: N802
        return "\\begin{aligned}" + r" \\ ".join(self.all(c) for c in e.findall(M + "e")) + "\\end{aligned}"


def latex(omml: str | None, strict: bool = False) -> str | None:
    """An equation as LaTeX; null if it doesn't parse or, when strict, holds what there is no rule for."""
    if not omml:
        return None
    names = " ".join(f'xmlns:{p}="{u}"' for p, u in PREFIXES.items())
    try:
        root = ET.fromstring(f"<x {names}>{omml}</x>")
    except ET.ParseError:
        return None
    writer = _Writer()
    out = re.sub(r"  +", " ", writer.all(root)).strip()
    return None if strict and writer.unknown else out


def to_latex(omml: Column, strict: bool = False) -> Column:
    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: latex(x, strict)).astype(object)

    return convert(omml)
