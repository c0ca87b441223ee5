"""Small manuscripts in code: one function makes any element, the others name the shapes that tests need."""

from __future__ import annotations

from vellum.functions.wordml import PREFIXES
from vellum.sources.packages import package_bytes

NS = " ".join(f'xmlns:{p}="{PREFIXES[p]}"' for p in ("w", "m"))


def make(tag: str, *inner: str, **attributes: object) -> str:
    """An element; attributes are of the tag's own namespace."""
    prefix = tag.partition(":")[0]
    said = "".join(f' {prefix}:{k}="{v}"' for k, v in attributes.items())
    return f"<{tag}{said}>{''.join(inner)}</{tag}>"


def piece(text: str, tag: str = "w:t") -> str:
    return make("w:r", f'<{tag} xml:space="preserve">{text}</{tag}>')


def change(tag: str, text: str, number: int, author: str) -> str:
    shown = piece(text, "w:delText" if tag == "w:del" else "w:t")
    return make(tag, shown, id=number, author=author, date=f"2026-01-0{number}T00:00:00Z")


def added(text: str, number: int = 1, author: str = "Ann") -> str:
    return change("w:ins", text, number, author)


def removed(text: str, number: int = 2, author: str = "Bob") -> str:
    return change("w:del", text, number, author)


def line(*inner: str, style: str = "", mark: str = "") -> str:
    """A paragraph of texts and elements, with a style, and a change of its end mark."""
    props = make("w:pStyle", val=style) if style else ""
    props += make("w:rPr", make(f"w:{mark}", id=90, author="A")) if mark else ""
    return make("w:p", make("w:pPr", props) if props else "", *(x if x.startswith("<") else piece(x) for x in inner))


def grid(*rows: list[str]) -> str:
    return make("w:tbl", *(make("w:tr", *(c if c.startswith("<w:tc>") else make("w:tc", line(c)) for c in r)) for r in rows))


def formula(text: str) -> str:
    return make("m:oMath", make("m:r", make("m:t", text)))


def part(root: str, *inner: str) -> bytes:
    return f'<?xml version="1.0" encoding="UTF-8"?><{root} {NS}>{"".join(inner)}</{root}>'.encode()


def body(*inner: str) -> bytes:
    return part("w:document", make("w:body", *inner))


def footnotes(**texts: str) -> bytes:
    return part("w:footnotes", make("w:footnote", "<w:p/>", id=0, type="separator"), *(make("w:footnote", line(t), id=k[1:]) for k, t in texts.items()))


def archive(document: bytes, **more: bytes) -> bytes:
    return package_bytes([("[Content_Types].xml", b"<Types/>"), ("word/document.xml", document), *((f"word/{k}.xml", v) for k, v in more.items())])
