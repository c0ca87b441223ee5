"""Edits of one table by row and cell, keeping its formatting.  Row -1 is the last."""

from __future__ import annotations

import copy
import xml.etree.ElementTree as ET
from collections.abc import Callable

from vellum.functions.editing import Refused, read, write
from vellum.functions.wordml import XML_SPACE, W, text_of


def _rows(table: ET.Element) -> list[ET.Element]:
    return [r for r in table if r.tag == W + "tr"]


def _row(table: ET.Element, at: int) -> ET.Element:
    rows = _rows(table)
    if not -len(rows) <= at < len(rows):
        raise Refused(f"the table has {len(rows)} rows")
    return rows[at]


def _cell(row: ET.Element, at: int) -> ET.Element:
    cells = [c for c in row if c.tag == W + "tc"]
    if not -len(cells) <= at < len(cells):
        raise Refused(f"the row has {len(cells)} cells")
    return cells[at]


def grid(fragment: str) -> list[list[str]]:
    """The texts of all cells, by row."""
    return [["\n".join(text_of(p) for p in c if p.tag == W + "p") for c in r if c.tag == W + "tc"] for r in _rows(read(fragment))]


def _write_cell(cell: ET.Element, value: str) -> None:
    """The text goes to the first run, which keeps its look; other runs and paragraphs lose theirs."""
    paragraphs = [p for p in cell if p.tag == W + "p"]
    p = paragraphs[0] if paragraphs else ET.SubElement(cell, W + "p")
    for other in paragraphs[1:]:
        cell.remove(other)
    runs = [r for r in p if r.tag == W + "r"]
    for other in [c for c in p if c.tag not in (W + "pPr",) and c is not (runs[0] if runs else None)]:
        p.remove(other)
    run = runs[0] if runs else ET.SubElement(p, W + "r")
    for child in [c for c in run if c.tag != W + "rPr"]:
        run.remove(child)
    t = ET.SubElement(run, W + "t")
    t.text = value
    if value != value.strip():
        t.set(XML_SPACE, "preserve")


def set_cell(fragment: str, row: int, column: int, value: str) -> str:
    table = read(fragment)
    _write_cell(_cell(_row(table, row), column), value)
    return write(table)


def set_row(fragment: str, row: int, values: list[str]) -> str:
    table = read(fragment)
    own = _row(table, row)
    n = sum(c.tag == W + "tc" for c in own)
    if n != len(values):
        raise Refused(f"the row has {n} cells")
    for i, v in enumerate(values):
        _write_cell(_cell(own, i), v)
    return write(table)


def clone_row(fragment: str, row: int, count: int = 1) -> str:
    """Copies of a row after it."""
    table = read(fragment)
    own = _row(table, row)
    at = list(table).index(own) + 1
    table[at:at] = [copy.deepcopy(own) for _ in range(count)]
    return write(table)


def drop_row(fragment: str, row: int) -> str:
    table = read(fragment)
    if len(_rows(table)) == 1:
        raise Refused("a table keeps one row")
    table.remove(_row(table, row))
    return write(table)


def drop_column(fragment: str, column: int) -> str:
    """A column away, of a table without merged cells."""
    table = read(fragment)
    if table.find(f".//{W}gridSpan") is not None or table.find(f".//{W}vMerge") is not None:
        raise Refused("the table has merged cells")
    for r in _rows(table):
        r.remove(_cell(r, column))
    lines = table.find(W + "tblGrid")
    if lines is not None and len(lines):
        lines.remove(lines[column])
    return write(table)


def sort_rows(fragment: str, key: Callable[[list[str]], object], header: int = 1, pinned: tuple[str, ...] = ()) -> str:
    """Data rows by a key of their texts; rows whose first cell is pinned stay last, in the order given."""
    table = read(fragment)
    rows = _rows(table)[header:]
    shown = {id(r): ["\n".join(text_of(p) for p in c if p.tag == W + "p") for c in r if c.tag == W + "tc"] for r in rows}
    pin = {p: i for i, p in enumerate(pinned)}
    order = sorted(rows, key=lambda r: (shown[id(r)][0] in pin, pin.get(shown[id(r)][0], 0), key(shown[id(r)]) if shown[id(r)][0] not in pin else 0))
    at = list(table).index(rows[0]) if rows else 0
    for r in rows:
        table.remove(r)
    table[at:at] = order
    return write(table)


def keep_together(fragment: str) -> str:
    """No row splits over pages, and each but the last keeps with the next."""
    table = read(fragment)
    rows = _rows(table)
    for k, r in enumerate(rows):
        props = r.find(W + "trPr")
        if props is None:
            props = ET.Element(W + "trPr")
            r.insert(0, props)
        if props.find(W + "cantSplit") is None:
            ET.SubElement(props, W + "cantSplit")
        if k == len(rows) - 1:
            continue
        for p in r.iter(W + "p"):
            pp = p.find(W + "pPr")
            if pp is None:
                pp = ET.Element(W + "pPr")
                p.insert(0, pp)
            if pp.find(W + "keepNext") is None:
                pp.insert(1 if len(pp) and pp[0].tag == W + "pStyle" else 0, ET.Element(W + "keepNext"))
    return write(table)
