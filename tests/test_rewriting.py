"""Edits of markup that no query shows: what they make, and what they refuse."""

import builders as B
import pytest

from vellum.functions import locating, markup, wiring
from vellum.functions.editing import Refused, read, text
from vellum.functions.wordml import W, in_view, parse, rows_in_view, whitespace_only

LINK = '<w:hyperlink w:anchor="Falk1971"><w:r><w:rPr><w:rStyle w:val="Hyperlink"/></w:rPr><w:t>Falk 1971</w:t></w:r></w:hyperlink>'
P = f'<w:p>{B.piece("So (")}<w:bookmarkStart w:id="1" w:name="Falk1971txt"/>{LINK}<w:bookmarkEnd w:id="1"/>{B.piece(") wrote. ")}</w:p>'
FIELD = '<w:r><w:t>by </w:t><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> REF Table1 \\h </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>{}<w:r><w:fldChar w:fldCharType="end"/><w:t> end</w:t></w:r>'


def test_links_keep_their_words():
    assert text(locating.replace_keeping_links(P, "So (Falk 1971) wrote", "Then (Falk 1971) said")) == "Then (Falk 1971) said. "
    for new in ("no label", "Falk 1971 and Falk 1971"):
        with pytest.raises(Refused):
            locating.replace_keeping_links(P, "So (Falk 1971) wrote", new)
    with pytest.raises(Refused, match="across an end"):
        locating.replace_keeping_links(P, "1971) wrote", "x")
    assert text(locating.relabel_link(P, "Falk1971", "Falk and Holm 1971")) == "So (Falk and Holm 1971) wrote. "
    for anchor, label in (("Falk1971", ""), ("none", "x")):
        with pytest.raises(Refused):
            locating.relabel_link(P, anchor, label)
    bare, gone = locating.remove_links(P, {"other"})
    assert gone == ["Falk1971"] and "hyperlink" not in bare and locating.remove_links(P, {"Falk1971"})[1] == []


def test_citations_change_their_form():
    told = wiring.to_narrative(P, "Falk1971")
    assert text(told) == "So Falk (1971) wrote. " and next(x for x in wiring.places_of(read(told)) if x["kind"] == "link")["label"] == "Falk (1971)"
    assert text(wiring.to_parenthetical(told, "Falk1971")) == "So (Falk 1971) wrote. "
    wide = wiring.respan_link(P, "Falk1971", "(Falk 1971)")
    assert next(x for x in wiring.places_of(read(wide)) if x["kind"] == "link")["label"] == "(Falk 1971)"
    with pytest.raises(Refused):
        wiring.respan_link(P, "Falk1971", "wrote")
    assert [wiring.balanced_span(t, 0, n) for t, n in (("Falk 1971)", 10), ("(Falk", 5), ("Falk (1971)", 10), ("Falk", 4), (") (", 3))] == ["Falk 1971", "Falk", "Falk (1971)", "Falk", None]


def test_marks_and_links_are_made_and_unmade():
    assert wiring.unlink_by_anchor(P, "^Falk")[1:] == (1, 1)
    bare = wiring.delete_bookmark(P, "Falk1971txt")
    assert "bookmark" not in bare and wiring.wrap_link_in_bookmark(bare, "Falk1971", "Falk1971txt", 1).count("bookmark") == 2
    moved = wiring.marker_bookmark(bare, "Falk1971txt", 4)
    assert [x["stop"] for x in wiring.places_of(read(wiring.rewrap_marker(moved, "Falk1971txt"))) if x["kind"] == "mark"] == [13]
    selfish = P.replace('w:anchor="Falk1971"', 'w:anchor="Falk1971txt"')
    assert 'w:anchor="Falk1971"' in wiring.retarget_self_link(selfish, "Falk1971txt")
    with pytest.raises(Refused):
        wiring.retarget_self_link(P, "Falk1971txt")
    assert text(wiring.link_in_para(P, "wrote", "X")) == text(P)
    with pytest.raises(Refused, match="in a link"):
        wiring.wrap_visible_span(P, 4, 8, "X")
    nested = f"<w:p>{FIELD.format(LINK)}</w:p>"
    assert "fldChar" not in wiring.remove_outer_field(nested, "Table1", "Falk1971") and LINK.count("hyperlink") == 2


def test_fields_by_depth():
    inner = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>HYPERLINK \\l "Deep"</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>shown</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    root = read(f"<w:p>{FIELD.format(inner)}</w:p>")
    found = markup.fields(root)
    assert [markup.target_of(f.instruction) for f in found] == ["Table1", "Deep"] and all(f.end is not None for f in found)
    assert "".join(found[0].label) == "".join(found[1].label) == "shown"
    runs = markup.isolate_field(root, found[0])
    assert "".join(t.text for r in runs for t in r.iter(W + "t")) == "shown" and "".join(t.text for t in root.iter(W + "t")) == "by shown end"
    torn = read('<w:p><w:r><w:instrText>REF Gone \\h</w:instrText></w:r></w:p>')
    assert [markup.target_of(f.instruction) for f in markup.fields(torn)] == ["Gone"]
    assert markup.target_of("REF A") is None and markup.target_of("REF A", clickable=False) == "A" and markup.target_of("PAGEREF A") is None
    dead = read('<w:p><w:hyperlink w:anchor="A"><w:r><w:t> </w:t></w:r></w:hyperlink><w:hyperlink w:anchor="B"><w:r><w:delText>x</w:delText></w:r></w:hyperlink></w:p>')
    assert [(x["anchor"], x["dead"]) for x in markup.internal_links(dead)] == [("A", True), ("B", False)]


def test_properties_go_where_the_format_wants_them():
    p = '<w:p><w:pPr><w:pStyle w:val="S"/><w:jc w:val="left"/><w:pPrChange w:id="1"><w:pPr><w:spacing w:after="9"/></w:pPr></w:pPrChange></w:pPr></w:p>'
    made = read(markup.set_para_property(p, "spacing", '<w:spacing w:after="5"/>'))[0]
    assert [e.tag.removeprefix(W) for e in made] == ["pStyle", "spacing", "jc", "pPrChange"]
    assert markup.own_child(read(p)[0], "spacing") is None
    run = markup.set_run_property("<w:r><w:t>x</w:t></w:r>", "sz", '<w:sz w:val="20"/>')
    assert run.index("rPr") < run.index("<w:t>") and markup.set_sect_property("<w:sectPr><w:cols/></w:sectPr>", "pgSz", '<w:pgSz w:w="1"/>').index("pgSz") < 20
    assert markup.set_run_text("<w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r>", "new ") == '<w:r><w:t xml:space="preserve">new </w:t></w:r><w:r><w:t /></w:r>'
    assert markup.balanced("<w:a><w:b/></w:a>text") and not markup.balanced("<w:a>") and not markup.balanced("</w:a>")
    assert len(markup.element_spans("<w:tbl><w:tr><w:tc><w:tbl><w:tr/></w:tbl></w:tc></w:tr></w:tbl><w:tbl/>", "tbl")) == 1
    hoisted, n = markup.hoist_links(f'<w:p><w:ins w:id="7" w:author="A">{B.piece("a")}{LINK}{B.piece("b")}</w:ins></w:p>')
    assert n == 1 and hoisted.count("<w:ins ") == 3 and hoisted.index("<w:hyperlink") < hoisted.index("Falk 1971")
    body = read('<w:body><w:p/><w:bookmarkEnd w:id="3"/><w:bookmarkStart w:id="4" w:name="a"/><w:bookmarkEnd w:id="4"/><w:proofErr w:type="spellEnd"/><w:p/></w:body>')
    assert [m[3] for m in markup.markers_before(body, body[-1])] == [False, True, True, False]


def test_paragraph_edits():
    assert text(locating.rstrip_para(P)) == "So (Falk 1971) wrote." and locating.rstrip_para(f"<w:p>{LINK}</w:p>").count("Falk 1971") == 1
    styled = locating.replace_with_runs(P, "wrote", [("has ", None), ("said", "<w:rPr><w:i/></w:rPr>")])
    assert text(styled) == "So (Falk 1971) has said. " and "<w:i />" in styled
    with pytest.raises(Refused):
        locating.replace_with_runs(P, "wrote", [("x", "<w:i/>")])
    assert locating.set_run_properties(f"<w:p>{FIELD.format(B.piece('x'))}</w:p>", {"b": "<w:b/>"})[1] == 3
    assert locating.rep("a-b a−b", "a-b", "c", 2, normalize=True) == "c c"
    with pytest.raises(Refused, match="2 times"):
        locating.rep("a a", "a", "b")
    assert locating.prose_props(f"<w:p><w:pPr><w:jc w:val='left'/></w:pPr>{LINK}<w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r></w:p>") == ('<w:pPr><w:jc w:val="left" /></w:pPr>', "<w:rPr><w:b /></w:rPr>")
    for refused, why in ((P, "bookmark"), ("<w:p><w:r><w:footnoteReference w:id='1'/></w:r></w:p>", "note"), ("<w:p><w:pPr><w:sectPr/></w:pPr></w:p>", "section"), (f"<w:p>{B.added('x')}</w:p>", "changes"), ("<w:p><w:bookmarkEnd w:id='1'/></w:p>", "half")):
        with pytest.raises(Refused, match=why):
            locating.drop_para(refused)
    assert locating.drop_para(P, allow_bookmarks=True) == ""
    assert locating.diagnose([P], "So", "Falk") .startswith("the text meets the link") and locating.diagnose([P, P], "So", "x").startswith("2 paragraphs")
    assert locating.invariants(P).links == 1 and locating.invariants(P).bookmarks == 1


def test_views_under_a_predicate():
    body = B.body(B.line(B.added("a", 1, "Ann"), B.removed("b", 2, "Bob"), B.added(" ", 3, "Cy")))
    root = in_view(parse(body)[0], "final", whitespace_only)
    assert sum(e.tag in (W + "ins", W + "del") for e in root.iter()) == 2
    root = in_view(parse(body)[0], "original", lambda e: e.get(W + "author") == "Bob")
    assert "".join(t.text for t in root.iter(W + "t")) == "ab "
    table = read("<w:tbl><w:tr><w:trPr><w:ins w:id='1'/></w:trPr></w:tr><w:tr/><w:sdt><w:sdtContent><w:tr><w:trPr><w:del w:id='2'/></w:trPr></w:tr></w:sdtContent></w:sdt></w:tbl>")
    assert sorted(rows_in_view(table, "final")) == [False, True, True] and sorted(rows_in_view(table, "original")) == [False, True, True]
    assert parse(b"<a>" * 1000 + b"</a>" * 1000)[1].startswith("nested deeper")
