"""Packages that come whole need no shuffle of their text: plans hold no joins or windows, and the results are those of loose parts."""

import pytest
from builders import NS, body, formula, line, make, part

from vellum.operators import apparatus, compare, documents, house, layers, numbering, rounds
from vellum.plans import carried, layered, numbered, protocol

ORDERS = [(1, 7), (2, 8), (35, 9), (42, 9)]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def frame(spark, *rows):
    return spark.createDataFrame([(d, p, b) for d, p, b in rows], "doc string, part string, blob binary")


def test_exhibits_are_shifted_in_one_pass(spark, orders):
    text = plan(numbered.exhibits_shifted(spark, orders))
    assert text.count("MapInArrow") == 2 and "Join" not in text and "Aggregate" not in text, text


def test_notes_are_shifted_with_the_text(spark):
    notes = part("w:footnotes", make("w:footnote", line("See Table 2 and Table 1."), id=1))
    parts = frame(spark, ("d", "word/document.xml", body(line("Table 1. One"), line("Table 2. Two"))), ("d", "word/footnotes.xml", notes), ("d", "x.bin", b"x"), ("e", "word/footnotes.xml", notes))
    made = {(r["doc"], r["part"]): bytes(r["blob"]) for r in numbering.shift_exhibits(parts, "Table", 2, 3).collect()}
    assert b"See Table 5 and Table 1." in made["d", "word/footnotes.xml"] and b"Table 5. Two" in made["d", "word/document.xml"] and b"Table 1. One" in made["d", "word/document.xml"]
    assert made["d", "x.bin"] == b"x" and made["e", "word/footnotes.xml"] == notes


def test_house_glyphs_meet_in_one_join(spark, orders):
    text = plan(protocol.house_glyphs(spark, orders))
    assert text.count("Join") == 1 and "Aggregate" not in text, text


def test_math_glyphs_come_back_where_that_is_clear(spark):
    now = frame(spark, ("d", "word/document.xml", body(line(formula("a-b")), line(formula("c-d")))))
    was = frame(spark, ("d", "word/document.xml", body(line(formula("a−b")), line(formula("c−d")), line(formula("c-d")))))
    whole = documents.loose(house.restore_math_glyphs(documents.whole(now), was))
    for made in (house.restore_math_glyphs(now, was), whole):
        (blob,) = (bytes(r["blob"]).decode() for r in made.collect())
        assert "a−b" in blob and "c-d" in blob


def test_drawings_take_captions_without_joins(spark, orders):
    text = plan(apparatus.figures(carried.packages(spark, orders)))
    assert "Join" not in text and "Window" not in text, text
    assert "Join" not in plan(carried.figure_described(spark, orders))


def test_drawings_above_their_captions(spark):
    drawn = "<w:r><w:drawing/></w:r>"
    doc = body(line(drawn), line("Figure 1. A"), line("text"), line(drawn), line("Figure 2. B"))
    below = body(line(drawn), line("text"), line("Figure 1. A"), line(drawn))
    rows = apparatus.figures(frame(spark, ("a", "word/document.xml", doc), ("b", "word/document.xml", below))).collect()
    assert sorted((r["doc"], r["pos"], r["number"]) for r in rows) == [("a", 0, "1"), ("a", 3, "2"), ("b", 0, None), ("b", 3, "1")]


def test_notes_are_added_in_one_pass(spark, orders):
    text = plan(carried.notes_added(spark, orders))
    assert "Join" not in text and "Aggregate" not in text and text.count("MapInArrow") == 2, text


def test_house_is_tallied_in_one_pass(spark, orders):
    text = plan(protocol.house_applied(spark, orders))
    assert "Join" not in text and "Aggregate" not in text and text.count("MapInArrow") == 2, text


def test_tally_is_what_scope_and_audit_say(spark):
    size = lambda n: make("w:rPr", make("w:sz", val=n))
    style = lambda name, *inner, **more: f'<w:style w:type="{more.get("kind", "paragraph")}" w:styleId="{name}"{more.get("plus", "")}>{"".join(inner)}</w:style>'
    styles = f'<w:styles {NS}><w:docDefaults><w:rPrDefault>{size(20)}</w:rPrDefault></w:docDefaults>{style("Std", plus=chr(32) + "w:default=" + chr(34) + "1" + chr(34))}{style("Cap", size(24))}{style("Sub", make("w:basedOn", val="Cap"))}{style("Ch", size(30), kind="character")}</w:styles>'.encode()
    run = lambda text, props="": f"<w:r>{props}<w:t>{text}</w:t></w:r>"
    docs = {
        "a": body(line("Table 1. Std"), line("Table 2. Sub", style="Sub"), line(run("Note: x", make("w:rPr", make("w:rStyle", val="Ch")))), line(run("Note: y", size(20)), run("more"))),
        "b": body(line("Table 1. Cap", style="Cap"), line("prose")), "c": body(line("prose")),
    }
    parts = frame(spark, *((d, "word/document.xml", b) for d, b in docs.items()), ("a", "word/styles.xml", styles), ("b", "word/styles.xml", styles))
    found: dict = {}
    for r in house.audit(parts).collect():
        found[r["doc"]] = found.get(r["doc"], 0) + 1
    want = {r["doc"]: (r["captions"], r["notes"], r["equations"], found.get(r["doc"], 0)) for r in house.scope(parts).collect()}
    assert {r["doc"]: (r["captions"], r["notes"], r["equations"], r["left"]) for r in house.tally(parts).collect()} == want and want["a"][3]


def test_verdicts_need_two_joins_of_digests(spark, orders):
    text = plan(protocol.round_verdicts(spark, orders))
    assert text.count("Join") == 2 and "Aggregate" not in text, text


def test_verdicts_count_copies_and_losses(spark):
    mark = '<w:bookmarkStart w:id="1" w:name="M"/><w:bookmarkEnd w:id="1"/>'
    doc = lambda *texts: body(*(line(t) for t in texts))
    was = frame(spark, ("d", "word/document.xml", body(line("a"), line("a"), line(mark, "b"))), ("e", "word/document.xml", doc("x")))
    offered = frame(spark, ("d", "word/document.xml", doc("a", "a", "a", "b", "new", "new")))
    now = frame(spark, ("d", "word/document.xml", doc("a", "a", "a", "b", "new", "own")))
    got = {r["doc"]: (r["offered"], r["kept"], r["reverted"], r["authored"], r["lost"], r["outcome"]) for r in rounds.verdict(was, offered, now).collect()}
    assert got == {"d": (3, 2, 1, 1, 1, "accepted in part"), "e": (0, 0, 0, 0, 0, "nothing moved")}


def test_rewrites_are_found_without_a_group_a_document(spark, orders):
    text = plan(layers.build_overrides(*layered.sides(spark, orders)))
    assert "CoGroup" not in text and text.count("MapInArrow") == 3, text


def test_lists_change_as_paragraphs_do(spark):
    both = spark.createDataFrame([("d", ["a", "b", "c"], ["a", "x", "c", "d"])], "doc string, before array<string>, after array<string>")
    assert [(r["change"], r["before_pos"], r["after_pos"]) for r in compare.changed_lists(both).collect()] == [("changed", 1, 1), ("inserted", None, 3)]


def test_trees_are_written_as_the_library_writes_them():
    import xml.etree.ElementTree as ET

    from vellum.functions import wordml

    wordml.serialise(ET.Element("x"))
    blobs = [body(line("a &amp; &lt;b&gt; é"), line(formula("x"), style="Q")), b'<a b="&quot;1&#10;2"><c/>t<d xml:space="preserve"> </d> u</a>', b'<n:a xmlns:n="urn:no-prefix"><n:b/></n:a>']
    for blob in blobs:
        root = wordml.parse(blob)[0]
        assert wordml.serialise(root).partition(b"\n")[2] == ET.tostring(root, encoding="utf-8")
    assert wordml._written(wordml.parse(blobs[0])[0]) and wordml._written(wordml.parse(blobs[2])[0]) is None
