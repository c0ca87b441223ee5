import builders as B
import pytest
from pyspark.sql import functions as F

from vellum.functions import citations, wordml
from vellum.functions import text as T
from vellum.operators import compare, documents
from vellum.sources import packages, timings


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docx")
    merged = [["Harbour", "Boats"], ["Skagen", "0.47"], ['<w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + B.line("Counted June") + "</w:tc>"]]
    body = B.body(
        B.line("Introduction", style="Heading1"), B.line("We follow Smith et al. (2020) and others (Lee 2019; Roe and Doe 2001a, 2003)."),
        B.line("Kept ", B.added("new words "), B.removed("old "), "text."), B.line("Table 4. Boats by harbour"), B.grid(*merged),
        B.line(B.formula("x=y+1")), B.line("See note", '<w:r><w:footnoteReference w:id="1"/></w:r>', "<w:hyperlink w:anchor='gone'>" + B.piece("link") + "</w:hyperlink>"),
        B.line("References"), B.line("Smith, A. 2020. Title. Journal."), B.line("Unused, B. (2011). Other. Journal."),
    )
    (folder / "a.docx").write_bytes(B.archive(body, footnotes=B.footnotes(n1="The note here", n2="Nobody points at this")))
    (folder / "b.docx").write_bytes(B.archive(B.body(B.line("Only prose in here"))))
    (folder / "broken.docx").write_bytes(b"no archive")
    (folder / "bad.docx").write_bytes(B.archive(b"<w:document"))
    return packages.read_parts(spark, str(folder)).cache()


def named(frame):
    return frame.withColumn("doc", F.regexp_extract("doc", r"([^/]+)\.docx$", 1))


def test_packages_are_read_and_written_alike(spark, parts, tmp_path):
    assert [r["doc"] for r in named(parts.where("error IS NOT NULL")).collect()] == ["broken"]
    packages.write_packages(parts, f"file://{tmp_path}/out")
    back = packages.read_parts(spark, f"{tmp_path}/out")
    key = lambda f: sorted((r["doc"], r["part"], r["ord"], bytes(r["blob"])) for r in named(f.where("part IS NOT NULL")).collect())
    assert key(back) == key(parts)
    assert [(r["doc"], r["part"]) for r in named(documents.malformed(parts)).collect()] == [("bad", "word/document.xml")]


def test_both_sides_of_the_changes(parts):
    side = lambda v: [r["text"] for r in documents.blocks(parts, v).where("text LIKE 'Kept%'").collect()]
    assert side("final") == ["Kept new words text."]
    assert side("original") == ["Kept old text."]
    log = documents.revisions(parts).orderBy("seq").collect()
    assert [(r["kind"], r["author"], r["text"]) for r in log] == [("ins", "Ann", "new words "), ("del", "Bob", "old ")]


@pytest.mark.parametrize(
    ("body", "final", "original"),
    [
        (B.line("One ", mark="del") + B.line("two"), ["One two"], ["One ", "two"]),
        (B.line("One ", mark="ins") + B.line("two"), ["One ", "two"], ["One two"]),
        (B.line(B.added("all new"), mark="ins") + B.line("rest"), ["all new", "rest"], ["rest"]),
        ("<w:tbl><w:tr><w:trPr><w:del w:id='1'/></w:trPr><w:tc>" + B.line("a") + "</w:tc></w:tr><w:tr><w:tc>" + B.line("b") + "</w:tc></w:tr></w:tbl>", ["b"], ["a", "b"]),
        ("<w:p><w:moveFrom w:id='1'>" + B.piece("moved") + "</w:moveFrom></w:p><w:p><w:moveTo w:id='2'>" + B.piece("moved") + "</w:moveTo></w:p>", ["", "moved"], ["moved", ""]),
    ],
)
def test_views_of_marks_rows_and_moves(body, final, original):
    for view, want in (("final", final), ("original", original)):
        root = wordml.in_view(wordml.parse(B.body(body))[0], view)
        assert [wordml.text_of(p) for p in root.iter(wordml.W + "p")] == want
        assert not wordml.REVISION.search(wordml.serialise(root))


def test_property_snapshots_go_back():
    body = "<w:p><w:r><w:rPr><w:b/><w:rPrChange w:id='1'><w:rPr><w:i/></w:rPr></w:rPrChange></w:rPr><w:t>x</w:t></w:r></w:p>"
    shapes = {}
    for view in ("final", "original"):
        root = wordml.in_view(wordml.parse(B.body(body))[0], view)
        shapes[view] = [e.tag.removeprefix(wordml.W) for e in root.find(f".//{wordml.W}rPr")]
    assert shapes == {"final": ["b"], "original": ["i"]}


def test_a_clean_document_is_the_same_on_both_sides(parts):
    only = parts.where("doc LIKE '%/b.docx'")
    assert documents.blocks(only, "final").collect() == documents.blocks(only, "original").collect()
    assert compare.changed_paragraphs(documents.blocks(parts), documents.blocks(parts)).count() == 0


def test_word_counts_by_zone(parts):
    got = {r["doc"]: r.asDict() for r in named(documents.word_counts(documents.blocks(parts), documents.notes(parts))).collect()}
    want = {"headings": 1, "captions": 5, "tables": 6, "references": 11, "appendix": 0, "footnotes": 7, "equations": 1, "prose": 15 + 4 + 2}
    assert {k: v for k, v in got["a"].items() if k != "doc"} == want
    assert got["b"]["prose"] == 4


def test_grid_notes_links_and_lint(parts):
    grid = {(r["row"], r["gcol"]): r["text"] for r in documents.grid_rows(documents.cells(parts)).collect()}
    assert grid[(2, 0)] == grid[(2, 1)] == "Counted June" and grid[(1, 1)] == "0.47"
    assert [r["id"] for r in documents.orphan_notes(parts).collect()] == ["2"]
    assert [(r["anchor"], r["label"]) for r in documents.dangling_links(parts).collect()] == [("gone", "link")]
    assert documents.lint(parts).count() == 0
    bad = B.body("<w:p><w:r><w:t> edge</w:t></w:r><w:pPr/></w:p>", "<w:del w:id='4'><w:p/></w:del>", "<w:ins w:id='4'/>", "<w:p><w:del w:id='5'>" + B.piece("x") + "</w:del></w:p>")
    codes = {f["code"] for f in wordml.lint(wordml.parse(bad)[0])}
    assert codes == {"edge-space", "properties-not-first", "block-in-revision", "repeated-revision-id", "text-in-deletion"}


def test_citations_against_the_list(parts):
    rows = documents.blocks(parts).where("kind <> 'cell'").select("doc", "pos", "text")
    cites, entries = citations.citations(rows.where("text NOT LIKE 'Unused%'")), citations.reference_entries(rows)
    assert sorted(r["key"] for r in cites.collect()) == ["lee_2019", "roe_2001a", "roe_2003", "smith_2020"]
    found = {(r["finding"], r["key"]) for r in citations.cross_check(cites, entries).collect()}
    assert found == {("missing-ref", "lee_2019"), ("missing-ref", "roe_2001a"), ("missing-ref", "roe_2003"), ("uncited-ref", "unused_2011")}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("as von Thule (2013) and Guild of Weavers (2014) found", [("von Thule", "2013"), ("Guild of Weavers", "2014")]),
        ("Curiously, Odell's (1967, p. 30) tide", [("Odell's", "1967")]),
        ("(compare Falk 1971, 1983; Ørsted 2006, 17)", [("Falk", "1971"), ("Falk", "1983"), ("Ørsted", "2006")]),
        ("Holm and Quist (2015, 1066) wrote", [("Holm and Quist", "2015")]),
        ("in 2012 nothing (of 1999) was", []), ("no years at all (Smith)", []),
    ],
)
def test_citation_grammar(text, want):
    found = citations.citations_in(text)
    assert [(c["authors"], c["year"]) for c in found] == want
    assert all(a["stop"] <= b["start"] for a, b in zip(found, found[1:], strict=False))


def test_alignment_finds_changes_and_moves():
    before = ["a paragraph that is moved about", "the second one stays", "first words of it", "tail"]
    after = ["the second one stays", "first words of this", "tail", "a paragraph that was moved about", "and one more"]
    assert compare.align(before, after) == [("moved", 0, 3), ("changed", 2, 1), ("inserted", None, 4)]
    assert compare.align(before, before) == []


def test_text_columns(spark):
    xml = '<w:p><w:r><w:t> a &amp;lt; b</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><m:t>x</m:t><w:t/></w:p>'
    row = spark.createDataFrame([(xml, 'don\'t say "no" or \'x', "Anna Maria de Lopez")], "x string, q string, n string").select(
        T.visible_text(F.col("x")).alias("v"), T.delta_text(F.col("x")).alias("d"), T.preserve_space(F.col("x")).alias("p"), T.smarten(F.col("q")).alias("q"), T.initials(F.col("n")).alias("i")
    ).first()
    assert row["v"] == " a &lt; bx" and row["d"] == " a &lt; bgonex"
    assert row["p"].count('xml:space="preserve"') == 1 and T is not None
    assert row["q"] == "don’t say “no” or 'x" and row["i"] == "AMDL"


def test_markdown(parts):
    md = {r["doc"]: r["markdown"] for r in named(documents.to_markdown(documents.blocks(parts), documents.cells(parts))).collect()}["a"]
    assert md.startswith("# Introduction\n\nWe follow") and "**Table 4. Boats by harbour**\n\n| Harbour | Boats |\n| --- | --- |\n| Skagen | 0.47 |" in md and "$$x=y+1$$" in md


def test_timings_survive_torn_lines(spark, tmp_path):
    rows = [("gate", f"r{i}", f"2026-01-{i:02}", "ok", [("pytest", float(i), "ok"), ("lint", 1.0, "failed")], None) for i in range(1, 8)]
    timings.record(spark.createDataFrame(rows, "kind string, name string, at string, outcome string, steps array<struct<name:string,seconds:double,status:string>>, sweeps boolean"), str(tmp_path / "t"))
    (tmp_path / "t" / "torn.json").write_text('{"kind": "gate", "steps": [{"na')
    steps = timings.steps(timings.read(spark, str(tmp_path / "t"), "gate"))
    from vellum.operators.windows import regressions

    assert steps.count() == 7
    got = regressions(steps, "name", "seconds", ["at"]).collect()
    assert [(r["name"], r["was"], r["now"], r["samples"]) for r in got] == [("pytest", 2.5, 6.0, 7)]
