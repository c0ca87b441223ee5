import builders as B
import pytest
from pyspark.sql import functions as F

from vellum.functions import editing
from vellum.operators import audits, documents


def rows(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, pos int, text string")


def findings(frame):
    return sorted((r["pos"], r["finding"]) for r in frame.collect())


def test_prose_rules(spark):
    got = audits.prose_style(rows(spark, "As said (Smith, 2020) and more", "Lee et al (2019) say", "see p.45 or pp. 45-48", "Roe & Doe (2001) too", "Clean (Smith 2020, pp. 45–48), Lee et al. (2019)"))
    assert findings(got) == [(0, "year-comma"), (1, "et-al-period"), (2, "page-dash"), (2, "page-space"), (3, "ampersand")]


def test_entry_rules(spark):
    good = "Smith, A., and B. Lee. (2020). A title. Journal, 12 (3): 1–20. https://doi.org/10.1/a-1-2"
    got = audits.entry_style(rows(spark, good, "Smith, A. 2020. A title. Journal, 3: 1–2.", "Smith, A. & B. Lee. (2020). T.", "Smith, A. and B. Lee. (2020). T.", "Smith, A. (2020). T. Journal 12: 3–4.", "Smith, A. (2020). T. Journal, 12: 30-40, 50-60."))
    assert findings(got) == [(1, "year-parens"), (2, "ampersand"), (3, "and-comma"), (4, "journal-comma"), (5, "en-dash")]


def blocks(spark, *pairs):
    return spark.createDataFrame([("d", i, k, t) for i, (k, t) in enumerate(pairs)], "doc string, pos int, kind string, text string")


def test_captions_and_cross_references(spark):
    caps = audits.captions(blocks(spark, ("caption", "Table 1. A"), ("caption", "Table 3. B"), ("caption", "Figure 1. C"), ("caption", "Figure 1. D"), ("paragraph", "Table 9 is")))
    assert findings(audits.caption_numbers(caps)) == [(1, "number-out-of-order"), (2, "repeated-number"), (3, "repeated-number")]
    names = spark.createDataFrame([("d", n) for n in ("Table1", "Table1txt", "Table3")], "doc string, name string")
    links = spark.createDataFrame([("d", a) for a in ("Table1", "Table1txt", "Figure7")], "doc string, anchor string")
    got = {(r["finding"], r["subject"]) for r in audits.cross_references(caps, names, links).collect()}
    assert got == {("linked", "Table1"), ("caption-only", "Table3"), ("unlinked", "Figure1"), ("dangling", "Figure7")}


def test_sections(spark):
    own = blocks(spark, ("heading", "1 One"), ("heading", "1.1 Sub"), ("heading", "1.3 Sub"), ("heading", "2 Two"), ("heading", "3.1 Astray"), ("heading", "2 Two again"), ("paragraph", "See Section 1.1 and section 7."))
    heads = audits.sections(own)
    got = findings(audits.section_numbers(heads))
    assert (2, "out-of-sequence") in got and (4, "parent-mismatch") in got and (5, "number-twice") in got and not [g for g in got if g[0] in (0, 1, 3)]
    assert [(r["subject"]) for r in audits.section_mentions(own.where("kind = 'paragraph'"), heads).collect()] == ["7"]
    assert audits.section_mentions(own, heads.limit(0)).count() == 0


def test_comments_and_notes(spark):
    rows = [("1", "Ann", "Fix  this", 4), ("2", "Ann", "Fix this ", 4), ("3", "Bob", "Fix this", 4), ("4", "Ann", " ", 4), ("5", "Ann", " ", 4), ("6", "Ann", "Fix\tthis", 9), ("7", "Ann", "Fix this", None), ("8", "Ann", "Fix this", 9), ("9", "Cy", "Here", None), ("10", "Cy", "Here", 3)]
    comments = spark.createDataFrame([("d", *r) for r in rows], "doc string, id string, author string, text string, anchor int")
    assert sorted(int(r["id"]) for r in audits.repeated_comments(comments).collect()) == [2, 7, 8, 10]
    refs = spark.createDataFrame([("d", "1", 5), ("d", "2", 3), ("d", "3", 9), ("e", "1", 1)], "doc string, id string, pos int")
    assert sorted((r["id"], r["should"]) for r in audits.note_order(refs).collect()) == [("1", 2), ("2", 1)]


P = "<w:p><w:pPr><w:pStyle w:val=\"Body\"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t xml:space=\"preserve\">Bold start </w:t></w:r><w:r><w:t>and plain end.</w:t></w:r></w:p>"


def test_edits_keep_runs_and_formatting():
    made = editing.replace_in_para(P, "start and", "begin &")
    assert editing.text(made) == "Bold begin & plain end." and made.count("<w:r>") == 2 and "<w:b />" in made
    italic = editing.style_in_para(P, "start and", "italic")
    assert editing.text(italic) == editing.text(P) and italic.count("<w:i />") == 2 and italic.count("<w:r>") == 4
    assert editing.style_in_para(italic, "start and", "italic").count("<w:i />") == 2
    one, two = editing.split_para(P, "plain")
    assert (editing.text(one), editing.text(two)) == ("Bold start and ", "plain end.") and two.count("w:pStyle") == 1
    assert editing.text(editing.merge_paras(one, two, "")) == editing.text(P)
    assert editing.text(editing.insert_in_para(P, 5, "new ")) == "Bold new start and plain end."


@pytest.mark.parametrize(
    ("fragment", "old", "why"),
    [(P, "absent", "isn't there"), (P, "t", "times"), ("<w:p><w:hyperlink w:anchor='a'><w:r><w:t>word</w:t></w:r></w:hyperlink></w:p>", "word", "link"), (f"<w:p>{B.formula('x')}</w:p>", "x", "equation")],
)
def test_edits_that_are_refused(fragment, old, why):
    with pytest.raises(editing.Refused, match=why):
        editing.replace_in_para(fragment, old, "new")


def test_links_are_undone():
    linked = "<w:p><w:r><w:t xml:space='preserve'>See </w:t></w:r><w:hyperlink w:anchor='a'><w:r><w:rPr><w:rStyle w:val='Hyperlink'/></w:rPr><w:t>this</w:t></w:r></w:hyperlink></w:p>"
    made = editing.remove_link(linked, "a")
    assert editing.text(made) == "See this" and "hyperlink" not in made.lower()


def test_a_batch_per_document(spark, tmp_path):
    from vellum.sources import packages

    (tmp_path / "a.docx").write_bytes(B.archive(B.body(B.line("the sail is red"), B.line("nothing changes here"), B.line("the hull is red"))))
    parts = packages.read_parts(spark, str(tmp_path))
    paragraphs = documents.paragraphs_of(parts).withColumn("doc", F.lit("a"))
    edits = spark.createDataFrame(
        [("a", 0, "one", "sail", "red", "blue"), ("a", 1, "two", "sail is blue", "is blue", "was blue"), ("a", 2, "three", "absent", "x", "y"), ("a", 3, "four", "hull", "red", "red")],
        "doc string, seq int, name string, sign string, old string, new string",
    )
    made, verdicts = documents.apply_edits(paragraphs, edits)
    assert [editing.text(r["xml"]) for r in made.orderBy("pos").collect()] == ["the sail was blue", "nothing changes here", "the hull is red"]
    assert [(r["name"], r["ok"]) for r in verdicts.orderBy("seq").collect()] == [("one", True), ("two", True), ("three", False), ("four", False)]
    before, after = (f.agg(*(F.sum(audits.invariants(F.col("xml"))[c]).alias(c) for c in ("bookmarks", "links", "notes", "rows"))).first() for f in (paragraphs, made))
    assert before == after


def test_entries_that_have_to_move():
    import itertools

    assert audits.misfiled([1, 2, 9, 3, 4]) == [2] and audits.misfiled([]) == [] and audits.misfiled([2, 2, 2]) == []
    for keys in itertools.product(range(4), repeat=6):
        moved = audits.misfiled(list(keys))
        rest = [k for i, k in enumerate(keys) if i not in moved]
        longest = max(n for n in range(7) for c in itertools.combinations(keys, n) if list(c) == sorted(c))
        assert rest == sorted(rest) and len(rest) == longest
