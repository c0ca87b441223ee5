import builders as B
from pyspark.sql import functions as F

from vellum.operators import compare, documents, snapshots
from vellum.sources import packages


def parts(spark, folder, body, **more):
    folder.mkdir(exist_ok=True)
    (folder / "a.docx").write_bytes(B.archive(body, **more))
    return packages.read_parts(spark, str(folder)).withColumn("doc", F.lit("a"))


def body(text="An untouched paragraph", maths="x−1", label="Table 1", mark="Table1"):
    link = f"<w:hyperlink w:anchor='{mark}'>{B.piece(label)}</w:hyperlink>"
    return B.body(B.line("First one of all"), B.line(text), B.line(B.formula(maths)), B.line("See ", link), f"<w:p><w:bookmarkStart w:id='1' w:name='{mark}'/>{B.piece('Table 1. Title')}<w:bookmarkEnd w:id='1'/></w:p>")


def buckets(report):
    return sorted({r["bucket"] for r in report.collect()})


def test_a_package_against_itself_and_others(spark, tmp_path):
    notes = B.footnotes(n1="A note")
    own = parts(spark, tmp_path / "x", body(), footnotes=notes)
    assert compare.compare_packages(own, own).count() == 0 and compare.is_clean(compare.compare_packages(own, own))
    for k, (other, want) in enumerate(
        [
            (dict(body=body(text="A touched paragraph"), footnotes=notes), ["text"]),
            (dict(body=body(maths="x-1"), footnotes=notes), ["formula-glyphs"]),
            (dict(body=body(maths="x−2"), footnotes=notes), ["formula"]),
            (dict(body=body(label="Table one"), footnotes=notes), ["links", "text"]),
            (dict(body=body(mark="Table2"), footnotes=notes), ["bookmarks", "links"]),
            (dict(body=body(), footnotes=B.footnotes(n1="Another note")), ["notes"]),
            (dict(body=body()), ["notes", "structure"]),
        ]
    ):
        found = compare.compare_packages(own, parts(spark, tmp_path / f"y{k}", **other))
        assert buckets(found) == want and not compare.is_clean(found)


def test_anchors(spark, tmp_path):
    own = parts(spark, tmp_path / "x", body(text="One “quoted” thing and one more"))
    anchors = spark.createDataFrame([("a", "1", "First one of"), ("a", "2", "one"), ("a", "3", "absent"), ("a", "4", 'One "quoted"')], "doc string, anchor string, text string")
    places = snapshots.numbered(documents.blocks(own))
    got = {r["anchor"]: (r["verdict"], r["place"]) for r in snapshots.resolve(places, anchors).collect()}
    assert got["1"] == ("found", "P1") and got["2"][0] == "ambiguous" and got["3"] == ("missing", None) and got["4"][0] == "missing"
    assert {r["anchor"]: r["verdict"] for r in snapshots.resolve(places, anchors, normalize=True).collect()}["4"] == "found"
