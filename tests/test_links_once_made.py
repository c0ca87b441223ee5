"""Links are planned, made and counted on one parse; documents of the same bytes are read once, and the counts are those of the written parts."""

import pytest
from builders import NS, body, line, piece
from pyspark.sql import functions as F

from vellum.operators import documents, linkage
from vellum.plans import linked

ORDERS = [(1, 7), (2, 8), (33, 9), (34, 9), (35, 9), (36, 1)]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


def test_links_are_counted_in_one_pass(spark, orders):
    text = linked.links_made(spark, orders)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1 and "Join" not in text and "Aggregate" not in text, text


@pytest.mark.parametrize("rest", [False, True])
def test_counts_are_those_of_the_written_parts(spark, orders, rest):
    link = lambda anchor, label: f'<w:hyperlink w:anchor="{anchor}">{piece(label)}</w:hyperlink>'
    long = "This paragraph is long enough to be read as prose and not as part of a title, as any reader sees at once. "
    odd = {
        "broken": b"<w:document",
        "empty": body(),
        "plain": body(line(long + "So (Sen 1999) and Sen (1999)."), line("References"), line("Sen, A. 1999. On.")),
        "field": body(line(f'<w:fldSimple w:instr=" HYPERLINK \\l Sen1999 ">{piece("Sen 1999")}</w:fldSimple>', long), line("References"), line("Sen, A. 1999. On.")),
        "inside": body(line(long, "(Sen ", "1999)"), line(link("x", link("y", "z"))), line("References"), line("Sen, A. 1999. On.")),
    }
    more = spark.createDataFrame([(d, p, b) for d, b in odd.items() for p in ("word/document.xml", "word/other.xml")] + [("none", "word/document.xml", None)], "doc string, part string, blob binary")
    parts = linked.manuscripts(spark, orders).unionByName(more)
    made = (linkage.link_rest if rest else linkage.link_all)(parts)
    want = linkage.places(made).where("kind = 'link'").groupBy("doc", F.col("name").alias("anchor")).agg(F.count("*").alias("links"))
    rows = lambda frame: sorted(tuple(r) for r in frame.collect())
    assert rows(linkage.links_once_made(parts, rest)) == rows(want) and len(rows(want)) > 30


def test_same_bytes_are_read_once():
    asked = []
    once = documents.Once(lambda b: asked.append(b) or b.decode())
    assert [once(b) for b in (b"a", b"b", b"a", b"b", b"a")] == ["a", "b", "a", "b", "a"] and asked == [b"a", b"b"]


def test_little_is_kept_and_nothing_where_nothing_comes_again():
    once = documents.Once(len)
    assert [once(str(i).encode()) for i in range(once.MANY + 1)][-1] == 4 and once.kept is None and once(b"1234") == 4
    large = documents.Once(len)
    for _ in range(9):
        assert large(b"a") == 1
    assert large(b"x" * large.ROOM) == large.ROOM and list(large.kept) == [b"x" * large.ROOM]
    assert large(b"y") == 1 and list(large.kept) == [b"y"] and large.room == 1


def test_marks_between_paragraphs_come_first():
    from vellum.functions import wiring, wordml

    mark = '<w:bookmarkStart w:id="1" w:name="out"/>'
    root = wordml.parse(f'<w:document {NS}><w:body><w:p/>{mark}<w:p><w:bookmarkStart w:id="2" w:name="in"/><w:bookmarkEnd w:id="1"/></w:p></w:body></w:document>'.encode())[0]
    assert [(p["name"], p["para"]) for p in wiring.places(root)] == [("out", -1), ("in", 1)]
