"""What one document decides is read in one pass: no joins, whose sides an estimate may take for small, and no second parse."""

import pytest

from vellum.functions import wordml
from vellum.operators import apparatus, linkage, numbering
from vellum.plans import linked, numbered

ORDERS = [(1, 7), (2, 8), (30, 9)]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def one_pass(frame) -> None:
    text = plan(frame)
    assert text.count("MapInArrow") == 1 and "Join" not in text and "Window" not in text and "Aggregate" not in text, text


@pytest.mark.parametrize("audit", [numbering.exhibits, numbering.mention_of, numbering.fit_audit, numbering.place_exhibits])
def test_exhibits_need_one_pass(spark, orders, audit):
    one_pass(audit(numbered.packages(spark, orders)))


@pytest.mark.parametrize("audit", [linkage.audit_links, linkage.check_citations, linkage.link_plan, linkage.link_stats, linkage.link_rest])
def test_citation_links_need_one_pass(spark, orders, audit):
    one_pass(audit(linked.manuscripts(spark, orders)))


@pytest.mark.parametrize("audit", [linkage.exhibit_plan, linkage.exhibit_audit, linkage.link_exhibits])
def test_links_of_exhibits_need_one_pass(spark, orders, audit):
    one_pass(audit(linked.exhibits(spark, orders)))


def test_captions_of_one_name_place_each_block_once(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    texts = ["Table 1 says so.", "Between.", "Table 1. One", "Table 1. Two"]
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts)
    parts = spark.createDataFrame([("d", "word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>".encode())], "doc string, part string, blob binary")
    assert sorted((r["at"], r["place"]) for r in numbering.place_exhibits(parts).collect()) == [(0, 0), (1, 3), (2, 1), (3, 2)]


def test_edits_run_once_below_a_filter(spark, orders):
    text = plan(numbering.fit_audit(numbering.keep_exhibits_together(numbered.packages(spark, orders))))
    assert text.count("MapInArrow") == 2 and "ArrowEvalPython" not in text, text


def test_orders_are_dealt_out(spark, orders):
    assert numbered.packages(spark, orders).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_few_tags_are_not_measured_and_deep_ones_are():
    assert wordml.parse(b"<a><b/></a>")[0] is not None
    assert wordml.parse(b"<a>" * 401 + b"</a>" * 401)[1] == "nested deeper than 400"
    assert wordml.parse(b"<a>" + b"<b/>" * 900 + b"</a>")[0] is not None


def test_edit_part_keeps_other_parts_and_columns(spark):
    rows = [("d", "x.xml", 1, bytearray(b"<a/>")), ("d", "y.xml", 2, bytearray(b"<a/>")), ("d", None, 3, None), ("e", "x.xml", 4, bytearray(b"<a")), ("f", "x.xml", 5, None)]
    parts = spark.createDataFrame(rows, "doc string, part string, ord int, blob binary")
    made = {r["ord"]: r["blob"] for r in apparatus.edit_part(parts, "x.xml", lambda root: root.set("k", "v")).collect()}
    assert b'k="v"' in bytes(made.pop(1)) and made == {2: bytearray(b"<a/>"), 3: None, 4: bytearray(b"<a"), 5: None}
