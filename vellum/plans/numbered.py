"""Queries of printed numbers, sections and exhibits' places, on manuscripts written from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import documents, linkage, numbering
from vellum.plans.redlines import DOC, NS, run, x
from vellum.plans.registry import Registry, orders

REGISTRY = Registry()
query = REGISTRY.query

NUMBERING = (
    f'<w:numbering {NS}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>'
    '<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2)"/></w:lvl></w:abstractNum>'
    '<w:abstractNum w:abstractNumId="2"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="*"/></w:lvl></w:abstractNum>'
    '<w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num><w:num w:numId="6"><w:abstractNumId w:val="2"/></w:num></w:numbering>'
)


def packages(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """``(doc, part, blob)``: a numbered list, typed section numbers with faults by the key, mentions, and a table and a figure with captions."""
    k = F.col("o_orderkey")
    item = lambda level, text, num=5: x(f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr></w:pPr>', run(text), "</w:p>")
    head = lambda level, text: x(f'<w:p><w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>', run(text), "</w:p>")
    para = lambda *inner: x("<w:p>", *inner, "</w:p>")
    third = F.when(k % 3 == 0, "4 Late").otherwise("3 Late")
    said = F.when(k % 4 == 0, "See Sections 2 to 1.").otherwise(F.when(k % 4 == 1, "See Section 9.").otherwise("See Section 1.1."))
    bound = F.when(k % 2 == 0, '<w:pPr><w:keepNext/></w:pPr>').otherwise("")
    split = F.when(k % 5 == 0, "").otherwise("<w:trPr><w:cantSplit/></w:trPr>")
    cell = lambda t: f"<w:tc><w:p><w:pPr><w:keepNext/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    grid = x("<w:tbl><w:tr>", split, cell("a"), "</w:tr><w:tr><w:trPr><w:cantSplit/></w:trPr>", cell("b"), "</w:tr></w:tbl>")
    mark = '<w:bookmarkStart w:id="4" w:name="Table2"/><w:bookmarkEnd w:id="4"/>'
    body = x(
        f"<w:document {NS}><w:body>", head(1, "1 Start"), head(2, "1.1 Inner"), head(1, "2 Middle"), head(1, third), para(run(said)), item(0, "one"), item(1, "in"), item(1, "side"), item(0, "two"), item(1, "anew"), item(0, "dot", 6),
        para(run("As Table 2 and Figure 1 show, and Tables 2 and 3.")), para(run("Between.")), x("<w:p>", bound, mark, run("Table 2. Things"), "</w:p>"), grid, para(run("Note: counted by us.")), para(run("Figure 1. A view")), "<w:p><w:r><w:drawing/></w:r></w:p>",
        "</w:body></w:document>",
    )
    made = F.array(F.struct(F.lit("word/document.xml").alias("part"), body.cast("binary").alias("blob")), F.struct(F.lit("word/numbering.xml").alias("part"), F.lit(NUMBERING).cast("binary").alias("blob")))
    packed = orders(spark, sf_dir).select(k.cast("string").alias("doc"), made.alias("rows"))
    return packed if whole else documents.loose(packed)


@query(f"SELECT {DOC}, pos, level, number FROM orders, (VALUES (5, 0, '1.'), (6, 1, '1.a)'), (7, 1, '1.b)'), (8, 0, '2.'), (9, 1, '2.a)')) v(pos, level, number)")
def list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lists print before their paragraphs; bullets print nothing."""
    return numbering.list_numbers(packages(spark, sf_dir))


@query(f"SELECT {DOC}, pos, number, title FROM orders, (VALUES (0, '1', 'Start'), (1, '1.1', 'Inner'), (2, '2', 'Middle')) v(pos, number, title) UNION ALL SELECT {DOC}, 3, CASE WHEN o_orderkey % 3 = 0 THEN '4' ELSE '3' END, 'Late' FROM orders")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.headings(packages(spark, sf_dir)).select("doc", "pos", "number", "title")


@query(
    f"""
    SELECT {DOC}, 3 AS pos, 'out-of-sequence' AS finding, '4' AS subject FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT {DOC}, 4, 'range-not-ascending', '2 to 1' FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT {DOC}, 4, 'no-such-section', '9' FROM orders WHERE o_orderkey % 4 = 1
    """
)
def section_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers out of turn, mentions of what isn't there, and ranges that don't ascend."""
    return numbering.section_audit(packages(spark, sf_dir))


@query(f"SELECT {DOC}, '1,1.1,2,3' AS numbers FROM orders")
def sections_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section numbers once their gaps are closed."""
    heads = numbering.headings(numbering.renumber_sections(packages(spark, sf_dir)))
    return heads.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number"))), lambda h: h["number"]), ",").alias("numbers"))


@query(f"SELECT {DOC}, 'Table 5. Things' AS caption, 'As Table 5 and Figure 1 show, and Tables 5 and 3.' AS said, 'Table5' AS mark FROM orders")
def exhibits_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions, mentions and bookmarks of tables from the second on, moved by three."""
    found = linkage.outlines(numbering.shift_exhibits(packages(spark, sf_dir, whole=True), "Table", 2, 3))
    like = lambda start: F.explode(F.filter("texts", lambda t: t.like(start)))
    captions = found.select("*", like("Table%").alias("caption"))
    return captions.select("*", like("As %").alias("said")).select("doc", "caption", "said", F.explode("marks").alias("mark"))


@query(f"SELECT {DOC}, 13 AS pos, 'number-out-of-order' AS finding, 'Table 2' AS subject FROM orders")
def exhibit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables numbered out of turn, and mentions of tables that aren't there."""
    return numbering.exhibit_numbers(packages(spark, sf_dir), "Table")


@query(f"SELECT {DOC}, name, caption_at, body_at, start, stop FROM orders, (VALUES ('Table2', 13, 14, 13, 15), ('Figure1', 16, 17, 16, 17)) v(name, caption_at, body_at, start, stop)")
def exhibit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that each exhibit owns: caption, body and the notes below."""
    return numbering.exhibits(packages(spark, sf_dir)).select("doc", "name", "caption_at", "body_at", "start", "stop")


@query(f"SELECT {DOC}, name, 11 AS at FROM orders, (VALUES ('Table2'), ('Figure1')) v(name)")
def exhibit_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block outside its own span that mentions an exhibit."""
    return numbering.mention_of(packages(spark, sf_dir))


@query(
    f"""
    SELECT {DOC}, 'Table2' AS name, 'caption-unbound' AS finding FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT {DOC}, 'Figure1', 'caption-unbound' FROM orders
    UNION ALL SELECT {DOC}, 'Table2', 'row-may-split' FROM orders WHERE o_orderkey % 5 = 0
    """
)
def exhibit_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exhibits that a page break may part."""
    return numbering.fit_audit(packages(spark, sf_dir))


@query(f"SELECT {DOC}, 'Figure1' AS name, 'caption-unbound' AS finding FROM orders")
def exhibits_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page break may still part once tables are kept together."""
    return numbering.fit_audit(numbering.keep_exhibits_together(packages(spark, sf_dir)))


@query(f"SELECT {DOC}, CAST(b AS INTEGER) AS \"at\", CAST(CASE WHEN b <= 11 THEN b WHEN b = 12 THEN 17 ELSE b - 1 END AS INTEGER) AS place FROM orders, (SELECT unnest(range(0, 18)) AS b)")
def exhibits_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with exhibits moved behind their first mention."""
    return numbering.place_exhibits(packages(spark, sf_dir))
