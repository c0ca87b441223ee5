"""Queries of the gates: originals, clean copies and redlines written from orders, each kind of fault in its own share of them.

A document has a heading, a paragraph, a table, a marked paragraph with an equation and a last one.  By
the order's key modulo six its redline holds: a tracked insertion, a change without a mark, a bookmark
gone, one put in, another cell look and column width, or a tracked deletion of the last words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import markup, wordml
from vellum.operators import documents, gates
from vellum.plans.registry import Registry, orders, table

REGISTRY = Registry()
query = REGISTRY.query

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
ANN, BOB = ('w:id="{}" w:author="' + a + '" w:date="2026-01-01T00:00:00Z"' for a in ("Ann", "Bob"))


def x(*pieces: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in pieces))


def run(text: Column | str, tag: str = "t") -> Column:
    return x(f'<w:r><w:{tag} xml:space="preserve">', text, f"</w:{tag}></w:r>")


def packages(spark: SparkSession, sf_dir: str, kind: str, whole: bool = False) -> DataFrame:
    """``(doc, part, blob)`` of all originals, clean copies or redlines."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    m, red, clean = k % 6, kind == "redline", kind == "clean"
    when = lambda n, a, b: F.when(m == n, a).otherwise(b)
    nothing = F.lit("")
    first = run(x("First ", c, "."))
    if red:
        first = when(0, x(first, f"<w:ins {ANN.format(1)}>", run(" more"), "</w:ins>"), when(1, run(x("Changed ", c, ".")), first))
    elif clean:
        first = when(0, run(x("First ", c, F.when(k % 12 == 0, ". MORE").otherwise(". more"))), when(1, run(x("Changed ", c, ".")), first))
    look = when(4, x('<w:tcPr><w:vAlign w:val="center"/></w:tcPr>'), nothing) if red else nothing
    width = when(4, F.lit("900"), F.lit("800")) if red else F.lit("800")
    cells = x('<w:tbl><w:tblGrid><w:gridCol w:w="', width, '"/></w:tblGrid><w:tr><w:tc><w:p>', run("a"), "</w:p></w:tc><w:tc>", look, "<w:p>", run(x("b", c)), "</w:p></w:tc></w:tr></w:tbl>")
    bookmark = lambda name, n: x(f'<w:bookmarkStart w:id="{n}" w:name="', name, f'"/><w:bookmarkEnd w:id="{n}"/>')
    own = bookmark(x("M", c), 5)
    extra = bookmark(x("N", c), 6)
    marks = own
    if red:
        marks = when(2, nothing, when(3, x(own, extra), own))
    elif clean:
        marks = when(3, F.when(k % 4 == 3, x(own, extra)).otherwise(own), own)
    value = when(1, F.lit("-0.20398"), F.lit("-0.398")) if red else F.lit("-0.398")
    marked = x("<w:p>", marks, run("kept "), "<m:oMath><m:r><m:t>", value, "</m:t></m:r></m:oMath></w:p>")
    link = x('<w:hyperlink w:anchor="L', c, '">', run("see"), "</w:hyperlink>")
    last = x(run(x("Last ", c, ".")), link)
    if red:
        last = when(5, x(f"<w:del {BOB.format(2)}>", run(x("Last ", c, "."), "delText"), "</w:del>", f"<w:del {BOB.format(3)}>", x('<w:hyperlink w:anchor="L', c, '">', run("see", "delText"), "</w:hyperlink>"), "</w:del>"), last)
    elif clean:
        last = when(5, link, last)
    body = x(f"<w:document {NS}><w:body>", '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>', run(x("Title ", c)), "</w:p><w:p>", first, "</w:p>", cells, marked, "<w:p>", last, "</w:p></w:body></w:document>")
    title = x('<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>T', c, "</dc:title></cp:coreProperties>")
    bare = x('<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title></dc:title></cp:coreProperties>')
    core = F.when(k % 7 == 0, bare).otherwise(title) if red else title
    comments = x(f"<w:comments {NS}>", F.when(k % 2 == 0, x('<w:comment w:id="1" w:author="Cy" w:initials="C"><w:p>', run("why"), "</w:p></w:comment>")).otherwise(nothing), "</w:comments>")
    parts = [("word/document.xml", body), ("docProps/core.xml", core), ("word/comments.xml", comments)]
    made = F.array(*(F.struct(F.lit(p).alias("part"), b.cast("binary").alias("blob")) for p, b in parts))
    header = F.struct(F.lit("word/header1.xml").alias("part"), x(f"<w:hdr {NS}/>").cast("binary").alias("blob"))
    made = F.when((k % 5 == 0) & F.lit(red), made).otherwise(F.concat(made, F.array(header)))
    packed = orders(spark, sf_dir).select(k.cast("string").alias("doc"), made.alias("rows"))
    return packed if whole else documents.loose(packed)


DOC = "CAST(o_orderkey AS VARCHAR) AS doc"


@query(f"SELECT {DOC}, 'changed' AS change, 'Changed ' || o_custkey || '.' AS now, 'First ' || o_custkey || '.' AS should FROM orders WHERE o_orderkey % 6 = 1")
def gate_untracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that rejecting everything doesn't give back: changed without a mark."""
    found = gates.untracked(packages(spark, sf_dir, "redline"), packages(spark, sf_dir, "original"))
    return found.select("doc", "change", F.col("before").alias("now"), F.col("after").alias("should"))


@query(
    f"""
    SELECT {DOC}, 'First ' || o_custkey || '. more' AS now, 'First ' || o_custkey || '. MORE' AS should FROM orders WHERE o_orderkey % 12 = 0
    UNION ALL SELECT {DOC}, '', 'see' FROM orders WHERE o_orderkey % 6 = 5
    """
)
def gate_unaccepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that accepting everything doesn't give as the clean copy has them."""
    found = gates.unaccepted(packages(spark, sf_dir, "redline"), packages(spark, sf_dir, "clean"))
    return found.select("doc", F.col("before").alias("now"), F.col("after").alias("should"))


@query(
    f"""
    SELECT {DOC}, CAST(CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS insertions, CAST(CASE WHEN o_orderkey % 6 = 5 THEN 2 ELSE 0 END AS BIGINT) AS deletions,
           CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS comments, CAST(CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS BIGINT) AS revisions FROM orders
    """
)
def gate_package_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.package_counts(packages(spark, sf_dir, "redline"))


@query(f"SELECT {DOC}, 'word/document.xml' AS part, CAST(CASE o_orderkey % 6 WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS revisions FROM orders WHERE o_orderkey % 6 IN (0, 5)")
def gate_revisions_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.revisions_by_part(packages(spark, sf_dir, "redline"))


@query("SELECT kind, CAST(sum(n) AS BIGINT) AS revisions FROM (SELECT 'ins' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT 'del', 2 * count(*) FROM orders WHERE o_orderkey % 6 = 5) GROUP BY kind")
def gate_revision_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending revisions of all redlines, by kind."""
    return gates.revision_elements(packages(spark, sf_dir, "redline")).groupBy("kind").agg(F.count("*").alias("revisions"))


@query(
    f"""
    SELECT {DOC}, tag, CAST(n AS BIGINT) AS n FROM orders, (VALUES ('tbl', 1), ('tr', 1), ('tc', 2), ('sectPr', 0), ('drawing', 0), ('footnoteReference', 0)) t(tag, n)
    UNION ALL SELECT {DOC}, 'bookmarkStart', CASE o_orderkey % 6 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END FROM orders
    """
)
def gate_structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.structure_counts(packages(spark, sf_dir, "redline"))


@query(f"SELECT {DOC}, 'bookmarkStart' AS tag, CAST(1 AS BIGINT) AS was, CAST(CASE o_orderkey % 6 WHEN 2 THEN 0 ELSE 2 END AS BIGINT) AS now FROM orders WHERE o_orderkey % 6 IN (2, 3)")
def gate_structure_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.structure_diff(packages(spark, sf_dir, "original"), packages(spark, sf_dir, "redline"))


@query(f"SELECT {DOC}, 'N' || o_custkey AS name, CAST(1 AS BIGINT) AS times FROM orders WHERE o_orderkey % 6 = 3 AND o_orderkey % 4 = 3")
def gate_bookmark_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.bookmark_additions(packages(spark, sf_dir, "original"), packages(spark, sf_dir, "clean"))


@query(
    f"""
    SELECT {DOC}, 'lost' AS finding, 'M' || o_custkey AS name, CAST(1 AS BIGINT) AS was, CAST(0 AS BIGINT) AS now FROM orders WHERE o_orderkey % 6 = 2
    UNION ALL SELECT {DOC}, 'gained', 'N' || o_custkey, 0, 1 FROM orders WHERE o_orderkey % 6 = 3 AND o_orderkey % 4 <> 3
    """
)
def gate_bookmark_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks that rejecting loses, or gains without the clean copy having added them."""
    red = packages(spark, sf_dir, "redline")
    return gates.bookmark_changes(packages(spark, sf_dir, "original"), gates.rejected(red), packages(spark, sf_dir, "clean"))


@query(
    f"""
    SELECT {DOC}, 'part-lost' AS finding, 'word/header1.xml' AS subject FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT {DOC}, 'bookmark-dropped', 'M' || o_custkey FROM orders WHERE o_orderkey % 6 = 2
    UNION ALL SELECT {DOC}, 'property-lost', 'dc:title' FROM orders WHERE o_orderkey % 7 = 0
    """
)
def gate_collateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went on the way from the clean copies to the redlines."""
    return gates.compare_collateral(packages(spark, sf_dir, "clean"), packages(spark, sf_dir, "redline"))


@query(
    f"""
    SELECT {DOC}, 'bookmark-lost' AS finding, 'M' || o_custkey AS subject FROM orders WHERE o_orderkey % 6 = 2
    UNION ALL SELECT {DOC}, 'link-lost', 'L' || o_custkey FROM orders WHERE o_orderkey % 6 = 5
    """
)
def gate_accepted_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks and links that accepting the redlines doesn't give."""
    return gates.accepted_losses(packages(spark, sf_dir, "clean"), packages(spark, sf_dir, "redline"))


@query(f"SELECT {DOC}, 1 AS k, '-0.398' AS should, '-0.20398' AS now, 3 AS at FROM orders WHERE o_orderkey % 6 = 1")
def gate_accepted_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equations that accepting doesn't give, and where they part."""
    return gates.accepted_math(packages(spark, sf_dir, "clean"), packages(spark, sf_dir, "redline"))


@query(f'SELECT {DOC}, 0 AS "table", 0 AS "row", 1 AS cell FROM orders WHERE o_orderkey % 6 = 4')
def gate_cell_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.cell_property_changes(packages(spark, sf_dir, "original"), packages(spark, sf_dir, "redline"), "original")


@query(f'SELECT {DOC}, 1 AS "table" FROM orders WHERE o_orderkey % 6 = 4')
def gate_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.width_changes(packages(spark, sf_dir, "original"), packages(spark, sf_dir, "redline"))


@query(f"SELECT {DOC}, CASE o_orderkey % 7 WHEN 0 THEN '' ELSE 'T' || o_custkey END AS value FROM orders")
def core_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.core_property(packages(spark, sf_dir, "redline"), "dc:title")


@query(
    f"""
    SELECT {DOC}, 'Ann' AS author, CAST(1 AS BIGINT) AS times FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT {DOC}, 'Bob', 2 FROM orders WHERE o_orderkey % 6 = 5
    UNION ALL SELECT {DOC}, 'Cy', 1 FROM orders WHERE o_orderkey % 2 = 0
    """
)
def credited_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.read_authors(packages(spark, sf_dir, "redline"))


@query("SELECT author, CAST(sum(n) AS BIGINT) AS times FROM (SELECT 'D & E' AS author, count(*) AS n FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT 'D & E', count(*) FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'Bob', 2 * count(*) FROM orders WHERE o_orderkey % 6 = 5) GROUP BY author")
def credited_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is credited once two authors' changes and comments are another's."""
    made = gates.set_author(packages(spark, sf_dir, "redline"), "D & E", "DE", ("Ann", "Cy"))
    counted = gates.read_authors(made).groupBy("author").agg(F.sum("times").alias("times"))
    return counted.select(F.replace("author", F.lit("&amp;"), F.lit("&")).alias("author"), "times")


@query(
    f"""
    SELECT {DOC}, CAST(CASE WHEN o_orderkey % 6 = 5 THEN 2 ELSE 0 END AS BIGINT) AS pending,
           CASE WHEN o_orderkey % 6 = 1 THEN 'Changed ' || o_custkey || '.' ELSE 'First ' || o_custkey || CASE WHEN o_orderkey % 6 = 0 THEN '. more' ELSE '.' END END AS text FROM orders
    """
)
def accepted_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redlines with one author's changes accepted: what is still pending, and how the first paragraph reads."""
    seen = gates.in_view(packages(spark, sf_dir, "redline"), "final", wordml.by_author("Ann")).where("part = 'word/document.xml'")
    left = seen.select("doc", F.regexp_count(F.col("blob").cast("string"), F.lit(gates.REVISION)).cast("long").alias("pending"))
    first = gates.paragraph_texts(seen).where("pos = 1").select("doc", "text")
    return left.join(first, "doc")


@query(f"SELECT {DOC}, 'Last ' || o_custkey || '.see' AS was, 'see' AS now FROM orders WHERE o_orderkey % 6 = 5")
def gate_final_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last paragraphs that rejecting can't bring back, where clean copies are handed in without any mark."""
    clean = packages(spark, sf_dir, "clean")
    return gates.final_paragraph_cause(clean, packages(spark, sf_dir, "original"), clean)


@query(f"SELECT {DOC}, 'M' || o_custkey AS name FROM orders WHERE o_orderkey % 6 <> 2")
def gate_inserted_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks of the originals that the redlines still hold."""
    return gates.inserted_only_bookmarks(gates.bookmark_names(packages(spark, sf_dir, "original")), packages(spark, sf_dir, "redline"))


@query(f"SELECT {DOC}, 'L' || o_custkey AS anchor, CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE 'see' END AS label, 'element' AS form FROM orders")
def redline_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the redlines with what they show; a deletion is no text."""
    return documents.internal_links(packages(spark, sf_dir, "redline")).select("doc", "anchor", "label", "form")


@query(
    f"""
    WITH p AS (SELECT {DOC}, 0 AS pos, 'Last ' || o_custkey || '.see' AS text FROM orders UNION ALL SELECT {DOC}, 1, 'Title ' || o_custkey FROM orders UNION ALL SELECT {DOC}, 2, 'First ' || o_custkey || '.' FROM orders
               UNION ALL SELECT {DOC}, 3, 'a' FROM orders UNION ALL SELECT {DOC}, 4, 'b' || o_custkey FROM orders UNION ALL SELECT {DOC}, 5, 'kept ' FROM orders)
    SELECT doc, CASE pos WHEN 5 THEN 4 WHEN 0 THEN 5 ELSE pos - 1 END AS pos, text FROM p WHERE pos <> 2 AND pos <> 3 AND pos <> 4
    UNION ALL SELECT doc, CASE pos WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 2 END, text FROM p WHERE pos IN (2, 3, 4)
    """
)
def moved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their first paragraph moved behind the table's last cell."""
    texts = gates.paragraph_texts(packages(spark, sf_dir, "original"))
    texts = texts.withColumn("sign", F.when(F.col("text").startswith("First"), "A").when(F.col("text").startswith("b"), "C").otherwise("-"))
    marked = texts.select("doc", "pos", F.concat("sign", "text").alias("text"))
    out = gates.expected_after_move(marked, F.lit("AFirst"), F.lit("AFirst"), F.lit("Cb"))
    return out.select("doc", "pos", F.expr("substring(text, 2)").alias("text"))


@query(
    """
    SELECT p_partkey AS part, '<w:p><w:r/>' || p_name || '</w:p>' AS spliced, p_brand || '&quot;&lt;&amp;' AS attr, p_name || chr(9) || p_brand || chr(10) AS printed, p_name || p_brand AS editable,
           CAST(len(p_name) AS INTEGER) AS second_at, 'm,w' AS prefixes, p_partkey % 2 = 0 AS minted, CASE WHEN p_partkey % 3 = 0 THEN '_Ref' || p_partkey END AS clickable,
           CASE WHEN p_partkey % 3 < 2 THEN '_Ref' || p_partkey END AS depends, p_partkey % 2 = 0 AS holds, CAST(p_size AS DOUBLE) AS number
    FROM part
    """
)
def markup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of markup read by columns alone: splices, attributes, what is printed, runs, prefixes, references, numbers in prose."""
    k, name, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    xml = x('<w:p><w:pPr><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>', name, "</w:t><w:tab/></w:r><m:oMath><m:r><m:t></m:t></m:r></m:oMath><w:r><w:t>", brand, "</w:t><w:br/></w:r></w:p>")
    instruction = F.when(k % 3 == 0, x("REF _Ref", k.cast("string"), r" \h")).when(k % 3 == 1, x("REF _Ref", k.cast("string"), r" \* MERGEFORMAT")).otherwise("PAGEREF _Toc1")
    runs = markup.run_spans(xml)
    bare = F.when(k % 2 == 0, "<w:r><w:rPr><w:b/></w:rPr><w:tab/></w:r>").otherwise("<w:r><w:rPr><w:b/></w:rPr></w:r>")
    return table(spark, sf_dir, "part").select(
        k.alias("part"), F.replace(markup.append_before_close(x("<w:p><w:r/>", "</w:p>"), "w:p", name), F.lit("\u0000"), F.lit("")).alias("spliced"), markup.escape_attr(x(brand, '"<&')).alias("attr"),
        markup.printed_text(xml).alias("printed"), markup.editable_text(xml).alias("editable"), runs[1]["start"].alias("second_at"), F.array_join(markup.used_prefixes(xml), ",").alias("prefixes"),
        markup.word_minted(F.when(k % 2 == 0, x("_Ref", k.cast("string"))).otherwise(name)).alias("minted"), markup.ref_anchor(instruction).alias("clickable"), markup.ref_anchor(instruction, False).alias("depends"),
        markup.run_holds_content(bare).alias("holds"), markup.prose_numbers(x("of ", F.col("p_size").cast("string"), " men"))[0]["value"].alias("number"),
    )
