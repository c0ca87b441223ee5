"""Queries of the layers of a comparison, on manuscripts written from orders and changed by their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import documents, layers
from vellum.plans.redlines import DOC, NS, run, x
from vellum.plans.registry import Registry, orders, table

REGISTRY = Registry()
query = REGISTRY.query


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions ``(doc, part, blob)``: by the key modulo four the second makes words bold, rewrites a paragraph, loses a field and a bookmark's end, or renames a part and a picture."""
    k = F.col("o_orderkey")
    m, c = k % 4, F.col("o_custkey").cast("string")
    when = lambda n, a, b: F.when(m == n, a).otherwise(b)
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> REF Spot \\h </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>there</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    page = lambda n: f'<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>{n}</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    def version(new: bool) -> DataFrame:
        bold = when(0, x(run("plain "), "<w:r><w:rPr><w:b/></w:rPr><w:t>loud</w:t></w:r>"), run("plain loud")) if new else run("plain loud")
        said = when(1, run(x("New words ", c)), run(x("Old words ", c))) if new else run(x("Old words ", c))
        end = when(2, F.lit(""), F.lit('<w:bookmarkEnd w:id="1"/>')) if new else F.lit('<w:bookmarkEnd w:id="1"/>')
        spot = x('<w:bookmarkStart w:id="1" w:name="Spot"/>', run("here"), end)
        last = when(2, run("there"), F.lit(field)) if new else F.lit(field)
        body = x(f"<w:document {NS}><w:body><w:p>", bold, page(2 if new else 1), "</w:p><w:p>", said, "</w:p><w:p>", spot, last, "</w:p></w:body></w:document>")
        header = when(3, F.lit("word/header2.xml"), F.lit("word/header1.xml")) if new else F.lit("word/header1.xml")
        media = when(3, F.lit("word/media/image9.png"), F.lit("word/media/image1.png")) if new else F.lit("word/media/image1.png")
        parts = [(F.lit("word/document.xml"), body), (header, x(f"<w:hdr {NS}><w:p>", run(x("Running head of ", c)), "</w:p></w:hdr>")), (media, x("bytes", c))]
        made = F.array(*(F.struct(p.alias("part"), b.cast("binary").alias("blob")) for p, b in parts))
        return orders(spark, sf_dir).select(k.cast("string").alias("doc"), F.explode(made).alias("p")).select("doc", "p.*")

    return version(False), version(True)


@query(f"SELECT {DOC}, 0 AS pos, 6 AS start, 'loud' AS segment, '' AS was, 'bold' AS now FROM orders WHERE o_orderkey % 4 = 0")
def format_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches whose look changed; page numbers that a saving moved don't count."""
    return layers.fmt_diff(*sides(spark, sf_dir))


@query(f"SELECT {DOC}, 'REF Spot \\h' AS field, CAST(1 AS BIGINT) AS times FROM orders WHERE o_orderkey % 4 = 2")
def fields_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.stripped_fields(*sides(spark, sf_dir))


@query(f"SELECT {DOC}, 'no-end' AS finding, '1' AS subject FROM orders WHERE o_orderkey % 4 = 2")
def integrity_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.integrity(sides(spark, sf_dir)[1])


@query(
    f"""
    SELECT {DOC}, 'word/document.xml' AS before, 'word/document.xml' AS after FROM orders
    UNION ALL SELECT {DOC}, 'word/header1.xml', CASE WHEN o_orderkey % 4 = 3 THEN 'word/header2.xml' ELSE 'word/header1.xml' END FROM orders
    """
)
def parts_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of two versions that belong together, by name or by what they say."""
    before, after = (s.where("part LIKE 'word/%.xml'") for s in sides(spark, sf_dir))
    return layers.pair_parts(before, after)


@query(f"SELECT {DOC}, 'word/media/image1.png' AS was, 'word/media/image9.png' AS now FROM orders WHERE o_orderkey % 4 = 3")
def media_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layers.renamed_media(*sides(spark, sf_dir))


@query(f"SELECT {DOC}, 'Old words ' || o_custkey AS old, 'New words ' || o_custkey AS new, 'replaced' AS state FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 8 = 1 UNION ALL SELECT {DOC}, 'Old words ' || o_custkey, 'New words ' || o_custkey, 'added' FROM orders WHERE o_orderkey % 8 = 5")
def overrides_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites of a round merged into those stored."""
    before, after = sides(spark, sf_dir)
    pages = lambda d: d.withColumn("blob", F.regexp_replace(F.col("blob").cast("string"), "<w:t>[12]</w:t>", "<w:t>#</w:t>").cast("binary"))
    fresh = documents.held(layers.build_overrides(pages(before), pages(after)).where("old LIKE 'Old%'"))
    stored = fresh.where("CAST(doc AS BIGINT) % 8 = 1").select("doc", "old", F.lit("Some words").alias("new"))
    return layers.update_overrides(stored, fresh)


@query(f"SELECT {DOC}, 'New words ' || o_custkey AS text FROM orders WHERE o_orderkey % 4 = 1")
def overrides_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that stored rewrites change."""
    from vellum.operators import gates

    before, _ = sides(spark, sf_dir)
    texts = gates.paragraph_texts(before)
    stored = texts.where("text LIKE 'Old%' AND CAST(doc AS BIGINT) % 4 = 1").select("doc", F.col("text").alias("old"), F.regexp_replace("text", "^Old", "New").alias("new"))
    made, missed = layers.apply_overrides(texts, stored)
    return made.where("text LIKE 'New%'").select("doc", "text").join(missed.select("doc"), "doc", "left_anti")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS doc, n_name AS was, 'The ' || n_name AS now, TRUE AS grew FROM nation")
def labels_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that grew into others."""
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc"), F.col("n_name").alias("label"))
    return layers.label_moves(base, base.withColumn("label", x("The ", F.col("label"))))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'end' ELSE '' END AS edges, CASE p_partkey % 4 WHEN 0 THEN 'format' WHEN 1 THEN 'glyphs' WHEN 2 THEN 'structure' ELSE 'symbols' END AS bucket FROM part")
def edges_and_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of paragraphs whose white space changed, and what changed in equations."""
    k = F.col("p_partkey")
    after = F.when(k % 3 == 0, F.lit(" a")).when(k % 3 == 1, F.lit("a\t")).otherwise("a")
    tokens, shape = F.when(k % 4 == 1, "x−1").when(k % 4 == 3, "y-1").otherwise("x-1"), F.when(k % 4 == 2, "f").otherwise("sSub")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(layers.edge_diff(F.lit("a"), after), ",").alias("edges"), layers.formula_bucket(F.lit("x-1"), tokens, F.lit("sSub"), shape).alias("bucket"))


@query("SELECT o_orderkey AS id, 'replace' AS op, 'old' AS was, 'new' AS now FROM orders UNION ALL SELECT o_orderkey, 'insert', '', 'more' FROM orders WHERE o_orderkey % 2 = 0")
def word_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), x("some old words of ", k.cast("string")).alias("before"), x("some new words of ", k.cast("string"), F.when(k % 2 == 0, " more").otherwise("")).alias("after"))
    return layers.word_table(rows)
