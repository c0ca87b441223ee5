"""Queries of what a manuscript carries beside its text: notes, remarks, figures, styles, and its package; written from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import apparatus, documents, gates
from vellum.plans.redlines import DOC, NS, run, x
from vellum.plans.registry import Registry, orders, table
from vellum.sources import containers

REGISTRY = Registry()
query = REGISTRY.query

MORE = NS + (
    ' xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    ' xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"'
)
STYLES = (
    f'<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="18"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:type="paragraph" w:default="1" w:styleId="Normal"/>'
    '<w:style w:type="paragraph" w:styleId="Body"><w:basedOn w:val="Normal"/><w:rPr><w:sz w:val="24"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="Quote"><w:basedOn w:val="Body"/></w:style>'
    '<w:style w:type="character" w:styleId="Raised"><w:rPr><w:vertAlign w:val="superscript"/><w:sz w:val="12"/></w:rPr></w:style></w:styles>'
)


def packages(spark: SparkSession, sf_dir: str, *names: str, whole: bool = False) -> DataFrame:
    """``(doc, part, blob)``: two notes referred to (in stored order or not), an empty orphan and one with words; a thread; two figures; runs of several styles; of these names only, where any are given."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    para = lambda *inner: x("<w:p>", *inner, "</w:p>")
    styled = lambda style, *inner: x(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>', *inner, "</w:p>")
    ref = lambda n: f'<w:r><w:footnoteReference w:id="{n}"/></w:r>'
    first, second = F.when(k % 2 == 0, ref(1)).otherwise(ref(2)), F.when(k % 2 == 0, ref(2)).otherwise(ref(1))
    drawing = lambda rid, alt: x(f'<w:r><w:drawing><wp:inline><wp:extent cx="914400" cy="457200"/><wp:docPr id="1" name="p" descr="', alt, f'"/><a:blip r:embed="{rid}"/></wp:inline></w:drawing></w:r>')
    alt = F.when(k % 3 == 0, "").otherwise(x("A picture of ", c))
    raised = F.when(k % 5 == 0, '<w:r><w:rPr><w:rStyle w:val="Raised"/></w:rPr><w:t>up</w:t></w:r>').otherwise('<w:r><w:rPr><w:sz w:val="30"/></w:rPr><w:t>up</w:t></w:r>')
    body = x(
        f"<w:document {MORE}><w:body>", para(run("One"), first, run(" and two"), second), styled("Quote", run("quoted"), raised),
        para('<w:commentRangeStart w:id="1"/>', run("marked"), '<w:commentRangeEnd w:id="1"/><w:r><w:commentReference w:id="1"/></w:r>'),
        para(run("Figure 1. First")), para(drawing("rId5", alt)), para(run("Figure 2. Second")), para(drawing("rId5", F.lit("the same"))),
        '<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>',
    )
    size = F.when(k % 7 == 0, "24").otherwise("20")
    note = lambda n, half, text: x(f'<w:footnote w:id="{n}"><w:p><w:r><w:rPr><w:sz w:val="', half, '"/></w:rPr><w:t>', text, "</w:t></w:r></w:p></w:footnote>")
    notes = x(f'<w:footnotes {MORE}><w:footnote w:id="0" w:type="separator"><w:p/></w:footnote>', note(1, F.lit("20"), x("First of ", c)), note(2, size, F.lit("Second")), '<w:footnote w:id="3"><w:p/></w:footnote>', note(4, F.lit("20"), F.lit("Lost")), "</w:footnotes>")
    remark = lambda n, author, day, para_id, text: f'<w:comment w:id="{n}" w:author="{author}" w:date="2026-01-0{day}T00:00:00Z"><w:p w14:paraId="{para_id}">' + f"<w:r><w:t>{text}</w:t></w:r></w:p></w:comment>"
    remarks = f"<w:comments {MORE}>" + remark(1, "Ann", 1, "AA", "Why") + remark(3, "Cy", 3, "CC", "No") + remark(2, "Bob", 2, "BB", "So") + "</w:comments>"
    done = F.when(k % 2 == 0, "1").otherwise("0")
    w15 = 'xmlns:w15="http://schemas.microsoft.com/office/word/2012/wordml"'
    extended = x(f'<w15:commentsEx {w15}><w15:commentEx w15:paraId="AA" w15:done="', done, '"/><w15:commentEx w15:paraId="BB" w15:paraIdParent="AA" w15:done="0"/><w15:commentEx w15:paraId="CC" w15:paraIdParent="AA" w15:done="0"/></w15:commentsEx>')
    rels = x('<Relationships><Relationship Id="rId5" Type="image" Target="media/image1.png"/>', F.when(k % 2 == 0, '<Relationship Id="rId9" Type="data" Target="../customXml/item1.xml"/>').otherwise(""), "</Relationships>")
    core = F.when(k % 3 == 0, '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"/>').otherwise(x('<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>T</dc:title><dc:creator>C</dc:creator></cp:coreProperties>'))
    types = F.lit('<Types><Override PartName="/customXml/item1.xml" ContentType="x"/></Types>')
    settings = F.when(k % 2 == 0, f"<w:settings {NS}><w:trackRevisions/></w:settings>").otherwise(f"<w:settings {NS}/>")
    parts = {
        "word/document.xml": body, "word/footnotes.xml": notes, "word/comments.xml": F.lit(remarks), "word/commentsExtended.xml": extended, "word/styles.xml": F.lit(STYLES),
        "word/_rels/document.xml.rels": rels, "docProps/core.xml": core, "[Content_Types].xml": types, "word/settings.xml": settings, "customXml/item1.xml": F.lit("<a/>"),
    }
    made = F.array(*(F.struct(F.lit(p).alias("part"), b.cast("binary").alias("blob")) for p, b in parts.items() if not names or p in names))
    packed = orders(spark, sf_dir).select(k.cast("string").alias("doc"), made.alias("rows"))
    return packed if whole else documents.loose(packed)


def each(*rows: str, where: str = "TRUE") -> str:
    return " UNION ALL ".join(f"SELECT {DOC}, {r} FROM orders WHERE {where}" for r in rows)


@query(f"{each('CAST(1 AS VARCHAR) AS id')} AND o_orderkey % 2 = 1 UNION ALL {each('CAST(2 AS VARCHAR)')} AND o_orderkey % 2 = 1")
def notes_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes stored out of the order in which they are referred to."""
    return apparatus.out_of_order(packages(spark, sf_dir))


@query(each("'3' AS id, '' AS text, TRUE AS empty", "'4', 'Lost', FALSE"))
def note_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apparatus.orphans(packages(spark, sf_dir))


@query(each("'1' AS id", "'2'", "'4'"))
def notes_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes left once the empty ones that nothing refers to are gone."""
    return apparatus.notes(apparatus.prune_orphans(packages(spark, sf_dir))).select("doc", "id")


@query(f"{each(chr(39) + '1' + chr(39) + ' AS id, 1 AS at')} AND o_orderkey % 2 = 1 UNION ALL {each(chr(39) + '2' + chr(39) + ', 0')} AND o_orderkey % 2 = 1 UNION ALL {each(chr(39) + '1' + chr(39) + ', 0')} AND o_orderkey % 2 = 0 UNION ALL {each(chr(39) + '2' + chr(39) + ', 1')} AND o_orderkey % 2 = 0")
def notes_referred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apparatus.note_references(packages(spark, sf_dir))


@query(f"SELECT {DOC}, CASE WHEN o_orderkey % 2 = 1 AND n < 3 THEN CAST(3 - n AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS id, text FROM (SELECT *, unnest([1, 2, 3, 4]) AS n, unnest(['First of ' || o_custkey, 'Second', '', 'Lost']) AS text FROM orders)")
def notes_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with the ids that they have once they are numbered in the order they are referred to."""
    parts = packages(spark, sf_dir)
    return apparatus.notes(apparatus.remap_notes(parts, apparatus.renumber_notes(parts))).select("doc", "id", "text")


@query(f"SELECT {DOC}, '1' AS source, CASE WHEN o_orderkey % 2 = 1 THEN '2' ELSE '1' END AS target FROM orders UNION ALL SELECT {DOC}, '2', CASE WHEN o_orderkey % 2 = 1 THEN '1' ELSE '2' END FROM orders UNION ALL SELECT {DOC}, '4', '4' FROM orders")
def notes_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the packages and the ids of the same notes once renumbered."""
    parts = packages(spark, sf_dir)
    return apparatus.renumber_map(parts, apparatus.remap_notes(parts, apparatus.renumber_notes(parts)))


@query(each("'5' AS id, 'An added note' AS text, 2 AS at"))
def notes_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note put in behind a word, with its reference."""
    made = apparatus.add_note(packages(spark, sf_dir, documents.DOCUMENT, apparatus.NOTES, whole=True), "quoted", "An added note")
    return apparatus.notes_in_place(made).where("id = '5'")


@query(each("'Second and more' AS text"))
def notes_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apparatus.notes(apparatus.append_to_note(packages(spark, sf_dir), "Second", " and more")).where("id = '2'").select("doc", "text")


@query(f"SELECT {DOC}, CAST(NULL AS VARCHAR) AS face, 20 AS half_points, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 3 END AS BIGINT) AS runs FROM orders UNION ALL SELECT {DOC}, NULL, 24, 1 FROM orders WHERE o_orderkey % 7 = 0")
def note_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apparatus.note_fonts(packages(spark, sf_dir))


@query(f"SELECT {DOC}, '2' AS id, 24 AS half_points, 20 AS house FROM orders WHERE o_orderkey % 7 = 0")
def note_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose size isn't that of the others."""
    return apparatus.note_sizes(packages(spark, sf_dir))


@query(each("'Times' AS face, 21 AS half_points, CAST(3 AS BIGINT) AS runs"))
def notes_refaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apparatus.note_fonts(apparatus.set_note_font(packages(spark, sf_dir), "Times", 10.5))


@query(each("'1' AS id, 'Ann' AS author, 'Why' AS text, o_orderkey % 2 = 0 AS done, 2 AS anchor, 'Bob: So; Cy: No' AS replies"))
def remark_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of comments, replies by date."""
    found = apparatus.threads(packages(spark, sf_dir))
    said = F.array_join(F.transform("replies", lambda r: F.concat(r["author"], F.lit(": "), r["text"])), "; ")
    return found.select("doc", "id", "author", "text", "done", "anchor", said.alias("replies"))


@query(each("'1' AS id, TRUE AS done", "'2', FALSE", "'3', FALSE"))
def remarks_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apparatus.remarks(apparatus.set_done(packages(spark, sf_dir), {"1"})).select("doc", "id", "done")


@query(each("'2' AS id", "'3'"))
def remarks_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = apparatus.remove_remarks(packages(spark, sf_dir, documents.DOCUMENT, apparatus.STORE, whole=True), {"1"})
    return apparatus.remarks_stored(made).select("doc", "id")


@query("SELECT p_partkey AS id, CASE WHEN contains(p_name, 'a') THEN 'by name' WHEN contains(p_type, 'A') THEN 'by type' END AS comment FROM part")
def remarks_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of revisions by rules, the narrowest place that one fits first."""
    contexts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.concat(F.col("p_type"), F.lit("")).alias("paragraph"))
    rules = spark.createDataFrame([(1, "a", "by name"), (2, "A", "by type")], "rank int, needle string, comment string")
    names = contexts.withColumn("text", F.translate("text", "A", "")).withColumn("paragraph", F.translate("paragraph", "a", ""))
    return apparatus.match(names, rules, ("text", "paragraph")).select("id", "comment")


@query(f"SELECT {DOC}, CAST(n AS VARCHAR) AS number, 'rId5' AS rid, CASE WHEN n = 2 THEN 'the same' WHEN o_orderkey % 3 = 0 THEN '' ELSE 'A picture of ' || o_custkey END AS alt, n = 1 AND o_orderkey % 3 = 0 AS missing FROM (SELECT *, unnest([1, 2]) AS n FROM orders)")
def figure_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with their picture and its description."""
    parts = packages(spark, sf_dir)
    return apparatus.figures(parts).select("doc", "number", "rid").join(apparatus.alt_texts(parts).select("doc", "number", "alt", "missing"), ["doc", "number"])


@query(each("'rId5' AS rid, CAST(2 AS BIGINT) AS drawings, 'below' AS side"))
def figure_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures used by several drawings, and the side that drawings stand on."""
    parts = packages(spark, sf_dir)
    return apparatus.shared_relationships(parts).join(apparatus.caption_side(parts), "doc")


@query(each("CAST(0 AS BIGINT) AS missing, 'Seen anew' AS alt"))
def figure_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = apparatus.alt_texts(apparatus.set_alt_text(packages(spark, sf_dir, documents.DOCUMENT), "1", "Seen anew"))
    return made.groupBy("doc").agg(F.count_if("missing").alias("missing"), F.max(F.when(F.col("number") == "1", F.col("alt"))).alias("alt"))


@query(each("'<w:sectPr><w:pgSz w:w=\"16838\" w:h=\"11906\" w:orient=\"landscape\"/></w:sectPr>' AS turned, '<wp:extent cx=\"1828800\" cy=\"1371600\"/>' AS scaled"))
def figure_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last section on its side, and a drawing two inches wide."""
    xml = gates.xml_of(packages(spark, sf_dir), "word/document.xml")
    scaled = apparatus.scale_to_width(F.lit('<wp:extent cx="914400" cy="457200"/>'), F.lit(400), F.lit(300), F.lit(2.0))
    return xml.select("doc", apparatus.landscape(apparatus.section_properties(F.col("xml"))).alias("turned"), scaled.alias("scaled"))


@query(each("'Normal' AS style, '18' AS value, 'defaults' AS source", "'Body', '24', 'style Body'", "'Quote', '24', 'style Body'", "'Raised', '12', 'style Raised'"))
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size that each style gives, and where it has it from."""
    return apparatus.cascade(packages(spark, sf_dir), "sz").select("doc", "style", "value", "source")


@query(f"SELECT {DOC}, 'quoted' AS text, '24' AS value, 'style Body' AS source FROM orders UNION ALL SELECT {DOC}, 'up', CASE WHEN o_orderkey % 5 = 0 THEN '12' ELSE '30' END, CASE WHEN o_orderkey % 5 = 0 THEN 'style Raised' ELSE '' END FROM orders UNION ALL SELECT {DOC}, 'marked', '18', 'defaults' FROM orders")
def run_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of runs: their own, their character style's, their paragraph's, or the defaults'."""
    return apparatus.resolve_runs(packages(spark, sf_dir), "sz").where("text IN ('quoted', 'up', 'marked')").select("doc", "text", "value", "source")


@query(f"SELECT {DOC}, 1 AS pos, 'up' AS text, 'style Raised' AS source FROM orders WHERE o_orderkey % 5 = 0")
def raised_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apparatus.raised_prose(packages(spark, sf_dir))


@query(f"SELECT {DOC}, 'Quote' AS style, FALSE AS known FROM orders UNION ALL SELECT {DOC}, 'Raised', FALSE FROM orders WHERE o_orderkey % 5 = 0")
def styles_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles in use that a template swapped in doesn't know."""
    bare = apparatus.apply_template(packages(spark, sf_dir), f"<w:styles {NS}/>".encode())
    return apparatus.dangling_styles(bare).withColumn("known", F.lit(False))


@query(each("'Quote' AS style", "'Body'", "'Normal'", "'Raised'", "'New'"))
def styles_ensured(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = apparatus.ensure_style(apparatus.ensure_style(packages(spark, sf_dir), "New", '<w:style w:type="paragraph" w:styleId="New"/>'), "Body", '<w:style w:styleId="Body"/>')
    return apparatus.style_table(made).where("style IS NOT NULL").select("doc", "style").distinct()


@query(each("'docProps/core.xml' AS part, 'changed' AS change", "'customXml/item1.xml', 'removed'"))
def parts_of_other_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that mean something else: one written with other spaces and attribute order doesn't, one with another property does, one is gone."""
    parts = packages(spark, sf_dir)
    after = containers.set_core_property(parts.where("part <> 'customXml/item1.xml'"), "dc:title", F.concat(F.lit("New & "), "doc"))
    spelled = after.withColumn("blob", F.when(F.col("part") == "word/styles.xml", F.replace(F.col("blob").cast("string"), F.lit("<w:style "), F.lit('\n  <w:style w:rsidR="00AA" ')).cast("binary")).otherwise(F.col("blob")))
    return containers.changed_parts(parts, spelled)


@query(f"SELECT {DOC}, 'New & ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'C' END AS creator FROM orders")
def properties_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = containers.set_core_property(packages(spark, sf_dir), "dc:title", F.concat(F.lit("New & "), "doc"))
    title = gates.core_property(made, "dc:title").select("doc", F.replace("value", F.lit("&amp;"), F.lit("&")).alias("title"))
    return title.join(gates.core_property(made, "dc:creator").withColumnRenamed("value", "creator"), "doc")


@query(each("'T' AS title"))
def properties_carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles once the packages that lost theirs have them from their source."""
    parts = packages(spark, sf_dir).where("part = 'docProps/core.xml'")
    source = containers.set_core_property(parts, "dc:title", F.lit("T"))
    return gates.core_property(containers.carry_properties(parts, source, ("dc:title",)), "dc:title").withColumnRenamed("value", "title")


@query(each("TRUE AS tracking"))
def tracking_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packages(spark, sf_dir).where("part = 'word/settings.xml'")
    on = parts.withColumn("blob", F.lit(f"<w:settings {NS}><w:trackRevisions/></w:settings>").cast("binary"))
    return containers.keep_tracking(parts, on).select("doc", F.contains(F.col("blob").cast("string"), F.lit("<w:trackRevisions/>")).alias("tracking"))


@query(f"SELECT {DOC}, CASE WHEN o_orderkey % 2 = 0 THEN 'rId10' ELSE 'rId6' END AS rid, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS INTEGER) AS relationships FROM orders")
def relationships_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels = gates.xml_of(packages(spark, sf_dir), "word/_rels/document.xml.rels")
    made = containers.add_relationship(F.col("xml"), F.lit("footer"), F.lit("footer1.xml"))
    return rels.select("doc", containers.next_rid(F.col("xml")).alias("rid"), F.regexp_count(made, F.lit("<Relationship ")).alias("relationships"))


@query(each("2 AS defaults, 2 AS overrides"))
def types_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content types declared, each once however often it is asked for."""
    types = gates.xml_of(packages(spark, sf_dir), "[Content_Types].xml")
    made = containers.declare_default(containers.declare_default(containers.declare_default(F.col("xml"), "png", "image/png"), "PNG", "image/png"), "gif", "image/gif")
    made = containers.declare_override(containers.declare_override(made, "word/footer1.xml", "f"), "customXml/item1.xml", "x")
    return types.select("doc", F.regexp_count(made, F.lit("<Default ")).alias("defaults"), F.regexp_count(made, F.lit("<Override ")).alias("overrides"))


@query(f"SELECT {DOC}, CAST(0 AS BIGINT) AS stripped, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS restored FROM orders")
def parts_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of a folder of parts once it is taken out, and once it is put back: the part, its type and its relationship."""
    parts = packages(spark, sf_dir)
    bare = containers.strip_parts(parts)
    back = containers.restore_parts(bare, parts)
    count = lambda frame, name: frame.groupBy("doc").agg((F.sum(F.regexp_count(F.col("blob").cast("string"), F.lit("customXml/"))) + F.count_if(F.col("part").startswith("customXml/"))).alias(name))
    return count(bare, "stripped").join(count(back, "restored"), "doc")


def _files(spark: SparkSession, sf_dir: str, edited: bool = False) -> DataFrame:
    k = F.col("o_orderkey")
    return orders(spark, sf_dir).select(k.cast("string").alias("doc"), x("bytes of ", k.cast("string"), F.when((k % 4 == 0) & F.lit(edited), " edited").otherwise("")).cast("binary").alias("content"))


@query(f"SELECT {DOC}, o_orderkey % 4 = 0 AS edited, CASE WHEN o_orderkey % 4 = 0 THEN 'glyphs' END AS why, sha256('bytes of ' || o_orderkey) AS base FROM orders")
def stamps_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files changed since they were stamped, and what a tool's repair leaves in their stamps."""
    built, now = _files(spark, sf_dir), _files(spark, sf_dir, edited=True)
    stamps = containers.stamp(built, base=built)
    edited = containers.check_stamps(now, stamps)
    again = containers.restamp(stamps, now, "glyphs")
    clean = containers.describes(now, again).where("describes").select("doc")
    told = again.join(clean, "doc", "left_semi").join(edited, "doc", "left")
    return told.select("doc", F.coalesce("edited", F.lit(False)).alias("edited"), F.try_element_at("repairs", F.lit(1))["why"].alias("why"), F.col("base_sha256").alias("base"))


@query("SELECT s_suppkey AS id, 'f/r' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '_backup1' WHEN 1 THEN '_backup2' ELSE '_backup3' END || '.docx' AS path FROM supplier")
def backups_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = x("f/r", k.cast("string"), ".docx")
    name = lambda n: x("f/r", k.cast("string"), f"_backup{n}.docx")
    taken = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(name(1), name(3))).otherwise(F.array(name(2), name(1)))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), containers.next_backup_path(path, taken).alias("path"))


@query("SELECT 'f/n' || CAST(s_nationkey AS VARCHAR) AS stem, 'f/n' || CAST(s_nationkey AS VARCHAR) || '_v' || CAST(max(s_suppkey) AS VARCHAR) || '.docx' AS path, CAST(max(s_suppkey) AS INTEGER) AS version FROM supplier GROUP BY s_nationkey")
def latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select(x("f/n", F.col("s_nationkey").cast("string"), "_v", F.col("s_suppkey").cast("string"), ".docx").alias("path"))
    return containers.latest_versions(files)


@query(f"SELECT {DOC}, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS fresh, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS existing, NOT (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AS ok FROM orders")
def saves_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults that an edit made, and those that were there before it."""
    k = F.col("o_orderkey")
    old = F.when(k % 3 == 0, '<w:p><w:r/><w:pPr/></w:p>').otherwise("")
    new = F.when(k % 2 == 0, "<w:p><w:r><w:t> edge</w:t></w:r></w:p>").otherwise("")
    part = lambda *inner: table(spark, sf_dir, "orders").select(k.cast("string").alias("doc"), F.lit("word/document.xml").alias("part"), x(f"<w:document {NS}><w:body><w:p/>", *inner, "</w:body></w:document>").cast("binary").alias("blob"))
    return containers.save_report(part(old), part(old, new)).select("doc", "fresh", "existing", "ok")


@query(each("'word/a.xml' AS part, 6 AS bytes", "'media/b.bin', 3"))
def flat_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of packages written as one flat file each."""
    ns = 'xmlns:pkg="http://schemas.microsoft.com/office/2006/xmlPackage"'
    flat = f'<pkg:package {ns}><pkg:part pkg:name="/word/a.xml" pkg:contentType="x"><pkg:xmlData><a b="c"/></pkg:xmlData></pkg:part><pkg:part pkg:name="/media/b.bin" pkg:contentType="y"><pkg:binaryData>YWJj</pkg:binaryData></pkg:part></pkg:package>'
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), F.lit(flat).cast("binary").alias("content"))
    found = containers.flat_parts(files)
    size = F.when(F.col("part") == "word/a.xml", F.length(F.regexp_extract(F.col("blob").cast("string"), r"<a (b=\"c\") ?/>", 1)) + 1).otherwise(F.length("blob"))
    return found.select("doc", "part", size.alias("bytes"))


