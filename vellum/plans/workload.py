"""The manuscript workload: packages written in the plan, then read on both sides and counted.

Each document of the table becomes a part with a paragraph per line; every tenth paragraph holds a
tracked insertion, every twenty-fifth a deletion, and the first is a heading.  The markup is made by
column functions, so the same rows come at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import wordml
from vellum.operators import documents
from vellum.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc, part, blob)``: the table's documents as document parts."""
    run = lambda tag, x: F.concat(F.lit(f'<w:r><w:{tag} xml:space="preserve">'), x, F.lit(f"</w:{tag}></w:r>"))
    head = F.lit('<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>')
    added = F.concat(F.lit('<w:ins w:id="1" w:author="Ann" w:date="2026-01-01T00:00:00Z">'), run("t", F.lit(" added words")), F.lit("</w:ins>"))
    gone = F.concat(F.lit('<w:del w:id="2" w:author="Bob" w:date="2026-01-02T00:00:00Z">'), run("delText", F.lit(" gone")), F.lit("</w:del>"))
    # characters that XML can't hold are no part of a manuscript
    clean = F.regexp_replace("text", r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")
    paragraphs = F.transform(
        F.split(clean, "\n"),
        lambda x, i: F.concat(
            F.lit("<w:p>"), F.when(i == 0, head).otherwise(F.lit("")), run("t", T.escape(x)),
            F.when(i % 10 == 5, added).otherwise(F.lit("")), F.when(i % 25 == 7, gone).otherwise(F.lit("")), F.lit("</w:p>"),
        ),
    )
    xml = F.concat(F.lit(f'<w:document xmlns:w="{W}"><w:body>'), F.array_join(paragraphs, ""), F.lit("</w:body></w:document>"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("doc"), F.lit(documents.DOCUMENT).alias("part"), xml.cast("binary").alias("blob"))


def _side(view: str, extra: str) -> str:
    return f"""
    SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(pos AS INTEGER) AS pos, '{view}' AS view, line || CASE {extra} ELSE '' END AS text FROM ({LINES_SQL})
    """


@query(f"{_side('final', "WHEN pos % 10 = 5 THEN ' added words'")} UNION ALL {_side('original', "WHEN pos % 25 = 7 THEN ' gone'")}")
def perf_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every paragraph, on both sides of the tracked changes."""
    found = documents.rows_of(manuscripts(spark, sf_dir), wordml.blocks, documents.BLOCKS, "both")
    return found.select("doc", "pos", "view", "text")


@query(
    f"""
    SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(sum(CASE WHEN pos > 0 THEN w ELSE 0 END) AS BIGINT) AS prose, CAST(sum(CASE WHEN pos = 0 THEN w ELSE 0 END) AS BIGINT) AS headings
    FROM (SELECT doc_id, pos, len(list_filter(string_split_regex(line || CASE WHEN pos % 10 = 5 THEN ' added words' ELSE '' END, '\\s+'), lambda w: w <> '')) AS w FROM ({LINES_SQL})) GROUP BY 1
    """
)
def perf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every manuscript by bucket, as its final side reads."""
    found = documents.blocks(manuscripts(spark, sf_dir))
    return documents.word_counts(found).select("doc", "prose", "headings")


@query(
    f"""
    SELECT CAST(doc_id AS VARCHAR) AS doc, kind, author, CAST(count(*) AS BIGINT) AS revisions FROM (
        SELECT doc_id, 'ins' AS kind, 'Ann' AS author FROM ({LINES_SQL}) WHERE pos % 10 = 5 UNION ALL SELECT doc_id, 'del', 'Bob' FROM ({LINES_SQL}) WHERE pos % 25 = 7)
    GROUP BY ALL
    """
)
def perf_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked changes of every manuscript by kind and author."""
    return documents.revisions(manuscripts(spark, sf_dir)).groupBy("doc", "kind", "author").agg(F.count("*").alias("revisions"))


@query(
    f"""
    WITH l AS ({LINES_SQL})
    SELECT CAST(doc_id AS VARCHAR) AS doc, string_agg(md, chr(10) || chr(10) ORDER BY pos) || chr(10) AS markdown FROM (
        SELECT doc_id, pos, CASE WHEN pos = 0 THEN '# ' ELSE '' END || trim(line || CASE WHEN pos % 10 = 5 THEN ' added words' ELSE '' END, ' ') AS md FROM l)
    WHERE md NOT IN ('', '# ') GROUP BY 1
    """
)
def perf_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every manuscript as markdown."""
    return documents.to_markdown(documents.blocks(manuscripts(spark, sf_dir)))
