"""Queries of the house-style, caption and section audits, on text written from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import audits
from vellum.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

PROSE = {
    0: (["As in (N", ", 2001; and lee 2002)."], "year-comma", "(N{k}, 2001"),
    1: (["Lee et al found ", " things."], "et-al-period", "et al"),
    2: (["See p.4", " or so."], "page-space", "p."),
    3: (["See pp. ", "-9999 there."], "page-dash", "pp. {k}-9999"),
    4: (["Nothing is odd in ", " (Smith 2020)."], None, None),
}


def _prose_sql() -> str:
    parts = []
    for kind, (_, finding, subject) in PROSE.items():
        if finding:
            said = "'" + subject.replace("{k}", "' || CAST(o_custkey AS VARCHAR) || '") + "'"
            # names are letters only, so digits in them don't count
            said = said.replace("'(N' || CAST(o_custkey AS VARCHAR) || ', 2001'", "'(Nab, 2001'")
            parts.append(f"SELECT CAST(o_orderkey AS VARCHAR) AS doc, 0 AS pos, '{finding}' AS finding, {said} AS subject FROM orders WHERE o_orderkey % 5 = {kind}")
    return " UNION ALL ".join(parts)


@query(_prose_sql())
def prose_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style departures in sentences written from orders."""
    k = F.col("o_custkey").cast("string")
    sentence = None
    for kind, (parts, _, _) in PROSE.items():
        middle = F.lit("ab") if kind == 0 else k
        text = F.concat(F.lit(parts[0]), middle, F.lit(parts[1]))
        sentence = F.when(F.col("o_orderkey") % 5 == kind, text) if sentence is None else sentence.when(F.col("o_orderkey") % 5 == kind, text)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), F.lit(0).alias("pos"), sentence.alias("text"))
    return audits.prose_style(rows)


CAPTIONS_SQL = "SELECT CAST(l_orderkey AS VARCHAR) AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS pos, CAST(l_linenumber AS VARCHAR) AS number FROM lineitem"


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem")
    blocks = lines.select(F.col("l_orderkey").cast("string").alias("doc"), F.row_number().over(order).cast("long").alias("pos"), F.lit("caption").alias("kind"), F.concat(F.lit("Table "), F.col("l_linenumber"), F.lit(". Title")).alias("text"))
    return audits.captions(blocks)


@query(
    f"""
    WITH c AS (SELECT doc, pos, number, row_number() OVER (PARTITION BY doc ORDER BY pos) AS k, count(*) OVER (PARTITION BY doc, number) AS times FROM ({CAPTIONS_SQL}))
    SELECT doc, pos, CASE WHEN times > 1 THEN 'repeated-number' ELSE 'number-out-of-order' END AS finding, 'Table ' || number AS subject FROM c WHERE times > 1 OR CAST(number AS BIGINT) <> k
    """
)
def caption_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions numbered twice or out of order."""
    return audits.caption_numbers(captions(spark, sf_dir))


@query(
    f"""
    WITH c AS ({CAPTIONS_SQL}), v AS (SELECT doc, number, CAST(number AS BIGINT) AS k FROM c),
         n AS (SELECT DISTINCT doc, 'Table' || number AS name FROM v WHERE k % 3 <> 0 UNION SELECT DISTINCT doc, 'Table' || number || 'txt' FROM v WHERE k % 2 = 0),
         r AS (SELECT DISTINCT doc, 'Table' || number AS name FROM v WHERE k <> 4 UNION SELECT DISTINCT doc, 'Table' || number || 'txt' FROM v WHERE k <> 4 UNION SELECT DISTINCT doc, 'Table' || CAST(k + 1 AS VARCHAR) FROM v WHERE k <> 4)
    SELECT c.doc, CASE WHEN a.name IS NOT NULL AND t.name IS NOT NULL THEN CASE WHEN ra.name IS NOT NULL AND rt.name IS NOT NULL THEN 'linked' ELSE 'unreached' END
                WHEN a.name IS NOT NULL THEN 'caption-only' WHEN t.name IS NOT NULL THEN 'mention-only' ELSE 'unlinked' END AS finding, 'Table' || c.number AS subject
    FROM c LEFT JOIN n a ON a.doc = c.doc AND a.name = 'Table' || c.number LEFT JOIN n t ON t.doc = c.doc AND t.name = 'Table' || c.number || 'txt'
           LEFT JOIN r ra ON ra.doc = c.doc AND ra.name = 'Table' || c.number LEFT JOIN r rt ON rt.doc = c.doc AND rt.name = 'Table' || c.number || 'txt'
    UNION ALL SELECT r.doc, 'dangling', r.name FROM r LEFT JOIN n ON n.doc = r.doc AND n.name = r.name WHERE n.name IS NULL
    """
)
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each exhibit is linked, and links to places that are gone."""
    caps = captions(spark, sf_dir)
    n = F.col("number").cast("int")
    mark = lambda where, end, add=0: caps.where(where).select("doc", F.concat(F.lit("Table"), (n + add).cast("string"), F.lit(end)).alias("name"))
    names = mark(n % 3 != 0, "").unionByName(mark(n % 2 == 0, "txt"))
    linked = mark(n != 4, "").unionByName(mark(n != 4, "txt")).unionByName(mark(n != 4, "", 1))
    return audits.cross_references(caps, names, linked.withColumnRenamed("name", "anchor"))


@query(
    """
    WITH t AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 5 = 4 THEN NULL ELSE conv_id % 3 END AS anchor FROM conversations WHERE trim(text) <> ''),
         c AS (SELECT conv_id, 2 * turn AS id, role, text, anchor FROM t UNION ALL SELECT conv_id, 2 * turn + 1, role, text, CASE WHEN turn % 2 = 0 THEN anchor ELSE 7 END FROM t)
    SELECT CAST(b.conv_id AS VARCHAR) AS doc, CAST(b.id AS VARCHAR) AS id FROM (SELECT *, row_number() OVER w AS k, first_value(anchor) OVER w AS first FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS said FROM c) WINDOW w AS (PARTITION BY conv_id, role, said ORDER BY id)) b
    WHERE k > 1 AND (anchor IS NULL OR first IS NULL OR EXISTS (SELECT 1 FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS said FROM c) e WHERE e.conv_id = b.conv_id AND e.role = b.role AND e.said = b.said AND e.id < b.id AND e.anchor = b.anchor))
    """
)
def repeated_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that say again in the same place what their author said: every turn, and all again with other white space, some elsewhere."""
    said = F.col("conv_id").cast("string").alias("doc"), F.col("role").alias("author")
    turns = table(spark, sf_dir, "conversations").where("trim(text) <> ''").withColumn("anchor", F.when(F.col("turn") % 5 != 4, F.col("conv_id") % 3))
    once = turns.select(*said, (2 * F.col("turn")).cast("string").alias("id"), "text", "anchor")
    again = turns.select(*said, (2 * F.col("turn") + 1).cast("string").alias("id"), F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \n ")), F.lit("\t")).alias("text"), F.when(F.col("turn") % 2 == 0, F.col("anchor")).otherwise(F.lit(7)).alias("anchor"))
    return audits.repeated_comments(once.unionByName(again)).select("doc", "id")
