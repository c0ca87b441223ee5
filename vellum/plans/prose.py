"""Queries on text, printed numbers, citations and alignment.

Texts are those of the tables; citations and entries are written out from orders, the same way on
both sides, since the tables' prose has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import citations, numbers, text
from vellum.operators import compare
from vellum.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query


@query(
    """
    SELECT conv_id, turn, translate(s, '−∗’‘“”–—' || chr(160), '-*''''""-- ') AS plain
    FROM (SELECT conv_id, turn, replace(replace(text, '.', '’—'), 'e', '−') AS s FROM conversations)
    """
)
def normalized_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with typographic glyphs put in, folded to plain ones."""
    turns = table(spark, sf_dir, "conversations")
    put_in = F.replace(F.replace("text", F.lit("."), F.lit("’—")), F.lit("e"), F.lit("−"))
    return turns.select("conv_id", "turn", text.normalize_glyphs(put_in).alias("plain"))


@query("SELECT p_partkey AS part, lower(regexp_replace(p_name || '''s, É.', '[^\\p{L}\\p{N}_]+', '', 'g')) || '_' || CAST(1990 + p_size AS VARCHAR) AS key FROM part")
def anchor_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of works: names without punctuation, and the year."""
    parts = table(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("part"), text.key_for(F.concat("p_name", F.lit("'s, É.")), (F.lit(1990) + F.col("p_size")).cast("string")).alias("key"))


@query("SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM conversations")
def turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("words"))


@query(
    """
    SELECT conv_id, turn, CASE WHEN len(parts) % 2 = 1 THEN list_aggregate(list_transform(parts, lambda p, i: CASE WHEN i = 1 THEN p WHEN i % 2 = 0 THEN '“' || p ELSE '”' || p END), 'string_agg', '') ELSE s END AS smart
    FROM (SELECT conv_id, turn, s, string_split(s, '"') AS parts FROM (
        SELECT conv_id, turn, regexp_replace(replace(replace(text, ' t', ' "t'), 'e ', 'e'' '), '([\\p{L}\\p{N}])''', '\\1’', 'g') AS s FROM conversations))
    """
)
def smart_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with straight quotes put in, made curly."""
    straight = F.replace(F.replace("text", F.lit(" t"), F.lit(' "t')), F.lit("e "), F.lit("e' "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.smarten(straight).alias("smart"))


CELL_SQL = """
    SELECT l_orderkey AS doc, l_linenumber AS row, l_partkey AS part, l_extendedprice AS price,
           CASE l_linenumber % 5 WHEN 0 THEN '−' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.25** [0.04]'
                WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ',' || CAST(l_partkey % 90 + 10 AS VARCHAR)
                WHEN 2 THEN CAST(CAST(l_quantity AS BIGINT) % 9 + 1 AS VARCHAR) || ',' || CAST(l_partkey % 900 + 100 AS VARCHAR)
                WHEN 3 THEN 'n/a' ELSE CAST(l_partkey % 900 + 100 AS VARCHAR) || ' 000.5%' END AS cell
    FROM lineitem
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed numbers of several shapes, from line items."""
    whole = F.col("l_quantity").cast("long").cast("string")
    kind = F.col("l_linenumber") % 5
    cell = (
        F.when(kind == 0, F.concat(F.lit("−"), whole, F.lit(".25** [0.04]")))
        .when(kind == 1, F.concat(whole, F.lit(","), (F.col("l_partkey") % 90 + 10).cast("string")))
        .when(kind == 2, F.concat((F.col("l_quantity").cast("long") % 9 + 1).cast("string"), F.lit(","), (F.col("l_partkey") % 900 + 100).cast("string")))
        .when(kind == 3, F.lit("n/a"))
        .otherwise(F.concat((F.col("l_partkey") % 900 + 100).cast("string"), F.lit(" 000.5%")))
    )
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("row"), F.col("l_partkey").alias("part"), cell.alias("cell"))


VALUE_SQL = """
    CASE row % 5 WHEN 0 THEN -CAST(regexp_extract(cell, '(\\d+\\.\\d+)', 1) AS DOUBLE) WHEN 1 THEN CAST(replace(cell, ',', '.') AS DOUBLE)
         WHEN 2 THEN CAST(replace(cell, ',', {point}) AS DOUBLE) WHEN 4 THEN CAST(replace(replace(cell, ' ', ''), '%', '') AS DOUBLE) END
"""


@query(f"SELECT doc, row, part, cell, {VALUE_SQL.format(point="''")} AS value FROM ({CELL_SQL})")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each printed number, read without its table."""
    return cells(spark, sf_dir).withColumn("value", numbers.parse_number(F.col("cell")))


@query(
    f"""
    WITH c AS ({CELL_SQL}), m AS (SELECT doc, sum(CASE WHEN row % 5 = 1 THEN 1 ELSE 0 END) AS comma, sum(CASE WHEN row % 5 IN (0, 4) THEN 1 ELSE 0 END) AS point FROM c GROUP BY doc)
    SELECT c.doc, c.row, c.part, c.cell, CASE WHEN comma > point THEN {VALUE_SQL.format(point="'.'")} ELSE {VALUE_SQL.format(point="''")} END AS value FROM c JOIN m ON m.doc = c.doc
    """
)
def numbers_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each printed number, ambiguous ones settled by the mark that most of its table shows."""
    found = cells(spark, sf_dir).withColumn("mark", numbers.decimal_mark(F.col("cell"), Window.partitionBy("doc")))
    return found.select("doc", "row", "part", "cell", numbers.parse_number(F.col("cell"), F.col("mark")).alias("value"))


@query("SELECT o_orderkey AS doc, CAST(CAST(round(CAST(o_totalprice AS DECIMAL(18,2)), 1) AS DECIMAL(18,1)) AS VARCHAR) || ' USD' AS cell FROM orders")
def rounded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as printed, cut to one decimal half up."""
    printed = F.concat(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" USD"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), numbers.set_decimals(printed, 1).alias("cell"))


@query("SELECT o_orderkey AS doc, 'n' || CAST(o_custkey AS VARCHAR) || '_' || CAST(1960 + o_custkey % 60 AS VARCHAR) AS key, o_orderkey % 2 = 0 AS narrative FROM orders")
def found_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in sentences written from orders, told or listed by turns."""
    name, year = F.concat(F.lit("N"), F.col("o_custkey").cast("string")), (F.lit(1960) + F.col("o_custkey") % 60).cast("string")
    told = F.concat(F.lit("However, "), name, F.lit(" et al. ("), year, F.lit(", p. 12) found no effect of 1234 things."))
    listed = F.concat(F.lit("There is none (see "), name, F.lit(" and Other "), year, F.lit("; for 40 of them)."))
    sentences = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.when(F.col("o_orderkey") % 2 == 0, told).otherwise(listed).alias("text"))
    return citations.citations(sentences).select("doc", "key", "narrative")


@query(
    """
    SELECT o_orderkey AS doc, 'S' || CAST(o_custkey AS VARCHAR) AS surname, CAST(year(o_orderdate) AS VARCHAR) AS year, 's' || CAST(o_custkey AS VARCHAR) || '_' || CAST(year(o_orderdate) AS VARCHAR) AS key FROM orders
    """
)
def parsed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a list, written from orders, read back."""
    entry = F.concat(F.lit("S"), F.col("o_custkey"), F.lit(", Anna, and Bo Ek. ("), F.year("o_orderdate"), F.lit("). A title in 3 parts. Journal 12, 1–20."))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), citations.parse_reference(entry).alias("r")).select("doc", "r.*")


NUMBERED_LINES_SQL = "SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(pos AS VARCHAR) || ': ' || line AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


@query(
    f"""
    SELECT CAST(doc_id AS VARCHAR) AS doc, 'deleted' AS change, pos AS before_pos, CAST(NULL AS INTEGER) AS after_pos, line AS before, CAST(NULL AS VARCHAR) AS after FROM ({NUMBERED_LINES_SQL}) WHERE (doc_id + pos) % 20 = 0
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'changed', pos, pos, line, line || ' and more' FROM ({NUMBERED_LINES_SQL}) WHERE (doc_id + pos) % 20 = 10
    """
)
def aligned_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between documents and versions of them with lines dropped and changed; numbers tell equal lines apart."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = lines.select("doc_id", F.col("doc_id").cast("string").alias("doc"), "pos", F.concat(F.col("pos").cast("string"), F.lit(": "), "line").alias("text"))
    pick = F.pmod(F.col("doc_id") + F.col("pos"), F.lit(20))
    after = before.where(pick != 0).withColumn("text", F.when(pick == 10, F.concat("text", F.lit(" and more"))).otherwise(F.col("text")))
    return compare.changed_paragraphs(before.select("doc", "pos", "text"), after.select("doc", "pos", "text"))
