"""Queries of tables as rows of cells, of entries brought to the house's form, and of equations, written from orders, line items and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import entries, formulas
from vellum.operators import grids
from vellum.plans.redlines import x
from vellum.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of four rows for each customer: a header, a panel, an estimate with a decimal comma and stars, and a statistic."""
    k = F.col("c_custkey")
    texts = [["Label", "Value", "Other"], ["Panel A", "", ""], [x("row ", (k % 5).cast("string")), x((k % 9 + 1).cast("string"), ",25**"), "0,5"], ["Observations", x((k % 700 + 100).cast("string")), "12"], ["", "", ""], ["N", "3", "4"]]
    rows = F.array(*(F.array(*(t if not isinstance(t, str) else F.lit(t) for t in r)) for r in texts))
    exploded = table(spark, sf_dir, "customer").select(k.cast("string").alias("doc"), F.lit(0).alias("table"), F.posexplode(rows).alias("row", "_r")).select("doc", "table", "row", F.posexplode("_r").alias("cell", "text"))
    return exploded.withColumn("gcol", F.col("cell"))


D = "CAST(c_custkey AS VARCHAR) AS doc"


@query(f"SELECT {D}, 6 AS rows, 3 AS columns, 'Label|Value|Other' AS header FROM customer")
def grid_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir)
    return grids.shapes(found).join(grids.headers(found), ["doc", "table"]).select("doc", "rows", "columns", F.array_join("header", "|").alias("header"))


@query(f"SELECT {D}, CAST(c_custkey % 9 + 1 AS DOUBLE) + 0.25 AS value FROM customer WHERE c_custkey % 5 = 2")
def grid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value in the second column of the rows of one name, of tables found by their header."""
    found = cells(spark, sf_dir)
    wanted = found.join(grids.find(found, ["Label", "Val"]), ["doc", "table"], "left_semi")
    named = grids.row_named(grids.values(wanted), "row 2")
    return grids.column(named, 1).select("doc", "value")


@query(f"SELECT {D}, CAST(1 AS BIGINT) AS lost, CAST(1 AS BIGINT) AS gained, FALSE AS ok FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT {D}, 0, 0, TRUE FROM customer WHERE c_custkey % 2 = 1")
def grid_rows_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows lost and gained when a block is written into every other table."""
    found = cells(spark, sf_dir)
    block = found.where("row = 3 AND cell = 1 AND CAST(doc AS BIGINT) % 2 = 0").select("doc", "table", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit("999").alias("value"))
    made, _ = grids.update(found, block, row0=3, col0=1)
    return grids.rows_report(found, made).select("doc", "lost", "gained", "ok")


@query(f"SELECT {D}, 3 AS \"row\", CAST(c_custkey % 700 + 100 AS VARCHAR) AS was, '999' AS now FROM customer WHERE c_custkey % 2 = 0")
def grid_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir)
    block = found.where("row = 3 AND cell = 1 AND CAST(doc AS BIGINT) % 2 = 0").select("doc", "table", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit("999").alias("value"))
    return grids.update(found, block, row0=3, col0=1)[1].select("doc", "row", "was", "now")


@query(f"SELECT {D}, \"row\", kind FROM customer, (VALUES (0, 'header'), (1, 'panel'), (2, 'data'), (3, 'summary'), (4, 'blank'), (5, 'summary')) v(\"row\", kind)")
def grid_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each row of a table is."""
    return grids.plan_booktabs(cells(spark, sf_dir)).select("doc", "row", "kind")


@query(f"SELECT {D}, 4 AS \"row\" FROM customer")
def grid_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.blank_rows(cells(spark, sf_dir)).select("doc", "row")


@query(f"SELECT {D}, CASE r WHEN 1 THEN 'Panel A' WHEN 2 THEN 'row ' || CAST(c_custkey % 5 AS VARCHAR) WHEN 3 THEN 'Observations' WHEN 4 THEN '' ELSE 'N' END AS c0, CASE r WHEN 1 THEN '' WHEN 2 THEN CAST(c_custkey % 9 + 1 AS VARCHAR) || ',25**' WHEN 3 THEN CAST(c_custkey % 700 + 100 AS VARCHAR) WHEN 4 THEN '' ELSE '3' END AS c1 FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS r)")
def grid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data rows with a column for each cell."""
    return grids.to_frame(cells(spark, sf_dir), 3).select("doc", "c0", "c1")


@query("SELECT p_partkey AS id, CAST(p_size AS VARCHAR) || '.5' AS number, repeat('*', CAST(p_size % 4 AS BIGINT)) AS stars, CAST(p_size AS VARCHAR) || '.5' || repeat('*', CAST(p_size % 4 AS BIGINT)) || chr(10) || '(0.1)' AS shown FROM part WHERE p_size % 4 > 0")
def grid_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates with their stars, split and written."""
    size = F.col("p_size")
    number, stars = x(size.cast("string"), ".5"), F.expr("repeat('*', p_size % 4)")
    split = grids.split_stars(F.concat(number, stars))
    return table(spark, sf_dir, "part").where("p_size % 4 > 0").select(F.col("p_partkey").alias("id"), split["number"].alias("number"), split["stars"].alias("stars"), grids.result_cell(number, stars, F.lit("0.1")).alias("shown"))


@query(f"SELECT {D}, CAST(9360 AS BIGINT) AS most, TRUE AS fits FROM customer")
def grid_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the columns' widths fill a table's width and no more."""
    fitted = grids.fit_columns(cells(spark, sf_dir)).groupBy("doc").agg(F.sum("width").alias("s"))
    return fitted.select("doc", F.lit(9360).cast("long").alias("most"), F.col("s").between(9350, 9360).alias("fits"))


@query("SELECT n_nationkey AS id, 2 AS tops, 4 AS bottoms, 2 AS doubled FROM nation")
def grid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in three lines: rules above and below the header, and a double one under the last row."""
    tr = "<w:tr><w:tc><w:p/></w:tc><w:tc><w:tcPr><w:tcW w:w=\"1\"/></w:tcPr><w:p/></w:tc></w:tr>"
    made = grids.booktabs(x("<w:tbl>", tr, tr, tr, "</w:tbl>"), F.lit(1))
    count = lambda p: F.regexp_count(made, F.lit(p))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), count("<w:top ").alias("tops"), count("<w:bottom ").alias("bottoms"), count('w:val="double"').alias("doubled"))


@query(
    """
    SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Ek, A., and Bo Ny. (2001). On it. Journal, 12(3): 1–20.' WHEN 1 THEN 'Ek, A. (1999). Clean. http://x.y/1-2-3 10.1/a-1 5–7.' WHEN 2 THEN 'Ek, A. (1999). Pages pp. 3–4.' ELSE 'No year at all 1-2' END AS text,
           CASE o_orderkey % 4 WHEN 0 THEN 'ampersand,and-comma,year-parens,en-dash,journal-comma' WHEN 1 THEN 'year-parens,en-dash' WHEN 2 THEN 'page-space,en-dash' ELSE 'en-dash' END AS fixes,
           CASE o_orderkey % 4 WHEN 0 THEN 'Ek, A. & Bo Ny. 2001' WHEN 1 THEN 'Ek, A. 1999' WHEN 2 THEN 'Ek, A. (1999)' END AS head
    FROM orders WHERE o_orderkey % 4 < 3
    """
)
def entries_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the house's form, and what was mended."""
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, "Ek, A. & Bo Ny. 2001. On it. Journal 12(3): 1-20.").when(k % 4 == 1, "Ek, A. 1999. Clean. http://x.y/1-2-3 10.1/a-1 5-7.").when(k % 4 == 2, "Ek, A. (1999). Pages pp.3-4.").otherwise("No year at all 1-2")
    rows = table(spark, sf_dir, "orders").where(k % 4 < 3).select(k.alias("id"), raw.alias("raw")).withColumn("c", entries.convert_text(F.col("raw")))
    return rows.select("id", F.col("c.text").alias("text"), F.array_join("c.fixes", ",").alias("fixes"), entries.reference_head(F.col("raw")).alias("head"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS doc, CAST(n_nationkey AS BIGINT) AS pos, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY lower(n_name)) - 1 AS INTEGER) AS place FROM nation")
def entries_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where entries file."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("doc"), F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("surname"), F.concat("n_name", F.lit(", A. 2001.")).alias("text"))
    return entries.refile(rows).select("doc", "pos", "place")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'indent' ELSE '' END AS issues FROM part")
def entry_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.when(F.col("p_partkey") % 2 == 0, "<w:p><w:pPr/></w:p>").otherwise('<w:p><w:pPr><w:spacing w:line="240"/><w:ind w:left="720" w:hanging="720"/></w:pPr></w:p>')
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(entries.entry_layout(xml), ",").alias("issues"))


@query(
    """
    SELECT p_partkey AS id, p_partkey % 2 = 0 AS inline, TRUE AS displayed, '(' || p_size || ')' AS number, CASE WHEN p_partkey % 2 = 0 THEN 'β=1' END AS harvested, p_partkey % 2 = 0 AS bold, TRUE AS parses,
           CASE WHEN p_partkey % 2 = 0 THEN 'symbol β; interval [0, 1]' ELSE 'interval [0, 1]' END AS prose
    FROM part
    """
)
def formula_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equations that stand alone and how they are laid out, found again, numbered, declared, and maths typed as prose."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    maths = F.when(k % 2 == 0, "<m:oMath><m:r><m:t>β=1</m:t></m:r></m:oMath>").otherwise("<m:oMath><m:r><m:t>γ</m:t></m:r></m:oMath>")
    alone = F.when(k % 2 == 0, x("<w:p>", maths, "</w:p>")).otherwise(x("<w:p><m:oMathPara>", maths, "</m:oMathPara></w:p>"))
    numbered = x("<w:p>", maths, "<w:r><w:t> (", n, ")</w:t></w:r></w:p>")
    said = x("<w:p><w:r><w:t>Let β be in [0, 1] here.</w:t></w:r></w:p>")
    run = F.when(k % 2 == 0, '<m:r><m:rPr><m:sty m:val="b"/></m:rPr><m:t>x</m:t></m:r>').otherwise("<m:r><m:t>x</m:t></m:r>")
    symbols = F.when(k % 2 == 0, F.array(F.lit("β"))).otherwise(F.array(F.lit("γ")))
    grid = formulas.number_display(numbered)
    told = formulas.prose_math(said, symbols)
    return table(spark, sf_dir, "part").select(
        k.alias("id"), formulas.inline_display(alone).alias("inline"), formulas.in_display_mode(formulas.display(alone)).alias("displayed"), F.regexp_extract(grid, r"<w:t>(\([^<]*\))</w:t>", 1).alias("number"),
        F.regexp_extract(formulas.harvest(numbered, F.lit("β")), "<m:t>(.*?)</m:t>", 1).alias("harvested"), formulas.is_bold(run).alias("bold"), F.contains(formulas.clone(maths), F.lit('xmlns:m="')).alias("parses"),
        F.array_join(F.transform(told, lambda t: F.concat_ws(" ", t["kind"], t["said"])), "; ").alias("prose"),
    )
