"""Tables of manuscripts as rows of cells: looking them up, reading their values, rewriting blocks, classifying and measuring them.

Cells are ``(doc, table, row, cell, gcol, text)`` as ``documents.cells`` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import numbers
from vellum.functions.numbers import let
from vellum.functions.text import normalize_glyphs

KEY = ("doc", "table")


def headers(cells: DataFrame, row: int = 0) -> DataFrame:
    """``(doc, table, header)``: the texts of a header row, in order."""
    return cells.where(F.col("row") == row).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]).alias("header"))


def shapes(cells: DataFrame) -> DataFrame:
    """``(doc, table, rows, columns)``."""
    return cells.groupBy(*KEY).agg((F.max("row") + 1).alias("rows"), (F.max("cell") + 1).alias("columns"))


def column(cells: DataFrame, index: int) -> DataFrame:
    """A column's cells, the header's left out."""
    return cells.where((F.col("cell") == index) & (F.col("row") > 0))


def row_named(cells: DataFrame, label: str) -> DataFrame:
    """The cells of each table's first data row that begins with ``label``."""
    first = cells.where((F.col("cell") == 0) & (F.col("row") > 0) & (F.trim("text") == label)).groupBy(*KEY).agg(F.min("row").alias("row"))
    return cells.join(first, [*KEY, "row"])


def find(cells: DataFrame, wanted: list[str]) -> DataFrame:
    """``(doc, table)``: each document's first table whose header cells hold the wanted texts, in order."""
    fits = F.forall(F.zip_with("header", F.array(*(F.lit(w) for w in wanted)), lambda h, w: w.isNull() | F.coalesce(F.contains(h, w), F.lit(False))), lambda x: x) & (F.size("header") >= len(wanted))
    return headers(cells).where(fits).groupBy("doc").agg(F.min("table").alias("table"))


def row_signature(cells: DataFrame, skip_header: bool = True) -> DataFrame:
    """``(doc, table, signature, times)``: rows as lists of their cells, glyphs and white space in one spelling, and how often they are there."""
    plain = F.trim(F.regexp_replace(normalize_glyphs(F.col("text")), r"(?U)\s+", " "))
    rows = cells.where(F.col("row") >= int(skip_header)).groupBy(*KEY, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", plain.alias("t")))), lambda c: c["t"]).alias("signature"))
    return rows.groupBy(*KEY, "signature").agg(F.count("*").alias("times"))


def rows_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(doc, table, lost, gained, ok)``: whether a table kept exactly its rows, in any order."""
    was, now = row_signature(before).withColumnRenamed("times", "a"), row_signature(after).withColumnRenamed("times", "b")
    both = was.join(now, [*KEY, "signature"], "full_outer").withColumn("d", F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))
    told = both.groupBy(*KEY).agg(F.sum(F.greatest("d", F.lit(0))).alias("lost"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("gained"))
    return told.withColumn("ok", (F.col("lost") == 0) & (F.col("gained") == 0))


def values(cells: DataFrame) -> DataFrame:
    """Cells with ``value``, read by the decimal mark that their table shows."""
    marked = cells.withColumn("_mark", numbers.decimal_mark(F.col("text"), Window.partitionBy(*KEY)))
    return marked.withColumn("value", numbers.parse_number(F.col("text"), F.col("_mark"))).drop("_mark")


def to_frame(cells: DataFrame, width: int) -> DataFrame:
    """``(doc, table, row, c0, c1, ...)``: data rows with a column for each of ``width`` cells; a short row is filled with null."""
    wide = cells.where("row > 0").groupBy(*KEY, "row").pivot("cell", list(range(width))).agg(F.first("text"))
    return wide.select(*KEY, "row", *(F.col(str(i)).alias(f"c{i}") for i in range(width)))


def result_cell(number: Column, stars: Column, se: Column) -> Column:
    """An estimate as printed: number, stars, and its standard error in brackets below."""
    return F.concat(number, F.coalesce(stars, F.lit("")), F.coalesce(F.concat(F.lit("\n("), se, F.lit(")")), F.lit("")))


def update(cells: DataFrame, block: DataFrame, row0: int = 1, col0: int = 0) -> tuple[DataFrame, DataFrame]:
    """Cells with a block ``(doc, table, i, j, value)`` written from a corner on, and the changes ``(doc, table, row, cell, was, now)``."""
    new = block.select(*KEY, (F.col("i") + row0).alias("row"), (F.col("j") + col0).alias("cell"), F.col("value").alias("_new"))
    joined = cells.join(new, [*KEY, "row", "cell"], "left")
    changed = joined.where("_new IS NOT NULL AND NOT _new <=> text").select(*KEY, "row", "cell", F.col("text").alias("was"), F.col("_new").alias("now"))
    return joined.withColumn("text", F.coalesce("_new", "text")).drop("_new"), changed


def blank_rows(cells: DataFrame) -> DataFrame:
    """``(doc, table, row)`` of rows that say nothing; the last row of a table stays."""
    rows = cells.groupBy(*KEY, "row").agg(F.max(F.trim("text") != "").alias("_says")).withColumn("_last", F.max("row").over(Window.partitionBy(*KEY)))
    return rows.where("NOT _says AND row < _last").select(*KEY, "row")


def split_stars(text: Column) -> Column:
    """struct(number, stars): a cell's significance stars, to be raised, and what stands before them."""
    return F.struct(F.regexp_extract(text, r"^(.*?)\s*\*{1,3}$", 1).alias("number"), F.regexp_extract(text, r"(\*{1,3})$", 1).alias("stars"))


STATS = r"(?iu)^\s*(?:observations|obs\.?|n|r-?squared|r2|r²|adj\. r|f-?stat|log likelihood|clusters)\b"


def plan_booktabs(cells: DataFrame) -> DataFrame:
    """``(doc, table, row, kind)``: header rows, panels (a label alone), the summary block at the end, and data.

    The header ends before the first row that holds a number; the summary begins with the first row, behind
    all estimates, that names a statistic.
    """
    numeric = numbers.parse_number(F.col("text")).isNotNull() & (F.col("cell") > 0)
    rows = cells.groupBy(*KEY, "row").agg(F.max(numeric).alias("_num"), F.count_if(F.trim("text") != "").alias("_full"), F.max(F.when(F.col("cell") == 0, F.trim("text"))).alias("_label"))
    order = Window.partitionBy(*KEY).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_seen", F.max("_num").over(order)).withColumn("_stat", F.max(F.col("_label").rlike(STATS)).over(order))
    kind = F.when(~F.col("_seen") & ~((F.col("_full") == 1) & (F.col("row") > 0)), "header").when((F.col("_full") == 1) & (F.coalesce("_label", F.lit("")) != ""), "panel").when(F.col("_full") == 0, "blank").when(F.col("_stat"), "summary").otherwise("data")
    return rows.select(*KEY, "row", kind.alias("kind"))


#: Widths of characters in thousandths of their size: narrow, wide, and all others.
NARROW, WIDE = "iljtfrI.,;:'!|()[] ", "mwMWQO@%"


def text_width(text: Column, size: float = 10.0) -> Column:
    """About how wide a text is, in twentieths of a point."""
    narrow = F.length(text) - F.length(F.translate(text, NARROW, ""))
    wide = F.length(text) - F.length(F.translate(text, WIDE, ""))
    return F.round((narrow * 300 + wide * 850 + (F.length(text) - narrow - wide) * 520) * F.lit(size * 20 / 1000)).cast("int")


def fit_columns(cells: DataFrame, total: int = 9360, pad: float = 1.05, least: int = 300) -> DataFrame:
    """``(doc, table, cell, want, width)``: a table's width divided by what its columns hold; each gets ``least`` at least."""
    longest = F.array_max(F.transform(F.split("text", "\n"), lambda t: text_width(t)))
    want = cells.groupBy(*KEY, "cell").agg(F.greatest(F.ceil(F.max(longest) * pad), F.lit(least)).cast("int").alias("want"))
    whole = Window.partitionBy(*KEY)
    spare = F.lit(total) - F.count("*").over(whole) * least
    share = (F.col("want") - least) / F.greatest(F.sum(F.col("want") - least).over(whole), F.lit(1))
    return want.withColumn("width", F.floor(F.lit(least) + share * F.greatest(spare, F.lit(0))).cast("int"))


def house_rpr(font: str, size: float, bold: bool = False) -> str:
    half = round(size * 2)
    return f'<w:rPr><w:rFonts w:ascii="{font}" w:hAnsi="{font}" w:eastAsia="{font}" w:cs="{font}"/>{"<w:b/>" * bold}<w:sz w:val="{half}"/><w:szCs w:val="{half}"/></w:rPr>'


def house_ppr(font: str, size: float) -> str:
    return f'<w:pPr><w:spacing w:before="0" w:after="0" w:line="240" w:lineRule="auto"/>{house_rpr(font, size)}</w:pPr>'


def _bordered(rows: Column, where: Column, side: str, kind: str, size: int) -> Column:
    """Rows of markup with a border on one side of each cell where wanted."""
    border = f'<w:{side} w:val="{kind}" w:sz="{size}" w:space="0" w:color="auto"/>'
    bare = F.regexp_replace(rows, rf"<w:{side} [^>]*/>", "")
    opened = F.regexp_replace(F.regexp_replace(bare, r"<w:tc>(?!<w:tcPr>)", "<w:tc><w:tcPr></w:tcPr>"), r"(<w:tcPr>)((?:(?!</w:tcPr>|<w:tcBorders>).)*)(</w:tcPr>)", "$1$2<w:tcBorders></w:tcBorders>$3")
    return F.when(where, F.regexp_replace(opened, r"<w:tcBorders>", f"<w:tcBorders>{border}")).otherwise(rows)


def bottom_border(table: Column, kind: str = "double", size: int = 4) -> Column:
    """A table's markup with its last row ruled off."""
    pieces = F.split(table, r"(?<=</w:tr>)")
    last = F.size(F.filter(pieces, lambda p: F.contains(p, F.lit("</w:tr>")))) - 1
    return let(pieces, lambda ps: F.array_join(F.transform(ps, lambda p, i: _bordered(p, i == last, "bottom", kind, size)), ""))


def booktabs(table: Column, header_rows: Column, rule: int = 4, bottom: str = "double") -> Column:
    """A table's markup in three lines: above and below the header, and under the last row."""
    pieces = F.split(table, r"(?<=</w:tr>)")
    topped = let(pieces, lambda ps: F.array_join(F.transform(ps, lambda p, i: _bordered(_bordered(p, i == header_rows - 1, "bottom", "single", rule), i == 0, "top", "single", rule)), ""))
    return bottom_border(topped, bottom, rule)
