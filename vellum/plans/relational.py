"""The relational core of manuscript audits.

The tables hold no manuscripts, so document rows are derived from them the same way on both sides:
orders of status F are reference entries and those of status O are mentions (keyed by customer and
year), orders are notes and their line items the references to them, line numbers are section
numbers under an order, events are the revision log (user = author, type = kind) and the step log
(value = seconds), and lines of ``documents`` are paragraphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators import audits, checks, tables, windows
from vellum.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

ENTRIES_SQL = "SELECT DISTINCT o_custkey AS surname, year(o_orderdate) AS year FROM orders WHERE o_orderstatus = 'F'"
MENTIONS_SQL = "SELECT DISTINCT o_custkey AS surname, year(o_orderdate) AS year FROM orders WHERE o_orderstatus = 'O'"


def works(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status)
    return orders.select(F.col("o_custkey").alias("surname"), F.year("o_orderdate").cast("long").alias("year")).distinct()


@query(f"SELECT surname, year FROM ({MENTIONS_SQL}) WHERE (surname, year) NOT IN (SELECT (surname, year) FROM ({ENTRIES_SQL}))")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited but not listed."""
    return checks.missing(works(spark, sf_dir, "O"), works(spark, sf_dir, "F"), ["surname", "year"])


@query(f"SELECT surname, year FROM ({ENTRIES_SQL}) WHERE (surname, year) NOT IN (SELECT (surname, year) FROM ({MENTIONS_SQL}))")
def uncited_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed but never cited."""
    return checks.missing(works(spark, sf_dir, "F"), works(spark, sf_dir, "O"), ["surname", "year"])


@query("SELECT o_orderkey AS note_id, o_orderpriority AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note definitions that no reference points at."""
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), F.col("o_orderpriority").alias("kind"))
    return checks.missing(notes, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id")), ["note_id"])


@query(
    f"""
    WITH refs AS ({ENTRIES_SQL}), cites AS (SELECT o_orderkey, o_custkey AS surname, year(o_orderdate) AS year FROM orders WHERE o_orderstatus = 'P')
    SELECT c.o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM refs r WHERE r.surname = c.surname AND r.year = c.year) THEN c.surname
                              WHEN EXISTS (SELECT 1 FROM refs r WHERE r.surname = c.surname + 1 AND r.year = c.year) THEN c.surname + 1
                              ELSE c.surname END AS lead
    FROM cites c
    """
)
def reconciled_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mis-read lead author gives way to the next name only where the list has that one for the year."""
    cites = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("surname"), F.year("o_orderdate").cast("long").alias("year"))
    refs = works(spark, sf_dir, "F")
    own = refs.select(F.col("surname").alias("own_name"), F.col("year").alias("own_year"))
    other = refs.select(F.col("surname").alias("next_name"), F.col("year").alias("next_year"))
    joined = cites.join(own, (F.col("surname") == F.col("own_name")) & (F.col("year") == F.col("own_year")), "left")
    joined = joined.join(other, (F.col("surname") + 1 == F.col("next_name")) & (F.col("year") == F.col("next_year")), "left")
    return joined.select("o_orderkey", F.coalesce("own_name", "next_name", "surname").alias("lead"))


@query(
    """
    SELECT surname, year, o_orderkey AS first_mention FROM (
        SELECT o_custkey AS surname, year(o_orderdate) AS year, o_orderkey,
               row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS k
        FROM orders WHERE o_orderstatus = 'O')
    WHERE k = 1
    """
)
def first_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first mention of each work, which is the one that gets the link."""
    mentions = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("surname"), F.year("o_orderdate").cast("long").alias("year"), "o_orderdate", "o_orderkey")
    return windows.first_of(mentions, ["surname", "year"], ["o_orderdate", "o_orderkey"]).select("surname", "year", F.col("o_orderkey").alias("first_mention"))


PARTS_SQL = """
    before AS (SELECT p_partkey AS part, md5(p_brand) AS print FROM part WHERE p_partkey % 7 <> 0),
    after AS (SELECT p_partkey AS part, md5(CASE WHEN p_size > 40 THEN p_type ELSE p_brand END) AS print FROM part WHERE p_partkey % 11 <> 0)
"""


@query(
    f"""
    WITH {PARTS_SQL}
    SELECT coalesce(b.part, a.part) AS part, CASE WHEN b.part IS NULL THEN 'added' WHEN a.part IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM before b FULL OUTER JOIN after a ON a.part = b.part
    WHERE a.print IS DISTINCT FROM b.print
    """
)
def changed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that differ between two packages, by fingerprint."""
    parts = table(spark, sf_dir, "part")
    before = parts.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("part"), F.md5("p_brand").alias("print"))
    after = parts.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("part"), F.md5(F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(F.col("p_brand"))).alias("print"))
    return checks.changes(before, after, "part", "print")


@query(
    """
    WITH t AS (SELECT conv_id, turn, role FROM conversations)
    SELECT c.conv_id, c.turn, c.role, p.role AS parent_role FROM t c LEFT JOIN t p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
    """
)
def comment_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comment with the author of the one it replies to."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    parents = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    return turns.join(parents, ["conv_id", "turn"], "left")


#: Blocks by the customer's key modulo four: captions above, captions below, a table behind another caption, and prose only.
LAYOUTS = {0: "c t p c t", 1: "t c p t c", 2: "c c t p t", 3: "p p c p t"}
OWNERS = {0: {1: 0, 4: 3}, 1: {0: 1, 3: 4}, 2: {2: 1, 4: None}, 3: {4: 2}}
NAMES = {"c": "caption", "t": "table", "p": "paragraph"}


def _owners_sql() -> str:
    rows = [(m, t, "NULL" if c is None else c) for m, owners in OWNERS.items() for t, c in owners.items()]
    return f"SELECT c_custkey AS doc, CAST(t AS BIGINT) AS pos, CAST(c AS BIGINT) AS caption FROM customer, (VALUES {', '.join(map(str, rows)).replace(chr(39), '')}) v(m, t, c) WHERE c_custkey % 4 = m"


@query(_owners_sql())
def tables_with_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table with the caption that owns it: no caption reaches behind another, and the table below wins what is open."""
    layouts = F.array(*(F.array(*(F.lit(NAMES[b]) for b in LAYOUTS[m].split())) for m in range(4)))
    laid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.posexplode(F.element_at(layouts, (F.col("c_custkey") % 4 + 1).cast("int"))).alias("pos", "kind"))
    return tables.owned_tables(laid.withColumn("pos", F.col("pos").cast("long")))


@query(
    """
    WITH spans AS (SELECT l_orderkey AS doc, l_linenumber AS span, l_shipdate AS start, l_shipdate + INTERVAL 10 DAY AS stop FROM lineitem)
    SELECT a.doc, a.span AS a, b.span AS b, CAST(count(*) AS BIGINT) AS overlaps
    FROM spans a JOIN spans b ON a.doc = b.doc AND a.span < b.span AND a.start < b.stop AND b.start < a.stop
    GROUP BY ALL
    """
)
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one document that overlap."""
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("span"), F.col("l_shipdate").alias("start"), F.expr("l_shipdate + INTERVAL 10 DAYS").alias("stop"))
    return windows.overlaps(spans, "doc", "span", "start", "stop").groupBy("doc", "a", "b").agg(F.count("*").alias("overlaps"))


ROWS_SQL = "SELECT l_orderkey AS doc, l_partkey AS label, l_quantity AS value FROM lineitem WHERE"


@query(
    f"""
    SELECT doc, label, value, 'lost' AS side, CAST(count(*) AS BIGINT) AS times FROM ({ROWS_SQL} l_linestatus = 'O' EXCEPT ALL {ROWS_SQL} l_returnflag = 'N') GROUP BY ALL
    UNION ALL
    SELECT doc, label, value, 'gained', CAST(count(*) AS BIGINT) FROM ({ROWS_SQL} l_returnflag = 'N' EXCEPT ALL {ROWS_SQL} l_linestatus = 'O') GROUP BY ALL
    """
)
def rows_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows lost and gained between two versions, repeats counted."""
    rows = table(spark, sf_dir, "lineitem")
    pick = lambda where: rows.where(where).select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("label"), F.col("l_quantity").alias("value"))
    return checks.multiset_changes(pick("l_linestatus = 'O'"), pick("l_returnflag = 'N'"))


@query(
    """
    WITH was AS (SELECT l_orderkey AS bookmark FROM lineitem WHERE l_returnflag = 'A'), now AS (SELECT l_orderkey AS bookmark FROM lineitem WHERE l_returnflag = 'N'),
         back AS (SELECT l_orderkey AS bookmark FROM lineitem WHERE l_tax > 0.06)
    SELECT bookmark FROM (SELECT bookmark FROM was EXCEPT SELECT bookmark FROM now) INTERSECT SELECT bookmark FROM back
    """
)
def restored_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks that an edit removed and that were put back."""
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "bookmark")
    pick = lambda where: rows.where(where).select("bookmark")
    return pick("l_returnflag = 'A'").subtract(pick("l_returnflag = 'N'")).intersect(pick("l_tax > 0.06"))


@query(
    f"""
    SELECT 'missing-ref' AS finding, surname, year FROM ({MENTIONS_SQL}) WHERE (surname, year) NOT IN (SELECT (surname, year) FROM ({ENTRIES_SQL}))
    UNION ALL SELECT 'uncited-ref', surname, year FROM ({ENTRIES_SQL}) WHERE (surname, year) NOT IN (SELECT (surname, year) FROM ({MENTIONS_SQL}))
    UNION ALL SELECT 'ambiguous-cite', o_custkey, year(o_orderdate) FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL HAVING count(*) > 1
    """
)
def reference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the citation audit in one report."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("surname"), F.year("o_orderdate").cast("long").alias("year"))
    return checks.report(
        {
            "missing-ref": missing_references(spark, sf_dir),
            "uncited-ref": uncited_references(spark, sf_dir),
            "ambiguous-cite": checks.repeated(orders, ["surname", "year"]).select("surname", "year"),
        }
    )


@query("SELECT user_id AS author, event_type AS kind, CAST(count(*) AS BIGINT) AS revisions, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY ALL")
def revisions_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of each author by kind."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("author"), F.col("event_type").alias("kind"), "ts")
    return log.groupBy("author", "kind").agg(F.count("*").alias("revisions"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query(
    """
    SELECT o_custkey AS surname, year(o_orderdate) AS year, CAST(count(*) AS BIGINT) AS entries FROM orders GROUP BY ALL HAVING count(*) > 1
    """
)
def ambiguous_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with more than one entry."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("surname"), F.year("o_orderdate").cast("long").alias("year"))
    return checks.repeated(orders, ["surname", "year"]).withColumnRenamed("times", "entries")


@query(
    """
    SELECT l_orderkey AS doc, CAST(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS DOUBLE) AS prose, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS DOUBLE) AS tables,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS DOUBLE) AS footnotes FROM lineitem GROUP BY 1
    """
)
def buckets_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a column per bucket."""
    names = {"A": "prose", "N": "tables", "R": "footnotes"}
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("bucket"), "l_quantity")
    pivot = rows.groupBy("doc").pivot("bucket", list(names)).agg(F.sum("l_quantity"))
    return pivot.select("doc", *(F.coalesce(k, F.lit(0.0)).alias(v) for k, v in names.items()))


@query(
    """
    WITH sizes AS (SELECT l_suppkey AS doc, CAST(l_quantity AS BIGINT) AS size, count(*) AS n FROM lineitem GROUP BY ALL),
         house AS (SELECT doc, size FROM (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY n DESC, size) AS k FROM sizes) WHERE k = 1)
    SELECT s.doc, s.size, CAST(s.n AS BIGINT) AS notes, h.size AS house FROM sizes s JOIN house h ON s.doc = h.doc WHERE s.size <> h.size AND s.n <= 2
    """
)
def odd_note_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes whose size is a rarity against their document's most common one."""
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_quantity").cast("long").alias("size"))
    return windows.off_mode(notes, "doc", "size").where("times <= 2").select("doc", "size", F.col("times").alias("notes"), F.col("mode").alias("house"))


@query(
    """
    WITH s AS (SELECT user_id % 40 AS name, value AS seconds, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id % 40) AS n FROM events WHERE event_type <> 'error'),
         m AS (SELECT name, n, CAST(quantile_cont(CASE WHEN k <= greatest(3, n // 3) THEN seconds END, 0.5) AS DOUBLE) AS now, CAST(quantile_cont(CASE WHEN k > greatest(3, n // 3) THEN seconds END, 0.5) AS DOUBLE) AS was FROM s WHERE n >= 6 GROUP BY ALL)
    SELECT name, was, now, now - was AS delta, CAST(n AS BIGINT) AS samples FROM m WHERE now >= was * 1.01 AND now - was >= 0.1
    """
)
def step_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose recent median stands clear of the earlier one."""
    log = table(spark, sf_dir, "events").where("event_type <> 'error'").select((F.col("user_id") % 40).alias("name"), F.col("value").alias("seconds"), "ts", "event_id")
    return windows.regressions(log, "name", "seconds", ["ts", "event_id"], slower=1.01, floor=0.1)


@query("SELECT l_suppkey AS doc, CAST(count(DISTINCT l_partkey) AS BIGINT) AS styles FROM lineitem GROUP BY 1")
def styles_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many styles each document uses."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("doc")).agg(F.countDistinct("l_partkey").alias("styles"))


PAGES_SQL = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS sheet, l_linenumber AS printed FROM lineitem"


@query(
    f"""
    SELECT doc, sheet, printed, CASE WHEN printed <= was THEN 'RESTART' ELSE 'JUMP' END AS finding
    FROM (SELECT *, lag(printed) OVER (PARTITION BY doc ORDER BY sheet) AS was FROM ({PAGES_SQL})) WHERE printed <> was + 1
    """
)
def page_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets whose printed number restarts or jumps."""
    order = Window.partitionBy("doc").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    sheets = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc").select("doc", F.row_number().over(order).cast("long").alias("sheet"), F.col("l_linenumber").alias("printed"))
    return windows.numbering_breaks(sheets, "doc", "sheet", "printed")


@query(
    """
    SELECT doc, number, CAST(expected AS BIGINT) AS expected FROM (
        SELECT l_orderkey AS doc, l_linenumber AS number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS expected FROM lineitem)
    WHERE number <> expected
    """
)
def section_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that don't run 1 to N under their parent, in document order."""
    sections = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("number"), "l_shipdate")
    return windows.not_in_sequence(sections, ["doc"], ["l_shipdate", "number"], "number").select("doc", "number", "expected")


@query(
    """
    SELECT doc, pos, last_value(author IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS author
    FROM (SELECT user_id AS doc, event_id AS pos, CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END AS author FROM events)
    """
)
def inherited_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A continuation entry has the author of the entry it continues."""
    author = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    entries = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), author.alias("author"))
    return windows.forward_fill(entries, "doc", "pos", "author")


@query("SELECT doc_id, pos, CAST(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - len(line) - 1 AS BIGINT) AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)")
def paragraph_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each paragraph starts in its document's text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long").alias("start"))


@query(
    """
    WITH r AS (SELECT user_id AS doc, event_id AS pos, event_type AS format, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events),
         g AS (SELECT doc, pos, format, sum(CASE WHEN was IS DISTINCT FROM format THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS island FROM r)
    SELECT doc, CAST(island AS BIGINT) AS island, format, min(pos) AS start, max(pos) AS stop, CAST(count(*) AS BIGINT) AS length FROM g GROUP BY doc, island, format
    """
)
def format_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbours with one format."""
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.col("event_type").alias("format"))
    return windows.islands(runs, "doc", "pos", "format")


SHEETS_SQL = "SELECT l_orderkey AS doc, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS INTEGER) AS sheet, CAST(l_quantity AS DOUBLE) AS chars, l_returnflag = 'R' AS exhibit FROM lineitem"


def sheets_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(order).alias("sheet"), F.col("l_quantity").alias("chars"), (F.col("l_returnflag") == "R").alias("exhibit"))


@query(
    f"""
    SELECT doc, sheet, chars, exhibit, fullest FROM (SELECT *, max(CASE WHEN NOT exhibit THEN chars END) OVER w AS fullest, min(sheet) OVER w AS lo, max(sheet) OVER w AS hi FROM ({SHEETS_SQL}) WINDOW w AS (PARTITION BY doc))
    WHERE NOT exhibit AND sheet NOT IN (lo, hi) AND chars < 0.5 * fullest
    """
)
def underfilled_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets that hold less than half of their document's fullest sheet of text; first, last and exhibits' sheets never count."""
    return windows.underfilled(sheets_of(spark, sf_dir))


@query(
    f"""
    WITH s AS ({SHEETS_SQL}), u AS (SELECT doc, sheet FROM (SELECT *, max(CASE WHEN NOT exhibit THEN chars END) OVER w AS fullest, min(sheet) OVER w AS lo, max(sheet) OVER w AS hi FROM s WINDOW w AS (PARTITION BY doc))
        WHERE NOT exhibit AND sheet NOT IN (lo, hi) AND chars < 0.5 * fullest)
    SELECT u.doc, u.sheet, e.sheet AS exhibit FROM u LEFT JOIN s e ON e.doc = u.doc AND e.exhibit AND e.sheet = u.sheet + 1
    """
)
def blamed_exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short sheets with the exhibit that starts on the next one."""
    sheets = sheets_of(spark, sf_dir)
    landings = sheets.where("exhibit").select("doc", F.col("sheet").alias("exhibit"), F.col("sheet").alias("first"))
    return windows.blamed(windows.underfilled(sheets).select("doc", "sheet"), landings)


@query(
    """
    WITH r AS (SELECT c_custkey % 7 AS g, c_custkey // 7 AS n, c_custkey FROM customer), s AS (SELECT g, n, c_custkey, row_number() OVER (PARTITION BY g ORDER BY n) - 1 AS k, count(*) OVER (PARTITION BY g) AS t FROM r)
    SELECT CAST(g AS BIGINT) AS doc, CAST(0 AS BIGINT) AS pos, CAST(t - 1 AS INTEGER) AS place FROM s WHERE k = t - 1
    """
)
def reference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that have to move for their list to be sorted, where one entry of each list was put first: that one, and no other."""
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).cast("long").alias("doc"), F.format_string("Name%08d", F.expr("c_custkey DIV 7")).alias("surname"))
    order = Window.partitionBy("doc").orderBy("surname")
    listed = customers.withColumn("k", F.row_number().over(order)).withColumn("t", F.count("*").over(Window.partitionBy("doc")))
    put = listed.select("doc", F.when(F.col("k") == F.col("t"), 0).otherwise(F.col("k")).cast("long").alias("pos"), F.concat(F.lit("Ü"), "surname").alias("surname"), F.concat(F.lit("ü"), "surname", F.lit(", A. (2001).")).alias("text"))
    return audits.entry_order(put)


@query(
    """
    WITH n AS (SELECT l_suppkey AS doc, CASE WHEN l_quantity < 48 THEN 1 ELSE CAST(l_quantity AS BIGINT) END AS sep FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0),
         c AS (SELECT doc, sep, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc) AS total, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, sep) AS k FROM n GROUP BY doc, sep),
         h AS (SELECT doc, sep AS practice FROM c WHERE k = 1 AND n >= 8 AND n >= total * 0.9 AND total - n <= 2)
    SELECT n.doc, n.sep, h.practice FROM n JOIN h ON h.doc = n.doc WHERE n.sep <> h.practice
    """
)
def odd_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locators written unlike the practice of their list, where there is one."""
    notes = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_orderkey % 3 = 0").select(F.col("l_suppkey").alias("doc"), F.when(F.col("l_quantity") < 48, 1).otherwise(F.col("l_quantity").cast("long")).alias("sep"))
    return windows.off_majority(notes, "doc", "sep")


@query(
    """
    WITH f AS (SELECT l_suppkey AS doc, l_partkey AS note, min(l_shipdate) AS first FROM lineitem GROUP BY ALL)
    SELECT doc, note, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY first, note) AS BIGINT) AS number FROM f
    """
)
def renumbered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes numbered in the order of their first reference."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("note"), "l_shipdate")
    return windows.renumber(rows, "doc", "note", "l_shipdate")


@query(
    """
    SELECT doc, label, CAST(row_number() OVER (PARTITION BY doc ORDER BY label IN (1, 2), label, value, part) AS BIGINT) AS place, value, part
    FROM (SELECT l_orderkey AS doc, l_linenumber AS label, CAST(l_quantity AS DOUBLE) AS value, l_partkey AS part FROM lineitem)
    """
)
def rows_with_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sorted by label, listed ones last."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("label"), F.col("l_quantity").alias("value"), F.col("l_partkey").alias("part"))
    return tables.pinned_order(rows, "doc", "label", [1, 2], ["value", "part"])


@query(
    """
    SELECT name, event_id, seconds FROM (SELECT event_type AS name, event_id, value AS seconds, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 8
    """
)
def slowest_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight costliest runs of each step."""
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "event_id", F.col("value").alias("seconds"))
    return windows.top(log, ["name"], [F.desc("seconds"), F.col("event_id")], 8)


@query(
    """
    WITH RECURSIVE base AS (SELECT p_partkey AS style, CASE WHEN p_partkey % 5 <> 0 AND p_partkey > 3 THEN p_partkey // 3 END AS parent, CASE WHEN p_size > 30 THEN p_size END AS size FROM part),
    walk AS (SELECT style, parent, size, 0 AS depth FROM base UNION ALL SELECT w.style, b.parent, b.size, w.depth + 1 FROM walk w JOIN base b ON w.parent = b.style WHERE w.size IS NULL)
    SELECT style, max(size) AS size FROM walk GROUP BY style
    """
)
def inherited_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property of a style, from the nearest style it is based on that sets it."""
    styles = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("style"),
        F.when((F.col("p_partkey") % 5 != 0) & (F.col("p_partkey") > 3), F.expr("p_partkey DIV 3")).alias("parent"),
        F.when(F.col("p_size") > 30, F.col("p_size")).alias("size"),
    )
    return tables.inherit(styles, "style", "parent", "size")


@query(
    """
    WITH v AS (SELECT l_orderkey AS doc, l_linenumber AS pos, max(CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS truth, max(CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS proposal, max(CASE WHEN l_returnflag = 'N' THEN l_partkey END) AS now FROM lineitem GROUP BY ALL)
    SELECT doc, pos, CASE WHEN now IS NOT DISTINCT FROM proposal THEN 'kept' WHEN now IS NOT DISTINCT FROM truth THEN 'reverted' ELSE 'authored' END AS verdict FROM v
    """
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of a proposal: kept, reverted to the earlier truth, or written anew."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), "l_returnflag", "l_partkey")
    side = lambda flag: F.max(F.when(F.col("l_returnflag") == flag, F.col("l_partkey")))
    found = rows.groupBy("doc", "pos").agg(side("A").alias("truth"), side("R").alias("proposal"), side("N").alias("now"))
    return checks.verdict(found, "truth", "proposal", "now").select("doc", "pos", "verdict")


@query("SELECT l_orderkey AS doc, l_linenumber AS id, CAST(count(*) AS BIGINT) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that one document uses more than once."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"))
    return checks.repeated(rows, ["doc", "id"])


@query(
    """
    SELECT page_id, CAST(pos AS BIGINT) AS pos, link[1] AS target, link[2] AS label FROM (
        SELECT page_id, generate_subscripts(t, 1) - 1 AS pos, unnest(list_transform(list_zip(t, l), lambda x: [x[1], x[2]])) AS link
        FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS t, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS l FROM pages))
    """
)
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page in order, with what they show."""
    pattern = F.lit('<a href="([^"]*)">([^<]*)</a>')
    pages = table(spark, sf_dir, "pages")
    pairs = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("target"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("label"))
    found = pages.select("page_id", F.posexplode(pairs).alias("pos", "link"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), F.col("link.target").alias("target"), F.col("link.label").alias("label"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quoted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage whole; passages are few, and their size is checked before they are sent out."""
    return checks.containment(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
