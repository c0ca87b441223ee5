"""Audits of manuscripts: rules as columns, one finding per row, all families in one report.

Findings are ``(doc, pos, finding, subject)``.  Rules that look at one paragraph are expressions over
one scan; those that look at numbers and names across a document are joins and windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that name exhibits.
LABELS = ("Table", "Figure", "Box", "Chart", "Map", "Scheme")
_YEAR = r"(?:1[89]|20)\d{2}[a-z]?"

#: Rules on body text: a name, and a pattern each match of which is a finding.
PROSE_RULES = {
    "year-comma": rf"\(?[\p{{Lu}}][\p{{L}}'’-]+(?: et al\.)?, {_YEAR}(?=[;,)])",
    "et-al-period": r"\bet al(?![.\p{L}])",
    "page-space": r"\bpp?\.(?=\d)",
    "page-dash": r"\bpp?\. ?\d+-\d+",
    "ampersand": rf"[\p{{Lu}}][\p{{L}}'’-]+ & [\p{{Lu}}][\p{{L}}'’-]+,? \(?{_YEAR}",
}
#: Rules on entries of a reference list.
ENTRY_RULES = {
    "year-parens": rf"^[^(]*?[\p{{L}}.,] {_YEAR}\.",
    "ampersand": rf"^[^(]*?& (?=[^(]*\(?{_YEAR})",
    "and-comma": rf"^[\p{{L}}'’ -]+, [\p{{Lu}}]\. and [\p{{Lu}}]",
    "journal-comma": r"[\p{L}] \d{1,4}(?: ?\([^()]{1,12}\))? ?: ?[A-Za-z]?\d",
    "en-dash": r"(?<![\p{L}\d./:-])\d+-\d+(?![\d-]|/)",
}


def rule_findings(rows: DataFrame, text: str, rules: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep`` columns with ``finding`` and ``subject`` for each match of each rule; one scan for all rules."""

    def matches(name: str, pattern: str) -> Column:
        all_ = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.transform(all_, lambda m: F.struct(F.lit(name).alias("finding"), m.alias("subject")))

    found = F.flatten(F.array(*(matches(name, pattern) for name, pattern in rules.items())))
    return rows.select(*keep, F.explode(found).alias("_f")).select(*keep, "_f.*")


def prose_style(paragraphs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc", "pos")) -> DataFrame:
    return rule_findings(paragraphs, text, PROSE_RULES, list(keep))


def entry_style(entries: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc", "pos")) -> DataFrame:
    """An en-dash rule's first match counts; tokens of links and identifiers keep their hyphens."""
    plain = F.regexp_replace(text, r"\S*(?:http|doi|DOI)\S*|\b10\.\S+|\S*-\S*-\S*-\S*", "")
    dashes = {"en-dash": ENTRY_RULES["en-dash"]}
    others = {k: v for k, v in ENTRY_RULES.items() if k not in dashes}
    first = rule_findings(entries.withColumn("_plain", plain), "_plain", dashes, list(keep)).dropDuplicates([*keep, "finding"])
    return rule_findings(entries, text, others, list(keep)).unionByName(first)


def captions(blocks: DataFrame) -> DataFrame:
    """``(doc, pos, label, number, name)`` of captions; ``name`` is the bookmark they take."""
    pattern = rf"^({'|'.join(LABELS)})\s+(\d+)\b"
    found = blocks.select("doc", "pos", F.regexp_extract(F.trim("text"), pattern, 1).alias("label"), F.regexp_extract(F.trim("text"), pattern, 2).alias("number"), F.col("kind")).where("kind = 'caption' AND number <> ''")
    return found.select("doc", "pos", "label", "number", F.concat("label", "number").alias("name"))


def caption_numbers(caps: DataFrame) -> DataFrame:
    """Captions whose number is used twice, or isn't the next of its label."""
    order = Window.partitionBy("doc", "label").orderBy("pos")
    placed = caps.withColumn("_n", F.col("number").cast("int")).withColumn("_k", F.row_number().over(order)).withColumn("_times", F.count("*").over(Window.partitionBy("doc", "label", "number")))
    said = F.when(F.col("_times") > 1, "repeated-number").when(F.col("_n") != F.col("_k"), "number-out-of-order")
    return placed.select("doc", "pos", said.alias("finding"), F.concat_ws(" ", "label", "number").alias("subject")).where("finding IS NOT NULL")


def cross_references(caps: DataFrame, names: DataFrame, found_links: DataFrame) -> DataFrame:
    """``(doc, finding, subject)``: of each exhibit how it is linked, and links whose place is gone.

    An exhibit's bookmark is ``Table1``, its first mention's ``Table1txt``; each is to be linked to.
    """
    named = names.select("doc", F.col("name").alias("_name")).distinct()
    reached = found_links.select("doc", F.col("anchor").alias("_name")).distinct().withColumn("_reached", F.lit(True))
    marks = named.join(reached, ["doc", "_name"], "left")
    for end, column in (("", "cap"), ("txt", "txt")):
        side = marks.select(F.col("doc").alias("_d"), F.col("_name").alias("_m"), F.coalesce("_reached", F.lit(False)).alias(f"{column}_reached"), F.lit(True).alias(column))
        caps = caps.join(side, (F.col("doc") == F.col("_d")) & (F.concat("name", F.lit(end)) == F.col("_m")), "left").drop("_d", "_m")
    cap, txt = F.coalesce("cap", F.lit(False)), F.coalesce("txt", F.lit(False))
    state = F.when(cap & txt, F.when(F.col("cap_reached") & F.col("txt_reached"), "linked").otherwise("unreached")).when(cap, "caption-only").when(txt, "mention-only").otherwise("unlinked")
    states = caps.select("doc", state.alias("finding"), F.col("name").alias("subject"))
    dangling = reached.join(named, ["doc", "_name"], "left_anti").select("doc", F.lit("dangling").alias("finding"), F.col("_name").alias("subject"))
    return states.unionByName(dangling)


def sections(blocks: DataFrame) -> DataFrame:
    """``(doc, pos, number, parent, last)`` of numbered headings."""
    number = F.regexp_extract(F.trim("text"), r"^(\d+(?:\.\d+)*|[A-Z](?:\.\d+)+)\.?\s", 1)
    heads = blocks.where("kind = 'heading'").select("doc", "pos", number.alias("number")).where("number <> ''")
    return heads.select("doc", "pos", "number", F.regexp_extract("number", r"^(.*)\.[^.]+$", 1).alias("parent"), F.regexp_extract("number", r"(\d+)$", 1).cast("int").alias("last"))


def section_numbers(heads: DataFrame) -> DataFrame:
    """Numbers used twice, subsections under another parent, and children that don't run 1 to N."""
    key = Window.partitionBy("doc", "number")
    twice = heads.withColumn("_k", F.row_number().over(key.orderBy("pos"))).where("_k > 1").select("doc", "pos", F.lit("number-twice").alias("finding"), F.col("number").alias("subject"))
    order = Window.partitionBy("doc").orderBy("pos")
    above = F.lag("number").over(order)
    # a subsection follows its parent, a sibling or something below a sibling
    stray = F.coalesce(~F.startswith(F.concat(above, F.lit(".")), F.concat("parent", F.lit("."))), F.lit(True))
    astray = heads.withColumn("_s", stray).where("parent <> '' AND _s AND NOT parent RLIKE '^[A-Z]$'").select("doc", "pos", F.lit("parent-mismatch").alias("finding"), F.col("number").alias("subject"))
    place = F.row_number().over(Window.partitionBy("doc", "parent").orderBy("pos"))
    runs = heads.withColumn("_k", place).where("last <> _k").select("doc", "pos", F.lit("out-of-sequence").alias("finding"), F.col("number").alias("subject"))
    return reduce(DataFrame.unionByName, (twice, astray, runs))


def section_mentions(paragraphs: DataFrame, heads: DataFrame, text: str = "text") -> DataFrame:
    """Mentions of sections that the document doesn't have; documents without numbered headings aren't checked."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\b[Ss]ections?\s+(\d+(?:\.\d+)*)"), F.lit(1)))
    said = paragraphs.select("doc", "pos", found.alias("number"))
    known = heads.select("doc", "number").distinct()
    checked = said.join(heads.select("doc").distinct(), "doc", "left_semi")
    return checked.join(known, ["doc", "number"], "left_anti").select("doc", "pos", F.lit("no-such-section").alias("finding"), F.col("number").alias("subject"))


def repeated_comments(comments: DataFrame) -> DataFrame:
    """Comments ``(doc, id, author, text, anchor)`` of one author that say again, in the same place, what was said there before.

    White space aside texts have to be the same; a comment whose paragraph isn't known may be anywhere;
    blank ones never repeat.
    """
    shown = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    order = Window.partitionBy("doc", "author", "_t").orderBy(F.col("id").cast("long"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = comments.withColumn("_t", shown).where("_t <> ''").withColumn("_k", F.row_number().over(order))
    placed = placed.withColumn("_first", F.first(F.struct(F.col("anchor").alias("a"))).over(order)).withColumn("_seen", F.collect_set("anchor").over(before))
    again = F.col("anchor").isNull() | F.col("_first.a").isNull() | F.array_contains("_seen", F.col("anchor"))
    return placed.where((F.col("_k") > 1) & again).drop("_t", "_k", "_first", "_seen")


def misfiled(keys: list) -> list[int]:
    """The fewest places whose entries have to move for the rest to be in order: all outside a longest run that is."""
    import bisect

    ends: list = []
    at: list[int] = []
    back = [-1] * len(keys)
    for i, k in enumerate(keys):
        j = bisect.bisect_right(ends, k)
        back[i] = at[j - 1] if j else -1
        if j == len(ends):
            ends.append(k)
            at.append(i)
        else:
            ends[j], at[j] = k, i
    keep, i = set(), at[-1] if at else -1
    while i >= 0:
        keep.add(i)
        i = back[i]
    return [i for i in range(len(keys)) if i not in keep]


def filing_key(surname: Column, text: Column) -> Column:
    """Where an entry files: its surname without marks and points, then its whole text; case doesn't count."""
    # composed letters fold to plain ones
    from_, to = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįıĵķĺļľñńņňòóôõöøōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž", "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiiijklllnnnnooooooooorrrssssttuuuuuuuuuuwyyyzzz"
    fold = lambda c: F.translate(F.lower(F.trim(c)), from_, to)
    return F.struct(F.trim(F.regexp_replace(fold(surname), r"[^\p{L}\p{N} ]", "")).alias("name"), fold(text).alias("whole"))


def entry_order(entries: DataFrame) -> DataFrame:
    """``entries(doc, pos, surname, text)`` that have to move for their list to be in order, with ``place``, where they go.

    Lists with entries that continue the one above ("———") aren't judged.
    """
    import pyarrow as pa

    keyed = entries.withColumn("_key", filing_key(F.col("surname"), F.col("text"))).withColumn("_cont", F.max(F.col("text").rlike(r"^\s*[—–_-]{2,}").cast("int")).over(Window.partitionBy("doc"))).where("_cont = 0")
    rows = keyed.select("doc", "pos", F.col("_key.name").alias("name"), F.col("_key.whole").alias("whole"))
    doc, pos = (rows.schema[c].dataType.simpleString() for c in ("doc", "pos"))

    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by("pos")
        keys = list(zip(order.column("name").to_pylist(), order.column("whole").to_pylist(), strict=True))
        moved = misfiled(keys)
        rank = {i: r for r, i in enumerate(sorted(range(len(keys)), key=lambda i: (keys[i], i)))}
        take = pa.array(moved, pa.int64())
        return pa.table({"doc": order.column("doc").take(take), "pos": order.column("pos").take(take), "place": pa.array([rank[i] for i in moved], pa.int32())})

    return rows.groupBy("doc").applyInArrow(run, f"doc {doc}, pos {pos}, place int")


def note_order(references: DataFrame) -> DataFrame:
    """``references(doc, id, pos)``: notes whose definition isn't in the order of their first reference."""
    first = references.groupBy("doc", "id").agg(F.min("pos").alias("_at"))
    should = F.row_number().over(Window.partitionBy("doc").orderBy("_at", F.col("id").cast("long")))
    own = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("id").cast("long")))
    return first.select("doc", "id", own.alias("place"), should.alias("should")).where("place <> should")


def invariants(xml: Column) -> Column:
    """Counts that an edit must not move unasked: struct of bookmarks, links, notes, maths, rows, drawings."""
    counts = {
        "bookmarks": "<w:bookmarkStart\\b", "links": "<w:hyperlink\\b|HYPERLINK ", "notes": "<w:(?:footnote|endnote)Reference\\b",
        "maths": "<m:oMath>", "rows": "<w:tr[ >]", "drawings": "<w:drawing[ >]|<w:pict[ >]",
    }
    return F.struct(*(F.regexp_count(xml, F.lit(p)).alias(n) for n, p in counts.items()))
