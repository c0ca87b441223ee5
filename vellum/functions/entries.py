"""Entries of a reference list brought to the house's form, each fix proven to change no letter or digit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.numbers import let
from vellum.operators.audits import filing_key

_YEAR = r"(?:1[89]|20)\d{2}[a-z]?"
#: (name, pattern, replacement) in the order they are made; the head is what stands before the year.
FIXES = (
    ("ampersand", rf"&(?=[^(]*?\(?{_YEAR})", "and"),
    ("and-comma", r"^([\p{L}'’ -]+, [\p{Lu}]\.) and (?=[\p{Lu}])", "$1, and "),
    ("year-parens", rf"^([^(]*?[\p{{L}}.,]) ({_YEAR})\.(?=\s|$)", "$1 ($2)."),
    ("page-space", r"\b(pp?\.)(?=\d)", "$1 "),
    ("en-dash", r"(?<![\p{L}\d./:-])(\d+)-(\d+)(?![\d-]|/)", "$1–$2"),
    ("journal-comma", r"([\p{L}]) (\d{1,4}(?: ?\([^()]{1,12}\))? ?[:,] ?[A-Za-z]?\d)", "$1, $2"),
    ("et-al-period", r"\bet al(?![.\p{L}])", "et al."),
)
_KEEP = r"\S*(?:https?://|doi\.org|\bdoi:)\S*|\b10\.\d\S*|\S*-\S*-\S*-\S*"


def _letters(text: Column) -> Column:
    """What a fix must not move: letters and digits, the words that it swaps taken out."""
    return F.regexp_replace(F.regexp_replace(text, r"&|\band\b", ""), r"[^\p{L}\p{N}]", "")


def convert_text(text: Column) -> Column:
    """struct(text, fixes): an entry in the house's form and the names of what was mended; links and identifiers are left alone.

    A fix that would move a letter or a digit isn't made.
    """
    # tokens to keep are cut out, and come back in their order
    kept = F.regexp_extract_all(text, F.lit(_KEEP), F.lit(0))
    pieces = F.split(F.regexp_replace(text, _KEEP, "\u0001"), "\u0001")
    masked = F.array_join(pieces, "\u0001")
    none = F.array().cast("array<string>")
    state = F.struct(masked.alias("text"), none.alias("fixes"))

    def step(state: Column, name: str, pattern: str, new: str) -> Column:
        def made(s: Column) -> Column:
            after = F.regexp_replace(s["text"], pattern, new)
            return let(after, lambda a: F.when((a != s["text"]) & (_letters(a) == _letters(s["text"])), F.struct(a.alias("text"), F.concat(s["fixes"], F.array(F.lit(name))).alias("fixes"))).otherwise(s))

        return let(state, made)

    for fix in FIXES:
        state = step(state, *fix)

    def whole(s: Column) -> Column:
        parts = F.split(s["text"], "\u0001")
        return F.struct(F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(kept, i), F.lit("")))), "").alias("text"), s["fixes"].alias("fixes"))

    return let(state, whole)


def convert_entry(text: Column) -> Column:
    """The names of the fixes that an entry wants."""
    return convert_text(text)["fixes"]


def reference_head(text: Column) -> Column:
    """An entry up to its year, without what ends it; null without a year."""
    head = F.regexp_extract(text, rf"^(.*?\(?{_YEAR}\)?)(?:[.,]|\s|$)", 1)
    return F.nullif(F.rtrim(head), F.lit(""))


def refile(entries: DataFrame) -> DataFrame:
    """``entries(doc, pos, surname, text)`` with ``place``, from 0 in the order in which they file; lists with continuations keep theirs."""
    key = filing_key(F.col("surname"), F.col("text"))
    cont = F.max(F.col("text").rlike(r"^\s*[—–_-]{2,}").cast("int")).over(Window.partitionBy("doc"))
    order = Window.partitionBy("doc").orderBy(F.when(F.col("_c") == 1, F.col("pos")), "_k", "pos")
    return entries.withColumn("_c", cont).withColumn("_k", key).withColumn("place", F.row_number().over(order) - 1).drop("_c", "_k")


def entry_layout(paragraph: Column, hanging: int = 720) -> Column:
    """What is off in an entry's paragraph: its hanging indent, or space between its lines."""
    ind = F.regexp_extract(paragraph, r'<w:ind\b[^>]*\bw:hanging="(\d+)"', 1).try_cast("int")
    issues = F.array(F.when(F.coalesce(ind, F.lit(0)) != hanging, "indent"), F.when(paragraph.rlike(r'<w:spacing\b[^>]*\bw:line="(?!240")\d+"'), "line-space"))
    return F.array_compact(issues)
