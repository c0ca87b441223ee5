"""Text as columns: glyphs, words, quotes, keys and XML text nodes; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The glyphs that a word processor puts in on saving, and what they stand for.
#   minus, asterisk operator, single quotes, double quotes, en and em dash, no-break space
GLYPHS = "−∗’‘“”–— "
PLAIN = "-*''\"\"-- "

_TEXT_NODE = r"(?s)<(?:w|m):t(?:\s[^>]*)?(?<!/)>(.*?)</(?:w|m):t>"
_DELTA_NODE = r"(?s)<(?:w:t|m:t|w:delText)(?:\s[^>]*)?(?<!/)>(.*?)</(?:w:t|m:t|w:delText)>"


def normalize_glyphs(text: Column) -> Column:
    return F.translate(text, GLYPHS, PLAIN)


def words(text: Column) -> Column:
    """Number of tokens between white space in Unicode's sense."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def unescape(text: Column) -> Column:
    """The five named references of XML; the ampersand last, so nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def escape(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def visible_text(xml: Column) -> Column:
    """What a reader sees of a fragment: text and maths, deletions left out."""
    return unescape(F.concat_ws("", F.regexp_extract_all(xml, F.lit(_TEXT_NODE), F.lit(1))))


def delta_text(xml: Column) -> Column:
    """The text that a revision spans, deletions included."""
    return unescape(F.concat_ws("", F.regexp_extract_all(xml, F.lit(_DELTA_NODE), F.lit(1))))


def preserve_space(xml: Column) -> Column:
    """Mark text nodes whose edge white space would be trimmed; a no-break space is content, not white space."""
    bare = r"<w:t((?:\s(?!xml:space)[^\s>/=]+=\"[^\"]*\")*)>([ \t\r\n][^<]*|[^<]*[ \t\r\n])</w:t>"
    return F.regexp_replace(xml, bare, '<w:t$1 xml:space="preserve">$2</w:t>')


def smarten(text: Column) -> Column:
    """Curly quotes: an apostrophe after a letter or digit; double quotes in turn, where they pair.

    The parts between double quotes are joined by opening and closing ones in turn.
    """
    text = F.regexp_replace(text, r"(?<=[\p{L}\p{N}])'", "’")
    parts = F.split(text, '"')
    pairs = F.size(parts) % 2 == 1
    turned = F.transform(parts, lambda p, i: F.when(i == 0, p).when(i % 2 == 1, F.concat(F.lit("“"), p)).otherwise(F.concat(F.lit("”"), p)))
    return F.when(pairs, F.concat_ws("", turned)).otherwise(text)


def key_for(surname: Column, year: Column) -> Column:
    """The anchor of a work: name without punctuation in lower case, then the year."""
    return F.concat(F.lower(F.regexp_replace(surname, r"(?U)[^\w]+", "")), F.lit("_"), year.cast("string"))


def initials(name: Column) -> Column:
    return F.concat_ws("", F.transform(F.filter(F.split(name, r"(?U)\s+"), lambda w: w != ""), lambda w: F.upper(F.left(w, F.lit(1)))))
