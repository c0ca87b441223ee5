"""Styles as tables: what a style sets, what it inherits, and what a paragraph ends up with."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.wordml import W
from vellum.operators import documents, tables

STYLES = "style string, type string, based_on string, is_default boolean, property string, value string"


def _read(root: ET.Element) -> Iterator[dict]:
    defaults = root.find(f"{W}docDefaults")
    for holder in defaults.iter() if defaults is not None else ():
        if holder.tag in (W + "rPr", W + "pPr"):
            for p in holder:
                yield {"style": None, "type": "defaults", "based_on": None, "is_default": False, "property": p.tag.removeprefix(W), "value": p.get(W + "val", "true")}
    for s in root.iter(W + "style"):
        base = s.find(W + "basedOn")
        own = {"style": s.get(W + "styleId"), "type": s.get(W + "type"), "based_on": base.get(W + "val") if base is not None else None, "is_default": s.get(W + "default") in ("1", "true")}
        yield own | {"property": None, "value": None}
        for holder in (s.find(W + "rPr"), s.find(W + "pPr")):
            for p in holder if holder is not None else ():
                yield own | {"property": p.tag.removeprefix(W), "value": p.get(W + "val", "true")}


def styles(parts: DataFrame) -> DataFrame:
    """``(doc, style, type, based_on, is_default, property, value)``; a row without a property for each style."""
    return documents.rows_of(parts, _read, STYLES, part="word/styles.xml")


def resolved(found: DataFrame, property_: str) -> DataFrame:
    """``(doc, style, value)``: a property by each style, inherited where the style doesn't set it, else the defaults'."""
    key = lambda c: F.concat_ws("\u0001", "doc", c)
    base = found.where("style IS NOT NULL").groupBy("doc", "style").agg(
        F.first("based_on", ignorenulls=True).alias("based_on"), F.max(F.when(F.col("property") == property_, F.col("value"))).alias("value")
    )
    chain = base.select("doc", key("style").alias("k"), F.when(F.col("based_on").isNotNull(), key("based_on")).alias("up"), "value")
    own = tables.inherit(chain.select("k", "up", "value"), "k", "up", "value")
    defaults = found.where((F.col("type") == "defaults") & (F.col("property") == property_)).groupBy(F.col("doc").alias("_d")).agg(F.max("value").alias("_default"))
    named = base.select("doc", "style", key("style").alias("k")).join(own, "k").join(defaults, F.col("doc") == F.col("_d"), "left")
    return named.select("doc", "style", F.coalesce("value", "_default").alias("value"))


def unused(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Paragraph styles that no paragraph has and no used style is based on."""
    used = blocks.where("style IS NOT NULL").select("doc", "style").distinct()
    bases = found.where("based_on IS NOT NULL").join(used, ["doc", "style"], "left_semi").select("doc", F.col("based_on").alias("style"))
    own = found.where("type = 'paragraph' AND NOT is_default").select("doc", "style").distinct()
    return own.join(used.unionByName(bases), ["doc", "style"], "left_anti")
