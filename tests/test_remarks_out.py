"""Remarks are taken out of a package's bytes in one pass, which gives what the tree gives; where bytes don't do, the tree is taken."""

import xml.etree.ElementTree as ET

import pytest
from builders import NS, body, line, make, part, piece

from vellum.functions import wordml
from vellum.operators import apparatus, documents
from vellum.plans import carried

MARKED = line('<w:commentRangeStart w:id="1"/>', "said", '<w:commentRangeEnd w:id="1"/>', '<w:r><w:rPr><w:rStyle w:val="R"/></w:rPr><w:commentReference w:id="1"/></w:r>', '<w:commentRangeStart w:id="2"/>')
REMARK = lambda n, *inner: make("w:comment", *(inner or [line(f"no. {n}")]), id=n)
DECLARED = f"<w:document {NS}><w:body>{MARKED}</w:body></w:document>"
BY_BYTES = {
    "marks": body(MARKED, line("end")),
    "remarks": part("w:comments", REMARK(1), REMARK(12), REMARK(2), REMARK(1, line("again"), line(piece("x")))),
    "none": body(line("a")),
    "empty remark": f'<w:comments {NS}><w:comment w:id="1"/><w:comment w:id="3"/></w:comments>'.encode(),
    "bare runs": body(line("<w:r/>", "<w:r></w:r>", "<w:r> \n<w:rPr/> <w:rPr><w:b/></w:rPr></w:r>", "<w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r>", "<w:r><w:rPr><w:i/></w:rPr></w:r>")),
    "run in run": body(line("<w:r><w:r/></w:r>")),
    "runs of other names": body(line("<w:rt/>", "<w:rPr/>", '<w:r w:a="/">t</w:r>', '<w:r w:a=">"/>')),
    "quotes": body(line("<w:commentReference w:x='w:id=\"2\" >' w:id = '1' />", '<w:commentReference w:x=" w:id=&quot;1&quot;" w:id="2"/>', '<w:commentReference id="1"/>')),
    "no declaration": DECLARED.encode(),
    "in another prefix's declaration": DECLARED.replace("<w:body>", '<w:body><a:a xmlns:a="urn:a"/>').encode(),
    "spaced": DECLARED.replace("><", ">\n <").encode(),
    "many tags": body(*[MARKED] * 60),
}
BY_TREE = {
    "other prefix": DECLARED.replace("w:", "v:").replace("xmlns:w=", "xmlns:v=").encode(),
    "second prefix": DECLARED.replace("<w:body>", f'<w:body xmlns:v="{wordml.W[1:-1]}"><v:commentReference v:id="1"/>').encode(),
    "prefix by a reference": DECLARED.replace("<w:body>", f'<w:body xmlns:v="{wordml.W[1:-1].replace("http", "&#104;ttp")}"><v:commentReference v:id="1"/>').encode(),
    "prefix anew": DECLARED.replace("<w:body>", '<w:body><w:x xmlns:w="urn:w"><w:commentReference w:id="1"/></w:x>').encode(),
    "comment": DECLARED.replace("<w:body>", '<w:body><!-- <w:commentReference w:id="1"/> -->').encode(),
    "literal": DECLARED.replace("said", '<![CDATA[<w:commentReference w:id="1"/>]]>').encode(),
    "instruction": DECLARED.replace("<w:body>", '<w:body><?x <w:commentReference w:id="1"/>?>').encode(),
    "other encoding": ('<?xml version="1.0" encoding="UTF-16"?>' + DECLARED).encode("utf-16"),
    "latin": ('<?xml version="1.0" encoding="ISO-8859-1"?>' + DECLARED.replace("said", "é")).encode("latin-1"),
    "not empty": body(line('<w:commentReference w:id="1">x</w:commentReference>')),
    "id by a reference": body(line('<w:commentReference w:id="&#49;"/>')),
    "remark in remark": part("w:comments", REMARK(1, REMARK(2))),
    "properties before a change": body(line("<w:r><w:rPr><w:rPrChange><w:rPr><w:b/></w:rPr></w:rPrChange></w:rPr></w:r>")),
}


@pytest.mark.parametrize("name", [*BY_BYTES, *BY_TREE])
@pytest.mark.parametrize("ids", [{"1"}, {"2", "12"}, set()], ids=str)
def test_bytes_give_what_the_tree_gives(name, ids):
    blob = (BY_BYTES | BY_TREE)[name]
    root, why = wordml.parse(blob)
    apparatus._pruned(root, ids)
    made = apparatus._cut(blob, ids)
    assert why is None and (made is not None or name in BY_TREE)
    if made is not None:
        assert ET.canonicalize(made.decode(), rewrite_prefixes=True) == ET.canonicalize(wordml.serialise(root).decode(), rewrite_prefixes=True)
    if name in BY_TREE and ids == {"1"}:
        assert made is None


@pytest.mark.parametrize("blob", [b"", b"<w:document", body("<w:p>")[:-3], f"<w:document {NS}>{'<w:p>' * 401}{'</w:p>' * 401}</w:document>".encode(), DECLARED.replace("<w:body>", "<w:body><z:a/>").encode(), DECLARED.replace("said", "&no;").encode()])
def test_what_does_not_parse_is_not_cut(blob):
    assert apparatus._cut(blob, {"1"}) is None


def test_remarks_go_from_whole_packages_and_loose_parts(spark):
    blobs = {"document": [BY_BYTES["marks"], BY_TREE["comment"], b"<w:document", None], "comments": [BY_BYTES["remarks"], BY_TREE["remark in remark"], BY_BYTES["remarks"], BY_BYTES["empty remark"]]}
    rows = [(f"d{i}", f"word/{kind}.xml", b) for kind, own in blobs.items() for i, b in enumerate(own)] + [("d0", "x.bin", b"<w:r/>"), ("d4", "x.xml", b"<w:r/>")]
    parts = spark.createDataFrame(rows, "doc string, part string, blob binary")
    read = lambda frame: {(r["doc"], r["part"]): None if r["blob"] is None else bytes(r["blob"]) for r in documents.loose(frame).collect()}
    loose, whole = read(apparatus.remove_remarks(parts, {"1"})), read(apparatus.remove_remarks(documents.whole(parts), {"1"}))
    assert loose == whole and loose.keys() == {(d, p) for d, p, _ in rows}
    assert loose["d0", "x.bin"] == b"<w:r/>" and loose["d2", "word/document.xml"] == b"<w:document" and loose["d3", "word/document.xml"] is None
    assert b'w:id="1"' not in loose["d0", "word/document.xml"] and b'w:id="2"' in loose["d0", "word/document.xml"] and b"said" in loose["d0", "word/document.xml"]
    left = apparatus.remarks_stored(apparatus.remove_remarks(documents.whole(parts), {"1"}))
    assert sorted((r["doc"], r["id"]) for r in left.collect()) == [("d0", "12"), ("d0", "2"), ("d2", "12"), ("d2", "2"), ("d3", "3")]


def test_stored_remarks_are_those_of_all(spark):
    parts = spark.createDataFrame([("d", "word/comments.xml", BY_BYTES["remarks"]), ("e", "word/comments.xml", BY_BYTES["remarks"])], "doc string, part string, blob binary")
    names = ["doc", "id", "k", "author", "date", "text", "para_id"]
    rows = lambda frame: sorted(map(str, frame.select(*names).collect()))
    assert rows(apparatus.remarks_stored(parts)) == rows(apparatus.remarks(parts)) and len(rows(apparatus.remarks_stored(parts))) == 8


def test_remarks_are_removed_without_joins(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 8), (35, 9)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    frame = carried.remarks_removed(spark, str(tmp_path))
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "Aggregate" not in text and text.count("MapInArrow") == 2, text
    assert sorted(map(tuple, frame.collect())) == sorted((d, i) for d in ("1", "2", "35") for i in ("2", "3"))
