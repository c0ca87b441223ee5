"""Every registered query on one small set of odd tables: rows, columns and types of its contract."""

import random
import zlib

import pytest

from vellum.llm import registry

CONTRACT = {
    "op1_saat": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_htmltext": "page_id bigint, url string, text string, n_chars bigint",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6_onebit": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_linededup": "doc_id bigint, text string",
    "op8_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op9_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}
EXTRA = ["size long", "score double", "rank int", "shard int", "Cell string", "id string", "mark long", "n long", "t string", "key string", "word long", "payload string", "row_key string"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["stone", "river", "lamp", "vile1", "x", "Ünder"]) for _ in range(n))
    texts = [prose(rng.randint(1, 90)) for _ in range(60)] + ["", None, "  \n\t ", "a" * 30_000, "word " * 20_000, "\u0000퟿\U0001f600"]
    docs = [(i, t, rng.choice(["en", None]), rng.choice(["s", "", None, "ß"]), None if t is None else len(t)) for i, t in enumerate(texts)]
    docs += [docs[3], docs[3], (3, "another text of one id", "en", "s", 22), (None, "no id at all", "en", "s", 12), (None, None, None, None, None), (100, docs[5][1], "en", "s", 1)]
    labels = [(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (5, 1, 0), (7, None, None)]
    pages = [(i, f"http://h/{i % 3}", t) for i, t in enumerate(["<p>one</p>", None, "", "<article><p>" + "long text " * 200 + "</p></article>", "<nav>x</nav>"] * 2)] + [(None, None, "<p>z</p>")]
    vectors = [(i, [rng.random(), rng.random()], 0) for i in range(40)] + [(40, None, 0), (60, [], 0), (80, [0.0, 0.0], 0), (None, [1.0, 1.0], 0), (20, [0.5, 0.5], None), (1, [float("nan"), 1.0], 0)]
    made = {}
    for name in ("full", "empty"):
        folder = tmp_path_factory.mktemp(name)
        for table, rows, schema in (
            ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"),
            ("pages", pages, "page_id long, url string, html string"), ("embeddings", vectors, "vec_id long, embedding array<float>, label int"),
        ):
            taken = {x.split()[0].lower() for x in schema.split(", ")}
            extra = [e for e in EXTRA if e.split()[0].lower() not in taken]
            spark.createDataFrame([(*r, *[None] * len(extra)) for r in rows if name == "full"], ", ".join([schema, *extra])).write.parquet(f"{folder}/{table}.parquet")
        made[name] = str(folder)
    return made, {"documents": docs, "pages": pages}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_odd_rows_and_empty_tables(spark, folders, name):
    made, rows = folders
    query = registry.queries()[name]
    none = query(spark, made["empty"])
    types = dict(none.dtypes)
    for column in CONTRACT[name].split(", "):
        field, kind = column.split()
        assert types[field] == kind, (field, types[field])
    assert none.count() == 0
    got = query(spark, made["full"]).collect()
    if name in ("op2_sharding", "op4_toxicity", "op7_linededup", "op9_simhash", "op10_mixing"):
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d[0]) for d in rows["documents"])
    if name in ("op3_htmltext", "op8_warc"):
        assert sorted(str(r["page_id"]) for r in got) == sorted(str(d[0]) for d in rows["pages"])
    if name == "op2_sharding":
        want = sorted((str(i), 1 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in rows["documents"])
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
        sizes = [sum(r["shard"] == s for r in got) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s])) for s in range(8))
    if name == "op4_toxicity":
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
        for r in got:
            assert all(0 <= s["start"] < s["stop"] and 0.5 < s["p"] <= 1 for s in r["spans"])
    if name == "op5_packing":
        whole = {}
        for r in got:
            whole.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append((r["start"], r["length"]))
        assert len(whole) >= len({str(d[0]) for d in rows["documents"]})
        used = {}
        for r in got:
            used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in used.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
    if name in ("op1_saat", "op6_onebit"):
        assert {r["query_id"] for r in got} == ({0} if name == "op1_saat" else {0, 20})
        assert all(r["vec_id"] is not None and r["vec_id"] != r["query_id"] for r in got)
    if name == "op10_mixing":
        assert all(r["taken"] <= 2 * r["size"] for r in got)
        by = {}
        for d in rows["documents"]:
            by[d[3]] = by.get(d[3], 0) + len((d[1] or "").split(None))
        assert all(r["target"] <= 2 * r["source_size"] + 1e-6 for r in got)
