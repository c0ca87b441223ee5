import random

import pytest

import corpus_pipeline
from vellum.llm import linededup, mixing, simhash

WORDS = ["river", "stone", "green", "walks", "slowly", "homeward", "under", "lanterns", "of", "paper", "and", "rain"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "", ""]) + rng.choice(["", "", "", "", "."]) for _ in range(n))
    rows, labels = [], []
    passage = " ".join(f"{w} {i} stands here." for i, w in enumerate(WORDS * 2))
    for i in range(160):
        text, toxic = prose(rng.randint(30, 120)), i % 6 == 0
        if toxic:
            words = text.split()
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vilename", "grobianus"])
            text = " ".join(words)
        if i % 16 == 1:
            text = f"{text}. {passage} {prose(20)}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(200, rows[7][1], "en", "s1", rows[7][4]), (201, "Short copy", None, None, 10), (202, "Short copy", None, None, 10), (203, None, None, None, None), (204, "", "en", "s0", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), passage


def test_each_stage_acts_on_what_the_one_before_kept(spark, folder, tmp_path):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
    calm = {i for i in range(160) if i % 6} | {200, 201, 202, 203, 204}
    assert {r["doc_id"] for r in kept["toxicity"]} == calm
    assert {r["doc_id"] for r in kept["line_dedup"]} == calm
    text = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert sum(passage in (t or "") for t in text.values()) == 1
    assert text[200].strip() == "" or text[200] == text[7]
    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in kept["line_dedup"]}
    left = sorted(r["doc_id"] for r in kept["near_dedup"])
    assert len(left) == len(set(left)) and {201} <= set(left) and 202 not in left
    for i in set(prints) - set(left):  # what went is near something with a lower id
        assert any(j < i and (prints[i] ^ prints[j]).bit_count() <= 3 for j in prints)
    taken = {}
    for r in kept["mixing"]:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert max(taken.values()) <= 2 and set(taken) <= set(left)
    pieces = {}
    for r in kept["packing"]:
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in kept["packing"]}
    assert pieces == {i: tokens[i] * n for i, n in taken.items()}


def test_run_is_the_stages_in_a_row(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.count() > 100 and "sequence_id" in out.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]


def test_stages_of_an_empty_table(spark, folder):
    path, _ = folder
    none = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0


def test_modules_serve_the_pipeline():
    assert linededup.MIN_WORDS == 50 and mixing.WEIGHTS == (5, 2, 1) and simhash.BUDGET == 3


def test_near_duplicates_are_looked_for_in_the_tries_and_checked(spark, monkeypatch):
    asked = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda classes: asked.append(sorted(r["fp"] for r in classes.collect())) or links(classes))
    prose = " ".join(f"{w}{i % 29}" for i in range(20) for w in WORDS)
    # a line of seven words outweighs what differs: one fingerprint, but sets far apart
    line = " ".join(WORDS[:7] * 100)
    texts = [prose, prose + " more", f"{line} " + " ".join(f"one{i}" for i in range(30)), f"{line} " + " ".join(f"two{i}" for i in range(30))]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert prints[2] == prints[3] and (prints[0] ^ prints[1]).bit_count() <= 3
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()) == [0, 2, 3]
    assert len(asked) == 1 and len(asked[0]) == len(set(prints))
