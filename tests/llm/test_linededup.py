import random

from pyspark.sql import functions as F

from vellum.llm import linededup


def brute(rows, least):
    docs = sorted({(i, t) for i, t in rows}, key=lambda r: r[0])
    split = [[tuple(x.split()) for x in linededup.lines(t)[0]] for _, t in docs]
    places = {}
    for d, own in enumerate(split):
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += len(own[b])
                if n >= least:
                    places.setdefault(tuple(own[a : b + 1]), []).append((d, a, b + 1))
    gone = {}
    for found in places.values():
        for d, a, b in sorted(found)[1:]:
            gone.setdefault(d, set()).update(range(a, b))
    return {docs[d]: "".join(x for i, x in enumerate(linededup.lines(docs[d][1])[0]) if i not in gone.get(d, ())) for d in range(len(docs))}


def test_lines_add_up_to_the_text():
    for text in ["", "a", "a\n", "One. Two!  Three?\n\nfour", "e.g. x. ", "...\n", "a.b"]:
        assert "".join(linededup.lines(text)[0]) == text


def test_deletes_what_brute_force_deletes(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 4))) for _ in range(14)]
    passages = ["\n".join(rng.choice(pool) for _ in range(rng.randint(2, 7))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice(["\n", ". "]).join(parts)))
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", F.col("text"))
    for least, gram in ((6, 3), (8, 4), (10, 2)):
        got = {(r["doc_id"], r["old"]): r["text"] for r in linededup.dedup_lines(docs, least=least, gram=gram).collect()}
        assert got == brute(rows, least)


def test_passages_copies_and_odd_rows(spark):
    passage = " ".join(f"Sentence {i} of the passage runs on." for i in range(12))
    own = ["alpha beta gamma", "delta " * 60, "one two three. four five"]
    rows = [(1, f"{own[0]}. {passage} {own[2]}", "r", 0), (2, f"{own[2]}.\n{passage}", "r", 0), (3, passage, None, 0), (3, passage, None, 0)]
    rows += [(4, None, None, None), (5, "", None, 0), (6, own[1], None, 0), (7, own[1].strip(), None, 0), (8, "repeat me\n" * 100, None, 0), (None, "short", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_chars long")
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[1] == [rows[0][1]]
    assert got[2] == [own[2] + ".\n"]
    assert got[3] == ["", ""]
    assert got[4] == [None] and got[5] == [""] and got[None] == ["short"]
    assert got[6] == [own[1]] and got[7] == [""]
    assert got[8] == ["repeat me\n"]
    assert {r["doc_id"]: r["n_chars"] for r in out.where("doc_id IN (2, 4)").collect()} == {2: len(own[2]) + 2, 4: None}


def test_an_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string, n_chars long")).count() == 0
