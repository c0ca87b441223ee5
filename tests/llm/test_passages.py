import random

from pyspark.sql import functions as F

from vellum.llm import linededup, passages


def brute(rows, least):
    """The words of each document that stay: those of no window that came before."""
    docs = sorted(set(rows), key=lambda r: r[0])
    seen, left = set(), {}
    for i, text in docs:
        words = text.split()
        gone = set()
        for a in range(len(words) - least + 1):
            window = tuple(words[a : a + least])
            if window in seen:
                gone.update(range(a, a + least))
            seen.add(window)
        left[(i, text)] = [w for k, w in enumerate(words) if k not in gone]
    return left


def test_deletes_the_words_that_brute_force_deletes(spark, monkeypatch):
    monkeypatch.setattr(passages, "AT_ONCE", 300)
    rng = random.Random(8)
    some = lambda n: [rng.choice("abcdefghijk") for _ in range(n)]
    pool = [some(rng.randint(5, 25)) for _ in range(12)]
    rows = []
    for i in range(120):
        words = [w for _ in range(rng.randint(0, 5)) for w in (rng.choice(pool) if rng.random() < 0.6 else some(rng.randint(1, 9)))]
        # line ends and blank lines anywhere: passages are set into lines
        rows.append((i, "".join(w + rng.choice([" "] * 6 + ["\n", "\n\n \n", ". ", "  "]) for w in words)))
    rows += [rows[3], (200, "z " * 40), (201, "x " + "z " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("old", F.col("text"))
    for least, gram in ((6, 3), (9, 4), (12, 12)):
        got = {(r["doc_id"], r["old"]): r["text"].split() for r in linededup.dedup_passages(docs.repartition(3), least=least, gram=gram).collect()}
        assert got == brute(rows, least)


def test_a_passage_set_mid_line_goes_whole(spark):
    passage = "it goes on " + " ".join(f"with word{i} and" for i in range(20)) + " so ends"
    rows = [(1, f"Here {passage} there", 0), (2, f"But {passage.replace(' word7 ', chr(10) + chr(10) + 'word7 ')} elsewhere", 0), (3, f"line\nEnds in {passage}\nnext", 0), (None, None, None)]
    out = {r["doc_id"]: r for r in linededup.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert {i: r["text"] for i, r in out.items()} == {1: rows[0][1], 2: "But elsewhere", 3: "line\nEnds in\nnext", None: None}
    assert out[2]["n_chars"] == 13


def test_the_query_finds_passages_set_mid_line(spark, tmp_path):
    passage = " ".join(f"word{i}" for i in range(60))
    spark.createDataFrame([(1, f"a {passage} b"), (2, f"c {passage} d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["text"] for r in linededup.op7_linededup(spark, str(tmp_path)).collect()} == {1: f"a {passage} b", 2: "c d"}


def test_an_empty_table(spark):
    assert linededup.dedup_passages(spark.createDataFrame([], "doc_id long, text string, n_chars long")).count() == 0


def test_windows_that_agree_in_one_hash_only_are_not_equal(spark, monkeypatch):
    """With the first sum forced to one value, the second still tells windows apart."""
    import numpy as np

    ones = np.zeros(6, np.int64)
    first, later = passages._before([np.arange(6)], ones, [np.zeros(6, np.uint64), np.array([1, 2, 3, 1, 2, 4], np.uint64)])
    assert first.tolist() == [True, True, True, False, False, True] and later.tolist() == [False, False, False, True, True, False]
    words = passages.Words(["a b c d e f g a b c d e f g"], 5, 3, wide=True)
    for k in (0, 1):
        h = words.hash(5, k)
        assert (h[:3] == h[7:]).all() and len(set(h.tolist())) == 7
    assert not set(words.hash(5, 0).tolist()) & set(words.hash(5, 1).tolist())
