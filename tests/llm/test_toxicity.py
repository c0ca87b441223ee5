import itertools
import random

import numpy as np
import pytest

from vellum.llm import toxicity

CALM = ["the", "river", "runs", "over", "green", "stones", "and", "we", "walk", "slowly", "home"]
MEAN = ["vilename", "vilething", "stupidus", "grobian"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(CALM) + rng.choice(["", "s", "ly", "."]) for _ in range(rng.randint(10, 60))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 5) * toxic):
            words[rng.randrange(len(words))] = rng.choice(MEAN) + rng.choice(["", ",", "!"])
        out.append((" ".join(words), int(toxic)))
    return out


def brute_marginals(scores, move):
    total, ones = 0.0, np.zeros(len(scores))
    for states in itertools.product((0, 1), repeat=len(scores)):
        w = np.exp(sum(s for s, y in zip(scores, states) if y) + sum(move[a][b] for a, b in zip(states, states[1:])))
        total += w
        ones += w * np.array(states)
    return ones / total


def test_marginals_are_those_of_all_taggings():
    rng = np.random.default_rng(1)
    move = rng.normal(size=(2, 2))
    sequences = [rng.normal(size=n) * 2 for n in (5, 1, 9, 0, 3, 9, 2)]
    for got, s in zip(toxicity.marginals(sequences, move), sequences, strict=True):
        assert got == pytest.approx(brute_marginals(s, move) if len(s) else [])


def test_expected_transitions_add_up():
    rng = np.random.default_rng(2)
    index, labels = np.arange(9), np.array([0, 1, 1, 0, 0, 0, 1, 0, 1.0])
    batch = toxicity._Batch(index, labels, np.array([0, 4]), np.array([4, 5]))
    word, move = rng.normal(size=9), rng.normal(size=(2, 2))
    by_word, pairs = batch.expect(word, move)
    assert by_word == pytest.approx(np.concatenate([brute_marginals(word[:4], move), brute_marginals(word[4:], move)]))
    assert pairs.sum() == pytest.approx(7) and batch.seen.sum() == 7
    assert pairs[1].sum() == pytest.approx(by_word[[0, 1, 2, 4, 5, 6, 7]].sum())


def test_held_out_documents_and_unseen_words():
    train, held = corpus(400, 1), corpus(200, 2)
    model = toxicity.train([t for t, _ in train], [y for _, y in train])
    got = model.score([t for t, _ in held]) >= toxicity.THRESHOLD
    assert (got == np.array([y for _, y in held], dtype=bool)).mean() > 0.98
    text = "We walk home, vilenames! Slowly the vilethings, stones."
    assert [text[a:b] for a, b, _ in model.spans(text)] == ["vilenames!", "vilethings,"]
    assert 0 <= model.score([""])[0] < 0.5 and model.score(["river " * 30_000])[0] < 0.5


def test_without_toxic_or_any_labels():
    assert toxicity.train(["a b c"] * 4, [0] * 4).score(["a b", ""]).max() < 0.5
    assert toxicity.train([], []).score(["a b", ""]).max() < 0.5


def test_the_query_learns_outside_the_held_out_fold(spark, tmp_path):
    import zlib

    rows = [(i, *x) for i, x in enumerate(corpus(300, 3))]
    docs = [(i, t, 1) for i, t, _ in rows] + [(None, "grobian vilename grobian", 1), (900, None, 1), (901, "", 1), (5, rows[5][1], 1)]
    # labels of the held-out fold are wrong: a model that saw them would do badly
    labels = [(i, y if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - y) for i, _, y in rows] + [(None, 1), (901, None), (5, rows[5][2])]
    spark.createDataFrame(docs, "doc_id long, text string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        if r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("score", "toxicity")
    kept = toxicity.drop_toxic(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, y in truth.items() if not y} | {900, 901}
    assert toxicity.drop_toxic(frame.limit(0), spark.read.parquet(f"{tmp_path}/labels.parquet")).count() == 0
