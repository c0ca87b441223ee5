import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        total = sum(weight[n] for n in free)
        over = [n for n in free if left * weight[n] / total > most * sizes[n]]
        if not over:
            return out | {n: left * weight[n] / total for n in free}
        for n in over:
            out[n] = most * sizes[n]
            free.remove(n)
        left = share * sum(sizes.values()) - sum(out.values())


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, source string, size long")


@pytest.mark.parametrize("seed", range(3))
def test_targets_are_met(spark, seed):
    rng = random.Random(seed)
    sources = [f"s{i}" for i in range(9)] + [None, "é", "Z"]
    rows = [(i, rng.choice(sources[: 1 + i % 12]), rng.randint(0, 400)) for i in range(3000)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted((r["key"], r["size"]) for r in got) == sorted((k, n) for k, _, n in rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 2
    want = brute_targets(sizes)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(50, 0.01 * want[s])


def test_reruns_agree_in_any_partitioning(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), rng.randint(0, 90)) for i in range(2000)]
    pick = lambda f: sorted((r["key"], r["copies"]) for r in f.collect())
    assert pick(mixing.mix(frame(spark, rows))) == pick(mixing.mix(frame(spark, rows[::-1]).repartition(7)))


def test_documents_are_kept_in_number_as_well_as_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 64)
    monkeypatch.setattr(mixing, "FAN", 4)
    rng = random.Random(6)
    rows = [(i, "b" if i % 10 else "a", rng.randint(1, 60)) for i in range(4000)]
    got = [r for r in mixing.mix(frame(spark, rows)).collect() if r["source"] == "b"]
    p = got[0]["target"] / got[0]["source_size"]
    assert abs(sum(r["copies"] for r in got) - p * len(got)) <= 12
    assert abs(sum(r["copies"] * r["size"] for r in got) - got[0]["target"]) <= 60


def test_odd_rows(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    got = mixing.mix(frame(spark, [(None, None, 0), (None, None, 0), (1, "x", 0)])).collect()
    assert len(got) == 3 and all(r["copies"] == 0 and r["target"] == 0 for r in got)
    rows = [(7, "only", 10)] * 20
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == 20 and sum(r["copies"] for r in got) == 30


def test_the_mix_itself(spark):
    rows = [(i % 90, None if i % 11 == 0 else "word " * (i % 17), f"s{i % 4}", "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = F.sum(F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)))
    total, mixed = docs.agg(words).first()[0], out.agg(words).first()[0]
    assert abs(mixed - 1.5 * total) < 0.02 * total
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
