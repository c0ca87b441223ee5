import random

import corpus_pipeline
from vellum.llm import resemblance, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_the_stage_keeps_what_brute_force_keeps(spark):
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    texts = []
    for _ in range(25):
        base = some(rng.randint(40, 200))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):  # changed words, single ones and runs
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = some(1)[0]
            texts.append(" ".join(words))
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    rows += [(500, None, None, None, 0), (501, " ", None, None, 0), (502, "Two words", None, None, 0), (503, "two  WORDS", None, None, 0)]
    label = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similarity(rows[i][1], rows[j][1]) >= 0.8]
    for _ in rows:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    wide = [(i, j) for i, j in pairs if (simhash.fingerprint((rows[i][1] or "").encode()) ^ simhash.fingerprint((rows[j][1] or "").encode())).bit_count() > 3]
    assert len(wide) > 5  # the stage passed these before
    kept = corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(rows[i][0] for i in set(label))


def test_a_large_family_of_copies_against_brute_force(spark):
    """Many copies about as near to each other as counts: bands hold hundreds, and stars don't settle them."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    # sets that share a passage and nothing else
    texts += [" ".join(base[:25] + [f"y{i}z{k}" for k in range(40)]) for i in range(60)]
    label = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    for _ in range(12):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    got = {r["id"]: r["root"] for r in resemblance.near_groups(spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)).collect()}
    groups = lambda of: {frozenset(k for k in of if of[k] == v) for v in of.values()}
    assert groups(got) == groups(dict(enumerate(label)))


def test_prefixes_miss_no_pair(spark, monkeypatch):
    import numpy as np

    rng = random.Random(3)
    sets = []
    for _ in range(20):
        base = rng.sample(range(400), rng.randint(1, 40))
        sets += [sorted(set(base) ^ set(rng.sample(range(400), rng.randint(0, 4)))) or [1] for _ in range(6)]
    rows = [(i, np.array(x, np.uint64).tobytes()) for i, x in enumerate(sets)]
    wanted = spark.createDataFrame([(i, i % 7) for i in range(len(sets))], "sign long, root long")
    got = {(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in resemblance._prefix_pairs(spark.createDataFrame(rows, "sign long, own binary"), wanted).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if i % 7 != j % 7 and len(set(sets[i]) & set(sets[j])) * 5 >= 4 * len(set(sets[i]) | set(sets[j]))}
    assert len(want) > 100 and want <= got and all(i % 7 != j % 7 for i, j in got) and len(got) < 0.3 * len(sets) ** 2


def test_rows_are_kept_by_row(spark):
    one, other = ("one text of its own " * 3 + "here", "quite another text that nothing else is near to at all")
    rows = [(1, one, "a", "", 0), (1, other, "b", "", 0), (2, one, "c", "", 0), (None, other, "d", "", 0), (None, "a third text", "e", "", 0), (None, "a third text", "f", "", 0)]
    kept = resemblance.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(1, one), (1, other), (0, "a third text")])


def test_an_empty_table(spark):
    assert resemblance.keep_one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0
