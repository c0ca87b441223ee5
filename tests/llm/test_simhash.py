import random
import re

import numpy as np
import xxhash

from vellum.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(prints, budget=3):
    label = list(range(len(prints)))
    for _ in prints:
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= budget:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_fingerprints_are_those_of_the_definition():
    for text in ["", " \t", "One", "Two words", "a b c", "A  b\nC d\x0be", "Ünï ÄÖ İ x", "to " * 300, "a\xa0b c\x85d e"]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_walk_finds_the_components_of_all_close_pairs():
    rng = random.Random(1)
    for _ in range(20):
        seeds = [rng.getrandbits(48) for _ in range(4)]
        values = sorted({s ^ sum(1 << b for b in rng.sample(range(48), rng.randint(0, 3))) for s in seeds for _ in range(12)})
        got = simhash.walk(np.array(values, dtype=np.uint64), np.array([[0, len(values), 0, len(values)]]))
        want = brute_components(values)
        assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_links_join_across_chunks_of_a_large_subtree(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAVES", 8)
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(3)]
    values = sorted({b ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for b in base for _ in range(30)})
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    from vellum.llm.components import components

    found = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    got, want = [found.get(v, v) for v in values], brute_components(values)
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def test_components_of_documents(spark):
    text = " ".join(f"word{i} stands here" for i in range(80))
    rows = [(7, text, "x", "y"), (3, text.upper(), "x", "y"), (9, "quite another text of some words", None, None), (None, text, None, None)]
    rows += [(5, None, None, None), (4, "", None, None), (2, " \n", None, None), (9, "quite another text of some words", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["id"], r["component"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (None, 3), (9, 9), (9, 9), (5, 2), (4, 2), (2, 2)], key=str)
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([2, 3, 9, None], key=str)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_representatives(docs).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    from vellum.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(5, 5), (1, 0)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, **dict.fromkeys(range(200, 260), 100)}
