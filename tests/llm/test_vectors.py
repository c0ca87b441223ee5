import numpy as np
import pytest

from vellum.llm import onebit, saat, vectors


def data(n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + n // 8] = x[n // 2] + 0.05 * rng.standard_normal((n // 8, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string")


def ranked(scores, ids, own, k):
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != own][:k]
    return [(int(ids[i]), scores[i]) for i in order]


def table(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [64, 16384])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    x = data(400, 12, 1)
    ids = np.arange(400) * 5
    x[7] = x[3]  # a tie
    whole = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    got = table(saat.top_k(frame(spark, [(int(i), v.tolist(), 0, "x") for i, v in zip(ids, x, strict=True)]), "id % 100 = 0"))
    assert sorted(got) == list(range(0, 2000, 100))
    for q, rows in got.items():
        want = ranked(whole @ whole[q // 5], ids, q, 10)
        assert [(v, s) for _, v, s in rows] == want and [r for r, _, _ in rows] == list(range(1, 11))


def test_the_index_stops_before_the_end_only_on_proof():
    x = np.floor(1024 * data(3000, 16, 2).astype(np.float64)).astype(np.int64)
    index = saat.Index(x)
    few = 0
    for q in range(0, 3000, 100):
        rows = index.search(x[q], np.array([q]), 10)
        scores = x @ x[q]
        scores[q] = -(1 << 60)
        least = np.sort(scores)[-10]
        assert set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
        few += len(rows) < 300
    assert few > 15


def test_recall_of_the_codes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 700)
    x = data(2000, 64, 3)
    ids = np.arange(2000)
    got = table(onebit.nearest(frame(spark, [(int(i), v.tolist(), 0, "x") for i, v in enumerate(x)]), "id % 20 = 0"))
    exact = x.astype(np.float64)
    hits = 0
    for q, rows in got.items():
        want = ranked(exact @ exact[q], ids, q, 20)
        hits += len({v for v, _ in want} & {v for _, v, _ in rows})
        assert [s for _, _, s in rows] == pytest.approx([float(exact[v] @ exact[q]) for _, v, _ in rows], abs=1e-12)
        assert len(rows) == 20 and rows == sorted(rows, key=lambda r: (-r[2], r[1]))
    assert len(got) == 100 and hits >= 0.9 * 2000


def test_estimates_lie_within_their_bounds():
    x = data(1500, 100, 4).astype(np.float64)
    codes = onebit.Codes(x, x.mean(axis=0), onebit.rotation(100))
    inside = total = 0
    for q in range(0, 1500, 50):
        guess, off = codes.estimate(x[q])
        inside += (np.abs(guess - x @ x[q]) <= off + 1e-9).sum()
        total += len(x)
    assert inside > 0.9 * total


@pytest.mark.parametrize("search", [saat.top_k, onebit.nearest])
def test_odd_rows(spark, search):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1, "a"), (100, [0.5, 0.5], 1, "a"), (1, [1.0, 1.0], 1, "a"), (1, [1.0, 1.0], 1, "a"), (2, None, 1, "a"), (3, [], 1, "a")]
    rows += [(4, [nan, 1.0], 1, "a"), (5, [inf, 1.0], 1, "a"), (6, [None, 1.0], 1, "a"), (None, [1.0, 1.0], 1, "a"), (7, [1.0, 1.0, 1.0], 1, "a"), (200, [0.0, 0.0], 1, "a")]
    got = table(search(frame(spark, rows), "id % 100 = 0"))
    zero = search is saat.top_k
    assert [v for _, v, _ in got[0]] == [1, 1, 100] + [200] * zero
    assert (200 in got) == zero
    assert search(frame(spark, []), "id % 100 = 0").count() == 0


def test_vectors_too_large_for_a_long_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 1, "a"), (1, [1e300, 1.0], 1, "a"), (2, [3.0, -1e9], 1, "a"), (3, [5.0, 1.0], 1, "a"), (4, [1e6, 0.0], 1, "a")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string")
    got = table(saat.top_k(docs, "id % 100 = 0"))
    assert [(v, s) for _, v, s in got[0]] == [(4, 1024 * 1024 * 10**6), (3, 1024 * 1024 * 7)]


def test_the_centre_is_the_mean_of_all_rows(spark):
    x = data(900, 8, 5)
    docs = frame(spark, [(int(i), v.tolist(), 0, "x") for i, v in enumerate(x)] + [(2000, [1.0, 3.0], 0, "y")]).repartition(5)
    found = onebit.centres(vectors.pack(docs, "vec_id", "embedding", zero=False))
    assert sorted(found) == [2, 8]
    np.testing.assert_allclose(found[8], x.astype(np.float64).mean(axis=0), atol=1e-12)
    assert onebit.centres(vectors.pack(docs.limit(0), "vec_id", "embedding", zero=False)) == {}
