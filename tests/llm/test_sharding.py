import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import sharding


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(spark, axes, bits):
    names = [f"a{i}" for i in range(axes)]
    points = list(itertools.product(range(1 << bits), repeat=axes))
    frame = sharding.hilbert_index(spark.createDataFrame(points, ", ".join(f"{n} int" for n in names)), names, bits, "h")
    rows = sorted(frame.collect(), key=lambda r: r["h"])
    assert [r["h"] for r in rows] == list(range(len(points)))
    assert all(sum(abs(x[n] - y[n]) for n in names) == 1 for x, y in zip(rows, rows[1:], strict=False))


def test_shards_are_equal_gapless_and_narrow(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 50 == 0 else rng.choice("abcd"), rng.randint(0, 999) if i % 3 else 7, 1, 2) for i in range(1000)] + [(3, "a", 5, 1, 2)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_chars long, shard int, Cell int")
    out = sharding.assign_shards(docs, ["source", "n_chars"], "doc_id", shards=8)
    got = out.collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    sizes = [len(x) for x in by.values()]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1 and sorted(by) == list(range(8))
    for own in by.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert [r["curve"] for r in own] == sorted(r["curve"] for r in own)
    ends = [(min(r["curve"] for r in by[s]), max(r["curve"] for r in by[s])) for s in range(8)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    # pruning: shards whose range holds a value of either column are fewer than all
    held = sum(min(r["n_chars"] for r in own) <= 900 <= max(r["n_chars"] for r in own) for own in by.values())
    assert held < 8


def test_few_rows_constants_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "x", 2.0), (1, "x", 2.0), (None, None, None), (2, "x", float("nan"))], "doc_id long, source string, w double")
    got = sharding.assign_shards(docs, ["source", "w"], "doc_id", shards=8).collect()
    assert len(got) == 4 and all(r["slot"] == 0 for r in got)
    assert sharding.assign_shards(docs.limit(0), ["source"], "doc_id").count() == 0


def test_the_query_and_the_files(spark, tmp_path):
    rows = [(i, None if i == 5 else "ä" * i, "en", f"s{i % 3}", i) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in sharding.op2_sharding(spark, str(tmp_path)).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sharded = sharding.assign_shards(docs, ["source", "n_chars"], "doc_id", shards=4)
    sharding.write_shards(sharded, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 40 and back.select(F.countDistinct("shard")).first()[0] == 4


def test_the_plan_holds_no_python(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("k"))
    plan = sharding.assign_shards(docs, ["k"], "doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_bins_against_exact_quantiles(spark):
    """Common beginnings, outliers and heavy values: bins are as even as values allow, and in order."""
    rng = random.Random(4)
    rows = [(f"crawl_{2000 + int(rng.random() ** 2 * 400)}/part", 10.0**12 if i == 7 else rng.random(), "même début, puis " + chr(0x4E00 + rng.randint(0, 3000)), 5) for i in range(4000)]
    rows += [(None, None, None, None), ("a", float("nan"), "", 5)]
    docs = spark.createDataFrame(rows, "s string, x double, u string, one int")
    names = ["s", "x", "u", "one"]
    got = docs.select("*", *(b.alias(f"b{i}") for i, b in enumerate(sharding.quantise(docs, names)))).collect()
    for i, n in enumerate(names):
        own = sorted((r[n].encode() if isinstance(r[n], str) else r[n], r[f"b{i}"]) for r in got if r[n] is not None and r[n] == r[n])
        assert [b for _, b in own] == sorted(b for _, b in own)
        sizes = [sum(b == k for _, b in own) for k in range(16)]
        if n == "one":
            assert len(set(b for _, b in own)) == 1
        else:
            assert max(sizes) < 1.5 * len(own) / 16 and min(sizes) > 0.5 * len(own) / 16, (n, sizes)
        assert all(r[f"b{i}"] == 0 for r in got if r[n] is None)


def test_shard_and_slot_against_a_plain_sort(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 40)
    rng = random.Random(6)
    rows = [(rng.randint(0, 400), rng.choice("ab") if i % 3 else "hot", rng.randint(0, 99), i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n int, tie int")
    got = sharding.assign_shards(docs, ["source", "n"], "doc_id", shards=7, order=[F.col("tie")]).collect()
    axes = sharding.quantise(docs, ["source", "n"])
    cells = docs.select("*", (axes[0] * 16 + axes[1]).alias("cell"), F.xxhash64("doc_id", "tie").alias("h")).collect()
    curve = {r["tie"]: r["curve"] for r in got}
    size = {c: sum(r["cell"] == c for r in cells) for c in {r["cell"] for r in cells}}
    order = sorted(cells, key=lambda r: (curve[r["tie"]], r["h"] % -(-size[r["cell"]] // 40), r["doc_id"], r["tie"]))
    want = {}
    for k, r in enumerate(order):
        shard = k * 7 // len(rows)
        want[r["tie"]] = (shard, k - -(-shard * len(rows) // 7))
    assert {r["tie"]: (r["shard"], r["slot"]) for r in got} == want
