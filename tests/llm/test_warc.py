import glob
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from vellum.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"


def record(i, body, kind="response", refers=None):
    return warc.record(f"urn:x-page:{i}", kind, f"http://h/{i}\r\nX: y", body, len(body), hashlib.sha1(body).hexdigest(), "2020-01-01T00:00:00Z", refers)


@pytest.mark.parametrize("compressed", [True, False])
def test_records_come_back_and_are_passed_over(compressed):
    rng = random.Random(1)
    bodies = [bytes(rng.choices(b"ab\r\n WARC/1.1", k=n)) for n in (0, 1, 5000, 100_000, 17)]
    raw = [record(i, b) for i, b in enumerate(bodies)]
    data = b"".join(warc.gzip_member(r) if compressed else r for r in raw)
    if compressed:
        assert gzip.decompress(data) == b"".join(raw)
        data += b"".join(gzip.compress(r) for r in raw)  # members without lengths
        bodies = bodies * 2
    found = []
    for k, f in enumerate(warc.records(io.BytesIO(data), compressed, 0, len(data))):
        if k % 2 == 0:
            found.append(warc.http_parts(f.headers["content-type"], f.block())[2])
        assert f.headers["warc-target-uri"].endswith("%0D%0AX: y")
    assert found == bodies[::2]


def test_unwanted_payloads_are_not_inflated(monkeypatch):
    data = b"".join(warc.gzip_member(record(i, b"x" * 10_000_000)) for i in range(3))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.taken += len(out)
            return out

    assert len(list(warc.records(Counted(data), True, 0, len(data)))) == 3
    assert Counted.taken <= 3 * warc.HEAD


def test_broken_archives_say_so():
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.records(io.BytesIO(b"junk\r\n\r\n"), False, 0, 8))
    member = warc.gzip_member(record(1, b"y" * 50_000 + bytes(random.Random(1).randbytes(50_000))))
    with pytest.raises(ValueError, match="cut off"):
        for f in warc.records(io.BytesIO(member[:9000]), True, 0, 9000):
            f.block()


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip_of_pages(spark, tmp_path, compress, monkeypatch):
    big = "ä" * 600
    rows = [(1, "http://a/1", big, "r"), (9, None, big, "r"), (4, "http://a/4", big, "r"), (2, "u", "short", "r"), (3, "u", "short", "r"), (5, "", None, "r")]
    rows += [(None, "u", big, "r"), (None, "u", "z" * 2000, "r"), (None, "u", "z" * 2000, "r"), (7, "v", "WARC/1.1\r\n\r\n" * 200_000, "r"), (7, "v", "WARC/1.1\r\n\r\n" * 200_000, "r")]
    folder = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder, compress=compress)
    back = warc.read_archives(spark, folder)
    got = sorted((str(r["record_id"]), r["record_type"], str(r["refers_to"]), bytes(r["payload"]).decode() if r["payload"] is not None else None) for r in back.collect())
    want = []
    for i, _, h, _ in rows:
        revisit = h == big and i != 9
        want.append((f"urn:x-page:{'null' if i is None else i}", "revisit" if revisit else "response", "urn:x-page:9" if revisit else "None", None if revisit else h or ""))
    assert got == sorted(want)
    plan = back.where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a/"))
    assert sorted(r["record_id"] for r in plan.collect()) == ["urn:x-page:1", "urn:x-page:4"]
    assert back.where(~F.col("target_uri").startswith("http")).count() == len(rows) - 2
    bare = warc.read_archives(spark, folder, payload=False)
    assert "payload" not in bare.columns and bare.where("payload_length = 1200").count() == 3
    warc.write_archives(spark.createDataFrame(rows[:1], SCHEMA), folder, compress=compress)
    assert warc.read_archives(spark, folder).count() == len(rows) + 1


def test_files_without_a_manifest_and_left_behind(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(record(1, b"one") + record(2, b"two"))
    (tmp_path / "w" / "b.warc.gz").write_bytes(gzip.compress(record(3, b"three")))
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 3
    warc.write_archives(spark.createDataFrame([(4, "u", "x", "r")], SCHEMA), f"file://{tmp_path}/v")
    (tmp_path / "v" / "part-lost.warc.gz").write_bytes(b"half a rec")  # of a task that died
    assert warc.read_archives(spark, f"file://{tmp_path}/v").count() == 1
    assert len(glob.glob(f"{tmp_path}/v/_manifest-*")) == 1


def test_an_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/w")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 0


def test_digest_spellings():
    hexed = hashlib.sha1(b"x").hexdigest()
    import base64

    assert warc.digest_hex("sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()) == hexed == warc.digest_hex("SHA1:" + hexed.upper())
    assert warc.digest_hex(None) is None and warc.digest_hex("md5:abc") == "md5:abc"
