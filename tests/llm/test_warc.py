import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from scorelab.llm import warc
from scorelab.session import scratch_path


def fixture():
    fake = warc.record(5, "http://x", "inner", "AAAA", 5, None, False) + "\r\n\r\n"
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, ""), (4, "", None), (5, "http://a b/\r\n5", fake), (6, "u", fake * 3),
            (7, "u", "WARC/1.1\r\n"), (8, "u", "x" + "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (9, "u", "é漢\r\n\r\n"), (10, "u", "\r\n\r\n" + fake),
            (11, "u", "z" * 300000), (2, "http://a/2", "same"), (None, "u", "same"), (None, "u", "alone"), (12, "u", "\n"), (0, "u", "same"),
            (2**63 - 1, "u", "high"), (-2**63, "u", "low"), (2**63 - 2, "u", "high"), (10**18 + 1, "u", "nineteen")]
    return rows + [(100 + i, "u", f"<html>{i % 37}</html>") for i in range(300)]


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "WINDOW", 1000)
    rows = fixture()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")
    path = scratch_path(spark, "warc-test")
    warc.write_warc(df, path, min_revisit=least)
    got = warc.read_warc(spark, path).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    times = {}
    for _, _, h in rows:
        times[h or ""] = times.get(h or "", 0) + 1
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = len(b) >= least and times[h or ""] > 1 and f is not None and f != i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(r.intact for r in got)


def test_cut_file_and_empty(spark, tmp_path):
    whole = "".join(warc.record(i, "u", "p" * i, base64.b32encode(hashlib.sha1(b"p" * i).digest()).decode(), i, None, False) + "\r\n\r\n" for i in range(20)).encode()
    (tmp_path / "a.warc").write_bytes(whole[:-10])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole))
    (tmp_path / "c.warc").write_bytes(b"junk" + whole)
    got = warc.read_warc(spark, str(tmp_path)).groupBy("file").count().collect()
    assert sorted(r["count"] for r in got) == [19, 20]
    path = scratch_path(spark, "warc-none")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def archive(n=20, size=1):
    return [(warc.record(i, "u", "p" * i * size, base64.b32encode(hashlib.sha1(b"p" * i * size).digest()).decode(), i * size, None, False) + "\r\n\r\n").encode() for i in range(n)]


@pytest.mark.parametrize("window", [7, 100, 1 << 20])
def test_every_member_of_a_compressed_archive_is_read(spark, tmp_path, monkeypatch, window):
    """Archives that compress each record on its own, some of them in several members, with padding at the end."""
    monkeypatch.setattr(warc, "WINDOW", window)
    parts = archive()
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts) + b"\0" * 512)
    whole = b"".join(parts)
    (tmp_path / "cut_anywhere.warc.gz").write_bytes(b"".join(gzip.compress(whole[i:i + 333]) for i in range(0, len(whole), 333)))
    records, broken = warc.read_archives(spark, str(tmp_path))
    assert sorted(r["page_id"] for r in records.collect()) == sorted([*range(20)] * 2)
    assert records.where("not intact").isEmpty() and broken.isEmpty()


def test_broken_archives_are_listed(spark, tmp_path):
    parts = archive()
    whole = b"".join(parts)
    each = b"".join(gzip.compress(p) for p in parts)
    bad = bytearray(parts[3])
    bad[-6] ^= 1
    files = {"cut.warc": whole[:-10], "junk.warc": b"junk" + whole, "middle.warc": b"".join(parts[:5]) + b"#" + b"".join(parts[5:]),
             "cut.warc.gz": each[:-20], "garbled.warc.gz": each[:300] + b"\xff" * 40 + each[340:], "tail.warc.gz": each + b"tail",
             "digest.warc": bytes(bad), "good.warc": whole, "empty.warc": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    records, broken = warc.read_archives(spark, str(tmp_path))
    listed = {r["path"].rsplit("/", 1)[1]: (r["at"], r["reason"]) for r in broken.collect()}
    assert set(listed) == {"cut.warc", "junk.warc", "middle.warc", "cut.warc.gz", "garbled.warc.gz", "tail.warc.gz"}
    assert listed["junk.warc"] == (0, "no record at the start")
    assert listed["middle.warc"][0] == sum(map(len, parts[:5]))
    assert "too soon" in listed["cut.warc.gz"][1] and "not compressed" in listed["tail.warc.gz"][1]
    assert records.where("not intact").count() == 1


def test_windows_hold_little_of_a_large_archive():
    """A gigabyte of payloads passes in a few megabytes."""
    import tracemalloc

    record = archive(2, 64 << 20)[1]
    data = gzip.compress(record, 1) * 4
    tracemalloc.start()
    found = list(warc.candidates(warc.unpacked(data)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[3] for f in found[:-1]] == [64 << 20] * 4 and all(f[7] for f in found[:-1]) and found[-1][1] == 4 * len(record)
    assert peak < 32 << 20


def test_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 50_000)
    path = scratch_path(spark, "warc-sizes")
    df = spark.range(200).select("id", F.lit("u").alias("url"), F.repeat(F.concat(F.lit("x"), F.col("id").cast("string")), 1000).alias("html"))
    warc.write_warc(df.withColumnRenamed("id", "page_id"), path)
    assert spark.read.format("binaryFile").load(path).count() >= 200 * 3000 // 60_000
    assert warc.read_warc(spark, path).count() == 200
