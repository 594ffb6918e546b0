"""Archives: round trips, foreign files, byte ranges, damaged members."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from heliopanel.llm import warc as A

SCHEMA = "page_id long, url string, html string"


def written(spark, tmp_path, rows, schema=SCHEMA, **options):
    folder = str(tmp_path / "archive")
    A.write_warc(spark.createDataFrame(rows, schema), folder, **options)
    return folder


def plain(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>alt"), (2, "http://a/2", "<p>neu ä 漢"), (3, None, "<p>alt"), (4, "http://a/\n4", None), (5, "u", ""), (None, "x", "<p>alt"),
            (7, "http://long", "lorem " * 300_000), (2, "again", "<p>neu ä 漢"), (None, "only", "alone"), (None, "only", "alone")]
    folder = written(spark, tmp_path, rows)
    got = A.read_warc(spark, folder, range_bytes=700).withColumn("id", A.identifier(F.col("record_id"))).withColumn("first", A.identifier(F.col("refers_to"))).collect()
    assert len(got) == len(rows)
    by_url = {r.target: r for r in got}
    assert by_url["http://a/%0A4"].payload_bytes == 0 and by_url["http://a/%0A4"].first == "5" and by_url["u"].record_type == "response"
    assert by_url["http://a/1"].first == "3" and by_url["x"].first == "3" and by_url[None].record_type == "response"
    assert [r.record_type for r in got if r.id == "2"] == ["response"] * 2 and [r.record_type for r in got if r.target == "only"] == ["response"] * 2
    for page, _, html in rows:
        payload = (html or "").encode()
        mine = [r for r in got if r.id == (None if page is None else str(page)) and r.payload_digest == plain(payload)]
        assert mine and all(r.payload_bytes == len(payload) and bytes(r.payload) == (payload if r.record_type == "response" else b"") for r in mine)
    small = written(spark, tmp_path / "least", rows, min_revisit_bytes=7)
    types = {r.target: r.record_type for r in A.read_warc(spark, small).collect()}
    assert types["http://a/%0A4"] == "response" and types["http://a/1"] == "response" and types[None] == "response"


def test_any_program_can_unpack_the_files(spark, tmp_path):
    folder = written(spark, tmp_path, [(i, f"u{i}", f"<p>{i % 3}") for i in range(40)])
    data = b"".join(gzip.decompress(open(os.path.join(folder, f), "rb").read()) for f in os.listdir(folder) if f.startswith("part-"))
    assert data.count(b"WARC/1.1\r\n") == 40 and data.count(b"WARC-Type: response") == 3


@pytest.mark.parametrize("range_bytes", [333, 1 << 20])
def test_each_record_has_one_owner(spark, tmp_path, range_bytes):
    """Ranges that end inside headers, magics and members; foreign records between ours."""
    inner = A.member(A.record(99, "inner", b"x", None), 0)
    parts = [A.member(A.record(i, f"u{i}", os.urandom(60) + A.MAGIC * 3 + b"t" * i, None), 0) for i in range(12)]
    parts.insert(3, gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"))
    parts.insert(5, A.member(b"", 1) + gzip.compress(b"not a record") + A.MAGIC + b"noise")
    parts.append(A.member(A.record(50, "outer", b"-" * 400 + inner + b"-" * 400, None), 0))
    parts.append(A.member(A.record(51, "cut", b"q" * 500, None), 0)[:-30])
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "some.warc.gz").write_bytes(b"".join(parts))
    found = A.read_warc(spark, str(tmp_path / "f"), range_bytes=range_bytes)
    got = A.outermost(found, range_bytes).orderBy("offset").collect()
    assert [r.target for r in got] == ["u0", "u1", "u2", None, *[f"u{i}" for i in range(3, 12)], "outer"]
    assert got[3].record_type == "warcinfo" and bytes(got[3].payload) == b"abcd"
    assert all(a.offset + a.length <= b.offset for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("width", [1, 7, 64])
def test_ranges_of_any_width(width):
    data = b"".join(A.member(A.record(i, f"u{i}", os.urandom(40) + A.MAGIC * 2, None), 0) for i in range(6))
    source = A._Bytes(lambda at, n: data[at:at + n])
    found = [r["target"] for low in range(0, len(data), width) for r in A.records_in(source, low, min(low + width, len(data)))]
    assert found == [f"u{i}" for i in range(6)]


def test_magics_inside_payloads_and_false_digests(spark, tmp_path):
    source = A._Bytes(lambda at, n, d=A.member(A.record(1, "u", b"abc", None).replace(b"abc", b"abd"), 1): d[at:at + n])
    with pytest.raises(ValueError):
        list(A.records_in(source, 0, 1000))
    assert A.parsed(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n") is None and A.parsed(b"WARC/1.1") is None


def test_empty_and_extra_columns(spark, tmp_path):
    assert A.read_warc(spark, written(spark, tmp_path, [])).count() == 0
    rows = spark.createDataFrame([(1, "u", "a", "s", 3), (2, "v", "a", "t", 4)], SCHEMA + ", sha string, first int")
    assert sorted(map(tuple, A.archived(rows).select("page_id", "record_type", "refers_to").collect())) == [("1", "revisit", "2"), ("2", "response", None)]
