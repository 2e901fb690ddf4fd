import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from presswork.llm import warc

from .conftest import duck, frame, same_rows

SCHEMA = "page_id long, url string, html string, type string, payload string"
ROWS = [(1, "http://a/x", "<p>é</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "http://a/y", "<p>é</p>"), (5, "http://a/z", "\r\n\r\nWARC/1.1\r\n"),
        (6, "http://c", "x" * 300_000), (7, "http://ä/ö", "<p>é</p>"), (8, "http://c", "x" * 300_000), (9, "http://d", "one")]


def pages(spark, tmp_path, rows=ROWS):
    return frame(spark, tmp_path, [(*r, "clash", "clash") for r in rows], SCHEMA)


def test_sql_on_edge_cases(spark, tmp_path):
    df = pages(spark, tmp_path)
    same_rows(warc.digest(df), duck(warc.DIGEST_SQL, pages=df))
    none = spark.createDataFrame([], SCHEMA)
    assert warc.digest(none).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, None, "b")]
    got = sorted(((r.page_id is None, r.page_id, r.record_type, r.refers_to) for r in warc.digest(pages(spark, tmp_path, rows)).collect()), key=str)
    assert got == sorted([(False, 1, "response", None), (False, 1, "response", None), (True, None, "revisit", 1), (True, None, "response", None)], key=str)


def test_round_trip_and_push_down(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(warc.page_records(pages(spark, tmp_path)), path, maxFileBytes=1000)
    back = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    assert len(back) == len(ROWS)
    for i, url, html in ROWS:
        r, raw = back[f"urn:page:{i}"], (html or "").encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert r.payload_bytes == len(raw)
        assert (bytes(r.payload) == raw) if r.type == "response" else r.payload is None
        if url and "\r" not in url:
            assert r.target_uri == url
    assert back["urn:page:3"].target_uri == "http://b/%0D%0AX: y"
    df = warc.read_warc(spark, path)
    q = df.filter((F.col("type") == "revisit") & F.col("target_uri").startswith("http://a/"))
    assert "revisit" not in q._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]
    assert {r.record_id for r in q.collect()} == {"urn:page:1", "urn:page:4"}
    assert df.filter(F.col("target_uri").isNull()).count() == 1
    assert df.filter(F.col("record_id").isin("urn:page:9", "urn:page:2")).count() == 2
    assert warc.read_warc(spark, path, payload="false").filter("payload IS NOT NULL").count() == 0


def test_pushed_tests_skip_payloads(tmp_path):
    """Records that do not pass are not inflated past their head."""
    reader = warc.WarcReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([warc.EqualTo(("type",), "response"), warc.EqualTo(("payload",), b"x")]))
    assert len(left) == 1 and reader.tests == [("type", "eq", "response")]
    row = dict(type="response", record_id="r", target_uri="u", date=None, payload_digest="D", payload_bytes=50_000_000, refers_to=None,
               payload=b"y" * 50_000_000)
    data = warc.gzip_member(warc.record_bytes(row, "2020-01-01T00:00:00Z"), 1)
    assert gzip.decompress(data).endswith(b"y" * 10 + b"\r\n\r\n")
    import io
    import time

    class File(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    t = time.perf_counter()
    assert list(warc.read_records(File(data * 20), True, lambda r: False, True)) == []
    assert time.perf_counter() - t < 0.5


def test_other_writers_files(spark, tmp_path):
    """Plain files and gzip members without skip lengths."""
    row = dict(type="response", record_id="r1", target_uri="u", date=None, payload_digest="D", payload_bytes=3, refers_to=None, payload=b"abc")
    one = warc.record_bytes(row, "2020-01-01T00:00:00Z")
    two = warc.record_bytes(row | {"record_id": "r2", "payload": b"z" * 9000}, "2020-01-01T00:00:00Z")
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(one + two)
    (tmp_path / "w/b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    got = sorted((r.record_id, bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path / "w")).collect())
    assert got == sorted([("r1", b"abc"), ("r2", b"z" * 9000)] * 2)
    assert warc.read_warc(spark, str(tmp_path / "w")).filter("record_id = 'r2'").count() == 2
