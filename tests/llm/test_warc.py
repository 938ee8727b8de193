import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tabloom.llm import warc


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")


BIG = "é<p>\r\n\r\nWARC/1.1\r\n" + "x" * 200


def _rows():
    return [
        (5, "http://a/ b\r\nX: y", BIG, "z"), (3, None, BIG, None), (9, "u", BIG, "z"), (1, "u", "small", "z"), (2, "u", "small", "z"),
        (4, "u", None, "z"), (6, "u", "", "z"), (7, "u", "y" * 100, "z"), (8, "u", "y" * 100, "z"), (10, "u", "𝒳" * 3_000_000, "z"), (None, "u", BIG, "z"),
    ]


def test_round_trip(spark, tmp_path):
    rows = _rows()
    warc.write_pages(_pages(spark, rows).repartition(3), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), extra="page=x-page-id").collect()
    assert len(got) == len(rows)
    firsts = {}
    for i, _, html, _ in rows:
        if i is not None:
            firsts[html or ""] = min(firsts.get(html or "", i), i)
    by = {r["page"]: r for r in got}
    for i, url, html, _ in rows:
        r, raw = by[None if i is None else str(i)], (html or "").encode()
        revisit = len(raw) >= 100 and firsts[html or ""] != i
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (f"<urn:page:{firsts[html or '']}>" if revisit else None)
        assert bytes(r["payload"]) == (b"" if revisit else raw)
        assert r["http_length"] == len(raw) and r["payload_digest"] == "sha256:" + hashlib.sha256(raw).hexdigest()
        assert (r["target_uri"] is None) == (url is None)


def test_pushed_predicates_and_skipped_payloads(spark, tmp_path):
    warc.write_pages(_pages(spark, _rows()), str(tmp_path / "w"))
    df = warc.read_warc(spark, str(tmp_path / "w"), payloads="response")
    only = df.filter((F.col("record_type") == "revisit") & F.col("refers_to").startswith("<urn:page:3"))
    assert {r["record_id"] for r in only.collect()} == {"<urn:page:5>", "<urn:page:9>", "<urn:page:none>"}
    assert all(r["payload"] is None for r in only.collect())
    pushed = warc.WarcReader({"path": str(tmp_path / "w")}, ["record_type"])
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(pushed.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("offset",), 3)]))
    assert [type(f) for f in rest] == [GreaterThan]
    names = [b for p in pushed.partitions() for batch in pushed.read(p) for b in batch.column(0).to_pylist()]
    assert names == ["revisit"] * 4


def test_compressed_members_and_other_records(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = b"WARC/1.0\r\nwarc-type: resource\r\nContent-Length: 300000\r\n\r\n" + b"d" * 300_000 + b"\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(data))
    (tmp_path / "w" / "_hidden").write_bytes(b"junk")
    got = warc.read_warc(spark, str(tmp_path / "w"), payloads="resource").orderBy("offset").collect()
    assert [(r["record_type"], r["payload"] and len(r["payload"])) for r in got] == [("warcinfo", None), ("resource", 300_000)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc").write_bytes(b"not an archive\r\n")
    with pytest.raises(Exception, match="no WARC record"):
        warc.read_warc(spark, str(tmp_path / "bad")).collect()


def test_empty_table(spark, tmp_path):
    warc.write_pages(_pages(spark, []), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0
