"""Operator 7: archives read back, with copies, nulls and damage."""

import base64
import hashlib
import io

import pytest

from callgrove.llm import warc


def test_round_trip(spark):
    big = "é<p>" * 60_000
    pages = {1: "a", 2: "b", 3: "a", 4: None, 5: "", 6: big, 7: "a", 8: "c\r\n\r\nd"}
    df = spark.createDataFrame([(k, None if k == 2 else f"http://x/{k}", v) for k, v in pages.items()], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_warc(spark, warc.write_warc(df), with_payload=True).collect()}
    last = {}
    for k, v in pages.items():
        last[(v or "")] = k
    for k, v in pages.items():
        payload, original = (v or "").encode(), last[v or ""]
        assert got[k].payload_bytes == len(payload)
        assert got[k].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (got[k].record_type, got[k].refers_to) == (("response", None) if k == original else ("revisit", original))
        assert (bytes(got[k].payload) if got[k].payload is not None else None) == (payload if k == original else None)


def test_least_bytes_and_nulls(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (None, "u", "abcd"), (4, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = warc.read_warc(spark, warc.write_warc(df, min_bytes=3)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "revisit", 4), (1, "response", 0), (2, "response", 0), (4, "response", 0), (4, "response", 0)]
    assert warc.read_warc(spark, warc.write_warc(df.where("page_id > 9"))).count() == 0


def test_damage():
    good = b"".join(warc.member(warc.record(k, "u", b"x" * 100, warc.base32_sha1(b"x" * 100), None)) for k in (1, 2))
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(good))] == [1, 2]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records(io.BytesIO(good[:-30])))
    wrong = warc.member(warc.record(1, "u", b"y" * 100, warc.base32_sha1(b"x"), None))
    with pytest.raises(ValueError, match="payload digest"):
        list(warc.read_records(io.BytesIO(wrong)))
