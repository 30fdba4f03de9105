import hashlib

import pytest

from veracity.llm import warc as W
from veracity.session import scratch_path

SCHEMA = "page_id long, url string, html string"
BIG = "<p>same</p>" * 200


def pages(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, None, BIG), (3, "http://a b\r\nX: y", "small"), (4, None, "small"),
            (5, "u", None), (6, "u", ""), (None, "u", "no id"), (7, "u", "é\r\n\r\nWARC/1.1\r\n" * 90), (8, "u", "x" * 3_000_000)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_round_trip(spark):
    got = W.read_archives(spark, W.write_archives(pages(spark), scratch_path(spark, "warc"))).collect()
    assert all(r.error is None for r in got) and len(got) == 10
    by = {r.record_id: r for r in got}
    want = {str(r.page_id): (r.html or "").encode() for r in pages(spark).collect()}
    for k, r in by.items():
        body = want[k[len("<urn:page:"):-1].replace("none", "None")]
        assert r.payload_bytes == len(body)
        assert r.payload_digest == "sha1:" + hashlib.sha1(body).hexdigest()
        assert r.record_type == "revisit" or r.payload == body
    assert {k for k, r in by.items() if r.record_type == "revisit"} == {"<urn:page:1>", "<urn:page:2>"}
    assert by["<urn:page:1>"].refers_to == "<urn:page:9>" and by["<urn:page:1>"].payload is None
    assert "%0D%0A" in by["<urn:page:3>"].target_uri


def test_empty_table(spark):
    path = W.write_archives(spark.createDataFrame([], SCHEMA), scratch_path(spark, "warc"))
    assert W.read_archives(spark, path).count() == 0


def raw_archive(spark):
    path = W.write_archives(pages(spark).coalesce(1), scratch_path(spark, "warc"))
    return bytes(max((r.content for r in spark.read.format("binaryFile").load(path).collect()), key=len))


def test_dictionary_leads_and_one_frame_holds_one_record(spark):
    data = raw_archive(spark)
    kinds = [magic for _, magic, _ in W.frames(memoryview(data))]
    assert kinds.count(W.RECORD) >= 1 and all(k == W.RECORD or k & 0xFFFFFFF0 == 0x184D2A50 for k in kinds)
    big = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "concat('<html><body>page number ', id, repeat(' lorem ipsum', 20), '</body></html>') AS html")
    path = W.write_archives(big.coalesce(1), scratch_path(spark, "warc"))
    data = max((bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()), key=len)
    assert int.from_bytes(data[:4], "little") == W.DICTIONARY


def test_damage_is_reported_not_lost(spark, tmp_path):
    data = raw_archive(spark)
    at = [a for a, magic, _ in W.frames(memoryview(data)) if magic == W.RECORD]
    broken = bytearray(data)
    broken[at[1] + 20] ^= 0xFF
    (tmp_path / "flip").write_bytes(bytes(broken))
    (tmp_path / "cut").write_bytes(data[:-9])
    (tmp_path / "junk").write_bytes(b"not an archive at all")
    got = W.read_archives(spark, str(tmp_path)).collect()
    bad = [r for r in got if r.error]
    assert {r.file.rsplit("/", 1)[1] for r in bad} >= {"cut", "junk"} | ({"flip"} if any(r.file.endswith("flip") for r in bad) else set())
    assert len([r for r in got if r.file.endswith("flip")]) >= 2


@pytest.mark.parametrize("text", [b"HTTP/1.1 200\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nnocolon\r\n\r\n",
                                  W.record(1, "u", b"abc", "0" * 40, None, "d"), W.record(1, "u", b"abc", "x", None, "d")[:-2],
                                  W.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "d").replace(b"abc", b"abcd")])
def test_invalid_records(text):
    with pytest.raises(ValueError):
        W.parse(text)
