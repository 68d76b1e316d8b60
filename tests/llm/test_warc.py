import gzip

import pytest

from strandline.llm import warc as W
from tests.compare import check, tables

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, payload string, record_type string"


def pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "https://b/3", None), (4, None, ""), (5, "http://c/é\r\nX: y", "ü" * 200_000), (None, "http://d", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (6, "http://e", "a\r\n\r\nb")]
    return spark.createDataFrame([(*r, "p", "t") for r in rows], SCHEMA)


def test_oracle(spark):
    from strandline.llm.registry import ORACLES, op2_warc

    check(spark, tables(SF), SF, op2_warc, ORACLES["op2_warc"])


def test_revisits(spark):
    rows = W.page_archive(pages(spark)).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.page_id, []).append(r)
    assert (by[1][0].record_type, by[1][0].refers_to, by[1][0].payload_bytes) == ("revisit", 2, 8)
    assert [r.record_type for r in by[2]] == ["response", "response"] and by[None][0].record_type == "response"
    assert (by[3][0].record_type, by[3][0].refers_to) == ("revisit", 4) and by[5][0].payload_bytes == 400_000
    assert W.page_archive(pages(spark).limit(0)).count() == 0


def test_pushdown_and_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    W.write_pages(pages(spark), path)
    df = W.read_warc(spark, path, payload="false")
    hit = df.filter("record_type = 'response' AND target_uri LIKE 'http://a/%'")
    assert hit.count() == 2 and hit.filter("payload IS NOT NULL").count() == 0
    full = {r.record_id: r for r in W.read_warc(spark, path, verify="true").collect()}
    assert bytes(full["urn:page:5"].payload).decode() == "ü" * 200_000 and bytes(full["urn:page:6"].payload) == b"a\r\n\r\nb"
    assert W.read_warc(spark, path).filter("refers_to = 'urn:page:2'").count() == 1


def test_skipping_reads_less(spark, tmp_path):
    path = f"{tmp_path}/w"
    W.write_pages(pages(spark).coalesce(1), f"file://{path}")
    reader = W.WarcReader(f"file://{path}", True, False)
    reader.tests = [("eq", "record_id", "urn:page:6")]
    asked = []
    real = W._Inflater.fill
    W._Inflater.fill = lambda self: asked.append(1) or real(self)
    try:
        rows = [b for p in reader.partitions() for b in reader.read(p)]
    finally:
        W._Inflater.fill = real
    assert sum(b.num_rows for b in rows) == 1 and len(asked) <= 2 * 8


@pytest.mark.parametrize("kind", ["plain", "whole", "members"])
def test_foreign_archives(spark, tmp_path, kind):
    recs = [W.encode_record({"record_id": f"urn:x:{i}", "record_type": "response", "warc_date": "2020-01-01T00:00:00Z", "target_uri": f"http://h/{i}", "sha1_hex": "00" * 20, "refers_to": None, "payload_bytes": 3, "payload": b"%03d" % i}) for i in range(4)]
    name = "x.warc" if kind == "plain" else "x.warc.gz"
    data = b"".join(recs) if kind == "plain" else b"".join(map(gzip.compress, recs))
    (tmp_path / name).write_bytes(data)
    target = f"file://{tmp_path}" if kind != "whole" else f"file://{tmp_path}/{name}"
    rows = W.read_warc(spark, target).orderBy("record_id").collect()
    assert [bytes(r.payload) for r in rows] == [b"000", b"001", b"002", b"003"]


def test_damaged_payload_raises(spark, tmp_path):
    rec = W.encode_record({"record_id": "urn:x:1", "record_type": "response", "warc_date": "d", "target_uri": None, "sha1_hex": "00" * 20, "refers_to": None, "payload_bytes": 1, "payload": b"z"})
    (tmp_path / "x.warc.gz").write_bytes(W.gzip_member(rec))
    with pytest.raises(Exception, match="does not match its digest"):
        W.read_warc(spark, f"file://{tmp_path}", verify="true").collect()


def test_appends_add_up_and_overwrites_replace(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    two, one = (spark.createDataFrame(r, "page_id long, url string, html string") for r in ([(1, "u", "a"), (2, "u", "b")], [(3, "u", "c")]))
    W.write_pages(two, path)
    W.write_pages(one, path)
    assert sorted(r.record_id for r in W.read_warc(spark, path).collect()) == ["urn:page:1", "urn:page:2", "urn:page:3"]
    W.page_records(one).write.format("warc").mode("overwrite").save(path)
    assert [r.record_id for r in W.read_warc(spark, path).collect()] == ["urn:page:3"]


def test_dates_are_in_utc(spark):
    from datetime import datetime, timezone

    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        said = W.page_records(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")).first().warc_date
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert abs((datetime.strptime(said, "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc) - datetime.now(timezone.utc)).total_seconds()) < 120


def test_files_of_failed_attempts_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    W.write_pages(pages(spark), path)
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"half a rec")
    assert W.read_warc(spark, path).count() == 8
