import hashlib

import pytest

from gneiss.llm import warc
from tests.oracle import connection, same


def test_pages(spark):
    big, small = "é" * 60, "x" * 99
    rows = [(5, "http://a b/\n", big), (3, None, big), (7, "u", small), (8, "u", small), (9, "u", None), (None, "u", big), (3, None, big), (11, "u", "a\n\nWARC/1.1\r\n\r\n1 2 3 4 5\n")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload string")
    got = [tuple(r[c] for c in ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")) for r in warc.convert_pages(pages).collect()]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    kind = {(i, t): ("response", None) for i, _, t in rows} | {(5, big): ("revisit", 3)}
    by_id = sorted(got, key=str)
    wanted = sorted(((i, *kind[i, t], len((t or "").encode()), sha(t)) for i, _, t in rows if i is not None), key=str)
    assert [x for x in by_id if x[0] is not None] == wanted
    assert warc.convert_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    contents = [b"HTTP/1.1 200 OK\r\n\r\nhello\nURL 1 2 3 5\n", b"", b"\n\n\n"]
    data = warc.arc_start(version, "f.arc", "20200102") + b"".join(b"\n" + warc.arc_record(version, f"http://x/{k}", "1.2.3.4", "20200102030405", "text/html", c) for k, c in enumerate(contents)) + b"\n"
    block, *out = warc.parse_arc(data)
    assert block["URL"] == "filedesc://f.arc" and block["content"].startswith(f"{version} 0 ".encode()) and block["at"] == 0
    assert all(data[r["at"] :].startswith(f"http://x/{k} ".encode()) for k, r in enumerate(out))
    assert [r["content"] for r in out] == contents
    assert {r["version"] for r in out} == {version} and out[1]["URL"] == "http://x/1" and out[0]["Archive-date"] == "20200102030405"


def test_rolled_archives_and_revisits(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 4)
    texts = ["a" * 150, "b" * 300, "c" * 99, "d" * 100]
    rows = [(f"p/{k} \u00e9", f"http://h/{k}", texts[k % 4]) for k in range(30)] + [(None, "http://n/1", "e" * 200), (None, "http://n/2", "e" * 200), ("", "http://n/3", None)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(2)
    arc, out = f"file://{tmp_path}/arc", f"file://{tmp_path}/warc"
    warc.write_arc(pages, arc)
    own = warc.read_arc(spark, arc, packed=True)
    assert own.groupBy("file").count().agg({"count": "max"}).first()[0] == 4 and own.where("url like 'filedesc%'").count() == own.select("file").distinct().count() >= 11
    for r in own.where("version = 2 AND url NOT LIKE 'filedesc%'").collect():
        assert r["at"] > 0
    for r in warc.files(spark, arc).collect():
        for x in warc.parse_arc(warc.content_of(r["path"], r["content"])):
            if x["version"] == 2 and not x["URL"].startswith("filedesc"):
                assert int(x["Offset"]) == x["at"] and x["Filename"].endswith(".arc")
    warc.arc_to_warc(own, out, "string")
    found = warc.read_warc(spark, out).collect()
    info = {r["record_id"]: r for r in found if r["record_type"] == "warcinfo"}
    assert {r["url"] for r in info.values()} == {r["file"] for r in own.select("file").distinct().collect()} and all(b"URL IP-address" in r["payload"] for r in info.values())
    records = {r["url"]: r for r in found if r["record_type"] != "warcinfo"}
    assert len(records) == 33 and all(r["warcinfo"] in info for r in records.values()) and len({r["record_id"] for r in found}) == len(found)
    for k, text in enumerate(texts):
        same = sorted(i for i, _, t in rows if t == text)
        for i, url, t in rows:
            if t == text:
                r = records[url]
                assert (r["record_type"], r["refers_to"]) == (("response", None) if len(text) < 100 or i == same[0] else ("revisit", same[0])) and r["page_id"] == i
                assert r["payload"] == (text.encode() if r["record_type"] == "response" else None) and r["payload_bytes"] == len(text)
    assert [records[f"http://n/{k}"]["record_type"] for k in (1, 2, 3)] == ["response", "revisit", "response"] and records["http://n/3"]["page_id"] == ""


def test_bad_arcs():
    start = warc.arc_start(1, "f", "2020")
    for bad in (b"\nhttp://x 1.2.3.4 2020 text/html 99\nshort\n", b"\nhttp://x text/html 1\na\n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(start + bad))


def test_dates():
    assert warc.warc_date("20200102030405") == "2020-01-02T03:04:05Z"
    assert warc.warc_date("2020") == "2020-01-01T00:00:00Z"


def test_table_with_revisits(spark, tables):
    rows = [(k, f"http://h/{k}", None if k % 11 == 0 else f"{k % 7}" * (98 + k % 5)) for k in range(400, 0, -1)]
    folder, c = tables("pages", rows, "page_id long, url string, html string")
    out = warc.op3_warc(spark, folder)
    same(out, c, warc.OP3_SQL)
    assert out.where("record_type = 'revisit'").count() > 100


def test_whole_table(spark, sf):
    same(warc.op3_warc(spark, sf), connection(sf), warc.OP3_SQL)
