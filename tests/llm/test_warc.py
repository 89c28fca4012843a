"""Archive round trips."""

import gzip
import hashlib

import pytest

from corpusmill.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, record_type string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA)


ROWS = [
    (5, "http://a/", "x" * 100), (3, "http://b/\r\nevil: 1", "x" * 100), (9, None, "x" * 100), (4, "http://c/", "x" * 99), (8, "http://d/", "x" * 99),
    (1, "http://e/é", "é" * 5000 + "\r\n\r\nWARC/1.1\r\n"), (2, "", ""), (6, "http://f/", None), (3, "http://b/", "x" * 100), (None, "http://g/", "x" * 100), (10, "http://h/", "long " * 300_000),
]


def test_round_trip_with_revisits(spark, tmp_path):
    pages = frame(spark, ROWS).repartition(3)
    got = W.archive_digest(pages, str(tmp_path / "a")).collect()
    want = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        again = h == "x" * 100 and i != 3
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_headers_alone_and_filters(spark, tmp_path):
    folder = str(tmp_path / "b")
    W.write_pages(frame(spark, ROWS).repartition(2), folder, file_bytes=2000)
    heads = W.read_warc(spark, folder, payloads=False)
    assert "payload" not in heads.columns and heads.count() == len(ROWS)
    for where, want in (("record_type = 'revisit' and page_id in (5, 9)", [5, 9]), ("page_id = 4 and payload_bytes > 1", [4]), ("page_id = 4 and payload_bytes > 99", [])):
        assert sorted(r["page_id"] for r in W.read_warc(spark, folder, False, where).collect()) == want
        assert sorted(r["page_id"] for r in heads.where(where).collect()) == want
    urls = {r["page_id"]: r["target_uri"] for r in heads.collect()}
    assert urls[9] is None and "\n" not in urls[3] and urls[1] == "http://e/é"
    body = {r["page_id"]: bytes(r["payload"]) for r in W.read_warc(spark, folder, True, "record_type = 'response'").collect()}
    assert body[1].decode() == ROWS[5][2] and body[2] == b""


def test_payloads_are_not_inflated_for_headers(tmp_path):
    rows = [dict(page_id=n, url="u", record_type="response", payload=b"a" * 400_000, payload_digest="d", payload_bytes=400_000, refers_to=None) for n in range(3)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join(W.member(W.record_bytes(r, W.EPOCH)) for r in rows))
    assert gzip.decompress(path.read_bytes()).count(b"WARC/1.1") == 3  # any reader can read it

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n):
            self.n += n
            return self.f.read(n)

        def seek(self, *a):
            return self.f.seek(*a)

    with open(path, "rb") as f:
        stream = Counting(f)
        assert [h["warc-page-id"] for h, p in W.records(stream, lambda h: True, False)] == ["0", "1", "2"]
    with open(path, "rb") as f:
        assert [len(p) for h, p in W.records(f, lambda h: h["warc-page-id"] == "1", True)] == [400_000]


def test_damage_is_told(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"not an archive at all, really not")
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(W.records(f, lambda h: True, True))


def test_empty_table(spark, tmp_path):
    assert W.archive_digest(frame(spark, []), str(tmp_path / "c")).count() == 0
