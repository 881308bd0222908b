import base64
import hashlib
import tempfile

import pytest

from binlens.llm import warc

ROWS = [(5, "http://a/ü x", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (9, None, "<p>same</p>"), (7, "http://c", None), (8, "http://d", ""),
        (1, "u\r\nX: y", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n é\r\n\r\n"), (None, "http://n", "<p>same</p>"), (4, "r", "twice"), (4, "r", "twice"),
        (3, "l", "long " * 400_000)]
SCHEMA = "page_id long, url string, html string, id string, kind string"


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def want(rows, least=0):
    out = []
    for i, _, t in rows:
        size = len((t or "").encode())
        same = [j for j, _, u in rows if (u or "") == (t or "") and j is not None]
        first = min(same) if same and i is not None and size >= least else i
        out.append((i, size, digest(t), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA).repartition(3)


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(pages, least):
    got = [tuple(r) for r in warc.archive_index(pages, min_bytes=least).collect()]
    assert sorted(got, key=str) == want(ROWS, least)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_payloads_survive(spark, pages, compression):
    path = tempfile.mkdtemp(prefix="run-warc-") + "/w"
    warc.write_archives(pages, path, compression=compression)
    found = []
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect():
        found += list(warc.records(bytes(r.content)))
    assert len(found) == len(ROWS)
    ids = [h["warc-record-id"] for h, _ in found]
    assert all(h["warc-type"] in ("response", "revisit") and h["warc-date"] for h, _ in found) and len(set(ids)) == len(ROWS) - 1
    payloads = sorted(p for h, p in found if h["warc-type"] == "response")
    revisits = [h for h, p in found if h["warc-type"] == "revisit" and p == b""]
    assert all(h["warc-refers-to"] in ids for h in revisits)
    kept = [(i, t) for (i, _, _, kind, _), (_, _, t) in zip(want(ROWS), sorted(ROWS, key=lambda r: str((r[0], len((r[2] or "").encode()))))) if kind == "response"]
    assert payloads == sorted((t or "").encode() for _, t in kept)


def test_no_pages(pages):
    assert warc.archive_index(pages.limit(0)).count() == 0


def test_records_of_joined_gzip_members():
    import gzip
    a = warc._record("response", "1", "u", "D", None, b"one") + warc.END
    b = warc._record("response", "2", None, "D", None, b"") + warc.END
    got = list(warc.records(gzip.compress(a) + gzip.compress(b)))
    assert [p for _, p in got] == [b"one", b""] and got[0][0]["warc-target-uri"] == "u"
