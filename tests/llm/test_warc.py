import base64
import gzip
import hashlib
import io

import pytest
from millrace.llm.common import new_path
from millrace.llm.warc import archive_pages, fields, files, inflate, normalise, record, records, with_first, write_archives


def expect(rows):
    first = {}
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, html in rows:
        payload = (html or "").encode()
        to = first.get(html or "")
        to = None if to == i else to
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.fixture
def pages_of(spark):
    return lambda rows: spark.createDataFrame([(i, None if i is None else f"http://x.example/{i} \r\nX: y", h, "clash") for i, h in rows], "page_id long, url string, html string, payload string")


def test_pages_come_back(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert sorted(map(tuple, archive_pages(pages, archive_bytes=100_000).collect()), key=str) == expect(rows)


def test_edges(pages_of):
    rows = [(5, "same"), (3, "same"), (9, "same"), (1, None), (2, ""), (7, "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "same"), (None, "alone"), (8, "é" * 100_000)]
    assert sorted(map(tuple, archive_pages(pages_of(rows)).collect()), key=str) == expect(rows)
    assert archive_pages(pages_of([])).count() == 0


def test_members_and_index(spark, pages_of):
    folder = new_path(spark, "warc-test")
    whole = write_archives(with_first(pages_of([(i, f"page {i % 7}" * 50) for i in range(40)])), folder)
    members = normalise(whole).collect()
    assert sum(r.records for r in members) == 40
    for r in members:
        system, local = files(r.path)
        data = system.open_input_stream(local, compression=None).read()
        lines = system.open_input_stream(files(r["index"])[1], compression=None).read().decode().splitlines()
        at = 0
        for line in lines:
            offset, size, name = line.split(" ")
            assert int(offset) == at
            at += int(size)
            assert fields(gzip.decompress(data[int(offset) : at]))[0]["warc-record-id"] == name
        assert at == len(data) and len(list(records(inflate(io.BytesIO(data))))) == len(lines)


def test_a_cut_archive_is_refused():
    raw = gzip.compress(record(1, None, b"x" * 1000, None)[:-10])
    with pytest.raises(ValueError):
        list(records(inflate(io.BytesIO(raw))))
