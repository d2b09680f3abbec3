import gzip
from pathlib import Path

import pytest

from tillbook.llm import warc

BIG, ODD = "x" * 1500, "é" * 600 + "\r\n\r\nWARC/1.1\r\n"
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (2, "http://a/2", BIG), (3, None, None),
    (None, "u\r\nX: y", BIG), (None, None, None), (4, "u", ""), (4, "u", ""),
    (5, "q", ODD), (6, "q2", ODD), (7, "s", "short"), (8, "s", "short"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")


def test_round_trip_of_repeats_nulls_and_ties(pages):
    rows = {}
    for r in warc.round_trip(pages).collect():
        rows.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to))
    assert rows[1] == [(1500, "revisit", 2)]
    assert sorted(rows[2]) == [(1500, "response", None), (1500, "revisit", 2)]
    assert rows[3] == [(0, "response", None)] and rows[4] == [(0, "response", None)] * 2
    assert rows[5] == [(1214, "revisit", 6)] and rows[6] == [(1214, "response", None)]
    assert rows[7] == rows[8] == [(5, "response", None)]


def test_null_page_ids_revisit_the_known_page(pages):
    found = warc.round_trip(pages.where("page_id is null or page_id = 2")).where("page_id is null").collect()
    assert sorted((r.payload_bytes, r.record_type, r.refers_to or 0) for r in found) == [(0, "response", 0), (1500, "revisit", 2)]


def test_archives_are_warc_and_hold_whole_payloads(spark, pages, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    data = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path).glob("part-*"))
    records = list(warc.split_records(data))
    assert len(records) == 3 * len(PAGES)
    assert len({h["warc-record-id"] for h, _ in records}) == len(records)
    assert {h["warc-type"] for h, _ in records} == {"response", "revisit", "request", "metadata"}
    whole = warc.assemble(warc.read_records(spark, path))
    got = [r.capture.payload.decode() for r in whole.collect() if r.capture.type == "response"]
    assert sorted(got) == sorted(["", "", "", "", BIG, ODD, "short", "short"])
    one = whole.where("capture.uri = 'u%0D%0AX: y'").first()
    assert one.request.concurrent_to == one.metadata.concurrent_to == one.capture.record_id


def test_assembly_without_partners(spark):
    fields = "record_id string, type string, concurrent_to string, payload binary"
    rows = [("a", "response", None, b""), ("b", "request", "gone", b""), ("c", "metadata", None, b""), ("d", "request", "a", b""), ("e", "request", "a", b"")]
    found = warc.assemble(spark.createDataFrame(rows, fields)).collect()
    assert len(found) == 1 and found[0].request.record_id == "d" and found[0].metadata is None


def test_empty_table(pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_a_wrong_length_is_an_error():
    with pytest.raises(ValueError):
        list(warc.split_records(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nab\r\n\r\n"))


def record(n, size=20):
    block = bytes([65 + n % 26]) * size
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r{n:03}>\r\nContent-Type: text/plain\r\nContent-Length: {size}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def ids_in(spark, folder):
    found = warc.read_records(spark, str(folder)).select("record_id", "payload_bytes").collect()
    return sorted((r.record_id, r.payload_bytes) for r in found)


@pytest.mark.parametrize("how", ["plain", "whole", "members", "mixed", "padded"])
def test_foreign_archives(spark, tmp_path, how):
    records = [record(n, 20 + n) for n in range(60)]
    packed = {
        "plain": b"".join(records),
        "whole": gzip.compress(b"".join(records)),
        "members": b"".join(map(gzip.compress, records)),
        "mixed": gzip.compress(b"".join(records[:31])) + b"".join(gzip.compress(b"".join(records[a : a + 7])) for a in range(31, 60, 7)),
        "padded": b"".join(map(gzip.compress, records)) + b"\0" * 500,
    }[how]
    (tmp_path / "a.warc.gz").write_bytes(packed)
    assert ids_in(spark, tmp_path) == [(f"<r{n:03}>", 20 + n) for n in range(60)]


def test_cut_archives_are_errors():
    whole = b"".join(gzip.compress(record(n)) for n in range(5))
    for cut in (1, 4, 30):
        with pytest.raises(ValueError):
            list(warc.split_records(warc.inflate(whole[:-cut])))
    for cut in (1, 25, len(record(0)) - 8):
        with pytest.raises(ValueError):
            list(warc.split_records(warc.inflate(b"".join(map(record, range(2)))[:-cut])))
    assert list(warc.split_records(warc.inflate(b""))) == []


def test_a_very_long_record_is_streamed(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(n, size), 1) for n, size in enumerate((5, 64_000_000, 7))))
    assert ids_in(spark, tmp_path) == [("<r000>", 5), ("<r001>", 64_000_000), ("<r002>", 7)]


def test_a_long_page_makes_the_round(spark):
    text = "é very long page " * 400_000
    pages = spark.createDataFrame([(1, "u", text), (2, "v", text), (3, "w", "short")], "page_id long, url string, html string")
    found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    size = len(text.encode())
    assert found == {1: (size, "revisit", 2), 2: (size, "response", None), 3: (5, "response", None)}
