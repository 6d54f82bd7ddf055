import base64
import gzip
import hashlib
import glob

import pytest

from oligoloom.llm import tables, warc
from oligoloom.llm.tables import scratch_path, stored

SCHEMA = "page_id long, url string, html string, record_id string, type string, digest string, own long"
TRICKY = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>\r\n\r\nWARC/1.0\r\n\r\n\r\n\r\nWARC/1."
PAGES = [
    (5, "http://a.example/", "same"),
    (3, "http://b.example/x y?\r\nz=%0A", "same"),
    (9, None, "same"),
    (1, "http://c.example/", TRICKY),
    (2, "http://c.example/", TRICKY),
    (4, "", None),
    (6, "u", ""),
    (7, "http://d.example/é", "日本語 " * 30_000),
    (8, "no scheme", "\r\n\r\n"),
    (8, "no scheme", "\r\n\r\n"),
    (8, "no scheme", "other"),
    (None, "n", "same"),
    (None, "n", "only without id"),
    (None, "n", "only without id"),
]


def frame(spark, pages):
    return spark.createDataFrame([(*p, "r", "t", "d", 1) for p in pages], SCHEMA)


def archived(spark, pages, payloads=True, **options):
    path = scratch_path(spark, "warc")
    warc.write_archive(frame(spark, pages), path, **options)
    return path, warc.assemble(stored(warc.read_archive(spark, path, payloads), "records"))


def wanted(pages, least=0):
    rows, first = [], {}
    place = lambda p: (p[0] is None, p[0] or 0, p[1] or "")
    for page in sorted(pages, key=place):
        body = (page[2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        kind, refers = "response", None
        if len(body) >= least:
            if digest in first:
                kind, refers = "revisit", first[digest]
            else:
                first[digest] = page[0]
        rows.append((page[0], len(body), digest, kind, refers, page[1]))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("least", [0, 1, 5, 10_000_000])
@pytest.mark.parametrize("common", [1, 1000])
def test_round_trip(spark, monkeypatch, least, common):
    monkeypatch.setattr(tables, "COMMON_ROWS", common)
    pages = PAGES + [(n, f"http://hot.example/{n}", "hot") for n in range(100, 140)]
    _, captures = archived(spark, pages, least_bytes=least)
    assert sorted(map(tuple, warc.page_records(captures).collect()), key=repr) == wanted(pages, least)
    payloads = {(r.response.type, bytes(r.response.payload)) for r in captures.collect()}
    texts = {(p[2] or "").encode() for p in pages}
    assert {body for kind, body in payloads if kind == "response"} == texts
    assert {body for kind, body in payloads if kind == "revisit"} <= {b""}


def test_archives_are_plain_warc_text(spark):
    path, _ = archived(spark, [(1, "http://a.example/", "body")])
    names = glob.glob(path.removeprefix("file:") + "/part-*.gz")
    text = b"".join(gzip.open(n).read() for n in names)
    assert text.count(b"WARC/1.1\r\n") == 3 and text.endswith(b"\r\n\r\n")
    assert b"\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n" in text


def test_empty_table(spark):
    _, captures = archived(spark, [])
    assert captures.count() == 0 and warc.page_records(captures).count() == 0


def record(name, kind, *concurrent):
    return (name, kind, "t", "d", list(concurrent), None, None, {}, None, 0)


def test_assembly_by_either_side_and_by_way_of_others(spark):
    records = [
        record("a", "response", "ra"),
        record("ra", "request"),
        record("ma", "metadata", "ra"),
        record("b", "response"),
        record("rb", "request", "b"),
        record("rb2", "request", "b"),
        record("mb", "metadata", "b", "rb"),
        record("c", "revisit"),
        record("lost", "metadata", "nowhere"),
        record("w", "warcinfo"),
        record("odd", None),
    ]
    rows = warc.assemble(stored(spark.createDataFrame(records, warc.RECORD), "records")).collect()
    name = lambda r: None if r is None else r.record_id
    found = sorted(
        ((r.capture, name(r.response), name(r.request), name(r.metadata), name(r.other)) for r in rows), key=repr
    )
    assert found == sorted(
        [
            ("a", "a", "ra", "ma", None),
            ("b", "b", "rb", "mb", None),
            ("c", "c", None, None, None),
            (None, None, "rb2", None, None),
            (None, None, None, "lost", None),
            (None, None, None, None, "w"),
            (None, None, None, None, "odd"),
        ],
        key=repr,
    )


def test_records_cut_off_or_without_a_block():
    head = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 0"
    more = b"0\r\nWARC-Type: request\r\nContent-Length: 5\r\n\r\nab"
    found = list(warc.whole_records([(head, "x"), (more, "x"), (head + b"\r\n\r\n\r\n\r\n", "y")]))
    assert [block for _, block in found] == [b"", b"ab", b""]


@pytest.mark.parametrize("common", [2, 1000])
def test_lookup_keeps_every_row(spark, monkeypatch, common):
    monkeypatch.setattr(tables, "COMMON_ROWS", common)
    rows = spark.createDataFrame([("hot", n) for n in range(20)] + [("x", 1), ("y", 2), (None, 3)], "k string, n int")
    values = spark.createDataFrame([("hot", "H"), ("x", "X"), ("z", "Z")], "k string, v string")
    found = tables.lookup(stored(rows, "rows"), values, "k").collect()
    want = [("hot", n, "H") for n in range(20)] + [("x", 1, "X"), ("y", 2, None), (None, 3, None)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
