"""WARC packages: round trip, revisits, and the ZIP directories against the standard library."""

import hashlib
import io
import zipfile

import pytest

from codepairs.llm.warc import op1_warc, read_packages, shared_uri, write_packages, zip_members, zip_stored

SCHEMA = "page_id long, url string, html string, payload string, digest string"


def expected(rows):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    heads = {}
    for i, p in payloads:
        if len(p) >= 1000 and i is not None:
            heads[p] = max(heads.get(p, i), i)
    out = []
    for i, p in payloads:
        head = heads.get(p)
        refers = head if head is not None and head != i else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize("package_bytes, range_bytes", [(64 << 20, 4 << 20), (500, 300)])
def test_round_trip(spark, package_bytes, range_bytes):
    big, other = "ü" * 500, "x\r\n\r\ny" * 400
    rows = [(1, big), (2, big), (3, "short"), (4, "short"), (5, None), (6, ""), (None, big), (7, other), (7, other), (8, other * 200), (9, "ü" * 499 + "z"), (None, None)]
    df = spark.createDataFrame([(i, None if i == 3 else f"http://a/ b\r\n{i}", h, "clash", "clash") for i, h in rows], SCHEMA)
    records = read_packages(write_packages(df, shared_uri(spark, "warc"), package_bytes), range_bytes=range_bytes)
    assert got(records) == expected(rows)
    kept = sorted(((r.page_id, bytes(r.payload)) for r in records.collect() if r.record_type == "response"), key=str)
    assert {(i, p) for i, p in kept} >= {(i, (h or "").encode()) for i, h in rows if i in (2, 3, 4, 5, 6, 7, 8, 9)}
    assert {r.url for r in records.collect() if r.page_id == 1} == {"http://a/ b 1"}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert read_packages(write_packages(df, shared_uri(spark, "warc"))).collect() == []


def test_own_packages_open_elsewhere():
    members = [("a/ü.txt", b"12"), ("b", b""), ("c", b"PK\5\6" * 10)]
    data = b"".join(zip_stored(members))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        assert [(n, z.read(n)) for n in z.namelist()] == members
    found = zip_members(io.BytesIO(data), len(data))
    assert [(n, data[at : at + size]) for n, _, at, size in found] == members


def test_foreign_packages():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", "hello")
        with z.open("y", "w", force_zip64=True) as f:
            f.write(b"world")
        z.writestr("z", "packed" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\5\6 inside, and more of it"
    data = out.getvalue()
    found = zip_members(io.BytesIO(data), len(data))
    assert [(n, m) for n, m, _, _ in found] == [("x", 0), ("y", 0), ("z", 8)]
    assert [data[at : at + size] for n, m, at, size in found if m == 0] == [b"hello", b"world"]


def test_damaged():
    with pytest.raises(ValueError):
        zip_members(io.BytesIO(b"nothing here"), 12)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert got(op1_warc(spark, sf)) == expected(rows)
