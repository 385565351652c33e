"""WARC records in ZIP packages: written in bounded files, read back by ranges without extraction.

A package holds two stored members: ``archive/data.warc.gz``, one gzip member
per record, and ``indexes/index.cdxj``, a line per record with its offset and
length. The reader takes the end of a package, follows the ZIP64 locator if
there is one, reads the central directory, finds where the stored bytes of the
archive begin, and reads the index. Ranges of records then are work of their
own: they are dealt to tasks and read from the package where it lies.

Files are opened through ``pyarrow.fs``, which serves local, HDFS and object
stores by their URI; the folder must be one that all executors share.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codepairs.llm.registry import query, table
from codepairs.session import scratch_path, settle

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 64 << 20  # compressed records of a package
RANGE_BYTES = 4 << 20  # read at once
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 1000  # payloads of fewer bytes are stored each time

# Marks and sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = (b"PK" + bytes(x) for x in ((3, 4), (1, 2), (5, 6), (6, 6), (6, 7)))
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


def open_uri(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


# -- ZIP ------------------------------------------------------------------------


def zip_stored(members: list[tuple[str, bytes]]) -> Iterator[bytes]:
    """The bytes of a package whose members are stored, with all sizes and places in their ZIP64 fields."""
    at, central = 0, []
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        extra = struct.pack("<HHQQ", 1, 16, n, n)
        head = LOCAL + struct.pack("<5HIIIHH", 45, 0x800, 0, 0, 33, crc, MAX32, MAX32, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at)
        sizes = struct.pack("<6HIII5HII", 45, 45, 0x800, 0, 0, 33, crc, MAX32, MAX32, len(raw), len(extra), 0, 0, 0, 0, MAX32)
        central.append(CENTRAL + sizes + raw + extra)
        yield head
        yield data
        at += len(head) + n
    listing = b"".join(central)
    yield listing
    yield END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(listing), at)
    yield LOCATOR64 + struct.pack("<IQI", 0, at + len(listing), 1)
    yield END + struct.pack("<4HIIH", 0, 0, MAX16, MAX16, MAX32, MAX32, 0)


def zip_members(file, size: int) -> list[tuple[str, int, int, int]]:
    """``(name, method, place of its bytes, stored size)`` of every member, from the central directory."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail_at = max(0, size - MAX16 - 22)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(END, 0, end)  # these four bytes stood in the comment
    if end < 0:
        raise ValueError("not a ZIP package: it has no end record")
    count, n, at = struct.unpack_from("<HII", tail, end + 10)
    if (count == MAX16 or MAX32 in (n, at)) and tail[end - 20 : end - 16] == LOCATOR64:
        (end64,) = struct.unpack_from("<Q", tail, end - 12)
        record = read(end64, 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator points to no end record")
        count, n, at = struct.unpack_from("<QQQ", record, 32)
    listing, members, pos = read(at, n), [], 0
    for _ in range(count):
        if listing[pos : pos + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        method, stored, full, name_n, extra_n, note_n, place = struct.unpack_from("<10xH8xIIHHH8xI", listing, pos)[:7]
        name = listing[pos + 46 : pos + 46 + name_n].decode()
        extra = listing[pos + 46 + name_n : pos + 46 + name_n + extra_n]
        while len(extra) >= 4:
            tag, m = struct.unpack_from("<HH", extra)
            if tag == 1:  # the fields that did not fit stand here, in this order
                wide = list(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                full = wide.pop(0) if full == MAX32 else full
                stored = wide.pop(0) if stored == MAX32 else stored
                place = wide.pop(0) if place == MAX32 else place
            extra = extra[4 + m :]
        local = read(place, 30)
        if local[:4] != LOCAL:
            raise ValueError(f"no member begins at {place}")
        name_l, extra_l = struct.unpack_from("<HH", local, 26)
        members.append((name, method, place + 30 + name_l + extra_l, stored))
        pos += 46 + name_n + extra_n + note_n
    return members


# -- WARC -----------------------------------------------------------------------


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields and HTTP fields, named in lower case, and the payload that the record holds."""

    def fields(head: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}

    head, _, rest = record.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _writer(folder: str, package_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_uri(folder)
        parts: list[bytes] = []
        index: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            # A name of its own for each attempt; only those that a finished task reports are read.
            name = f"{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{base}/{name}") as out:
                for data in zip_stored([(ARCHIVE, b"".join(parts)), (INDEX, b"".join(index))]):
                    out.write(data)
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(index)], pa.int64())})
            parts.clear()
            index.clear()
            return row

        store.create_dir(base, recursive=True)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packer.compress(warc_record(*row)) + packer.flush()
                place = {"urn": f"urn:page:{'' if row[0] is None else row[0]}", "digest": row[3], "offset": held, "length": len(data)}
                index.append(json.dumps(place).encode() + b"\n")
                parts.append(data)
                held += len(data)
                if held >= package_bytes:
                    held = 0
                    yield flush()
        if parts:
            yield flush()

    return write


def marked(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: which pages are stored, and to which the others refer."""
    payload = F.coalesce(pages["html"].cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= MIN_REVISIT
    heads = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("_head"), F.count("*").alias("_n")).filter("_n > 1")
    heads = settle(heads.select(F.col("digest").alias("_of"), "_head"), "warc-heads")
    # Small payloads, which may be very common, are spread under keys that match nothing.
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce("page_id", F.xxhash64("url")).cast("string")))
    told = rows.withColumn("_key", key).join(heads, F.col("_key") == F.col("_of"), "left")
    refers = F.when(~F.col("_head").eqNullSafe(F.col("page_id")), F.col("_head"))
    return told.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record per page into packages in ``folder`` (a URI that all executors share); returns ``(path, records)``, stored.

    Of pages with equal payloads of at least 1000 bytes the one with the largest
    id is a response; the others are revisits of it, those with a null id too.
    Rows that share that largest id are responses each, as are all if every id
    is null. A null html is an empty payload, a null url a record without a
    target. Extra columns are ignored; an empty table writes no package.
    """
    return settle(marked(pages).mapInArrow(_writer(folder, package_bytes), "path string, records long"), "warc-manifest")


# -- reading --------------------------------------------------------------------


def _ranges(range_bytes: int):
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where the records of each package lie: runs of neighbours that are read at once."""
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = open_uri(path)
                rows: list[tuple[str, int, list[int]]] = []
                with store.open_input_file(name) as file:
                    members = {m[0]: m for m in zip_members(file, file.size())}
                    for member in (ARCHIVE, INDEX):
                        if member not in members or members[member][1] != 0:
                            raise ValueError(f"{path} has no stored member {member}")
                    start = members[ARCHIVE][2]
                    file.seek(members[INDEX][2])
                    listing = file.read(members[INDEX][3])
                places = sorted((x["offset"], x["length"]) for x in map(json.loads, listing.splitlines()))
                for offset, length in places:
                    if rows and sum(rows[-1][2]) + length <= range_bytes and rows[-1][1] + sum(rows[-1][2]) == start + offset:
                        rows[-1][2].append(length)
                    else:
                        rows.append((path, start + offset, [length]))
                for at in range(0, len(rows), 1000):
                    columns = list(zip(*rows[at : at + 1000], strict=True))
                    yield pa.RecordBatch.from_pydict({"path": columns[0], "start": pa.array(columns[1], pa.int64()), "lengths": pa.array(columns[2], pa.list_(pa.int64()))})

    return ranges


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _records(with_payload: bool):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths")), strict=True):
                store, name = open_uri(path)
                with store.open_input_file(name) as file:
                    file.seek(start)
                    data = memoryview(file.read(sum(lengths)))
                rows, at = [], 0
                for n in lengths:
                    warc, http, payload = parse_record(zlib.decompress(data[at : at + n], 31))
                    at += n
                    stored = warc["warc-type"] == "response"
                    size = len(payload) if stored else int(http["content-length"])
                    digest = hashlib.sha1(payload).hexdigest() if stored else warc["warc-payload-digest"].removeprefix("sha1:")
                    row = (_page(warc["warc-record-id"]), warc.get("warc-target-uri"), warc["warc-type"], _page(warc.get("warc-refers-to")), size, digest)
                    rows.append((*row, payload if stored else None) if with_payload else row)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return records


def read_packages(packages: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the packages named in column ``path``; size and digest of stored payloads are taken from their bytes.

    A revisit holds no payload (null); its size and digest are those it was written with.
    """
    n = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = packages.select("path").repartition(n, "path")
    ranges = named.mapInArrow(_ranges(range_bytes), "path string, start long, lengths array<long>").repartition(n, "path", "start")
    return ranges.mapInArrow(_records(with_payload), RECORDS + (", payload binary" if with_payload else ""))


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder in the shared scratch space, with its scheme."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
heads AS (SELECT h, max(page_id) AS head FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1),
told AS (SELECT page_id, h, CASE WHEN head IS DISTINCT FROM page_id THEN head END AS refers_to FROM p LEFT JOIN heads USING (h))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM told"""


@query(SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as packages and reads the records back."""
    packages = write_packages(table(spark, sf_dir, "pages"), shared_uri(spark, "warc"))
    return read_packages(packages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
