"""Web archives in ZIP packages: written by tasks, and read back by byte ranges without unpacking anything.

A package holds one stored member of WARC records, each a gzip member of its own, and an index of their offsets. The
reader finds the central directory from the package's last bytes (ZIP64 forms included), the index from the directory,
the records from the index; it reads those ranges only. Index lines become rows, so one package's records are read by
many tasks, in runs of neighbouring ranges.

* Writing: a task streams its rows into packages of a bounded size under names of its own and reports them as rows.
  The written list of packages is what counts; leftovers of lost or repeated tasks are in no list. Files are opened
  through Arrow's file systems (file, hdfs, s3, gs), never as local paths.
* Records with equal payloads: that of the largest page_id is a response, the others are revisits, which hold the HTTP
  header (with the payload's length) and its digest, and refer to the response. Nulls are the smallest ids; of repeated
  rows with one id and payload one stays a response. Payloads are told apart by SHA-256 and counted before any join.
* A null html is an empty payload, and empty payloads are equal like others. Null ids and urls come back as null. Blanks,
  controls and characters beyond ASCII in a url are percent-encoded. An empty table gives no package and no record. A
  payload must fit in memory, as every value of a table must. Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, work_folder

PACKAGE_BYTES, PACKAGE_RECORDS = 1 << 29, 100_000  # a package is closed beyond either
READ_BYTES, READ_GAP = 1 << 23, 1 << 16  # most bytes of one read, most unused bytes inside it
TASK_BYTES = 1 << 25
# Names of the packaging and record formats.
DATA, INDEX, DESCRIPTION = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2000-01-01T00:00:00Z"
PAGE = re.compile(r"<urn:recurra:page:(-?\d+|none):")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- records -----------------------------------------------------------------------------------


def record_id(page_id: int | None, digest: str, more: str = "") -> str:
    return f"<urn:recurra:page:{'none' if page_id is None else page_id}:{digest}{more}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, target: int | None) -> tuple[bytes, dict]:
    """One record, uncompressed, and the fields of its index line."""
    digest = sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest, f":{uuid.uuid4()}" if revisit else ""),
        "WARC-Date": CAPTURED,
        "WARC-Block-Digest": f"sha1:{sha1(block)}",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]-._~|{}^`\\\"<>")
    if revisit:
        head |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": record_id(target, digest)}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    index = {"url": head.get("WARC-Target-URI", ""), "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{digest}"}
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", index


def parsed(data: bytes) -> dict:
    """Fields of one record, checked against the lengths and digests that it states."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    block, end = rest[:length], rest[length:]
    if len(block) != length or end != b"\r\n\r\n":
        raise ValueError(f"record {fields['warc-record-id']} is cut")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    revisit = fields["warc-type"] == "revisit"
    if fields["warc-block-digest"] != f"sha1:{sha1(block)}" or not revisit and stated != sha1(payload):
        raise ValueError(f"record {fields['warc-record-id']} differs from its digest")
    sizes = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)

    def page(name: str) -> int | None:
        number = PAGE.match(fields.get(name, "<urn:recurra:page:none:"))[1]
        return None if number == "none" else int(number)

    return {
        "record_id": fields["warc-record-id"],
        "page_id": page("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to_id": fields.get("warc-refers-to"),
        "refers_to": page("warc-refers-to"),
        "payload_bytes": int(sizes[1]) if revisit else len(payload),
        "payload_digest": stated,
        "payload": None if revisit else payload,
    }


# --- writing -----------------------------------------------------------------------------------


def sort_key(url: str) -> str:
    """Host labels from the last to the first, then the path: neighbours of a site stand together in an index."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


class Package:
    """A ZIP package written front to back, so to any store that takes streams."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = opened(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.system, self.place, self.stream = system, path, system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines: list[str] = []
        self.offset = 0

    def add(self, *fields) -> None:
        plain, index = record(*fields)
        member = gzip.compress(plain, 6, mtime=0)
        self.data.write(member)
        index |= {"offset": str(self.offset), "length": str(len(member)), "filename": DATA.rpartition("/")[2]}
        self.lines.append(f"{sort_key(index['url'])} {re.sub(r'[^0-9]', '', CAPTURED)} {json.dumps(index)}\n")
        self.offset += len(member)

    def full(self) -> bool:
        return self.offset > PACKAGE_BYTES or len(self.lines) >= PACKAGE_RECORDS

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            for line in sorted(self.lines):
                member.write(line.encode())
        names = [{"name": path.rpartition("/")[2], "path": path} for path in (DATA, INDEX)]
        self.zip.writestr(zipfile.ZipInfo(DESCRIPTION), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": names}))
        self.zip.close()
        self.stream.close()
        return self.path, self.system.get_file_info(self.place).size, len(self.lines)


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, revisit, target) of every row: which record answers and which refers to another."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("_h", F.sha2("payload", 256))
    each = rows.groupBy("_h", "page_id").agg(F.count(F.lit(1)).alias("_n"))
    groups = each.groupBy("_h").agg(F.max(F.struct("page_id", "_n")).alias("_top"), F.sum("_n").alias("_all"))
    copies = stage(groups.filter("_all > 1").select(F.col("_h").alias("_g"), F.col("_top.page_id").alias("target"), F.col("_top._n").alias("_tied")))
    marked = rows.join(copies, F.col("_h") == F.col("_g"), "left")
    is_top = F.col("page_id").eqNullSafe(F.col("target"))
    plain = marked.withColumn("revisit", F.col("_g").isNotNull() & ~is_top)
    columns = ["page_id", "url", "payload", "revisit", "target"]
    if copies.filter("_tied > 1").isEmpty():
        return plain.select(*columns)
    is_tied = F.coalesce(F.col("_tied") > 1, F.lit(False)) & is_top
    tied = stage(marked.filter(is_tied).withColumn("_row", F.monotonically_increasing_id()))
    first = stage(tied.groupBy("_h").agg(F.min("_row").alias("_first"))).select("_first")
    chosen = tied.join(first, tied["_row"] == first["_first"], "left").withColumn("revisit", F.col("_first").isNull())
    return plain.filter(~is_tied).select(*columns).unionByName(chosen.select(*columns))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of pages(page_id, url, html) as a record; the list of packages (path, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "revisit", "target"))):
                package = package or Package(folder)
                package.add(*(value.as_py() for value in row))
                if package.full():
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*done)], ["path", "bytes", "records"])

    return stage(decided(pages).mapInArrow(run, "path string, bytes long, records long"))


# --- reading -----------------------------------------------------------------------------------


class Ranges:
    """Byte ranges of one file."""

    def __init__(self, path: str):
        system, inside = opened(path)
        self.file = system.open_input_file(inside)
        self.size = self.file.size()

    def __call__(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"the file ends before byte {start + length}")
        return data

    def close(self) -> None:
        self.file.close()


def end_of_directory(read: Ranges) -> tuple[int, int, int]:
    """(entries, size, offset) of the central directory, from the file's last bytes."""
    tail = min(read.size, 22 + 0xFFFF)
    data = read(read.size - tail, tail)
    at = data.rfind(b"PK\x05\x06", 0, len(data) - 18)
    while at >= 0 and at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data):
        at = data.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("not a ZIP package")
    entries, size, offset = struct.unpack_from("<HII", data, at + 10)
    place = read.size - tail + at
    if place >= 20 and (locator := read(place - 20, 20))[:4] == b"PK\x06\x07":
        far = struct.unpack_from("<Q", locator, 8)[0]
        record64 = read(far, 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 directory is not where its locator says")
        return struct.unpack_from("<QQQ", record64, 32)
    return entries, size, offset


def directory(read: Ranges) -> Iterator[tuple[str, int, int, int]]:
    """(name, method, stored size, offset of the local header) of every member; the directory is read in windows."""
    entries, size, offset = end_of_directory(read)
    buffer, taken = b"", 0

    def want(length: int) -> None:
        nonlocal buffer, taken
        while len(buffer) < length:
            more = min(max(1 << 16, length - len(buffer)), size - taken)
            if more <= 0:
                raise ValueError("the central directory is cut")
            buffer += read(offset + taken, more)
            taken += more

    for _ in range(entries):
        want(46)
        if buffer[:4] != b"PK\x01\x02":
            raise ValueError("not an entry of a central directory")
        method, = struct.unpack_from("<H", buffer, 10)
        stored, plain, names, extras, comments = struct.unpack_from("<IIHHH", buffer, 20)
        at, = struct.unpack_from("<I", buffer, 42)
        want(46 + names + extras + comments)
        name = buffer[46 : 46 + names].decode("utf-8")
        extra, k = buffer[46 + names : 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # 64-bit values of the fields that are all ones, in this order
                here = k + 4
                wide = []
                for value in (plain, stored, at):
                    if value == 0xFFFFFFFF:
                        value, = struct.unpack_from("<Q", extra, here)
                        here += 8
                    wide.append(value)
                plain, stored, at = wide
            k += 4 + length
        buffer = buffer[46 + names + extras + comments :]
        yield name, method, stored, at


def members(read: Ranges, prefix: str) -> dict[str, tuple[int, int]]:
    """(first byte, length) of every stored member under a prefix; a compressed one is an error."""
    found = {}
    for name, method, length, at in directory(read):
        if name.startswith(prefix) and not name.endswith("/"):
            if method != 0:
                raise ValueError(f"{name} is compressed; ranges of it cannot be read")
            head = read(at, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            found[name] = (at + 30 + sum(struct.unpack_from("<HH", head, 26)), length)
    return found


def lines_of(read: Ranges, start: int, length: int) -> Iterator[bytes]:
    rest = b""
    for at in range(start, start + length, 1 << 20):
        *whole, rest = (rest + read(at, min(1 << 20, start + length - at))).split(b"\n")
        yield from whole
    if rest:
        yield rest


def entries_of(path: str) -> Iterator[tuple[str, int, int]]:
    """(path, first byte, length) of every record that the package's indexes list."""
    read = Ranges(path)
    data = {name.rpartition("/")[2]: place for name, place in members(read, "archive/").items()}
    for name, (start, length) in members(read, "indexes/").items():
        for line in lines_of(read, start, length):
            if line.strip():
                fields = json.loads(line[line.index(b"{") :])
                first, size = data[fields["filename"]]
                at, n = int(fields["offset"]), int(fields["length"])
                if at + n > size:
                    raise ValueError(f"{name} points beyond {fields['filename']}")
                yield path, first + at, n
    read.close()


def records_of(ranges: Iterator[tuple[str, int, int]]) -> Iterator[dict]:
    """Parsed records of (path, first byte, length), which come sorted; neighbours are read together."""
    run: list[tuple[int, int]] = []
    read, current = None, None

    def flush() -> Iterator[dict]:
        if run:
            first = run[0][0]
            data = read(first, run[-1][0] + run[-1][1] - first)
            for start, length in run:
                unpacker = zlib.decompressobj(31)
                plain = unpacker.decompress(data[start - first : start - first + length])
                if not unpacker.eof or unpacker.unused_data:
                    raise ValueError(f"no whole record at byte {start} of {current}")
                yield parsed(plain)
            run.clear()

    for path, start, length in ranges:
        last = run[-1][0] + run[-1][1] if run else 0
        if path != current or run and (not 0 <= start - last <= READ_GAP or start + length - run[0][0] > READ_BYTES):
            yield from flush()
        if path != current:
            if read:
                read.close()
            read, current = Ranges(path), path
        run.append((start, length))
    yield from flush()
    if read:
        read.close()


def read_archives(packages: DataFrame, payload: bool = True) -> DataFrame:
    """Records of packages(path, bytes, records): (record_id, page_id, url, record_type, refers_to_id, refers_to,
    payload_bytes, payload_digest) and, if wanted, the payload of responses.

    An index that lists another number of records than were written is an error.
    """
    spark = packages.sparkSession
    total = packages.agg(F.sum("bytes").alias("bytes"), F.sum("records").alias("records")).first()
    tasks = max(spark.sparkContext.defaultParallelism, (total.bytes or 0) // TASK_BYTES)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = list(entries_of(path))  # bounded by the records of a package
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["path", "start", "length"])

    entries = stage(packages.select("path").repartition(tasks, "path").mapInArrow(index, "path string, start long, length long"))
    if (listed := entries.count()) != (total.records or 0):
        raise ValueError(f"{total.records} records were written, the indexes list {listed}")
    kinds = {
        "record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to_id": pa.string(),
        "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    } | ({"payload": pa.binary()} if payload else {})

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], list(kinds))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))))
        rows, held = [], 0
        for row in records_of(ranges):
            rows.append(row)
            held += row["payload_bytes"] if payload else 0
            if len(rows) >= 1000 or held > READ_BYTES:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    placed = entries.repartitionByRange(tasks, "path", "start").sortWithinPartitions("path", "start")
    names = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    return placed.mapInArrow(fetch, ", ".join(f"{c} {names[kind]}" for c, kind in kinds.items()))


def resolved(records: DataFrame) -> DataFrame:
    """All records with a payload: revisits get that of the response they refer to, null if there is none."""
    answers = records.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload").alias("_payload"))
    joined = records.join(answers, F.col("refers_to_id") == F.col("_id"), "left")
    return joined.withColumn("payload", F.coalesce("payload", "_payload")).drop("_id", "_payload")


def archive_folder(pages: DataFrame) -> str:
    return f"{work_folder(pages.sparkSession).rstrip('/')}/archives-{uuid.uuid4().hex}"
