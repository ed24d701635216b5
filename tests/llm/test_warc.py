import base64
import gzip
import hashlib
import io
import json
import random
import zipfile
from collections import Counter, defaultdict

import pytest

from recurra.llm import warc

PAGES = "page_id long, url string, html string, record_id string, payload string, _h string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(3)


def brute(rows):
    """Multiset of (page_id, bytes, digest, type, refers_to)."""
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    out = Counter()
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids.sort(key=lambda i: (i is not None, i or 0))
        out[(ids[-1], len(payload), digest, "response", None)] += 1
        out.update((i, len(payload), digest, "revisit", ids[-1]) for i in ids[:-1])
    return out


def digests(records):
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return Counter(tuple(r[c] for c in columns) for r in records)


ROWS = (
    [(k, f"http://h{k % 3}.example.com/p/{k}", f"<p>{k % 11} é</p>") for k in range(60)]
    + [(100, None, None), (101, "http://a b/\n", ""), (None, "x", "only"), (None, "y", "only"), (None, "z", "<p>1 é</p>")]
    + [(200, "http://[bad/", "tie")] * 5 + [(7, "u", "other"), (300, "http://long.example", "long \r\n\r\n" * 40_000)]
)


def test_records_and_payloads(spark, tmp_path):
    packages = warc.write_archives(pages(spark, ROWS), f"{tmp_path}/a")
    records = warc.read_archives(packages).collect()
    assert digests(records) == brute(ROWS)
    whole = warc.resolved(warc.read_archives(packages)).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in whole) == Counter((i, (h or "").encode()) for i, _, h in ROWS)
    assert {r.url for r in records if r.page_id in (100, 101)} == {None, "http://a%20b/%0A"}
    assert all((r.payload is None) == (r.record_type == "revisit") for r in records)


def test_packages_are_ordinary_zip_files(spark, tmp_path, monkeypatch):
    written = warc.write_archives(pages(spark, ROWS), f"file:{tmp_path}/b").collect()
    assert sum(p.records for p in written) == len(ROWS)
    for package in written:
        with zipfile.ZipFile(package.path.removeprefix("file:")) as z:
            assert z.testzip() is None
            data, lines = z.read(warc.DATA), z.read(warc.INDEX).decode().splitlines()
        assert lines == sorted(lines) and len(lines) == package.records
        for line in lines:
            fields = json.loads(line[line.index("{") :])
            at, n = int(fields["offset"]), int(fields["length"])
            assert gzip.decompress(data[at : at + n]).startswith(b"WARC/1.1\r\n")
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == package.records  # members one after the other


def test_package_sizes_are_bounded():
    """Many small packages hold what one large one does; a worker's module is the test's own here."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="run-")
    paths, package = [], None
    for k in range(25):
        package = package or warc.Package(folder)
        package.add(k, "http://e/", b"x" * k, False, None)
        if len(package.lines) >= 10:
            paths.append(package.close()[0])
            package = None
    paths.append(package.close()[0])
    found = [r["page_id"] for path in paths for r in warc.records_of(sorted(warc.entries_of(path)))]
    assert len(paths) == 3 and sorted(found) == list(range(25))


def package_of(folder, names, comment=b"", method=zipfile.ZIP_STORED):
    path = f"{folder}/{random.random()}.zip"
    with zipfile.ZipFile(path, "w", method) as z:
        z.comment = comment
        for name, data in names.items():
            z.writestr(name, data)
    return path


def test_directories_with_zip64_forms_and_comments(tmp_path, monkeypatch):
    names = {f"archive/m{k}.warc.gz": b"data %d" % k for k in range(3000)}
    comment = b"before PK\x05\x06 and after" + bytes(60_000)
    plain = package_of(tmp_path, names, comment)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 20)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 100)
    wide = package_of(tmp_path, names, comment)
    assert b"PK\x06\x06" in open(wide, "rb").read() and b"PK\x06\x06" not in open(plain, "rb").read()
    for path in (plain, wide):
        read = warc.Ranges(path)
        found = warc.members(read, "archive/")
        assert {name: read(*place) for name, place in found.items()} == names
        read.close()


def test_only_ranges_are_read(tmp_path):
    package = warc.Package(str(tmp_path))
    rng = random.Random(1)
    for k in range(200):
        package.add(k, f"http://e/{k}", rng.randbytes(20_000), False, None)
    path, size, _ = package.close()
    taken = []

    class Counting(warc.Ranges):
        def __call__(self, start, length):
            taken.append(length)
            return super().__call__(start, length)

    original, warc.Ranges = warc.Ranges, Counting
    try:
        entries = sorted(warc.entries_of(path))
        assert sum(taken) < 0.1 * size
        taken.clear()
        got = list(warc.records_of(entries[3:5] + entries[150:151]))
        assert [r["page_id"] for r in got] == [3, 4, 150] and len(taken) == 2 and sum(taken) < 70_000
    finally:
        warc.Ranges = original


def test_damage_is_an_error(tmp_path):
    plain, _ = warc.record(1, "http://e/", b"payload", False, None)
    assert warc.parsed(plain)["payload"] == b"payload"
    for bad in (plain.replace(b"payload\r", b"paYload\r"), plain[:-1], b"", b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            warc.parsed(bad)
    compressed = package_of(tmp_path, {"archive/data.warc.gz": b"x" * 100}, method=zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="compressed"):
        list(warc.entries_of(compressed))
    other = tmp_path / "other"
    for data in (b"", b"no package", b"PK\x05\x06" + bytes(5)):
        other.write_bytes(data)
        with pytest.raises(ValueError):
            list(warc.entries_of(str(other)))


def test_a_shorter_index_is_an_error(spark, tmp_path):
    packages = warc.write_archives(pages(spark, ROWS[:5]), f"{tmp_path}/c")
    more = packages.withColumn("records", packages["records"] + 1)
    with pytest.raises(ValueError, match="were written"):
        warc.read_archives(more)


def test_empty_table(spark, tmp_path):
    packages = warc.write_archives(pages(spark, []), f"{tmp_path}/d")
    assert packages.collect() == [] and warc.read_archives(packages).collect() == []


def test_sorted_keys():
    assert warc.sort_key("http://www.example.com/a?b") == "com,example,www)/a?b"
    assert warc.sort_key("") == ")/" and warc.sort_key("http://[bad/") == "http://[bad/"
    assert io.BytesIO(gzip.compress(b"x", 6, mtime=0)).read(2) == b"\x1f\x8b"
