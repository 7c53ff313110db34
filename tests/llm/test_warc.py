import gzip
import hashlib
import io
import json
import struct
import zipfile

import pytest

from foliospark.llm import warc
from foliospark.llm.warc import DATA_MEMBER, INDEX_MEMBER, lines_of, members, package, parse_record, put, read_packages, record, write_packages
from foliospark.llm.shared import written

SCHEMA = "page_id long, url string, html string, digest string, content string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x") for i, u, h in rows], SCHEMA)


def brute(rows):
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and first[h or ""] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h or ""] if revisit else None, None))
    return sorted(out, key=str)


def files_of(spark, folder, contents):
    """Packages as rows of paths, a null and a path without a file as they are."""
    rows = [(put(str(folder), c) if isinstance(c, bytes) else c,) for c in contents]
    return spark.createDataFrame(rows, "path string")


@pytest.mark.parametrize("slice_bytes", [1 << 20, 7])
def test_lines_of_slices(monkeypatch, slice_bytes):
    monkeypatch.setattr(warc, "SLICE_BYTES", slice_bytes)
    for text in (b"", b"one\n", b"one\ntwo and more of it\n\nthree", b"x" * 40 + b"\n" + b"\n".join(b"%d" % k for k in range(50))):
        data = b"head" + text + b"tail"
        read = lambda a, n: data[a : a + n]  # noqa: B023, E731
        found = [x for at in range(0, max(len(text), 1), slice_bytes) for x in lines_of(read, 4, len(text), at)]
        assert found == [x for x in text.split(b"\n") if x]


def test_an_archive_over_4_gb_is_read_by_ranges(spark, tmp_path):
    """A package with a hole of 5 GB before the archive, so that its places only fit ZIP64 fields."""
    payloads = [b"page %d" % k for k in range(3)]
    records = [record(k, "u", p, hashlib.sha256(p).hexdigest(), None) for k, p in enumerate(payloads)]
    archive, at, lines = b"".join(records), 0, []
    for k, r in enumerate(records):
        lines.append(json.dumps({"page_id": k, "filename": "a.warc.gz", "offset": at, "length": len(r)}))
        at += len(r)
    index, hole = "\n".join(lines).encode(), 5 << 30
    directory, path = b"", f"{tmp_path}/big.zip"
    with open(path, "wb") as f:
        for name, size, data in ((b"hole.bin", hole, None), (b"archive/a.warc.gz", len(archive), archive), (b"indexes/index.jsonl", len(index), index)):
            start = f.tell()
            extra = struct.pack("<HHQQ", 1, 16, size, size)
            f.write(struct.pack("<4sHHHHHLLLHH", warc.LOCAL_SIG, 45, 0, 0, 0, 0, 0, warc.MAX32, warc.MAX32, len(name), len(extra)) + name + extra)
            f.write(data) if data is not None else f.seek(hole, 1)
            more = struct.pack("<HHQQQ", 1, 24, size, size, start)
            directory += struct.pack("<4sHHHHHHLLLHHHHHLL", warc.CENTRAL_SIG, 45, 45, 0, 0, 0, 0, 0, warc.MAX32, warc.MAX32, len(name), len(more), 0, 0, 0, 0, warc.MAX32) + name + more
        start = f.tell()
        f.write(directory)
        end64 = f.tell()
        f.write(struct.pack("<4sQHHLLQQQQ", warc.END64_SIG, 44, 45, 45, 0, 0, 3, 3, len(directory), start))
        f.write(struct.pack("<4sLQL", warc.END64_LOCATOR_SIG, 0, end64, 1) + struct.pack("<4sHHHHLLH", warc.END_SIG, 0, 0, 3, 3, warc.MAX32, warc.MAX32, 0))
    got = read_packages(spark.createDataFrame([(path,)], "path string")).orderBy("page_id").collect()
    assert [(r["page_id"], r["payload_digest"], r["error"]) for r in got] == [(k, hashlib.sha256(p).hexdigest(), None) for k, p in enumerate(payloads)]


def test_several_archives_and_null_ids(spark, tmp_path):
    out, sets, index = io.BytesIO(), {"a.warc.gz": [1, 2], "b.warc.gz": [3]}, []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, ids in sets.items():
            data = b""
            for k in ids:
                r = record(k, "u", b"p%d" % k, hashlib.sha256(b"p%d" % k).hexdigest(), None)
                index.append(json.dumps({"page_id": k, "filename": name, "offset": len(data), "length": len(r)}))
                data += r
            z.writestr(f"archive/{name}", data)
        z.writestr("other/pages.jsonl", "\n".join([*index, json.dumps({"page_id": 9, "filename": "none", "offset": 0, "length": 5}), "junk"]))
    got = read_packages(files_of(spark, tmp_path, [out.getvalue()])).collect()
    assert sorted(r["page_id"] for r in got if not r["error"]) == [1, 2, 3]
    assert {r["page_id"] for r in got if r["error"]} == {9, None} and len(got) == 5
    pages = written(write_packages(pages_of(spark, [(None, "u", "x"), (1, "u", "y")]), str(tmp_path)), "p")
    got = read_packages(pages).collect()
    assert [r["page_id"] for r in got if not r["error"]] == [1] and len(got) == 2


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "é" * 60), (2, None, "é" * 60), (3, "u\r\nx", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "\r\n\r\n" * 50), (0, "u", "é" * 60)]
    rows += [(100 + k, "u", "<html>" + "hot" * 50) for k in range(40)] + [(200, "u", "x" * 300_000)]
    for size in (1, 1 << 20):
        packages = written(write_packages(pages_of(spark, rows), str(tmp_path), package_bytes=size), "packages")
        got = [tuple(r) for r in read_packages(packages).collect()]
        assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"c" * 60_000])
def test_directory(zip64, comment):
    records = [(k, record(k, "u", b"payload %d" % k, "d", None)) for k in range(5)]
    data = package(records, zip64)
    if comment:
        out = io.BytesIO(data)
        with zipfile.ZipFile(out, "a") as z:
            z.comment = comment
        data = out.getvalue()
    reads = []
    places = members(lambda a, n: reads.append(n) or data[a : a + n], len(data))
    assert set(places) == {DATA_MEMBER, INDEX_MEMBER}
    at, n = places[INDEX_MEMBER]
    for k, line in enumerate(data[at : at + n].decode().splitlines()):
        entry = json.loads(line)
        start = places[DATA_MEMBER][0] + entry["offset"]
        assert parse_record(data[start : start + entry["length"]])["payload"] == b"payload %d" % k


def test_zip64_directory_by_limits(monkeypatch):
    """A directory with its fields at their limits, as archives over 4 GB have."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = package([(1, record(1, "u", b"x" * 50, "d", None))], True)
    assert warc.END64_SIG in data
    at, n = members(lambda a, m: data[a : a + m], len(data))[DATA_MEMBER]
    assert parse_record(data[at : at + n])["payload"] == b"x" * 50


def test_compressed_members_are_left_out_and_errors_are_rows(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "a" * 1000)
    data = out.getvalue()
    assert members(lambda a, n: data[a : a + n], len(data)) == {}
    good = package([(1, record(1, "u", b"p", hashlib.sha256(b"p").hexdigest(), None))])
    broken = package([(9, gzip.compress(b"no warc"))])
    wrong = package([(8, record(8, "u", b"p", "0" * 64, None))])
    got = read_packages(files_of(spark, tmp_path, [good, b"", None, b"junk", data, broken, wrong, f"{tmp_path}/none.zip"])).collect()
    assert [r["page_id"] for r in got if r["error"] is None] == [1]
    assert len(got) == 8 and {r["page_id"] for r in got if r["error"]} == {None, 9, 8}


def test_empty_table(spark, tmp_path):
    assert read_packages(write_packages(pages_of(spark, []), str(tmp_path))).count() == 0


def test_very_long_pages_and_ties(spark, tmp_path):
    long = "<p>é long page</p>" * 300_000
    rows = [(7, "u", long), (3, "u", long), (5, None, long + "x"), (1, "u", "x" * 99), (2, "u", "x" * 99), (4, "u", "x" * 100), (6, "u", "x" * 100)]
    got = [tuple(r)[:6] for r in read_packages(written(write_packages(pages_of(spark, rows), str(tmp_path)), "packages")).collect()]
    told = sorted((r[:5] for r in got), key=str)
    assert told == sorted((r[:5] for r in brute(rows)), key=str)
