"""WARC records in ZIP packages on the shared store, read by ranges from the central directory."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import shuffle_partitions, table, workspace, written

#: Payloads below this are never revisits.
LEAST_REVISIT = 100
#: A package is closed when its records reach this many bytes.
PACKAGE_BYTES = 8 << 20
#: Records get this date; a run doesn't depend on the clock.
DATE = "2020-01-01T00:00:00Z"
DATA_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.jsonl"

# Signatures and sizes of the ZIP format's records.
END_SIG, END_SIZE = b"PK\x05\x06", 22
END64_LOCATOR_SIG, END64_LOCATOR_SIZE = b"PK\x06\x07", 20
END64_SIG = b"PK\x06\x06"
CENTRAL_SIG, CENTRAL_SIZE = b"PK\x01\x02", 46
LOCAL_SIG, LOCAL_SIZE = b"PK\x03\x04", 30
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF

#: Members that are archives and indexes, by the ends of their names.
ARCHIVES, INDEXES = (".warc", ".warc.gz"), (".jsonl",)
#: Indexes are read in slices of about so many bytes, each in a row of its own that Spark deals out.
SLICE_BYTES = 1 << 20

#: Reads bytes from a package: (start, length) -> bytes.
RangeReader = Callable[[int, int], bytes]


def opened(path: str):
    """A file of the shared store, to be read by ranges: read_at(length, start) and size()."""
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def put(folder: str, data: bytes) -> str:
    """Write data as a new file in a folder of the shared store; its path. A task that runs twice leaves two files, one of which is read."""
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    name = f"{uuid.uuid4().hex}.zip"
    with store.open_output_stream(f"{place}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzipped WARC/1.1 record: a response with its payload, or a revisit without it."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload if refers_to is None else b"\r\n")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(http)}\r\n\r\n"
    return gzip.compress(head.encode("utf-8", "surrogatepass") + http + b"\r\n\r\n", compresslevel=1, mtime=0)


def package(records: list[tuple[int, bytes]], zip64: bool = False) -> bytes:
    """A ZIP with the gzipped records in one stored member and their offsets in another."""
    index, at = [], 0
    for page_id, data in records:
        index.append(json.dumps({"page_id": page_id, "filename": DATA_MEMBER.rpartition("/")[2], "offset": at, "length": len(data)}))
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((DATA_MEMBER, b"".join(x for _, x in records)), (INDEX_MEMBER, "".join(f"{x}\n" for x in index).encode("utf-8"))):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


def members(read: RangeReader, size: int) -> dict[str, tuple[int, int]]:
    """Start and length of the data of every stored member, from the central directory.

    Reads the end record (after a comment of any length), the ZIP64 end record where a field is
    at its limit, the directory, and each member's local header. A compressed member can't be
    read by ranges and is left out; a broken directory is a ValueError.
    """
    tail_at = max(0, size - END_SIZE - MAX16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END_SIG)
    if at < 0 or len(tail) - at < END_SIZE:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HLL", tail, at + 10)
    if n == MAX16 or length == MAX32 or start == MAX32:
        locator = read(tail_at + at - END64_LOCATOR_SIZE, END64_LOCATOR_SIZE)
        if locator[:4] != END64_LOCATOR_SIG:
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64_SIG:
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, found, at = read(start, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL_SIG:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<LLHHH", directory, at + 20)
        local, = struct.unpack_from("<L", directory, at + 42)
        name = directory[at + CENTRAL_SIZE : at + CENTRAL_SIZE + name_n].decode("utf-8", "replace")
        extra = directory[at + CENTRAL_SIZE + name_n : at + CENTRAL_SIZE + name_n + extra_n]
        if MAX32 in (packed, plain, local):
            plain, packed, local = zip64_values(extra, plain, packed, local)
        if method == 0:
            header = read(local, LOCAL_SIZE)
            if header[:4] != LOCAL_SIG:
                raise ValueError("broken local header")
            found[name] = (local + LOCAL_SIZE + sum(struct.unpack_from("<HH", header, 26)), packed)
        at += CENTRAL_SIZE + name_n + extra_n + comment_n
    return found


def zip64_values(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int, int]:
    """The sizes and the offset with those at their limit replaced from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            more = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return tuple(next(more) if x == MAX32 else x for x in (plain, packed, local))
        at += 4 + n
    raise ValueError("no ZIP64 extra field")


def parse_record(data: bytes) -> dict:
    """A gzipped record as its fields, with the payload of a response under "payload"."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def with_originals(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Pages with payload, digest and refers_to: the smallest id with an equal payload, or null.

    Equal payloads are grouped by digest and length in two steps, first within one of the salts,
    so that a payload with a third of all rows is spread; the result goes back the same way.
    """
    salts = 64
    html = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(
        F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"),
        F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("salt"),
    )
    parts = base.filter(F.col("n") >= LEAST_REVISIT).groupBy("digest", "salt").agg(F.min("page_id").alias("low"), F.count("*").alias("m"))
    firsts = parts.groupBy("digest").agg(F.min("low").alias("first"), F.sum("m").alias("m")).filter("m > 1").drop("m")
    by_salt = written(parts.select("digest", "salt").join(firsts, "digest"), "originals")
    found = base.join(by_salt, ["digest", "salt"], "left")
    return found.select("page_id", "url", "html", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Pack a WARC record per page into ZIP files in a folder of the shared store: rows (path, size).

    The payload is the html in UTF-8; null html and url count as empty. Of equal payloads of
    LEAST_REVISIT bytes or more, the record with the smallest id is a response and the others
    revisit it. Packages close at package_bytes, so memory is bounded by that and one page. Ids
    are integers; rows with a repeated id or payload all get records, those with the smallest id
    as responses; a null id makes a record that reads back as a row with an error; an empty table
    gives no packages; other columns are not read. The folder is a path or URI that Arrow's file
    systems open on driver and executors. Rows are lazy: write them, as each time that they are
    computed the files are written anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0

        def out() -> pa.RecordBatch:
            data = package(records)
            return pa.RecordBatch.from_arrays([pa.array([put(folder, data)]), pa.array([len(data)], pa.int64())], ["path", "size"])

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (batch.column(j)[k].as_py() for j in range(5))
                records.append((page_id, record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)))
                size += len(records[-1][1])
                if size >= package_bytes:
                    yield out()
                    records, size = [], 0
        if records:
            yield out()

    return with_originals(pages, id_col, url_col, html_col).mapInArrow(run, "path string, size long")


def index_slices(packages: DataFrame, path_col: str = "path") -> DataFrame:
    """What there is to read: a row per slice of an index, with the places of the package's archives.

    Reads each package's directory and local headers by ranges. A package whose directory can't be
    read, or which has no index or archive, is a row with an error.
    """

    def slices_of(path: str | None) -> Iterator[tuple]:
        try:
            if path is None:
                raise ValueError("no path")
            with opened(path) as file:
                places = members(lambda start, n: file.read_at(n, start), file.size())
            archives = {name.rpartition("/")[2]: [*place] for name, place in places.items() if name.endswith(ARCHIVES)}
            indexes = [place for name, place in places.items() if name.endswith(INDEXES)]
            if not archives or not indexes:
                raise ValueError("no stored archive or index")
            for start, n in indexes:
                for at in range(0, max(n, 1), SLICE_BYTES):
                    yield path, json.dumps(archives), start, n, at, None
        except (ValueError, struct.error, OSError) as e:
            yield path, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for path in batch.column(0):
                rows = list(zip(*slices_of(path.as_py()), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["path", "archives", "start", "length", "at", "error"])

    return packages.select(path_col).mapInArrow(run, "path string, archives string, start long, length long, at long, error string")


def lines_of(read: RangeReader, start: int, length: int, at: int) -> list[bytes]:
    """The lines that begin in the slice of an index from `at` on; the last one may go on behind it."""
    low = at - 1 if at else 0
    data = read(start + low, min(SLICE_BYTES + (1 if at else 0), length - low))
    end = low + len(data)
    while data and not data.endswith(b"\n") and end < length:
        more = read(start + end, min(1 << 16, length - end))
        cut = more.find(b"\n") + 1
        data, end = data + (more[:cut] if cut else more), end + (cut or len(more))
    if at:  # the line that the slice before began is its own
        data = data.partition(b"\n")[2]
    return [x for x in data.split(b"\n") if x.strip()]


def read_packages(packages: DataFrame, path_col: str = "path") -> DataFrame:
    """Every record of ZIP packages, found through directories and indexes, each read by its own range.

    packages has the paths of files in the shared store, as write_packages gives them. Directories
    are read first; slices of indexes are then dealt out, so that a large package is read by many
    tasks, none of which holds more than a slice and a record. An index has a JSON object per line,
    with offset and length and, where the package has several archives, the archive's filename.
    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, and error: a package
    or record that can't be read, or a record without a number as its id, gives a row with the reason
    instead of a failure. A response's digest and length are computed from the payload read; a
    revisit's are those that it states for the payload it refers to.
    """
    spark = packages.sparkSession
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"
    names = [x.split()[0] for x in schema.split(", ")]

    def row_of(read: RangeReader, archives: dict[str, list[int]], line: bytes) -> tuple:
        page_id = None
        try:
            entry = json.loads(line)
            page_id = entry.get("page_id")
            only = next(iter(archives.values())) if len(archives) == 1 else None
            start, n = archives.get(entry.get("filename", "").rpartition("/")[2]) or only or [0, -1]
            if not 0 <= entry["offset"] <= entry["offset"] + entry["length"] <= n:
                raise ValueError("no such range in an archive")
            fields = parse_record(read(start + entry["offset"], entry["length"]))
            refers = fields.get("WARC-Refers-To")
            payload = fields["payload"]
            if refers is None:
                n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                wrong = None if digest == fields["WARC-Payload-Digest"].removeprefix("sha256:") else "digest differs"
            else:
                n, digest, wrong = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
            return (int(fields["WARC-Record-ID"][10:-1]), n, digest, fields["WARC-Type"], int(refers[10:-1]) if refers else None, wrong)
        except (ValueError, KeyError, OSError, EOFError, AttributeError, TypeError, zlib.error) as e:
            return (page_id if isinstance(page_id, int) else None, None, None, None, None, str(e))

    def rows_of(path: str, archives: str | None, start: int, length: int, at: int, error: str | None) -> Iterator[tuple]:
        if error is not None:
            yield (None, None, None, None, None, error)
            return
        with opened(path) as file:
            read: RangeReader = lambda a, n: file.read_at(n, a)
            for line in lines_of(read, start, length, at):
                yield row_of(read, json.loads(archives), line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(rows_of(*(c[k].as_py() for c in batch.columns)))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], kind) for kind in kinds], names)

    dealt = index_slices(packages, path_col).repartition(shuffle_partitions(spark), "path", "start", "at")
    return dealt.mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = written(write_packages(table(spark, sf_dir, "pages"), f"{workspace(spark)}/foliospark/warc-{uuid.uuid4().hex}"), "packages")
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


QUERIES = {"op7_warc": op7_warc}

ORACLE_SQL = {
    "op7_warc": f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {LEAST_REVISIT} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_REVISIT} AND first <> page_id THEN first END AS refers_to,
       NULL::VARCHAR AS error
FROM f
"""
}
