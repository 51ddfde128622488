"""WARC archives as a PySpark Python data source, ``warc``, that reads and writes.

Reading plans one partition a file (writers roll files over at ROLL_BYTES, so files are bounded). Predicates on record
type, record id, target URI, payload digest and refers_to are pushed down: of each record the headers are parsed first, and
only a record that passes them has its payload decoded; option ``payload=false`` decodes none. Records are gzip members
whose extra field ``sl`` has the compressed length, so that unwanted ones are stepped over, not inflated; members without
it and plain files are read too.

Writing puts part files of unique names into a folder of that write beside the target and moves them there at commit, so tasks that are lost and run
again leave nothing behind. Files are opened by pyarrow's file systems (local paths, file:, hdfs:, s3:, gs:).

``archive`` writes a record for each page: of equal payloads of LEAST_SHARED bytes or more the one with the smallest id is
a response, the others are revisits that refer to it and carry no payload. Digests are counted before anything is joined,
and only those found twice or more are joined to the pages, in a join that can be split by rows.

Edge cases: a null payload is empty; a null url is an empty target; a null id goes into the record as such, comes back
as null and is never smaller than another id; rows of the same id and payload are all responses if theirs is the
smallest id; an empty table makes an archive without files; further columns are not read.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from threadmill.llm.common import shared_folder, small_batches, table

NAME = "op8_warc"
LEAST_SHARED = 100
ROLL_BYTES = 1 << 28
READ = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, full_length long, headers string, payload binary, file string, offset long"
WRITE = ("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "full_length", "payload")
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def file_system(path):
    """(pyarrow file system, path in it) of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


def header_bytes(record) -> bytes:
    """The record's header block: a version line, named fields, an empty line."""
    payload = record.get("payload") or b""
    fields = [
        ("WARC-Type", record["record_type"]), ("WARC-Record-ID", f"<{record['record_id']}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", record.get("target_uri")), ("WARC-Payload-Digest", f"sha256:{record['payload_digest']}"),
        ("X-Full-Payload-Length", str(record["full_length"])),
        ("WARC-Refers-To", f"<{record['refers_to']}>" if record.get("refers_to") else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if record["record_type"] == "revisit" else None),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload))),
    ]
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def member(record) -> bytes:
    """The record as a gzip member whose extra field sl has its compressed and uncompressed length."""
    raw = header_bytes(record) + (record.get("payload") or b"") + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    extra = b"sl" + struct.pack("<HII", 8, 24 + len(body) + 8, len(raw))
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class Wanted:
    """Header predicates that a record must pass."""

    def __init__(self, allowed=None):
        self.allowed = allowed or {}

    def __call__(self, headers):
        return all(field(headers, k) in v for k, v in self.allowed.items())


def field(headers, column):
    value = headers.get(HEADERS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value.removeprefix("sha256:") if column == "payload_digest" else value


CHUNK = 1 << 16


def records(f, size, wanted=Wanted(), payload=True):
    """(offset, headers, payload or None) of the records of an open file that pass; payloads of others aren't decoded."""
    at = 0
    while at < size:
        f.seek(at)
        chunk = f.read(min(CHUNK, size - at))
        if chunk[:2] == b"\x1f\x8b":
            length = None
            if len(chunk) >= 24 and chunk[3] & 4 and chunk[12:14] == b"sl":
                length = struct.unpack("<I", chunk[16:20])[0]
            z, raw, data, end = zlib.decompressobj(31), b"", chunk, b"\r\n\r\n"
            while end not in raw and not z.eof:
                raw += z.decompress(data, 4096)
                data = z.unconsumed_tail
                if not data and end not in raw and not z.eof and not (data := f.read(CHUNK)):
                    break
            head, found, rest = raw.partition(end)
            if not found:
                raise ValueError(f"cut record at {at}")
            headers = parse_headers(head)
            need, take = int(headers.get("content-length", 0)), payload and wanted(headers)
            if take or length is None:
                body = [rest]
                while not z.eof:
                    part = z.decompress(data)  # what the limited calls held back comes even without more input
                    if take:
                        body.append(part)
                    if not z.eof and not (data := f.read(CHUNK)):
                        raise ValueError(f"cut record at {at}")
                length = length or f.tell() - len(z.unused_data) - at
                out = b"".join(body)[:need] if take else None
            else:
                out = None
            if wanted(headers):
                yield at, headers, out
            at += length
        else:
            while b"\r\n\r\n" not in chunk:
                more = f.read(CHUNK)
                if not more:
                    if not chunk.strip():
                        return
                    raise ValueError(f"cut record at {at}")
                chunk += more
            skipped = len(chunk) - len(chunk.lstrip(b"\r\n"))
            head = chunk.lstrip(b"\r\n").partition(b"\r\n\r\n")[0]
            headers = parse_headers(head)
            need, start = int(headers.get("content-length", 0)), at + skipped + len(head) + 4
            if wanted(headers):
                out = None
                if payload:
                    f.seek(start)
                    out = f.read(need)
                yield at, headers, out
            at = start + need + 4


class FilePartition(InputPartition):
    def __init__(self, path, size):
        super().__init__(path)
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS:
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.allowed[name] = self.allowed.get(name, values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = file_system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")) and "/_" not in x.path[len(root):])
        return [FilePartition(p, n) for p, n in files] or [FilePartition(None, 0)]

    def read(self, partition):
        if partition.path is None:
            return
        system, _ = file_system(self.path)
        with system.open_input_file(partition.path) as f:
            for at, h, payload in records(f, partition.size, Wanted(self.allowed), self.payload):
                full = h.get("x-full-payload-length")
                yield (*(field(h, c) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")),
                       int(full) if full is not None else int(h.get("content-length", 0)), json.dumps(h), payload, partition.path, at)


class Written(WriterCommitMessage):
    def __init__(self, files):
        self.files = files


class WarcWriter(DataSourceWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite, self.roll = options["path"], overwrite, int(options.get("roll_bytes", ROLL_BYTES))
        self.parts = f"_parts-{uuid.uuid4().hex}"  # a folder for each write, so that writers to one path don't meet

    def write(self, rows):
        system, root = file_system(self.path)
        files, out, n = [], None, 0
        system.create_dir(f"{root}/{self.parts}", recursive=True)
        try:
            for row in rows:
                record = {c: row[c] for c in WRITE}
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, n = system.open_output_stream(f"{root}/{self.parts}/{files[-1]}", compression=None), 0
                raw = member(record | {"payload": bytes(record["payload"] or b"")})
                out.write(raw)
                n += len(raw)
                if n >= self.roll:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for x in WarcReader({"path": self.path}).partitions():
                if x.path:
                    system.delete_file(x.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda name: system.move(f"{root}/{self.parts}/{name}", f"{root}/{name}"), [x for m in messages if m for x in m.files]))
        self._drop_parts(system, root)

    def abort(self, messages):
        self._drop_parts(*file_system(self.path))

    def _drop_parts(self, system, root):
        with contextlib.suppress(FileNotFoundError):
            system.delete_dir(f"{root}/{self.parts}")


class WarcSource(DataSource):
    """Options: path; payload (read: false leaves payloads null); roll_bytes (write)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages, path, id_col="page_id", url_col="url", html_col="html"):
    """Writes pages' records to path."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    pages = pages.withColumns({"payload_digest": F.sha2("payload", 256), "full_length": F.octet_length("payload").cast("long")})
    twice = (pages.where(F.col("full_length") >= LEAST_SHARED).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("payload_digest", "first"))
    rows = pages.join(twice, "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    rows = rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), urn(F.col("id")).alias("record_id"), F.coalesce("target_uri", F.lit("")).alias("target_uri"),
        F.when(again, urn(F.col("first"))).alias("refers_to"), "payload_digest", "full_length", F.when(~again, F.col("payload")).alias("payload"))
    rows.write.format("warc").mode("append").option("path", path).save()


def query(spark, sf_dir):
    return of(spark, table(spark, sf_dir, "pages"))


def of(spark, pages):
    small_batches(spark)
    path = f"{shared_folder(spark, 'warc')}/archive"
    archive(pages, path)
    back = spark.read.format("warc").load(path)
    number = lambda c: F.nullif(F.substring_index(F.col(c), ":", -1), F.lit("")).cast("long")
    response = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("full_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST_SHARED} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= {LEAST_SHARED}
"""
