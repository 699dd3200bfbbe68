"""WARC archives as a PySpark data source, written and read.

Reading: files are planned into partitions by size; predicates on the columns of ``PUSHED`` are taken over from Spark and tested, as soon
as a record's headers are parsed; only of records that pass, and only if ``payload`` is wanted, the block is read and decoded.
``.warc`` files skip by Content-Length. ``.warc.gz`` files hold gzip members of one record or of many; members written here carry their length
in an ``sl`` extra field, so that an unwanted one is skipped unread; others are inflated to find their end.

Writing: each task writes files of its own under new names; the driver lists those of successful tasks in a manifest of the commit,
and only files of some manifest are read, so lost executors, retries and speculative tasks leave no record twice. Appended commits
add up; an overwriting one takes the place of those before it.

A record without an end, with a Content-Length that is no number, or in a broken or truncated gzip member fails the job with file and
byte. With option ``bad=report`` it ends its file instead, and shows as a row whose headers hold ``x-error`` alone; with pushed
predicates no such row passes.

Defined results: null html is an empty payload; null or unprintable urls are left out or percent-encoded; a null page_id is an empty
header, null again when read; of repeated rows with large payloads all but one revisit it; an empty table gives an archive without records.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition,
                                    WriterCommitMessage)

from .common import shared_path, table

SCHEMA = ("record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
          "content_type string, headers map<string,string>, payload binary")
#: Columns that are headers; predicates on them are tested before a block is read.
PUSHED = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
          "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
MANIFEST, FILE_BYTES, LEAST_REVISIT = "_committed", 64 << 20, 1000
_END = b"\r\n\r\n"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def member(data: bytes) -> bytes:
    """One gzip member whose ``sl`` field holds its own and the plain length."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 14 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + _END


def parse_headers(data: bytes) -> dict[str, str]:
    """Headers by lower-case name; a line that starts with white space continues the one before."""
    found: dict[str, str] = {}
    name = ""
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class BadRecord(ValueError):
    """A record that cannot be read, with its file and the byte at which it, or its gzip member, begins."""


class _Plain:
    """The bytes of an uncompressed file from one record to the next."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start = file, size, 0

    def head(self) -> bytes | None:
        """The headers of the next record; None at the end of the file."""
        data = b""
        self.file.seek(self.start)
        while _END not in data:
            more = self.file.read(4096)
            if not more:
                if data.strip():
                    raise BadRecord("headers without an end")
                return None
            data += more
        cut = data.index(_END)
        self.body = self.start + cut + 4
        return data[:cut]

    def block(self, length: int, wanted: bool) -> bytes | None:
        if self.body + length > self.size:
            raise BadRecord("block cut off")
        data = None
        if wanted:
            self.file.seek(self.body)
            data = self.file.read(length)
        self.start = self.body + length + 4
        return data


class _Gzip:
    """The same for a file of gzip members, which hold one record each or many."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.z = file, size, 0, None
        self.data, self.left, self.start, self.length, self.first = b"", b"", 0, 0, True

    def _open(self) -> bool:
        """Begin the next member; False at the end of the file."""
        if self.at >= self.size:
            return False
        self.start, self.z, self.left, self.length, self.first = self.at, zlib.decompressobj(31), b"", None, True
        return True

    def _more(self, room: int, chunk: int) -> bool:
        """Inflate up to ``room`` more bytes of the member; False at its end."""
        if self.z is None or self.z.eof:
            return False
        if not self.left:
            self.file.seek(self.at)
            self.left = self.file.read(chunk)
            if not self.left:
                raise BadRecord("gzip member cut off")
            if self.length is None:
                self.length = 0
                if len(self.left) > 24 and self.left[3] & 4 and self.left[12:16] == b"sl\x08\0":
                    self.length = struct.unpack("<I", self.left[16:20])[0]
            self.at += len(self.left)
        try:
            self.data += self.z.decompress(self.left, room)
        except zlib.error as exc:
            raise BadRecord(f"gzip member broken ({exc})") from None
        self.left = self.z.unconsumed_tail
        if self.z.eof:
            self.at -= len(self.z.unused_data)
        return True

    def head(self) -> bytes | None:
        while True:
            if self.data[:4].strip() or not self.data:
                if _END in self.data:
                    break
            else:
                # What ends one record is no part of the next.
                self.data = self.data.lstrip(b"\r\n")
                continue
            if not self._more(1024, 1024):
                if self.data.strip():
                    raise BadRecord("headers without an end")
                self.data = b""
                if not self._open():
                    return None
        cut = self.data.index(_END)
        head, self.data = self.data[:cut], self.data[cut + 4:]
        return head

    def block(self, length: int, wanted: bool) -> bytes | None:
        if not wanted and self.first and self.length:
            # Written here: the member holds this record alone and says how long it is.
            if self.start + self.length > self.size:
                raise BadRecord("gzip member cut off")
            self.at, self.z, self.data = self.start + self.length, None, b""
            return None
        parts, missing = [], length
        while True:
            part, self.data = self.data[:missing], self.data[missing:]
            missing -= len(part)
            if wanted:
                parts.append(part)
            if not missing:
                break
            if not self._more(1 << 20, 1 << 16):
                raise BadRecord("block cut off")
        self.first = False
        return b"".join(parts) if wanted else None


def read_records(file, size: int, wanted, payload: bool, name: str = "") -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the records of one file whose headers are ``wanted``; HTTP headers are no payload.

    Raises :class:`BadRecord` with ``name`` and the place for what is no record.
    """
    file.seek(0)
    at = (_Gzip if file.read(2) == b"\x1f\x8b" else _Plain)(file, size)
    try:
        while (head := at.head()) is not None:
            headers = parse_headers(head)
            try:
                length = int(headers.get("content-length", ""))
            except ValueError:
                length = -1
            if length < 0:
                raise BadRecord(f"Content-Length {headers.get('content-length')!r}")
            take = wanted(headers)
            block = at.block(length, take and payload)
            if take:
                if block is not None and headers.get("content-type", "").startswith("application/http") and _END in block:
                    block = block[block.index(_END) + 4:]
                yield headers, block
    except BadRecord as exc:
        raise BadRecord(f"{name}, byte {at.start}: {exc}") from None


@dataclass
class Files(InputPartition):
    files: list

    def __init__(self, files):
        super().__init__(0)
        self.files = files


@dataclass
class Written(WriterCommitMessage):
    names: list


def manifests_in(paths) -> list[str]:
    return sorted(p for p in paths if p.rpartition("/")[2].startswith(MANIFEST) and p.endswith(".json"))


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.target = int(options.get("partitionbytes", 32 << 20))
        self.bad = options.get("bad", "fail")
        if self.bad not in ("fail", "report"):
            raise ValueError("option bad is fail or report")
        #: Equality tests on any header, from options named ``header:Name``.
        self.tests = [(k[7:].lower(), {v}) for k, v in options.items() if k.lower().startswith("header:")]

    def pushFilters(self, filters):
        for f in filters:
            name = PUSHED.get(f.attribute[0]) if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name is None:
                yield f
            else:
                self.tests.append((name, {f.value} if isinstance(f, EqualTo) else set(f.value)))

    def partitions(self):
        system, path = filesystem(self.path)
        found = {i.path: i.size for i in system.get_file_info(fs.FileSelector(path, allow_not_found=False))
                 if i.type == fs.FileType.File}
        manifests = manifests_in(found)
        if manifests:
            names = []
            for m in manifests:
                with system.open_input_stream(m) as f:
                    names += [f"{path.rstrip('/')}/{n}" for n in json.loads(f.read())]
        else:
            names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
        parts, room = [], 0
        for n in sorted(names, key=lambda n: (-found[n], n)):
            if not parts or room < found[n]:
                parts.append([])
                room = self.target
            parts[-1].append((n, found[n]))
            room -= found[n]
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition):
        system, _ = filesystem(self.path)
        wanted = lambda h: all(h.get(n) in values for n, values in self.tests)
        for name, size in partition.files:
            with system.open_input_file(name) as file:
                try:
                    for h, block in read_records(file, size, wanted, self.payload, name):
                        yield (*[h.get(n) for n in PUSHED.values()], h, block)
                except BadRecord as exc:
                    if self.bad == "fail":
                        raise
                    if not self.tests:
                        yield (*[None] * len(PUSHED), {"x-error": str(exc)}, None)


class WarcWriter(DataSourceWriter):
    """Rows of (headers map, block binary); a header with a null value is left out."""

    def __init__(self, options, names, overwrite):
        self.path, self.names, self.overwrite = options["path"], names, overwrite

    def write(self, iterator):
        system, path = filesystem(self.path)
        system.create_dir(path, recursive=True)
        at, block = self.names.index("headers"), self.names.index("block")
        names, out, size = [], None, 0
        for row in iterator:
            if out is None:
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = system.open_output_stream(f"{path.rstrip('/')}/{names[-1]}", compression=None), 0
            data = member(record(row[at], bytes(row[block] or b"")))
            out.write(data)
            size += len(data)
            if size >= FILE_BYTES:
                out.close()
                out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        system, path = filesystem(self.path)
        system.create_dir(path, recursive=True)
        earlier = manifests_in(i.path for i in system.get_file_info(fs.FileSelector(path)))
        with system.open_output_stream(f"{path.rstrip('/')}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        for m in earlier if self.overwrite else ():
            system.delete_file(m)

    def abort(self, messages):
        """Without a manifest entry no file is read; what tasks have written stays unlisted."""


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def page_records(pages: DataFrame) -> DataFrame:
    """(headers, block) for each page (page_id, url, html). Of equal payloads of ``LEAST_REVISIT`` bytes or more the one with
    the largest page_id is a response, the others revisit it."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("n", F.octet_length("payload")).withColumn("digest", F.sha1("payload"))
    base = base.withColumn("row", F.monotonically_increasing_id())
    who = F.struct(F.col("page_id").isNotNull().alias("some"), F.col("page_id"), F.col("row"))
    # One row per payload that occurs twice or more; partial aggregation keeps a very common one apart.
    shared = (base.filter(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max(who).alias("first"), F.count(F.lit(1)).alias("times"))
              .filter("times > 1").select("digest", "first"))
    found = base.join(shared, "digest", "left").withColumn("revisit", F.coalesce(F.col("first") != who, F.lit(False)))
    only = lambda c: F.when(F.col("revisit"), c)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    url = F.col("url")
    for code in [*range(0, 33), 127]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    headers = {
        "WARC-Type": F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        "WARC-Record-ID": F.concat(F.lit("<urn:x-page:"), text(F.col("page_id")), F.lit(":"), F.col("row").cast("string"), F.lit(">")),
        "WARC-Date": F.lit("1970-01-01T00:00:00Z"),
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
        "WARC-Profile": only(F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        "WARC-Refers-To": only(F.concat(F.lit("<urn:x-page:"), text(F.col("first.page_id")), F.lit(":"), F.col("first.row").cast("string"), F.lit(">"))),
        "Content-Type": F.lit("application/http; msgtype=response"),
        "X-Page-ID": text(F.col("page_id")),
        "X-Refers-To-Page-ID": only(text(F.col("first.page_id"))),
        "X-Payload-Length": F.col("n").cast("string"),
    }
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(~F.col("revisit"), F.concat(http.cast("binary"), F.col("payload")))
    return found.select(F.create_map(*[x for k, v in headers.items() for x in (F.lit(k), v)]).alias("headers"), block.alias("block"))


def write_pages(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def op6_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive in the shared folder and read back: responses with payload, revisits by headers only."""
    path = shared_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    number = lambda name: F.expr(f"CAST(nullif(headers['{name}'], '') AS BIGINT)")
    out = lambda df, n, digest: df.select(
        number("x-page-id").alias("page_id"), n.cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        "record_type", number("x-refers-to-page-id").alias("refers_to"))
    full = read(spark, path).filter("record_type = 'response'")
    bare = read(spark, path, payload="false").filter("record_type = 'revisit'")
    return out(full, F.octet_length("payload"), F.sha1("payload")).unionByName(
        out(bare, number("x-payload-length"), F.substring_index("payload_digest", ":", -1)))
