"""WARC files as a PySpark data source, and archiving of pages with revisit records.

Reading plans one partition per group of files (writers close a file at file_bytes, so
partitions stay even), takes equality, IN, null and prefix predicates on the record type
and the other header columns, parses a record's headers first, and decodes a payload only
when the record passes and option `payload` is true. Gzip members carry the format's `sl`
extra field (compressed and plain length), with which a reader skips the rest of a member
unread; members without it are inflated to their end; plain files are read too.

Options: path (a folder or one file), payload (true), verify (false: compare a decoded
payload with its digest and fail on a difference), file_bytes, level (gzip level).
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

from .common import local_path, saved, session, shared_dir

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, refers_to string, content_length long, payload_bytes long, headers map<string,string>, payload binary"
#: The header behind each string column.
HEADER = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES, LEVEL, DATE = 64 << 20, 4, "2000-01-01T00:00:00Z"
HOT_DIGESTS = 256
_MAX = (1 << 63) - 1


def file_system(path: str):
    """A pyarrow file system and the path inside it."""
    from pyarrow import fs

    local = local_path(path)
    return (fs.LocalFileSystem(), local) if local is not None else fs.FileSystem.from_uri(path)


def _listed(system, inner: str) -> list[tuple[str, int]] | None:
    """Names and sizes of the files that finished writes left in a folder, None without a manifest."""
    from pyarrow import fs

    manifest = f"{inner}/_manifest.json"
    if system.get_file_info(manifest).type != fs.FileType.File:
        return None
    with system.open_input_stream(manifest) as f:
        return [(n, s) for n, s in json.loads(f.read())]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_bytes(first: str, headers: dict[str, str]) -> bytes:
    clean = (f"{k}: {' '.join(str(v).split())}" for k, v in headers.items())
    return "\r\n".join([first, *clean, "", ""]).encode()


def record_bytes(kind: str, record_id: str, uri: str, payload: bytes, size: int, sha1: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One whole record. A revisit has the HTTP headers of its full payload, and no payload."""
    http = _header_bytes("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(size)})
    block = http + (payload if kind == "response" else b"")
    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{sha1}"}
    if kind == "revisit":
        headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{refers_to}>"}
    headers |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return _header_bytes("WARC/1.1", headers) + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with the `sl` extra field."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class _Files(InputPartition):
    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]):
        self.paths = paths


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return WarcWriter(dict(self.options), overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.target = int(options.get("file_bytes", FILE_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            kind = {EqualTo: "in", EqualNullSafe: "in", In: "in", IsNull: "null", IsNotNull: "filled", StringStartsWith: "starts"}.get(type(f))
            if column not in HEADER or kind is None:
                yield f
                continue
            value = getattr(f, "value", None)
            if isinstance(f, EqualNullSafe) and value is None:
                kind = "null"
            self.tests.append((column, kind, list(value) if isinstance(f, In) else [value] if kind == "in" else value))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, inner = file_system(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [_Files([self.path])]
        found = _listed(system, inner)
        if found is None:
            found = sorted((i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(inner)) if i.base_name.endswith((".warc", ".warc.gz")))
        out: list[InputPartition] = []
        held, size = [], 0
        for name, n in found:
            if held and size + n > self.target:
                out.append(_Files(held))
                held, size = [], 0
            held.append(f"{self.path.rstrip('/')}/{name}")
            size += n
        return [*out, _Files(held)] if held else out or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            for row in self.records(path):
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        yield _batch(rows)

    def passes(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            have = row[column]
            if kind == "null":
                ok = have is None
            elif kind == "filled":
                ok = have is not None
            elif kind == "in":
                ok = have is not None and have in value
            else:
                ok = have is not None and have.startswith(value)
            if not ok:
                return False
        return True

    def records(self, path: str) -> Iterator[dict]:
        local = local_path(path)
        if local is not None:
            f = open(local, "rb", buffering=1 << 20)
        else:
            system, inner = file_system(path)
            f = system.open_input_file(inner)
        with f:
            at = 0
            while True:
                f.seek(at)
                source = _Member(f)
                head = source.until(b"\r\n\r\n")
                if not head.strip():
                    return
                lines = head.decode("utf-8", "replace").strip().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record at byte {at} of {path}")
                headers: dict[str, str] = {}
                for name, _, value in (x.partition(":") for x in lines[1:]):
                    # a header that comes again is one list, as in HTTP
                    name, value = name.strip(), value.strip()
                    headers[name] = f"{headers[name]}, {value}" if name in headers else value
                known = {k.lower(): v for k, v in headers.items()}
                length = int(known.get("content-length", 0))
                row = {c: known.get(h.lower()) for c, h in HEADER.items()} | {"content_length": length, "payload_bytes": length, "headers": list(headers.items()), "payload": None}
                for c in ("record_id", "refers_to"):
                    if row[c]:
                        row[c] = row[c].strip("<>")
                if row["payload_digest"]:
                    row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
                if self.passes(row):
                    left = length
                    if (row["content_type"] or "").startswith("application/http"):
                        http = source.until(b"\r\n\r\n", length)
                        if len(http) > length or not http.endswith(b"\r\n\r\n"):
                            # no end of headers in this record: all of it is payload
                            source.buffer, http = http + source.buffer, b""
                        left -= len(http)
                        row["payload_bytes"] = left
                        if row["record_type"] == "revisit":
                            sizes = [x.partition(":")[2] for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")]
                            row["payload_bytes"] = int(sizes[0]) if sizes else None
                    if self.payload and row["record_type"] != "revisit":
                        row["payload"] = source.take(left)
                        if self.verify and row["payload_digest"] and digest(row["payload"]) != row["payload_digest"]:
                            raise ValueError(f"digest of {row['record_id']} does not match")
                    elif source.size is None:
                        source.take(left)
                    yield row
                elif source.size is None:
                    source.skip(length)
                at = at + source.size if source.size is not None else source.end(f)


class _Member:
    """A record's bytes, from one gzip member or a plain file."""

    def __init__(self, f):
        self.f, self.start, self.size, self.buffer = f, f.tell(), None, b""
        head = f.read(12)
        self.inflate = None
        if head[:2] == b"\x1f\x8b":
            self.inflate = zlib.decompressobj(31)
            if len(head) == 12 and head[3] & 4:
                extra = f.read(struct.unpack("<H", head[10:12])[0])
                i = 0
                while i + 4 <= len(extra):
                    n = struct.unpack("<H", extra[i + 2 : i + 4])[0]
                    if extra[i : i + 2] == b"sl" and n == 8:
                        self.size = struct.unpack("<I", extra[i + 4 : i + 8])[0]
                    i += 4 + n
                head += extra
            self.pending = head
        else:
            self.buffer = head

    def more(self, n: int) -> bool:
        if self.inflate is None:
            data = self.f.read(n)
            self.buffer += data
            return bool(data)
        data = self.pending or self.inflate.unconsumed_tail or (b"" if self.inflate.eof else self.f.read(4096))
        self.pending = b""
        if not data or self.inflate.eof:
            return False
        self.buffer += self.inflate.decompress(data, max(n, 4096))
        return True

    def until(self, mark: bytes, most: int | None = None) -> bytes:
        while (i := self.buffer.find(mark)) < 0 and (most is None or len(self.buffer) < most):
            if not self.more(1024):
                i = len(self.buffer)
                break
        out = self.buffer[: len(self.buffer) if i < 0 else i + len(mark)]
        self.buffer = self.buffer[len(out) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < n:
            if not self.more(n - have):
                break
            parts.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        if self.inflate is None and n > len(self.buffer):
            self.f.seek(n - len(self.buffer), os.SEEK_CUR)
            self.buffer = b""
        else:
            self.take(n)

    def end(self, f) -> int:
        """Where the next record starts: after this member, or after a plain record's blank lines."""
        if self.inflate is None:
            at = f.tell() - len(self.buffer)
            f.seek(at)
            blank = f.read(4)
            return at + (len(blank) - len(blank.lstrip(b"\r\n")))
        while self.more(1 << 16):
            self.buffer = b""
        return f.tell() - len(self.inflate.unused_data)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {c: pa.string() for c in HEADER} | {"content_length": pa.int64(), "payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_id, record_type, target_uri, payload, payload_digest, payload_bytes and
    refers_to become files of gzip members; the driver lists those of finished tasks in a manifest."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.target, self.level = int(options.get("file_bytes", FILE_BYTES)), int(options.get("level", LEVEL))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, inner = file_system(self.path)
        system.create_dir(inner, recursive=True)
        files, out, size, name = [], None, 0, ""
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size = system.open_output_stream(f"{inner}/{name}", compression=None), 0
                payload = r["payload"] or b""
                uri = r["target_uri"] if (r["target_uri"] or "").strip() else r["record_id"]
                size += out.write(gzip_member(record_bytes(r["record_type"], r["record_id"], uri, payload, r["payload_bytes"], r["payload_digest"], r["refers_to"]), self.level)) or 0
                if out.tell() >= self.target:
                    files.append((name, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            files.append((name, out.tell()))
            out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        system, inner = file_system(self.path)
        system.create_dir(inner, recursive=True)
        files = [tuple(x) for m in messages if m for x in m.files]
        files += [] if self.overwrite else _listed(system, inner) or []
        with system.open_output_stream(f"{inner}/_manifest.json", compression=None) as f:
            f.write(json.dumps(sorted(set(files))).encode())

    def abort(self, messages) -> None:
        system, inner = file_system(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                system.delete_file(f"{inner}/{name}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32(hexadecimal: Column) -> Column:
    """Bare base32 of a SHA-1 in hexadecimal: 40 digits are eight groups of 20 bits, four characters each."""
    groups = []
    for i in range(8):
        value = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        groups += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*groups)


def archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of pages (page_id, url, html) under path.

    Of equal payloads of min_bytes or more the smallest page_id is a response (all its rows,
    if it is repeated), others are revisits of it; shorter ones are all responses. Null html
    is an empty payload; null ids sort last. Only (id, digest) rows are grouped; a payload
    moves once, by id, so that copies of one payload do not meet in one task. The digests that
    over 1 / HOT_DIGESTS of all rows share, fewer than that many, are broadcast.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    key = F.coalesce(F.col("page_id").cast("long"), F.lit(_MAX))
    rows = pages.select(key.alias("id"), "url", html.alias("payload")).withColumn("sha1", F.sha1("payload"))
    narrow = rows.select("id", "sha1", F.octet_length("payload").alias("n"))
    first = narrow.filter(F.col("n") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    first = saved(session(pages), first, "repeated")
    total = narrow.count()
    hot = F.broadcast(first.filter(F.col("rows") * HOT_DIGESTS > total).drop("rows"))
    cold = narrow.join(hot, "sha1", "left_anti").join(first.drop("rows"), "sha1")
    both = narrow.join(hot, "sha1").unionByName(cold).filter("id > first").select("id", "sha1", "first")
    later = saved(session(pages), both.groupBy("id", "sha1").agg(F.min("first").alias("first")), "revisits")
    out = rows.join(later, ["id", "sha1"], "left").select(
        F.concat(F.lit("urn:page:"), F.col("id")).alias("record_id"),
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
        base32(F.col("sha1")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.concat(F.lit("urn:page:"), F.col("first")).alias("refers_to"),
    )
    out.write.format("warc").mode("append").save(path)


def page_number(urn: Column) -> Column:
    return F.nullif(F.substring_index(urn, ":", -1).cast("long"), F.lit(_MAX))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages in the shared folder and read the archives back, payloads checked
    against digests: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = session(pages)
    register(spark)
    path = shared_dir(spark, "warc")
    archive(pages, path)
    back = spark.read.format("warc").option("verify", "true").load(path).filter(F.col("record_type").isin("response", "revisit"))
    return back.select(page_number(F.col("record_id")).alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", page_number(F.col("refers_to")).alias("refers_to"))
