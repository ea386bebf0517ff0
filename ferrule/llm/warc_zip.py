"""WARC records in ZIP-packaged archives: written as stored members, read by range without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import looked_up, shared_dir, staged, staged_and_seen

#: Where this package's writer puts records and index; the reader finds members by the patterns below.
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdx"
_INDEXES = re.compile(r"^indexes/[^/]+\.cdxj?(?:\.gz)?$")
#: Bytes of records that one task reads, and rows of one payload from which it counts as a hot one.
TASK_BYTES, HOT = 64 << 20, 1000
MANIFEST = "path string, records long, bytes long"
RECORD = "uid long, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_bytes(uid: int, page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One gzip member holding one WARC/1.1 record. A revisit has the HTTP head of its page, with the full length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}:{uid}>"), ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", json.dumps(url)[1:-1] if url is not None else None), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", None if kind == "response" else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip.compress(lines.encode() + block + b"\r\n\r\n", 6, mtime=0)


_PAGE, _REFERS = re.compile(r"<urn:page:(-?\d*):(-?\d+)>"), re.compile(r"<urn:page:(-?\d+)>")


def parse_record(data: bytes) -> dict:
    """A gzip member back to the columns of RECORD; the payload of a revisit is null.

    Records of other writers have no page_id, uid and refers_to; where they carry no digest or HTTP head, digest and size are those of what they hold.
    """
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    field = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    page, refers, url = _PAGE.fullmatch(field.get("warc-record-id", "")), _REFERS.fullmatch(field.get("warc-refers-to", "")), field.get("warc-target-uri")
    if url is not None and page:
        url = json.loads(f'"{url}"')
    kind, found = field.get("warc-type", "resource"), field.get("warc-payload-digest", "")
    return {
        "uid": int(page[2]) if page else None, "page_id": int(page[1]) if page and page[1] else None, "url": url, "record_type": kind,
        "refers_to": int(refers[1]) if refers else None, "payload_digest": found[5:] if found.startswith("sha1:") else digest(payload),
        "payload_bytes": size, "payload": payload if kind != "revisit" else None,
    }


def surt(url: str | None) -> str:
    """Sort key of an index line: the host's labels reversed, then path and query, without white space."""
    try:
        parts = urlsplit(url or "")
    except ValueError:
        parts = urlsplit("")
    key = ",".join(reversed(parts.netloc.lower().split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", key)


class _Counted(io.RawIOBase):
    """A sink that cannot seek, so that the archive streams to any store."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self):
        return True

    def write(self, data):
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write (uid, page_id, url, payload, record_type, refers_to) rows into ZIP archives; returns the staged manifest (path, records, bytes).

    A task streams its rows into archives of about archive_bytes, each with a stored WARC member and a stored index of its records. Every
    attempt writes files of its own, and only those that the manifest names count: a lost or repeated task leaves orphans and no
    wrong record. The store is reached through pyarrow's file systems.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        fs.create_dir(root, recursive=True)
        rows = ((b, i) for b in batches for i in range(b.num_rows))
        pending = next(rows, None)
        while pending is not None:
            name = f"{uuid.uuid4().hex}.wacz"
            index: list[str] = []
            count = at = 0
            with fs.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                with z.open(WARC_MEMBER, "w", force_zip64=True) as member:
                    while pending is not None and at < archive_bytes:
                        b, i = pending
                        get = lambda c: b.column(c)[i].as_py()  # noqa: B023, E731
                        data = record_bytes(get("uid"), get("page_id"), get("url"), get("payload"), get("record_type"), get("refers_to"))
                        member.write(data)
                        about = {"url": get("url"), "offset": str(at), "length": str(len(data)), "filename": WARC_MEMBER.split("/")[-1]}
                        index.append(f"{surt(get('url'))} 20240101000000 {json.dumps(about)}\n")
                        at += len(data)
                        count += 1
                        pending = next(rows, None)
                with z.open(INDEX_MEMBER, "w", force_zip64=True) as member:
                    for line in sorted(index):
                        member.write(line.encode())
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count], "bytes": [at]})

    return staged(records.select("uid", "page_id", "url", "payload", "record_type", "refers_to").mapInArrow(run, MANIFEST), "warc-manifest")


def central_directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Member name to (offset of its data, size, method), from the end records, ZIP64 where they say so. f reads at any offset."""
    tail_at = max(0, size - (1 << 16) - 22 - 20 - 56)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == entries or 0xFFFFFFFF in (length, offset):
        locator = tail[end - 20 : end]
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack("<Q", locator[8:16])
        end64 = f.read_at(56, at)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, length, offset = struct.unpack("<QQQ", end64[32:56])
    data, at, found = f.read_at(length, offset), 0, {}
    for _ in range(entries):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method = struct.unpack("<H", data[at + 10 : at + 12])[0]
        packed, whole, n_name, n_extra, n_note = struct.unpack("<IIHHH", data[at + 20 : at + 34])
        (header,) = struct.unpack("<I", data[at + 42 : at + 46])
        name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[e : e + 4])
            if tag == 1:  # ZIP64: 8 bytes for each field above that is full
                big, k = extra[e + 4 : e + 4 + n], 0
                if whole == 0xFFFFFFFF:
                    (whole,), k = struct.unpack("<Q", big[k : k + 8]), k + 8
                if packed == 0xFFFFFFFF:
                    (packed,), k = struct.unpack("<Q", big[k : k + 8]), k + 8
                if header == 0xFFFFFFFF:
                    (header,) = struct.unpack("<Q", big[k : k + 8])
            e += 4 + n
        local = f.read_at(30, header)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("bad local header")
        a, b = struct.unpack("<HH", local[26:30])
        found[name] = (header + 30 + a + b, packed, method)
        at += 46 + n_name + n_extra + n_note
    return found


def _index_lines(f, start: int, length: int, packed: bool) -> Iterator[bytes]:
    """Lines of a stored index member, read by range and, where packed, through gzip of one or many members."""
    unzip, done, rest = zlib.decompressobj(31), 0, b""
    while done < length:
        part = f.read_at(min(1 << 20, length - done), start + done)
        done += len(part)
        while packed and part:
            rest += unzip.decompress(part)
            part = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
        *lines, rest = (rest if packed else rest + part).split(b"\n")
        yield from lines
    yield rest


def list_records(archives: DataFrame) -> DataFrame:
    """Archives given by path to (path, start, length) of their records, as their index members (CDXJ) list them.

    A task reads an archive's end records, central directory and index members by range, nothing else. An archive may hold several members of
    records, archive/<filename>, and several indexes, indexes/*.cdx or *.cdxj, also with .gz. Members must be stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = _open_fs(path)
                with fs.open_input_file(at) as f:
                    members = central_directory(f, f.size())
                    indexes = [name for name in members if _INDEXES.match(name)]
                    if not indexes:
                        raise ValueError(f"{path}: no index member")
                    for name in indexes:
                        start, length, method = members[name]
                        if method:
                            raise ValueError(f"{path}: {name} is compressed by the archive, so it cannot be read by range")
                        out: dict[str, list] = {"path": [], "start": [], "length": []}
                        for line in _index_lines(f, start, length, name.endswith(".gz")):
                            if not line.strip() or line.startswith(b"!"):
                                continue
                            about = json.loads(line.split(b" ", 2)[2])
                            data, _, method = members[f"archive/{about['filename']}"]
                            if method:
                                raise ValueError(f"{path}: {about['filename']} is compressed by the archive, so it cannot be read by range")
                            for c, v in zip(out, (path, data + int(about["offset"]), int(about["length"]))):
                                out[c].append(v)
                            if len(out["path"]) >= 50_000:
                                yield pa.RecordBatch.from_pydict(out, schema=schema)
                                out = {c: [] for c in out}
                        yield pa.RecordBatch.from_pydict(out, schema=schema)

    return archives.select("path").mapInArrow(run, "path string, start long, length long")


def read_records(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """(path, start, length) rows to RECORD rows, each record read by its range. payloads=False leaves payload null."""

    kinds = {"uid": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, out, held = None, None, [], 0
        for batch in batches:
            for p, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
                if p != path:
                    if f is not None:
                        f.close()
                    fs, at = _open_fs(p)
                    path, f = p, fs.open_input_file(at)
                record = parse_record(f.read_at(length, start))
                if record["payload"] is not None:
                    found = digest(record["payload"])
                    if found != record["payload_digest"] or len(record["payload"]) != record["payload_bytes"]:
                        raise ValueError(f"{p} at {start}: the payload does not match its digest")
                if not payloads:
                    record["payload"] = None
                out.append(record)
                held += record["payload_bytes"] if payloads else 300
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
        if f is not None:
            f.close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return ranges.mapInArrow(run, RECORD)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """pages to (uid, page_id, url, payload, record_type, refers_to).

    Payload is html in UTF-8, null as empty. Of rows with equal payloads of at least `least` bytes the one with the largest page_id is the
    response and others revisit it; smaller payloads are all responses. Where that page_id is repeated, one of its rows is
    the response and its repeats revisit it too. A null page_id is smaller than any; where all are null one row
    is the response and the others revisit it with refers_to null. Other columns are ignored.

    Only (digest, page_id, row hash) is grouped, with partial maxima before the shuffle.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string").cast("binary"), F.lit("").cast("binary"))
    base = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"), F.sha1(payload).alias("d"))
    same = F.xxhash64("page_id", "url", "d")
    counted = staged(base.groupBy("d", "page_id", "url", same.alias("uid")).agg(F.count("*").alias("n")), "warc-pages")
    top = (
        counted.groupBy(F.col("d").alias("td"))
        .agg(F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("u"), "uid")).alias("top"), F.sum("n").alias("rows"))
        .where("rows > 1")
    )
    repeats = counted.where("n > 1").select(F.col("uid").alias("ru"), "n")
    rows = base.withColumn("uid", same)
    if repeats.isEmpty():
        rows = rows.withColumn("nth", F.lit(1))
    else:  # equal rows are told apart by making them again, numbered, from one of them
        again = rows.join(repeats, F.col("uid") == F.col("ru")).groupBy("d", "page_id", "url", "uid", "n").agg(F.any_value("payload").alias("payload"))
        again = again.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        rows = rows.join(repeats, F.col("uid") == F.col("ru"), "left_anti").withColumn("nth", F.lit(1)).unionByName(again.drop("n"))
    top, seen = staged_and_seen(top, "warc-top", n=F.count("*"), hot=F.count_if(F.col("rows") >= HOT))
    spread = F.concat(F.lit("~"), F.col("uid").cast("string"), F.lit("."), F.col("nth").cast("string"))  # digests are hexadecimal
    joined = looked_up(rows, top, F.col("d"), "td", spread, F.col("rows") >= HOT, seen)
    first = F.col("rows").isNull() | (F.octet_length("payload") < least) | ((F.col("uid") == F.col("top.uid")) & (F.col("nth") == 1))
    return joined.select("uid", "page_id", "url", "payload", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("top.page_id")).alias("refers_to"))


def write_pages(pages: DataFrame, folder: str, archive_bytes: int = 256 << 20, **columns) -> DataFrame:
    return write_archives(with_revisits(pages, **columns), folder, archive_bytes)


def read_archives(archives: DataFrame, payloads: bool = True, task_bytes: int = TASK_BYTES) -> DataFrame:
    """RECORD rows of archives given by path.

    Ranges, a few bytes each, are staged and dealt anew by place, so that a task reads about task_bytes of neighbouring records, however few or large
    the archives are; small inputs are still dealt over all cores.
    """
    ranges, seen = staged_and_seen(list_records(archives), "warc-ranges", bytes=F.sum("length"), n=F.count("*"))
    wanted = -(-(seen["bytes"] or 0) // task_bytes)
    tasks = max(1, wanted, min(archives.sparkSession.sparkContext.defaultParallelism, -(-seen["n"] // 100)))
    return read_records(ranges.repartitionByRange(tasks, "path", "start").sortWithinPartitions("path", "start"), payloads)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = write_pages(pages, f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}")
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
