"""Web archives packed in ZIP files: a writer, and a reader that range-reads single records in place.

Each write task packs its pages into archives of bounded size: a ZIP file with two stored members,
``archive/data.warc.gz`` (one gzip member per WARC record) and ``indexes/index.cdxj`` (sorted lines "key timestamp
{json}", a record each, the JSON with its file, offset and length).  The reader finds the end record, follows the ZIP64
locator where there is one, parses the central directory, takes every stored index member (.cdxj or .cdx, also
with .gz), and reads each record by its byte range; nothing is unpacked to disk.  Files go through the file system of the shared checkpoint folder's address.

Of records with equal payloads of at least ``min_revisit`` bytes the one with the largest page_id is the
response; the others are revisits without payload that carry its digest and length.

Defined results: a null html is an empty payload; a null url is an empty target; rows that share the payload
and the largest page_id are all responses; a null page_id revisits the largest id, or is a response if none
of the equal payloads has an id; repeated rows give a record each; an empty table gives no archive; other columns
than page_id, url and html are not read; texts are never cut.  Of archives written elsewhere, records without a page's
number have a null page_id, and an archive without an index is an error that names it.
"""

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
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keys, shared_folder, text_or_empty, written

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


@dataclass(frozen=True)
class ArchiveConfig:
    archive_bytes: int = 16 << 20
    min_revisit: int = 0
    level: int = 6


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def surt(url: str) -> str:
    """The sort key of an address: its host from the last name to the first, then the rest."""
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)(.*)", url, re.S)
    return _clean((",".join(reversed(m[1].split("."))) + ")" + (m[2] or "/") if m else url).lower()) or "-"


def index_line(url: str, kind: str, said: str, offset: int, length: int) -> str:
    fields = {"url": _clean(url), "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": f"sha1:{said}",
              "length": str(length), "offset": str(offset), "filename": WARC.rsplit("/", 1)[1]}
    return f"{surt(url)} 19700101000000 {json.dumps(fields)}"


def index_entries(data: bytes) -> list[tuple[str, int, int]]:
    """(member, offset, length) of each line of an index; lines without JSON and its headers are not records."""
    rows = [json.loads(line[line.index("{"):]) for line in data.decode().splitlines() if "{" in line and not line.startswith("!")]
    return [(f"archive/{r['filename']}", int(r["offset"]), int(r["length"])) for r in rows]


def page_number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(m[1]) if m else None


def warc_record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    block = HTTP + payload if kind == "response" else HTTP
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {_clean(url or '')}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>",
                     "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("truncated WARC record")
    return fields, rest[:n]


# -- ZIP ------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


class ZipRanges:
    """The directory of a ZIP file read from its end; ``read_at(offset, length)`` gives bytes of the file."""

    def __init__(self, read_at, size: int):
        self._read_at = read_at
        start = max(0, size - 65_557)  # the end record and the longest comment
        tail = read_at(start, size - start)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        locator = read_at(start + at - 20, 20) if start + at >= 20 else b""
        if locator[:4] == b"PK\x06\x07":
            end64 = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end record")
            count, length, offset = struct.unpack_from("<QQQ", end64, 32)
        self.members = dict(self._directory(read_at(offset, length), count))

    @staticmethod
    def _directory(data: bytes, count: int):
        at = 0
        for _ in range(count):
            if data[at:at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, n, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46:at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            end = at + 46 + n + extra
            x = at + 46 + n
            while x + 4 <= end:
                kind, m = struct.unpack_from("<HH", data, x)
                if kind == 1:  # ZIP64: the fields that are full in the entry, in this order
                    y = x + 4
                    if size == 0xFFFFFFFF:
                        size, y = struct.unpack_from("<Q", data, y)[0], y + 8
                    if packed == 0xFFFFFFFF:
                        packed, y = struct.unpack_from("<Q", data, y)[0], y + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", data, y)[0]
                x += 4 + m
            if flags & 1:
                raise ValueError(f"{name} is encrypted")
            yield name, Member(name, method, size, header)
            at = end + comment

    def data_start(self, name: str) -> int:
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is not stored")
        local = self._read_at(m.header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        return m.header + 30 + sum(struct.unpack_from("<HH", local, 26))

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        n = self.members[name].size - offset if length is None else length
        return self._read_at(self.data_start(name) + offset, n)


def pack(records: bytes, index: bytes, zip64: bool = True) -> bytes:
    """A ZIP file with both members stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((WARC, records), (INDEX, index)):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


# -- Spark ----------------------------------------------------------------------------------------

def write_archives(pages: DataFrame, config: ArchiveConfig = ArchiveConfig()) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html); returns the manifest (archive, records)."""
    base = shared_folder(pages.sparkSession, "archives")
    rows = pages.select("page_id", "url", text_or_empty("html").alias("html"), F.sha1(text_or_empty("html")).alias("digest"))
    heavy = rows.where(F.octet_length("html") >= config.min_revisit).groupBy("digest").agg(
        F.count("*").alias("m"), F.max("page_id").alias("first")).where("m > 1").select("digest", "first")
    rows = rows.join(keys(heavy, "archive-copies"), "digest", "left").select("page_id", "url", "html", "first")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(base)
        data, index, n = bytearray(), [], 0

        def flush():
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{root}/{path.rsplit('/', 1)[1]}") as f:
                f.write(pack(bytes(data), "\n".join(sorted(index)).encode()))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["archive", "records"])

        fs.create_dir(root, recursive=True)
        for b in batches:
            for i in range(b.num_rows):
                page, url, html, first = (b.column(k)[i].as_py() for k in range(4))
                kind = "revisit" if first is not None and page != first else "response"
                payload = html.encode("utf-8", "surrogatepass")
                record = gzip.compress(warc_record(kind, page, url, payload, first if kind == "revisit" else None), config.level, mtime=0)
                index.append(index_line(url or "", kind, digest(payload), len(data), len(record)))
                data += record
                n += 1
                if len(data) >= config.archive_bytes:
                    yield flush()
                    data, index, n = bytearray(), [], 0
        if n:
            yield flush()

    return written(rows.mapInArrow(run, "archive string, records long"), "archive-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row for each record of the archives: page_id, url, payload (null for revisits) and what its header says."""
    def run(batches):
        for b in batches:
            for path in b.column("archive").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    ranges = ZipRanges(lambda at, n: f.read_at(n, at), f.size())
                    indexes = [m for m in ranges.members if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", m)]
                    if not indexes:
                        raise ValueError(f"{path}: no index")
                    entries = sorted(e for m in indexes for e in index_entries(
                        gzip.decompress(ranges.read(m)) if m.endswith(".gz") else ranges.read(m)))
                    starts = {m: ranges.data_start(m) for m in {e[0] for e in entries}}
                    for k in range(0, len(entries), 256):
                        yield batch_of([(offset, length, *parse_record(gzip.decompress(f.read_at(length, starts[m] + offset))))
                                        for m, offset, length in entries[k:k + 256]], path)

    def batch_of(rows, path):
        out = []
        for offset, length, fields, block in rows:
            kind = fields["warc-type"]
            payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
            scheme, _, said = fields.get("warc-payload-digest", "").partition(":")
            if payload is not None and scheme == "sha1" and digest(payload) != said:
                raise ValueError(f"{path}: the record at {offset} doesn't have the digest of its header")
            size = len(payload) if payload is not None else fields.get("warc-payload-length")
            out.append((page_number(fields.get("warc-record-id")), fields.get("warc-target-uri"), payload, None if size is None else int(size),
                        said or None, kind, page_number(fields.get("warc-refers-to")), path, offset, length))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length"]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    schema = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, archive string, offset long, length long")
    archives = manifest.count()
    return manifest.repartition(max(1, min(archives, 10_000))).mapInArrow(run, schema)
