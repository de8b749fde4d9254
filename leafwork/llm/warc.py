"""WARC archives packaged as ZIP files: a writer job, and a reader that fetches byte ranges."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork import session
from leafwork.session import staged, staging_root

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Fixed value: the profile that a revisit of an identical payload names.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 4 << 20  # neighbouring records are fetched together up to so many bytes


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop-style URI or an absolute path, and the path in it."""
    if uri.startswith("file:/"):
        uri = "/" + uri[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- records ----------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digested: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, as its own gzip member. A revisit holds the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": None if url is None else "".join(url.split()),
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha1:{digested}",
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "replace") + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """Fields of a record and its payload; raises ValueError if it is cut or the digest is wrong."""
    head, end, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not end or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit, digested = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or digest(payload) != digested):
        raise ValueError(f"{fields['WARC-Record-ID']}: payload does not match its digest")

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
        "payload_digest": digested, "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To")), "payload": None if revisit else payload,
    }


# -- ZIP --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    start: int  # of the local header
    size: int


class Package:
    """The stored members of a ZIP file that is read in ranges (`read(offset, length)`)."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        found = tail.rfind(b"PK\x05\x06")
        if found < 0:
            raise ValueError("no end of central directory")
        entries, length, start = struct.unpack("<HII", tail[found + 10 : found + 20])
        if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = tail[found - 20 : found] if found >= 20 else read(tail_at + found - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end = read(struct.unpack("<Q", locator[8:16])[0], 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            entries, length, start = struct.unpack("<QQQ", end[32:56])
        self.members = {m.name: m for m in self._directory(read(start, length), entries)}

    @staticmethod
    def _directory(raw: bytes, entries: int) -> Iterator[Member]:
        at = 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
            packed, size, name_n, extra_n, comment_n = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
            start = struct.unpack("<I", raw[at + 42 : at + 46])[0]
            name = raw[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + name_n : at + 46 + name_n + extra_n]
            while len(extra) >= 4:  # the ZIP64 field holds only those values that did not fit
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == 1:
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    start = wide.pop(0) if start == 0xFFFFFFFF else start
                extra = extra[4 + n :]
            if method == 0 and not flags & 1:  # only stored, plain members can be read in ranges
                yield Member(name, start, size)
            at += 46 + name_n + extra_n + comment_n

    def locate(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member lie in the file: (offset, length)."""
        member = self.members.get(name)
        if member is None:
            raise ValueError(f"{name} is no stored member")
        head = self.read(member.start, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        name_n, extra_n = struct.unpack("<HH", head[26:30])
        return member.start + 30 + name_n + extra_n, member.size


def read_package(read, size: int) -> Iterator[dict]:
    """All records of a packaged archive, through its index, without extracting it."""
    package = Package(read, size)
    base, _ = package.locate(DATA)
    index = read(*package.locate(INDEX)).decode("utf-8").splitlines()
    spans = [(e["offset"], e["length"]) for e in (json.loads(line[line.index("{") :]) for line in index)]
    at = 0
    while at < len(spans):
        end = at + 1
        while end < len(spans) and spans[end][0] == sum(spans[end - 1]) and sum(spans[end]) - spans[at][0] <= READ:
            end += 1
        first = spans[at][0]
        raw = read(base + first, sum(spans[end - 1]) - first)
        for offset, length in spans[at:end]:
            yield parse_record(raw[offset - first : offset - first + length])
        at = end


# -- jobs -------------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages as page_id, url, payload, digest, revisit, refers_to.

    Of pages with equal payloads of at least `min_bytes` the one with the largest id holds it and
    the others revisit it. Rows that share that largest id all hold it. Null ids come last, and hold
    the payload if no page of the group has an id. A null html is an empty payload.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    holders = rows.groupBy("digest").agg(F.max("page_id").alias("holder"))
    large = F.octet_length("payload") >= min_bytes
    revisit = large & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    marked = rows.join(holders, "digest")
    return marked.select(
        "page_id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("holder")).alias("refers_to")
    )


def write_archives(marked: DataFrame, folder: str, *, limit: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of `mark_revisits` as ZIP-packaged archives; returns path, size, records.

    Each task writes its own files of about `limit` bytes into `folder`, which all machines share,
    under names no other attempt uses. The returned table, written once, lists those of the attempts
    that counted; files of lost attempts are never read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        package = None
        for frame in frames:
            for row in zip(frame["page_id"], frame["url"], frame["payload"], frame["digest"], frame["refers_to"], frame["revisit"], strict=True):
                page_id, url, payload, digested, refers_to, revisit = row
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                if package is None:
                    package = _Writer(store, f"{root}/{uuid.uuid4().hex}.zip")
                package.add(page_id, record(page_id, url, payload, base64.b32encode(digested).decode(), refers_to, revisit, date))
                if package.at >= limit:
                    yield package.close()
                    package = None
        if package is not None:
            yield package.close()

    # ids as text: a long column with nulls would pass through doubles
    as_text = marked.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return staged(as_text.mapInPandas(run, "path string, size bigint, records bigint"))


class _Writer:
    def __init__(self, store: fs.FileSystem, path: str):
        self.path, self.at, self.index = path, 0, []
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.member.write(raw)
        self.index.append(f"{page_id} {json.dumps({'offset': self.at, 'length': len(raw)})}")
        self.at += len(raw)

    def close(self) -> pd.DataFrame:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return pd.DataFrame({"path": [self.path], "size": [size], "records": [len(self.index)]})


def read_archives(archives: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """All records of the listed archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    `payload` (null for revisits) is left out if not wanted. Each payload is held against its digest.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    schema += ", payload binary" * payload
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = file_system(folder)

        def frame_of(rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype="Int64" if n in ("page_id", "refers_to", "payload_bytes") else object) for n in names})

        for frame in frames:
            for path in frame["path"]:
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for found in read_package(lambda at, n, f=file: f.read_at(n, at), file.size()):
                        rows.append(found)
                        held += len(found["payload"] or b"")
                        if held > READ or len(rows) >= 5000:
                            yield frame_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield frame_of(rows)

    count = max(1, archives.count())
    return archives.repartition(count).mapInPandas(run, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, *, min_bytes: int = 0, payload: bool = False) -> DataFrame:
    """Write pages to packaged archives in the staging folder and read them back.

    Repeated rows are records of their own, an empty table gives no archive and no rows, other
    columns are ignored; see `mark_revisits` for nulls.
    """
    folder = f"{staging_root(spark)}/archives-{uuid.uuid4().hex}"
    session._STAGED.append(folder)
    return read_archives(write_archives(mark_revisits(pages, min_bytes), folder), folder, payload)
