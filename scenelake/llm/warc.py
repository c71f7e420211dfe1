"""WARC archives in ZIP packages: written by tasks, located by directory, read by range.

Each writing task makes packages of its own in the shared folder: a stored member
``archive/data.warc.gz`` with one gzip member per record, and a stored index
``indexes/index.cdxj``.  Reading parses the central and ZIP64 directories, reads the index, and
fetches each record by its byte range; nothing is extracted to disk.

Files are named anew for each attempt of a task, and the list of packages is written once with
the names of the attempts that succeeded, so that repeated tasks leave no double records.
"""

from __future__ import annotations

import gzip
import json
import math
import uuid
import zipfile
import zlib
from contextlib import closing

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm import zip_archive
from scenelake.llm.common import P, delete_at_end, own_path, shuffle_partitions, staged

#: Payloads below this many bytes are never written as revisits.
MIN_REVISIT = 100
#: A package is closed once its records have so many bytes.
PACKAGE_BYTES = 256 << 20
#: A task reads about so many bytes of packages, dealt in blocks of so many.
READ_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20
_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "1970-01-01T00:00:00Z"  # pages have no date of their own
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header only."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    safe = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    """One ZIP package being written to a stream that can't seek."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.stream = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(_DATA, "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, record: bytes, page_id: int | None, digest: str) -> None:
        packed = gzip.compress(record, 3, mtime=0)
        self.data.write(packed)
        entry = {"page": page_id, "digest": digest, "offset": self.at, "length": len(packed)}
        self.index.append(json.dumps(entry))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(_INDEX, "w", force_zip64=True) as index:
            index.write("\n".join(self.index).encode())
        self.zip.close()
        self.stream.close()


def revisits(narrow: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(id, digest, refers_to): records whose payload a smaller id has written.

    ``narrow`` has id, digest and payload size.  Digests are counted before the join, which then
    holds repeated payloads only.
    """
    large = narrow.where(F.col("bytes") >= min_bytes)
    first = (
        large.groupBy("digest")
        .agg(F.min("id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "refers_to")
    )
    return large.join(first, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct()


def write(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit: int = MIN_REVISIT,
    package_bytes: int = PACKAGE_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """(package, n_records, n_bytes): the packages that hold one record per row of ``pages``.

    They are written to ``folder``; if none is given, to the shared folder until the driver ends.

    The payload is the html in UTF-8, null counting as empty; a long one is held whole by its task.  Of equal payloads of ``min_revisit``
    bytes or more the smallest id is the response and others revisit it; rows that share the
    smallest id, rows without an id and smaller payloads are responses.  An empty table gives no
    package; other columns aren't read.
    """
    spark = pages.sparkSession
    kept = folder is not None
    folder = folder or own_path(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    narrow = staged(rows.select("id", "digest", F.octet_length("html").alias("bytes")), "payloads")
    found = revisits(narrow, min_revisit).select(
        F.col("id").alias(f"{P}id"), F.col("digest").alias(f"{P}digest"), "refers_to"
    )
    same = (F.col("id") == F.col(f"{P}id")) & (F.col("digest") == F.col(f"{P}digest"))
    typed = rows.join(found, same, "left").select("id", "url", "html", "digest", "refers_to")

    def packages(it):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        package, name, n = None, "", 0
        for batch in it:
            for page_id, url, page, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    name, n = f"{uuid.uuid4().hex}.wacz", 0
                    package = _Package(fs, f"{root}/{name}")
                package.add(_record(page_id, url, page.encode(), digest, refers_to), page_id, digest)
                n += 1
                if package.at >= package_bytes:
                    package.close()
                    yield _row(f"{folder}/{name}", n, package.at)
                    package = None
        if package is not None:
            package.close()
            yield _row(f"{folder}/{name}", n, package.at)

    def _row(name, n, size):
        return pa.RecordBatch.from_pylist([{"package": name, "n_records": n, "n_bytes": size}])

    found = staged(typed.mapInArrow(packages, "package string, n_records long, n_bytes long"), "packages")
    if not kept and not found.isEmpty():
        delete_at_end(spark, folder)
    return found


class _Ranges:
    """A file that is read by range."""

    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read_at(self, nbytes: int, offset: int) -> bytes:
        return self.file.read_at(nbytes, offset)

    def close(self) -> None:
        self.file.close()


def locate(packages: DataFrame) -> DataFrame:
    """(package, offset, length): the byte range of every record, from directories and indexes."""

    def batches(it):
        for batch in it:
            for uri in batch.column(0).to_pylist():
                with closing(_Ranges(uri)) as file:
                    found = {m.name: m for m in zip_archive.members(file)}
                    base, _ = zip_archive.stored_range(file, found[_DATA])
                    at, size = zip_archive.stored_range(file, found[_INDEX])
                    entries = [json.loads(x) for x in file.read_at(size, at).splitlines()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uri] * len(entries), pa.string()),
                        pa.array([base + e["offset"] for e in entries], pa.int64()),
                        pa.array([e["length"] for e in entries], pa.int64()),
                    ],
                    names=["package", "offset", "length"],
                )

    return packages.select("package").mapInArrow(batches, "package string, offset long, length long")


def parse(record: bytes) -> dict:
    """Headers and payload of one uncompressed WARC record; a bad digest is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))

    def number(name: str) -> int | None:
        text = fields.get(name, "").strip("<>").removeprefix(_URN)
        return int(text) if text else None

    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and len(payload) != length:
        raise ValueError("short payload")
    return {
        "id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": None if revisit else payload,
    }


_READ = (
    "id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


def read(packages: DataFrame) -> DataFrame:
    """One row per record, fetched by range; a revisit's payload is null.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload for revisits too.
    """
    total = packages.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # a given number, as rows here are small and what they stand for isn't
    tasks = max(shuffle_partitions(packages.sparkSession), math.ceil(total / READ_BYTES))
    block = F.floor(F.col("offset") / BLOCK_BYTES)
    dealt = locate(packages).repartition(tasks, "package", block).sortWithinPartitions("package", "offset")
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload", pa.binary()),
        ]
    )

    def batches(it):
        uri, file = None, None
        for batch in it:
            rows, held = [], 0
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if name != uri:
                    if file:
                        file.close()
                    uri, file = name, _Ranges(name)
                rows.append(parse(zlib.decompress(file.read_at(length, offset), wbits=31)))
                held += len(rows[-1]["payload"] or b"")
                if held > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if file:
            file.close()

    return dealt.mapInArrow(batches, _READ)
