"""WARC archives: one gzip member per record, written and read sequentially (operator 4).

Writing: each task appends records to archives of bounded size in a shared folder; an archive is
written under a name of its own attempt and then moved, so a repeated task leaves one copy.
A payload that another record of smaller id has too is written as a revisit record, which
carries the HTTP header of the full payload but no body.

Reading: archives are read front to back in fixed pieces; each gzip member is inflated step by step,
its block framed by Content-Length and checked against the record's digest. A broken member,
a wrong length or a wrong digest is an error.

Defined cases: a null payload is empty; a null url is written as an empty target; rows of equal id
are records of their own, all responses if theirs is the smallest id of the payload; a row with a
null id is a response and never referred to; an empty table gives no archive and no row; other
columns are not written. Archives lie in the folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import shared_folder

from .store import settle, whole_text

READ_BYTES = 1 << 18
ARCHIVE_BYTES = 256 << 20
_DATE = "2000-01-01T00:00:00Z"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: Column) -> Column:
    """Base32 SHA-1 of a binary or text column: five hex digits make four letters."""
    hexed = F.sha1(payload)
    letters = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(hexed, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def mark_revisits(df: DataFrame, id: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """``df`` with its payload's digest and ``refers_to``: the smallest id of equal payloads, unless its own.

    Digests are counted before they meet rows; only those that occur twice are joined.
    """
    marked = df.withColumn("payload_digest", digest(F.col(payload)))
    large = F.octet_length(payload) >= least_bytes
    twice = settle(marked.where(large).groupBy("payload_digest").agg(F.min(id).alias("refers_to"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select(F.col("payload_digest").alias("of"), "refers_to"), "digests")
    joined = marked.join(twice, large & (F.col("payload_digest") == F.col("of")), "left").drop("of")
    return joined.withColumn("refers_to", F.when(F.col("refers_to") != F.col(id), F.col("refers_to")))


def _name(id: object) -> str:
    """The URN of an id: other characters than letters, digits and ``-._~`` are percent-encoded, and the first of the text
    ``None``, as that alone names a null id."""
    return f"<urn:page:{'%4Eone' if id == 'None' else quote(str(id), safe='')}>"


def record(id: object, url: str, payload: bytes, named: str, refers_to: object = None) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(id)}",
            f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{named}",
            f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n"
    return deflate.compress(text.encode() + block + b"\r\n\r\n") + deflate.flush()


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_archives(df: DataFrame, folder: str, id: str, url: str, payload: str, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write marked rows (see ``mark_revisits``) and return the table of archives: ``path``, ``records``."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        stream, size, number, records = None, 0, 0, 0

        def close() -> pa.RecordBatch:
            stream.close()
            name = f"{root}/pages-{task:06d}-{number:04d}.warc.gz"
            store.move(f"{root}/_{attempt}-{number}", name)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/pages-{task:06d}-{number:04d}.warc.gz"]),
                                               pa.array([records], pa.int64())], names=["path", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, target, body, named, refers = (batch.column(c)[i].as_py() for c in range(5))
                if stream is None:
                    stream, size, records = store.open_output_stream(f"{root}/_{attempt}-{number}", compression=None), 0, 0
                data = record(key, target or "", body, named, refers)
                stream.write(data)
                size, records = size + len(data), records + 1
                if size >= most_bytes:
                    yield close()
                    stream, number = None, number + 1
        if stream is not None:
            yield close()

    rows = df.select(F.col(id), F.col(url).cast("string"), F.col(payload).cast("binary"), "payload_digest", "refers_to")
    return settle(rows.mapInArrow(write, "path string, records long"), "archives")


def members(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive read in pieces: header fields and block, framed by Content-Length."""
    inflate, out, begun = zlib.decompressobj(31), bytearray(), False
    for rest in chunks:
        while rest:
            out += inflate.decompress(rest)
            begun = True
            if not inflate.eof:
                break
            rest = inflate.unused_data
            yield _framed(bytes(out))
            inflate, out, begun = zlib.decompressobj(31), bytearray(), False
    if begun:
        raise ValueError("archive ends inside a record")


def _framed(member: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    length = int(fields["Content-Length"])
    if not version.startswith("WARC/") or not gap or rest[length:] != b"\r\n\r\n":
        raise ValueError("record is not framed by its Content-Length")
    return fields, rest[:length]


def parse(fields: dict[str, str], block: bytes) -> dict:
    """One report row of a record, with its digests verified."""
    def sha1(data: bytes) -> str:
        return base64.b32encode(hashlib.sha1(data).digest()).decode()

    if fields["WARC-Block-Digest"] != "sha1:" + sha1(block):
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    http, _, body = block.partition(b"\r\n\r\n")
    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if fields["WARC-Type"] == "response" and (sha1(body) != named or len(body) != size):
        raise ValueError(f"payload differs in {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {"id": _page(fields["WARC-Record-ID"]), "named": fields["WARC-Record-ID"] != _name(None), "payload_bytes": size, "payload_digest": named,
            "record_type": fields["WARC-Type"], "refers_to": _page(refers) if refers else None,
            "url": fields["WARC-Target-URI"], "payload": body if fields["WARC-Type"] == "response" else None}


def _page(name: str) -> str:
    return unquote(name.removeprefix("<urn:page:").removesuffix(">"))


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives in column ``path``, each archive read by one task from front to back; ``named`` is false for a null id."""
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "named"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.bool_()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                store, root = _store(folder)
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    held, size = [], 0
                    for fields, block in members(iter(lambda: stream.read(READ_BYTES), b"")):
                        row = parse(fields, block)
                        if not with_payload:
                            row["payload"] = None
                        held.append(row)
                        size += len(row["payload"] or b"") + 500
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds)], names=names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], k) for n, k in zip(names, kinds)], names=names)

    # a task an archive: a number given to repartition stands, whatever the planner would join
    dealt = paths.select("path").repartitionByRange(max(1, paths.count()), "path")
    return dealt.mapInArrow(read, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, "
                                  "url string, payload binary, named boolean")


def round_trip(df: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row and read the archives back."""
    folder = shared_folder(df.sparkSession, "warc")
    body = df.select(F.col(id), F.col(url), whole_text(F.col(payload)).cast("binary").alias("payload"))
    archives = write_archives(mark_revisits(body, id, "payload", least_bytes), folder, id, url, "payload")
    kind = df.schema[id].dataType
    return read_archives(archives, with_payload=False).select(
        F.when(F.col("named"), F.col("id")).try_cast(kind).alias(id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast(kind).alias("refers_to"))


def round_trip_sql() -> str:
    letters = " || ".join(
        f"substr('{_BASE32}', ((CAST('0x' || substr(h, {i + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)"
        for i in range(0, 40, 5) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {letters} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""
