"""Operator 8: WARC records in ZIP packages, read by range without extraction.

Writing: every page is a WARC/1.1 record, gzipped on its own; records are
gathered to ``archive/data.warc.gz``, their places to ``indexes/index.cdxj``,
and both are stored (not compressed again) in a ZIP of about ``PACK_BYTES``.
Of records with equal payloads of ``REVISIT_BYTES`` or more the one with the
largest page id is a response and the others are revisits of it.

Reading: the end-of-central-directory record is found from the file's tail,
or its ZIP64 form by the locator; the central directory and its ZIP64 extra
fields give the members; the index member gives record places inside the
stored archive member, and records are read by ranges (neighbours in one
read). Packages of any writer with stored members can be read.

Archives are written below the shared folder through ``pyarrow.fs``; a task
attempt writes its own files, and only the files of successful attempts are in
the manifest, so lost executors and repeated attempts do no harm.

Cases: null html is an empty payload; a null page id stays null; of rows that
repeat the largest page id with the same payload each is a response; a null
url becomes ``urn:none``, and characters that a header cannot hold are
percent-encoded; empty tables write no archive; further columns do not matter.
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
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_path
from .shared import sized

REVISIT_BYTES = 1000
PACK_BYTES = 16 << 20
READ_BYTES = 4 << 20  # neighbouring records are read together up to this size

# fixed values of the formats
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:page:(.*)>")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a folder or file that all tasks share."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def record(page_id, url: str | None, payload: bytes, digest: bytes, refers_to, date: str) -> bytes:
    """One WARC record (not gzipped); refers_to None: a response."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    uri = quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) if url else "urn:none"
    block = _HTTP + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Member:
    name: str
    method: int
    size: int  # as stored
    header: int  # offset of the local header


def directory(f, size: int) -> list[Member]:
    """Members listed by the central directory of a ZIP file object."""
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise zipfile.BadZipFile("no end of central directory")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] <= len(tail):
            break
    count, length, start = struct.unpack_from("<HLL", tail, at + 10)
    end_of_directory = tail_at + at
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":  # ZIP64 locator
        place = struct.unpack_from("<Q", tail, at - 12)[0]
        f.seek(place)
        end = f.read(56)
        if end[:4] != b"PK\x06\x06":  # something stands before the archive
            place = end_of_directory - 20 - 56
            f.seek(place)
            end = f.read(56)
        if end[:4] != b"PK\x06\x06":
            raise zipfile.BadZipFile("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
        end_of_directory = place
    moved = end_of_directory - length - start  # bytes before the archive
    f.seek(start + moved)
    raw, members, i = f.read(length), [], 0
    for _ in range(count):
        if raw[i : i + 4] != b"PK\x01\x02":
            raise zipfile.BadZipFile("broken central directory")
        method = struct.unpack_from("<H", raw, i + 10)[0]
        packed, full, n, m, c = struct.unpack_from("<LLHHH", raw, i + 20)
        header = struct.unpack_from("<L", raw, i + 42)[0]
        name, extra = raw[i + 46 : i + 46 + n], raw[i + 46 + n : i + 46 + n + m]
        k = 0
        while k + 4 <= len(extra):
            tag, bytes_ = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: only the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{bytes_ // 8}Q", extra, k + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + bytes_
        members.append(Member(name.decode("utf-8", "replace"), method, packed, header + moved))
        i += 46 + n + m + c
    return members


def data_start(f, member: Member) -> int:
    """Offset of a stored member's bytes; its local header has its own lengths."""
    if member.method:
        raise zipfile.BadZipFile(f"{member.name} is compressed")
    f.seek(member.header)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} has another digest")
    own = lambda x: m[1] if x and (m := _ID.fullmatch(x)) and m[1] else None
    return {"record_type": kind, "page_id": own(fields["WARC-Record-ID"]), "refers_to": own(fields.get("WARC-Refers-To")), "target_uri": fields["WARC-Target-URI"],
            "payload_digest": digest, "payload_bytes": int(fields["X-Payload-Length"]), "payload": payload if kind == "response" else None}


def records(f, size: int) -> Iterator[dict]:
    """All records of a package, by the places in its index members."""
    members = {m.name: m for m in directory(f, size)}
    starts: dict[str, int] = {}
    for name, index in members.items():
        if not name.startswith("indexes/"):
            continue
        f.seek(data_start(f, index))
        entries = [json.loads(line.split(" ", 2)[2]) for line in f.read(index.size).decode().splitlines()]
        places = sorted((f"archive/{e['filename']}", int(e["offset"]), int(e["length"])) for e in entries)
        i = 0
        while i < len(places):
            member, low, _ = places[i]
            j, high = i, low
            while j < len(places) and places[j][0] == member and (j == i or places[j][1] + places[j][2] - low <= READ_BYTES):
                high = max(high, places[j][1] + places[j][2])
                j += 1
            if member not in starts:
                starts[member] = data_start(f, members[member])
            f.seek(starts[member] + low)
            part = f.read(high - low)
            for _, at, length in places[i:j]:
                yield parse_record(gzip.decompress(part[at - low : at - low + length]))
            i = j


def _package(parts: list[bytes], lines: list[str], zip64: bool) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in ((DATA, b"".join(parts)), (INDEX, "".join(lines).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as m:
                m.write(content)
    return out.getvalue()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   date: str = "1970-01-01T00:00:00Z", pack_bytes: int = PACK_BYTES, zip64: bool = True) -> DataFrame:
    """Write one record per page; returns the manifest (path, n_records, n_bytes)."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    digest = F.sha1("html")
    same = slim.where(F.octet_length("html") >= REVISIT_BYTES).groupBy(digest.alias("digest")).agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
    same = materialize(same.where("n > 1").drop("n"), "payloads")
    keyed = slim.withColumn("digest", digest).join(sized(same, 100), "digest", "left")
    refers = F.when((F.octet_length("html") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("target")), F.col("target").cast("string"))
    keyed = keyed.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.unhex("digest").alias("digest"), refers.alias("refers_to"))
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("n_records", T.LongType()), T.StructField("n_bytes", T.LongType())])

    def run(batches):
        fs, inner = open_store(folder)
        parts, lines, size = [], [], 0

        def flush():
            content = _package(parts, lines, zip64)
            name = f"pack-{uuid.uuid4().hex}.zip"  # another attempt writes other names
            fs.create_dir(inner, recursive=True)
            with fs.open_output_stream(f"{inner}/{name}") as f:
                f.write(content)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(parts)], pa.int64()), pa.array([len(content)], pa.int64())], names=schema.names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for x in batch.slice(lo, 256).to_pylist():
                    raw = record(x["page_id"], x["url"], x["html"].encode(), x["digest"], x["refers_to"], date)
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = pack.compress(raw) + pack.flush()
                    lines.append(f"{x['page_id'] or '-'} 19700101000000 " + json.dumps({"offset": size, "length": len(raw), "filename": "data.warc.gz"}) + "\n")
                    parts.append(raw)
                    size += len(raw)
                    if size >= pack_bytes:
                        yield flush()
                        parts, lines, size = [], [], 0
        if parts:
            yield flush()

    return materialize(keyed.mapInArrow(run, schema), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the packages in ``path``: record_type, page_id and
    refers_to (strings), target_uri, payload_digest, payload_bytes, payload."""
    kinds = [("record_type", T.StringType(), pa.string()), ("page_id", T.StringType(), pa.string()), ("refers_to", T.StringType(), pa.string()),
             ("target_uri", T.StringType(), pa.string()), ("payload_digest", T.StringType(), pa.string()), ("payload_bytes", T.LongType(), pa.int64())]
    kinds += [("payload", T.BinaryType(), pa.binary())] * payloads
    schema = T.StructType([T.StructField(n, t) for n, t, _ in kinds])

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, _, t in kinds], names=schema.names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = open_store(path)
                rows, size = [], 0
                with fs.open_input_file(inner) as f:
                    for r in records(f, f.size()):
                        rows.append(r)
                        size += len(r["payload"] or b"")
                        if size > READ_BYTES or len(rows) >= 4096:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    # a package is a task's work, however small its manifest row
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, schema)


def op8_warc_zip(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, scratch_path(spark, "warc-zip"))
    found = read_archives(manifest, payloads=False)
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS target FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM target THEN target END AS refers_to
FROM m
"""
