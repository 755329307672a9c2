"""WARC (operator 5): archives written as one gzip stream, normalised to one member for each record.

Tasks write their rows as WARC records into archives that are compressed as a whole, the way many
tools leave them. The normaliser inflates such a stream once, in pieces, and rewrites every record
as a gzip member of its own, with a sidecar index of offsets; readers then fetch single records.
Archives lie in the shared folder. Every attempt of a task writes files of its own name, and only
the names that a finished attempt returns are ever read, so a task that is run again does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, materialise, read, scratch_path, sized

#: Payload bytes after which a task starts a new archive; what is read at once; the smallest payload that is ever revisited.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 18
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit holds the HTTP header alone. digest: hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if refers_to is not None else payload)
    safe = "".join(c if "\x20" < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {safe}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    return {k: v.strip() for k, found, v in (line.partition(":") for line in head.decode().split("\r\n")[1:]) if found}


def records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The records of an uncompressed stream, one at a time, whole."""
    held = bytearray()
    need = 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + int(headers(bytes(held[:at]))["Content-Length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the archive ends within a record")


def inflated(f: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, in pieces of at most CHUNK bytes.

    A stream that ends before its trailer, or whose checksum is wrong, raises an error.
    """
    d, begun = zlib.decompressobj(31), False
    while data := f.read(CHUNK):
        while data:
            if d.eof:
                d = zlib.decompressobj(31)
            begun = True
            if piece := d.decompress(data, CHUNK):
                yield piece
            data = d.unused_data if d.eof else d.unconsumed_tail
    while begun and not d.eof and (piece := d.decompress(b"", CHUNK)):
        yield piece
    if begun and not d.eof:
        raise ValueError("the archive is cut off within a compressed stream")


def parse(raw: bytes) -> tuple[str, int, str, str, str | None]:
    """(page id, payload bytes, payload digest in hex, record type, id it refers to) of one record."""
    at = raw.index(b"\r\n\r\n")
    head = headers(raw[:at])
    block = raw[at + 4 : at + 4 + int(head["Content-Length"])]
    cut = block.index(b"\r\n\r\n") + 4
    stated = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(headers(block[: cut - 4])["Content-Length"])
    name = head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    if head["WARC-Type"] == "revisit":
        return name, size, stated, "revisit", head["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">")
    payload = block[cut:]
    if hashlib.sha1(payload).hexdigest() != stated or len(payload) != size:
        raise ValueError(f"the payload of record {name} isn't what its header says")
    return name, len(payload), stated, "response", None


def _store(folder: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store, path


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html (binary), digest, and refers_to where an equal payload has a larger id.

    Only ids and digests are grouped; the pages themselves aren't shuffled unless there are too many
    repeated payloads to send to every task.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= REVISIT_BYTES
    repeated = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least"), F.count(F.when(F.col("page_id").isNull(), 1)).alias("nulls")).where("keeper is not null and (least <> keeper or nulls > 0)")
    repeated = materialise(repeated.select("digest", "keeper"), "warc-repeated")
    small = sized(repeated)
    if small is not repeated:
        joined = rows.join(small, "digest", "left")
    else:  # by page and not by payload, so that a payload of many pages isn't one task's
        ids = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest")).distinct().join(repeated, "digest")
        joined = rows.alias("r").join(ids.alias("i"), F.col("r.page_id").eqNullSafe(F.col("i.page_id")) & (F.col("r.digest") == F.col("i.digest")), "left").select("r.*", "i.keeper")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.select(F.col("page_id").cast("string"), "url", "html", "digest", refers.cast("string").alias("refers_to"))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Writes the records; returns a row (path, records) for each archive, compressed as one stream."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        out = packer = None
        name, size, n = "", 0, 0
        done: list[tuple[str, int]] = []

        def finish() -> None:
            nonlocal out
            if out is not None:
                out.write(packer.flush())
                out.close()
                done.append((name, n))
                out = None

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is None:
                    name, size, n, packer = f"{path}/mono-{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(4, zlib.DEFLATED, 31)
                    out = store.open_output_stream(name, compression=None)
                out.write(packer.compress(record("" if page_id is None else page_id, url, payload, digest, refers_to)))
                size += len(payload)
                n += 1
                if size >= ARCHIVE_BYTES:
                    finish()
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], ["path", "records"])

    return materialise(arrow_map(planned, rows, "path string, records bigint"), "warc-archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with one member for each record; returns (path, index, records).

    archives: (path, records). An archive that holds other than its number of records raises an
    error. The index has a line for each record: id, url, digest, offset and length.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for b in batches:
            done = []
            for source, expected in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                name = f"{path}/members-{uuid.uuid4().hex}.warc.gz"
                offset = n = 0
                with store.open_input_stream(source, compression=None) as f, store.open_output_stream(name, compression=None) as out, store.open_output_stream(name + ".idx", compression=None) as index:
                    for raw in records(inflated(f)):
                        member, head = gzip.compress(raw, 4, mtime=0), headers(raw[: raw.index(b"\r\n\r\n")])
                        out.write(member)
                        entry = {"id": head["WARC-Record-ID"], "url": head["WARC-Target-URI"], "digest": head["WARC-Payload-Digest"], "offset": offset, "length": len(member)}
                        index.write(json.dumps(entry).encode() + b"\n")
                        offset += len(member)
                        n += 1
                if n != expected:
                    raise ValueError(f"{source} holds {n} records, not {expected}")
                done.append((name, name + ".idx", n))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string()), pa.array([x[2] for x in done], pa.int64())], ["path", "index", "records"])

    return materialise(arrow_map(spread(archives), rows, "path string, index string, records bigint"), "warc-members")


def spread(archives: DataFrame) -> DataFrame:
    """An archive to a task, as far as there are tasks."""
    return archives.repartition(max(1, min(2_000, archives.count())))


def fetch(index: DataFrame, member_path: str, url: str) -> list[bytes]:
    """The records of a URL in one archive, read at their offsets alone. index: the lines of its index."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(member_path if "://" in member_path else f"file://{member_path}")
    with store.open_input_file(path) as f:
        found = []
        for e in index.where(F.col("url") == url).orderBy("offset").select("offset", "length").toLocalIterator():
            f.seek(e.offset)
            found.append(gzip.decompress(f.read(e.length)))
    return found


def read_members(members: DataFrame, folder: str) -> DataFrame:
    """One row for each record, fetched at its offset: page_id (text), payload_bytes, payload_digest, record_type, refers_to."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for b in batches:
            for path, index in zip(b.column("path").to_pylist(), b.column("index").to_pylist(), strict=True):
                with store.open_input_stream(index, compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with store.open_input_file(path) as f:
                    for at in range(0, len(entries), 5_000):
                        found = []
                        for e in entries[at : at + 5_000]:
                            f.seek(e["offset"])
                            found.append(parse(gzip.decompress(f.read(e["length"]))))
                        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return arrow_map(spread(members), rows, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all rows of pages (page_id, url, html), normalises the archives and reads them back.

    A null html is an empty payload, a null url an empty one. Of payloads of REVISIT_BYTES or more
    that are equal the record with the largest page_id is the response, the others revisit it; a row
    that repeats the same id and payload is written again as it is. A row without an id is written
    under an empty one and comes back as null. An empty table gives no archives and no rows. Other
    columns are ignored.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    folder = scratch_path(spark, "warc")
    got = read_members(normalise(write_archives(plan_records(pages), folder), folder), folder)
    bare = F.when(F.col("page_id") != "", F.col("page_id")).cast(kind)
    return got.select(bare.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"))


QUERIES = {"op5_warc": op5_warc}
ORACLE = {
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
        k as (select d, max(page_id) as keeper from p where n >= 1000 group by d)
        select page_id, n::bigint as payload_bytes, d as payload_digest,
               case when keeper is not null and keeper <> page_id then 'revisit' else 'response' end as record_type,
               case when keeper is not null and keeper <> page_id then keeper end as refers_to
        from p left join k using (d)"""
}
