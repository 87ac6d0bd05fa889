"""WARC archives: a writer, and a splittable reader.

The writer puts every page into a record, each record into a gzip member of
its own, and the members of a task into archive files. Of pages with equal
payloads the one with the largest id is a ``response`` record; the others
are ``revisit`` records that name it and carry no payload.

The reader cuts the files into byte ranges. A task scans its range for the
gzip magic number, takes a candidate for a member only when its first bytes
decode to a WARC header, and owns the records that start inside its range;
it reads past the range's end to finish the last of them. So any range can
be read (or read again, when an executor is lost) without the others.

Files are opened by URI through Arrow's file systems (file, hdfs, s3, gs).
A write attempt has file names of its own, and the manifest, a parquet table
that Spark commits, lists only those of successful attempts.

Edge cases: a null html is an empty payload; a null url is left out; a null
page_id is written as such and read back as null; all rows of the largest
page_id of a group of equal payloads are responses; an empty table gives an
empty manifest and no records; a damaged or truncated record is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir

REVISIT_BYTES = 1000     # smaller payloads are always written in full
SPLIT_BYTES = 32 << 20   # bytes of archive for each read task
FILE_BYTES = 1 << 30     # a task begins a new archive file beyond it
GZIP_LEVEL = 3
READ_BYTES = 1 << 18

MAGIC = b"\x1f\x8b\x08"  # fixed value: RFC 1952, deflate
START = b"WARC/"  # fixed value: how a record begins
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: WARC 1.1
MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(uri: str):
    """(file system, path) of a URI or local path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _name(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def encode_record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member with a response record, or with a revisit record."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(page_id)),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", None if url is None else _clean(url)),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    else:
        block += payload
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def decode_record(raw: bytes) -> tuple:
    """The columns of RECORDS from one decompressed record."""
    end = raw.index(b"\r\n\r\n")
    fields = _fields(raw[:end])
    block = raw[end + 4 : end + 4 + int(fields["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    size = int(_fields(block[:http_end])["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    payload, kind = None, fields["warc-type"]
    if kind == "response":
        payload = block[http_end + 4 :]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"record {fields['warc-record-id']}: the payload doesn't fit its digest")
    return _page_id(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, _page_id(fields.get("warc-refers-to")), payload


def plan_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, revisit and refers_to.

    Only (page_id, digest, size) is grouped, after a partial maximum, so a
    payload that a third of all pages share costs no more than others; the
    pages then meet the table of revisits by page_id."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    slim = p.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    top = (slim.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
           .where("n > 1").select("digest", "size", "refers_to"))
    revisits = materialize(slim.join(top, ["digest", "size"]).where("NOT page_id <=> refers_to").select("page_id", "digest", "refers_to").distinct(), "warc-revisits")
    r = revisits.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to", F.lit(True).alias("revisit"))
    return (p.join(r, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.sha1("payload") == F.col("r_digest")), "left")
            .select("page_id", "url", "payload", F.coalesce("revisit", F.lit(False)).alias("revisit"), "refers_to"))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives into ``folder`` (a
    URI that all executors reach; default: below ``spark.checkpoint.dir``).
    Returns the manifest: path, bytes, records of each file."""
    folder = folder or shared_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        done, out, name = [], None, ""
        size = records = 0
        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    system.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size, records = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                member = encode_record(page_id, url, payload, refers_to, revisit)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return materialize(plan_revisits(pages).mapInArrow(run, MANIFEST), "warc-manifest")


def scan_range(source, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decompressed records whose members start in [start, end) of a file.

    ``source`` has seek and read. Memory: one record and one buffer."""
    at, buffer, held = start, b"", start  # buffer holds the bytes from offset held on

    def fill(offset: int, least: int) -> bytes:
        """Bytes from offset on, at least so many unless the file ends."""
        nonlocal buffer, held
        if offset < held or offset > held + len(buffer):
            source.seek(offset)
            buffer, held = b"", offset
        buffer, held = buffer[offset - held :], offset
        while len(buffer) < least and held + len(buffer) < size:
            source.seek(held + len(buffer))
            more = source.read(READ_BYTES)
            if not more:
                break
            buffer += more
        return buffer

    while at < end:
        window = fill(at, len(MAGIC))
        found = window.find(MAGIC)
        if found < 0:  # the magic number may lie across two buffers
            if held + len(window) >= size:
                return
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        record, after = _member(fill, at, size)
        if record is None:
            at += 1
        else:
            yield record
            at = after


def _member(fill, at: int, size: int) -> tuple[bytes | None, int]:
    """The record of the gzip member at ``at`` and the offset behind it;
    (None, ...) if no WARC record begins there. A member that begins like a
    record but is damaged or cut off raises an error."""
    probe, head, offset = zlib.decompressobj(31), b"", at
    try:
        while len(head) < len(START) and not probe.eof and (data := fill(offset, 64)):
            head += probe.decompress(data[:64], len(START) - len(head))
            if probe.unconsumed_tail:
                break
            offset += min(64, len(data))
    except zlib.error:
        return None, at
    if head != START:
        return None, at
    z, parts, offset = zlib.decompressobj(31), [], at
    while not z.eof:
        data = fill(offset, 1)
        if not data:
            raise ValueError(f"the record at byte {at} is cut off")
        parts.append(z.decompress(data))
        offset += len(data) - len(z.unused_data)
    return b"".join(parts), offset


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the files of a manifest (columns path, bytes): RECORDS,
    with null payloads for revisits, and for all if ``payloads`` is false."""
    ranges = (manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start"))
              .select("path", "bytes", F.col("start").cast("long").alias("start"), F.least(F.col("start") + split_bytes, F.col("bytes")).cast("long").alias("end")))
    schema = RECORDS if payloads else RECORDS.replace(", payload binary", "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for frame in frames:
            for path, size, start, end in frame.itertuples(index=False):
                system, base = _open(path)
                rows, held = [], 0
                with system.open_input_file(base) as source:
                    for record in scan_range(source, size, start, end):
                        row = decode_record(record)
                        rows.append(row[: len(names)])
                        held += len(record) if payloads else 100
                        if held > 8 << 20:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    # one range is one row: dealt round-robin, so that a task gets few ranges
    return ranges.repartition(_tasks(manifest, split_bytes)).mapInPandas(run, schema)


def _tasks(manifest: DataFrame, split_bytes: int) -> int:
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return max(1, min(int(total), 100_000))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    for c in ("page_id", "payload_bytes", "refers_to"):
        frame[c] = frame[c].astype("Int64")
    return frame
