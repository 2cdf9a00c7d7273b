"""WARC bundles of independent Zstandard frames with a seek table at the end.

A bundle is a valid .warc.zst file in the Zstandard seekable format: records are
grouped into frames, and a skippable frame at the end lists the frames' sizes.
The index maps each record to its bundle, frame and offset in the frame.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint, settle, slices

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<II")

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame long, offset long, length long"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha1).decode()}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


class BundleWriter:
    """Frames of about frame_bytes of records; call add, then close."""

    def __init__(self, out, frame_bytes: int, level: int = 3):
        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.open, self.open_bytes, self.frames, self.written = [], 0, [], 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset in it) of the record."""
        at = (len(self.frames), self.open_bytes)
        self.open.append(raw)
        self.open_bytes += len(raw)
        if self.open_bytes >= self.frame_bytes:
            self._flush()
        return at

    def _flush(self):
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.open_bytes))
            self.written += len(packed)
            self.open, self.open_bytes = [], 0

    def close(self):
        self._flush()
        table = b"".join(ENTRY.pack(*f) for f in self.frames) + FOOTER.pack(len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the end of an open bundle."""
    size = f.size()
    f.seek(size - FOOTER.size)
    n, _, magic = FOOTER.unpack(f.read(FOOTER.size))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    f.seek(size - FOOTER.size - n * ENTRY.size)
    raw, at, out = f.read(n * ENTRY.size), 0, []
    for packed, full in ENTRY.iter_unpack(raw):
        out.append((at, packed, full))
        at += packed
    return out


def read_frame(f, entry: tuple[int, int, int]) -> bytes:
    f.seek(entry[0])
    return zstandard.ZstdDecompressor().decompress(f.read(entry[1]), max_output_size=entry[2])


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


def write_bundles(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    frame_bytes: int = 1 << 18,
    bundle_bytes: int = 1 << 26,
    min_revisit_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    max_broadcast: int = 1_000_000,
) -> DataFrame:
    """Writes a record for each row of pages under folder and returns the index.

    Of rows with equal payloads of at least min_revisit_bytes bytes, those with
    the largest id are responses and the others revisits that refer to it; rows
    that repeat the largest id are all responses; null ids sort lowest. A null
    payload is empty, a null URL has no field. A payload longer than frame_bytes has
    a frame of its own, which a task holds as a whole. Bundles end at about
    bundle_bytes compressed bytes. An empty table writes nothing and gives an empty
    index; other columns are not read. A task that is run again writes files of
    another name, and the index names the files of the run that counted.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.unhex(F.sha1("payload")))
    shared = p.where(F.length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    shared = settle(shared.where("n > 1 and last is not null").drop("n"))
    few = shared.count() <= max_broadcast
    p = p.join(F.broadcast(shared) if few else shared, "digest", "left")
    other = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    p = p.select("id", "url", "payload", "digest", F.when(other, F.col("last")).alias("refers_to"), other.alias("revisit"))

    def run(batches):
        fs, root = _store(folder)
        task, writer, n = TaskContext.get(), None, 0
        for batch in slices(batches):
            rows = [[], [], [], [], []]
            for i, url, payload, sha1, refers, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{task.partitionId():06d}-{n:04d}-{task.taskAttemptId()}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                raw = record(i, url, payload, sha1, refers, revisit, date)
                for column, value in zip(rows, (i, name, *writer.add(raw), len(raw))):
                    column.append(value)
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer, n = None, n + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["page_id", "bundle", "frame", "offset", "length"])
        if writer:
            writer.close()

    return settle(p.mapInArrow(run, INDEX))


def read_records(index: DataFrame, folder: str, with_payload: bool = False, frames_per_task: int = 16, max_tasks: int = 50_000) -> DataFrame:
    """The records of the index's rows, read by their frames and offsets.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, payload);
    payload is null for revisits and unless asked for. Rows are grouped by frame,
    so a frame is read once; other frames of a bundle are not read. Frames are dealt
    over tasks by their number, as the index itself is too small to say how much
    there is to read. A response whose payload does not have the digest in its head
    is an error. Index rows that repeat give repeated records; an empty index none.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fs, root = _store(folder)
        with fs.open_input_file(f"{root}/{key[0]}") as f:
            raw = read_frame(f, seek_table(f)[key[1]])
        rows = []
        for at, n in zip(pdf["offset"], pdf["length"]):
            fields, http, payload = parse(raw[at : at + n])
            revisit = fields["WARC-Type"] == "revisit"
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{key[0]}, frame {key[1]}: a payload differs from its digest")
            ids = [None if x == "null" else int(x) for x in (fields[k][10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To") if k in fields)]
            rows.append((ids[0], int(http["Content-Length"]), digest, fields["WARC-Type"], ids[1] if revisit else None, payload if with_payload and not revisit else None))
        out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    frames = index.select("bundle", "frame").distinct().count()
    tasks = min(max(1, -(-frames // frames_per_task)), max_tasks)
    return index.repartition(tasks, "bundle", "frame").groupBy("bundle", "frame").applyInPandas(run, schema)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


#: What reading back gives, in SQL: base32 writes five hexadecimal digits as four characters.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
b AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1], lambda d:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5)) AS BIGINT) // d) % 32 AS BIGINT), 1)), '')), '') AS payload_digest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM b
"""
