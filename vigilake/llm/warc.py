"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames with whole WARC records,
closed by a seek table in a skippable frame, so any frame can be read alone. The
index table maps each record's identifier to its file, its frame and its place in
the frame, and is the manifest: only files it names belong to the archive, which
makes repeated or lost tasks harmless.
"""

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import checkpoint_dir, staged, table

# Fixed values of the seekable format: skippable-frame magic and seek-table magic.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

# Uncompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 32 * 1024 * 1024

INDEX = "page_id bigint, file string, frame int, frame_start bigint, frame_bytes bigint, record_start bigint, record_bytes bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, intact boolean"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def classify(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Add payload, payload_sha1, record_type and refers_to to ``pages`` (page_id, url, html).

    Of equal payloads the largest page_id is the response and the others revisit it.
    A row that repeats that page_id and payload is a response too, since a record
    cannot revisit itself; a NULL page_id revisits any other.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_sha1"))
    shared = known.groupBy("payload_sha1").agg(F.max("page_id").alias("__winner"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    # Written, so that the join sees its size and can split a payload that very many pages share.
    found = known.join(staged(shared, "responses"), "payload_sha1", "left")
    revisits = (F.octet_length("payload") >= min_revisit_bytes) & F.col("__winner").isNotNull() & ~F.col("__winner").eqNullSafe(F.col("page_id"))
    return found.select(
        "page_id", "url", "payload", "payload_sha1",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("__winner")).alias("refers_to"),
    )


def record_bytes(row, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head of its payload but not the payload."""
    payload = bytes(row.payload)
    sha1 = base64.b32encode(bytes.fromhex(row.payload_sha1)).decode()
    url = f"urn:page:{row.page_id}" if row.url is None else quote(row.url, safe="".join(map(chr, range(33, 127))))
    missing = row.page_id is None
    body = HTTP_HEAD % len(payload) + (b"" if row.record_type == "revisit" else payload)
    heads = [
        ("WARC-Type", row.record_type), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-ID", "" if missing else str(row.page_id)), ("X-Payload-Length", str(len(payload))), ("X-URL-Missing", "yes" if row.url is None else "no"),
    ]
    if row.record_type == "revisit":
        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(row.refers_to))]
    heads.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + body + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with the (compressed, uncompressed) size of every frame and the closing footer."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Sizes of all frames from a bundle's bytes or its end."""
    count, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    at = len(tail) - 9 - 8 * count
    head, size = struct.unpack("<II", tail[at - 8 : at])
    if head != SKIPPABLE or size != 8 * count + 9:
        raise ValueError("damaged seek table")
    return [struct.unpack_from("<II", tail, at + 8 * i) for i in range(count)]


@dataclass
class Place:
    """File system and folder of an archive, for tasks: any file system pyarrow knows by its URI."""

    uri: str

    def open(self):
        from pyarrow import fs

        uri = self.uri if "://" in self.uri else "file://" + self.uri.removeprefix("file:")
        return fs.FileSystem.from_uri(uri)


def write_bundles(classified: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write every row as a WARC record under ``folder`` and return the index, itself written there.

    Every task writes bundles of its own with names no other attempt uses, and sends
    on where each record is. A frame is closed after ``frame_bytes``; a larger record has its own.
    """
    place = Place(folder)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        system, root = place.open()
        system.create_dir(root, recursive=True)
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
        out, name, frames, written, buffer, waiting, rows = None, "", [], 0, [], [], []

        def close_frame():
            nonlocal written, out, name
            if not buffer:
                return
            if out is None:
                name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                out, written = system.open_output_stream(f"{root}/{name}", compression=None), 0
            plain = b"".join(buffer)
            packed = squeeze.compress(plain)
            out.write(packed)
            rows.extend((page, name, len(frames), written, len(packed), start, size) for page, start, size in waiting)
            frames.append((len(packed), len(plain)))
            written += len(packed)
            buffer.clear(), waiting.clear()

        def close_bundle():
            nonlocal out
            if out is not None:
                out.write(seek_table(frames))
                out.close()
                out = None
                frames.clear()

        def taken():
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
            made["page_id"] = made["page_id"].astype("Int64")
            rows.clear()
            return made

        held = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                row = row._replace(page_id=None if pd.isna(row.page_id) else int(row.page_id), refers_to=None if pd.isna(row.refers_to) else int(row.refers_to))
                data = record_bytes(row, date)
                waiting.append((row.page_id, held, len(data)))
                buffer.append(data)
                held += len(data)
                if held >= frame_bytes:
                    close_frame()
                    held = 0
                    if written >= bundle_bytes:
                        close_bundle()
            # Records whose frame is still open are sent on with a later batch, or at the end.
            if rows:
                yield taken()
        close_frame()
        close_bundle()
        if rows:
            yield taken()

    index = classified.mapInPandas(pack, INDEX)
    path = f"{folder}/index"
    index.write.option("compression", "zstd").parquet(path)
    return classified.sparkSession.read.schema(index.schema).parquet(path)


def parse_record(data: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, digest, payload_bytes, payload or None, intact) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    kind, digest, length = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    page = int(fields["X-Page-ID"]) if fields["X-Page-ID"].strip() else None
    url = None if fields["X-URL-Missing"] == "yes" else fields["WARC-Target-URI"]
    if kind == "revisit":
        return page, url, kind, int(fields["X-Refers-To-Page"]), digest, length, None, True
    return page, url, kind, None, digest, length, payload, base32_sha1(payload) == digest and len(payload) == length


def read_frames(spark: SparkSession, folder: str, index: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Records of an archive; with ``wanted`` (page_id) only those, of which only their frames are read.

    One row per frame goes to the tasks; each opens the file at the frame's place.
    """
    place, picked = Place(folder), index if wanted is None else index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    # A frame has at most FRAME_BYTES of records and one more, so its list of places is bounded.
    frames = picked.groupBy("file", "frame", "frame_start", "frame_bytes").agg(F.collect_list(F.struct("record_start", "record_bytes")).alias("records"))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        system, root = place.open()
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, rows in batch.groupby("file"):
                with system.open_input_file(f"{root}/{name}") as file:
                    for row in rows.itertuples(index=False):
                        file.seek(row.frame_start)
                        plain = expand.decompress(file.read(row.frame_bytes))
                        found = [parse_record(plain[r["record_start"] : r["record_start"] + r["record_bytes"]]) for r in row.records]
                        made = pd.DataFrame(found, columns=[c.split()[0] for c in RECORD.split(", ")])
                        yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    return frames.mapInPandas(unpack, RECORD)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/vigilake-llm/warc-{uuid.uuid4().hex}"
    index = write_bundles(classify(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    return read_frames(spark, folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
