"""Seekable Zstandard WARC bundles.

Each task writes one archive to the shared folder: records are grouped into
independent Zstandard frames of about ``frame_bytes``, and a footer seek table
(a skippable frame in the public seekable layout) lists every frame's size.
An index maps record ids to (archive, frame, offset and length inside the
frame).  Archive names are unique per attempt and only those of finished
tasks reach the index, so a repeated task leaves no trace.

Of records with equal payloads of at least ``min_bytes`` the one with the
largest id is a response; the others are revisits that refer to it and carry
no payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_store, shared_path, stage

MIN_BYTES = 1000
FRAME_BYTES = 1 << 18
BROADCAST_GROUPS = 200_000  # groups of equal payloads (about 100 bytes each) that are broadcast
SKIP, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the public format
ID = "urn:x-page:"


def payload_table(df: DataFrame, id_col: str, url_col: str, body_col: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, url, body, refers_to): body null and refers_to set for revisits."""
    body = F.coalesce(F.col(body_col).cast("string").cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), body.alias("body"))
    key = F.sha2(F.col("body"), 256)
    large = F.octet_length("body") >= min_bytes
    groups = (
        rows.filter(large)
        .select(key.alias("same"), "id")
        .groupBy("same")
        .agg(F.max("id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 and first_id is not null")
        .select("same", "first_id", "n")
    )
    groups = stage(groups, "equal-payloads")
    small = groups.count() <= BROADCAST_GROUPS
    met = join_groups(rows.withColumn("same", F.when(large, key)), groups, None if small else rows.count())
    again = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return met.select("id", "url", "body", F.when(again, F.col("first_id")).alias("refers_to"))


def join_groups(rows: DataFrame, groups: DataFrame, total: int | None) -> DataFrame:
    """``rows`` with first_id of their group.  Without ``total`` the groups are
    broadcast.  Else those of more than total / (4 * partitions) rows are (at
    most 4 * partitions of them), the others are joined by key, and rows that
    belong to neither are spread by a number of their own."""
    if total is None:
        return rows.join(F.broadcast(groups.drop("n")), "same", "left")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col("n") > max(64, total // (4 * parts))
    first = groups.filter(hot).select("same", F.col("first_id").alias("hot_id"))
    met = rows.join(F.broadcast(first), "same", "left")
    apart = F.col("same").isNull() | F.col("hot_id").isNotNull()
    key = F.when(apart, F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.col("same"))
    rest = groups.filter(~hot).select(F.col("same").alias("key"), "first_id")
    return met.withColumn("key", key).join(rest, "key", "left").withColumn("first_id", F.coalesce("hot_id", "first_id")).drop("key", "hot_id")


def record(page, url, body: bytes, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps digest and length of the payload."""
    digest = hashlib.sha1(body).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{page}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{ID}{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Writer:
    """Frames and their seek table into an open output stream."""

    def __init__(self, out, frame_bytes: int):
        import zstandard

        self.out, self.limit = out, frame_bytes
        self.press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.parts, self.size, self.frames = [], 0, []

    def add(self, raw: bytes) -> tuple[int, int]:
        """(frame, offset inside the frame) of the record."""
        if self.parts and self.size + len(raw) > self.limit:
            self.flush()
        at = (len(self.frames), self.size)
        self.parts.append(raw)
        self.size += len(raw)
        return at

    def flush(self) -> None:
        if self.parts:
            packed = self.press.compress(b"".join(self.parts))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = np.array(self.frames, "<u4").reshape(-1, 2).tobytes()
        tail = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIP, len(tail)) + tail)
        self.out.close()


def seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer."""
    end = f.size()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table (or one with checksums)")
    f.seek(end - 9 - 8 * n)
    sizes = np.frombuffer(f.read(8 * n), "<u4").reshape(-1, 2).astype(np.int64)
    starts = np.cumsum(sizes[:, 0]) - sizes[:, 0]
    return [(int(a), int(b), int(c)) for a, (b, c) in zip(starts, sizes, strict=True)]


def read_frame(f, offset: int, packed: int, size: int) -> bytes:
    import zstandard

    f.seek(offset)
    return zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)


def parse(frame: bytes) -> Iterator[tuple[dict[str, str], bytes, int, bytes]]:
    """(headers, record's block, payload length by its HTTP header, payload)."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        lines = frame[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(x.split(": ", 1) for x in lines[1:])
        size = int(head["Content-Length"])
        block = frame[end + 4 : end + 4 + size]
        if frame[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("cut-off WARC record")
        http, _, payload = block.partition(b"\r\n\r\n")
        yield head, block, int(http.rpartition(b"Content-Length: ")[2]), payload
        at = end + 8 + size


def write_bundles(
    rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES
) -> DataFrame:
    """Write ``payload_table`` rows as archives below ``folder`` and return the
    index: record, archive, frame, offset, length.  An empty partition writes
    no archive."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        name = f"{uuid.uuid4().hex}.warc.zst"
        out = None
        for pdf in parts:
            index = []
            for page, url, body, refers in zip(pdf["id"], pdf["url"], pdf["body"], pdf["refers_to"], strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = Writer(store.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                page = None if pd.isna(page) else int(page)
                refers = None if pd.isna(refers) else int(refers)
                raw = record("null" if page is None else page, url, bytes(body), refers, date)
                frame, at = out.add(raw)
                index.append((f"{ID}{'null' if page is None else page}", name, frame, at, len(raw)))
            yield pd.DataFrame(index, columns=["record", "archive", "frame", "offset", "length"])
        if out is not None:
            out.close()

    # nullable ids must not turn into floats on the way
    typed = rows.select(F.col("id").cast("string"), "url", "body", F.col("refers_to").cast("string"))
    index = typed.mapInPandas(write, "record string, archive string, frame int, offset bigint, length bigint")
    path = f"{folder}/index"
    index.write.parquet(path)
    return rows.sparkSession.read.schema(index.schema).parquet(path)


PAGES = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_bundles(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Every record of the index's archives, read frame by frame through the
    seek tables; a payload that does not fit its digest raises."""

    def pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        for pdf in parts:
            for archive, frames in pdf.groupby("archive")["frame"]:
                with store.open_input_file(f"{root}/{archive}") as f:
                    table = seek_table(f)
                    for k in frames:
                        rows = []
                        for head, _, size, body in parse(read_frame(f, *table[k])):
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            kind = head["WARC-Type"]
                            if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
                                raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                            page = _number(head["WARC-Record-ID"])
                            rows.append((page, size, digest, kind, _number(head.get("WARC-Refers-To")), body if payload else None))
                        out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                        yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    frames = index.select("archive", "frame").distinct()
    # dealt out evenly by number: a row stands for a whole frame of work, and a
    # split by key or size would be merged into one task
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartition(parts).mapInPandas(pages, PAGES)


def read_records(index_rows: DataFrame, folder: str) -> DataFrame:
    """(record, raw) of index rows, by frame and offset: only the frames that
    hold them are read."""

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = open_store(folder)
        for pdf in parts:
            for (archive, frame), rows in pdf.groupby(["archive", "frame"]):
                with store.open_input_file(f"{root}/{archive}") as f:
                    raw = read_frame(f, *seek_table(f)[frame])
                yield pd.DataFrame({"record": rows["record"], "raw": [raw[a : a + n] for a, n in zip(rows["offset"], rows["length"])]})

    return index_rows.repartition("archive", "frame").mapInPandas(fetch, "record string, raw binary")


def _number(urn: str | None) -> int | None:
    return None if urn is None or urn.endswith(":null>") else int(urn[len(ID) + 1 : -1])


def roundtrip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write one record per row, read all archives back: page_id,
    payload_bytes, payload_digest, record_type, refers_to.

    Null bodies are empty payloads.  Rows that repeat the largest id of a
    group of equal payloads are responses too; a null id is the smallest and a
    group of null ids only has no revisits.  Empty tables give empty results."""
    folder = shared_path(df.sparkSession, "warc")
    index = write_bundles(payload_table(df, id_col, url_col, body_col), folder)
    return read_bundles(index, folder, payload=False).drop("payload")
