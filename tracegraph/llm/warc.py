"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle is a file of frames
with a seek table at its end (a skippable frame in the layout of the published
Zstandard seekable format), so any record can be read by fetching one frame. The
index maps a record to its bundle, the number of its frame and its place inside the frame;
where a frame lies in the file is what the seek table says.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest
page id carries the payload (``response``); the others are ``revisit`` records that
refer to it. Smaller payloads are always stored.

Scale and recovery: bundles are written inside tasks, in the partitioning of the scan;
a task holds one frame. A bundle's name is new for every attempt, and only the index
(written by Spark's committer) makes it known, so an attempt that is lost or run
twice leaves at most files nobody refers to. Equal payloads are found on digests, with
a map-side combine. Reading deals runs of ``RUN`` neighbouring frames to tasks of about
``TASK_BYTES`` unpacked bytes, so their number grows with the archive; a task holds one frame.

Defined cases: a null html is an empty payload; a null url is written without a target;
rows without a page id are records too (never the one referred to, unless nothing else
holds the payload: then each is a response); rows repeating the smallest page id are all
responses; an empty table gives no bundle.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, small_batches, staged

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: reading: frames of a bundle that stay together, and unpacked bytes of a task
RUN, TASK_BYTES = 16, 64 << 20
INDEX = "page_id long, bundle string, frame int, frame_start long, frame_size long, start long, size long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_bytes(page_id, url, payload: bytes, n: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; ``refers_to``: the page a revisit refers to, else None."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    page = lambda s: int(s[10:-1]) if len(s) > 11 else None
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if h["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != n):
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    return {
        "page_id": page(h["WARC-Record-ID"]),
        "url": h.get("WARC-Target-URI"),
        "record_type": h["WARC-Type"],
        "payload_bytes": n,
        "payload_digest": digest,
        "refers_to": page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None,
        "payload": payload if h["WARC-Type"] == "response" else None,
    }


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """``frames``: (compressed size, size, low 32 bits of XXH64 of the content)."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), 0x80, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """The frames named by the seek table at the end of ``tail``."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    entries = tail[-9 - n * width : -9]
    return [(*struct.unpack_from("<II", entries, i * width), struct.unpack_from("<I", entries, i * width + 8)[0] if flags & 0x80 else 0) for i in range(n)]


def frames_in(file) -> list[tuple[int, int]]:
    """(start, compressed size) of the frames of an open bundle, by its seek table."""
    end = file.size()
    file.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    table = 9 + n * (12 if flags & 0x80 else 8)
    if magic != SEEKABLE or table > end:
        raise ValueError("no seek table")
    file.seek(end - table)
    sizes = [packed for packed, _, _ in read_seek_table(file.read(table))]
    return list(zip(itertools.accumulate(sizes, initial=0), sizes, strict=False))


class Bundle:
    """A file under construction: records fill a frame, frames follow each other."""

    def __init__(self, folder: str, frame_bytes: int):
        import zstandard
        from pyarrow import fs

        self.files, path = fs.FileSystem.from_uri(folder)
        self.files.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.files.open_output_stream(f"{path}/{self.name}", compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True)
        self.frame_bytes, self.at, self.frames = frame_bytes, 0, []
        self.buffer, self.waiting = bytearray(), []

    def add(self, page_id, record: bytes) -> list[tuple]:
        self.waiting.append((page_id, len(self.buffer), len(record)))
        self.buffer += record
        return self.flush() if len(self.buffer) >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        """Index rows of the frame that is written now."""
        import xxhash

        if not self.waiting:
            return []
        data = bytes(self.buffer)
        packed = self.zstd.compress(data)
        self.out.write(packed)
        rows = [(p, self.name, len(self.frames), self.at, len(packed), s, n) for p, s, n in self.waiting]
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.at += len(packed)
        self.buffer, self.waiting = bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return rows


def write_archive(pages: DataFrame, folder: str, id_col="page_id", url_col="url", html_col="html", min_bytes: int = 100, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20) -> DataFrame:
    """Writes the bundles below ``folder`` and returns the index (``INDEX``), one row per input row."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        F.encode(html, "UTF-8").alias("payload"),
        F.sha2(html, 256).alias("digest"),
    )
    sized = pages.select(F.col(id_col).alias("page_id"), F.octet_length(html).alias("n"), F.sha2(html, 256).alias("digest"))
    equal = sized.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
    equal = staged(equal.where("c > 1").drop("c"), "warc-equal")
    p = p.join(equal, "digest", "left")
    p = p.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    p = p.select("page_id", "url", "digest", "refers_to", F.octet_length("payload").alias("n"), F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, names = None, [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            rows = []
            for page_id, url, digest, refers_to, n, payload in zip(*[batch[c].astype(object).where(batch[c].notna(), None) for c in ("page_id", "url", "digest", "refers_to", "n", "payload")], strict=True):
                bundle = bundle or Bundle(folder, frame_bytes)
                whole = lambda x: None if x is None else int(x)
                rows += bundle.add(whole(page_id), record_bytes(whole(page_id), url, bytes(payload or b""), int(n), digest, whole(refers_to)))
                if bundle.at >= bundle_bytes:
                    rows, bundle = rows + bundle.close(), None
            yield frame_of(rows, names)
        if bundle:
            yield frame_of(bundle.close(), names)

    with small_batches(pages.sparkSession):
        return staged(p.mapInPandas(write, INDEX), "warc-index")


def frame_of(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["page_id"] = out["page_id"].astype("Int64")
    return out


def read_archive(index: DataFrame, folder: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records (``RECORD``) that ``index`` names, each frame fetched through the seek table
    of its bundle and unpacked once. The number of tasks follows from the unpacked bytes."""
    total = index.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    run = F.floor(F.col("frame") / RUN)
    dealt = index.select("bundle", run.alias("run"), "frame", "start", "size").repartition(-(-total // task_bytes) or 1, "bundle", "run")
    # a frame has a bounded number of records: its bytes are bounded, and a record has some hundred at least
    frames = dealt.groupBy("bundle", "run", "frame").agg(F.collect_list(F.struct("start", "size")).alias("records"))
    frames = frames.sortWithinPartitions("bundle", "frame")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        unzstd, names = zstandard.ZstdDecompressor(), [x.split()[0] for x in RECORD.split(", ")]
        name = file = places = None
        try:
            for batch in batches:
                for bundle, frame, records in zip(batch["bundle"], batch["frame"], batch["records"], strict=True):
                    if bundle != name:
                        if file is not None:
                            file.close()
                        name, file = bundle, files.open_input_file(f"{path}/{bundle}")
                        places = frames_in(file)
                    start, size = places[frame]
                    file.seek(start)
                    data = unzstd.decompress(file.read(size))
                    out = pd.DataFrame([parse_record(data[r["start"] : r["start"] + r["size"]]) for r in records], columns=names)
                    yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if file is not None:
                file.close()

    return frames.mapInPandas(read, RECORD)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes all pages and reads the records back from the bundles."""
    folder = shared_path(pages.sparkSession, "warc")
    return read_archive(write_archive(pages, folder, **columns), folder)


ORACLE = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (digest)
"""
