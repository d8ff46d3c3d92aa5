"""Operator 7, WARC archives as seekable Zstandard bundles.

A bundle holds WARC/1.1 records grouped into independent Zstandard frames, then a seek table in a skippable frame
(the public seekable format: sizes of every frame, and a footer), which any Zstandard reader skips. An index table maps each
record to its bundle, its frame and its place in the unpacked frame, so one record costs one seek and one
frame. Each task writes bundles of its own under a name of its own, renames them when they are whole, and
only then tells their index rows; what a lost or repeated task leaves behind is in no index.

Of the records whose payloads are equal (SHA-1) and at least `least` bytes long, that with the largest id is a response
and the others are revisits that refer to it and have no payload; smaller payloads are all responses.

Defined results: a null payload is an empty one; a row without id is a response unless its payload is kept under an id;
rows that share the id which is the largest of their payload are all responses; a null url is left out of its record;
an empty table gives no bundles and an empty index; other columns are ignored, whatever their names. A record lies whole in
one frame, so a payload of any length that a row holds makes a frame of its own length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, own_dir, written

#: Fixed values of the Zstandard seekable format: magic of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "id long, path string, frame int, at int, size int"
RECORD = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(i: int | None) -> str:
    return f"<urn:x-page:{'none' if i is None else i}>"


def record(i: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: the HTTP header tells the payload's length, also where a revisit leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(i)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in url))
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at `at` and where the next begins. A response's digest is checked against its payload."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at byte {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != length or digest(payload) != told):
        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
    of = lambda x: None if x is None or x == "<urn:x-page:none>" else int(x[12:-1])
    url = head.get("WARC-Target-URI")
    if url is not None:
        for code, c in (("%0D", "\r"), ("%0A", "\n"), ("%25", "%")):
            url = url.replace(code, c)
    row = {"id": of(head["WARC-Record-ID"]), "url": url, "record_type": kind, "refers_to": of(head.get("WARC-Refers-To")), "payload_bytes": length, "payload_digest": told, "payload": payload if kind == "response" else None}
    return row, end + 4 + len(block) + 4


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme of the file system in which Spark finds it, which is not always the local one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()


def _opened(path: str):
    """(file system, path in it) of a path with or without a scheme. Stores that pyarrow knows are supported."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Bundle:
    """Writes one seekable bundle."""

    def __init__(self, path: str, level: int = 3):
        import zstandard

        self.path, self.pack = path, zstandard.ZstdCompressor(level=level).compress
        self.fs, self.place = _opened(path)
        self.fs.create_dir(self.place.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.place + ".part")
        self.sizes: list[tuple[int, int]] = []

    def frame(self, data: bytes) -> None:
        packed = self.pack(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.out.close()
        self.fs.move(self.place + ".part", self.place)


class Reader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, path: str):
        import zstandard

        fs, place = _opened(path)
        self.file, self.unpack = fs.open_input_file(place), zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        each = 12 if flags & 0x80 else 8
        table = self.file.read_at(n * each, size - 9 - n * each)
        self.sizes = [struct.unpack_from("<II", table, i * each) for i in range(n)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        packed, size = self.sizes[k]
        return self.unpack(self.file.read_at(packed, self.starts[k]), max_output_size=size) if size else b""

    def record(self, frame: int, at: int) -> dict:
        return parse(self.frame(frame), at)[0]


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the records under folder and returns their index, which is written already. A folder without a scheme is Spark's default one's."""
    folder = qualified(pages.sparkSession, folder)
    rows = bounded_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    # The keepers of payloads that come again: where there are few, Spark broadcasts them, else rows meet by digest.
    again = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("sha", "keeper")
    told = rows.join(again, "sha", "left").select("id", "url", F.when((F.octet_length("payload") >= least) & ~F.col("keeper").eqNullSafe(F.col("id")), F.col("keeper")).alias("refers_to"), "payload")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, held, size, total, index = None, [], 0, 0, []

        def flush() -> None:
            nonlocal size
            bundle.frame(b"".join(held))
            held.clear()
            size = 0

        def told() -> pa.RecordBatch:
            bundle.close()
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["id", "path", "frame", "at", "size"])
            index.clear()
            return out

        for batch in batches:
            for i, url, refers, payload in zip(*(batch.column(k) for k in range(4)), strict=True):
                if bundle is None:
                    bundle, total = Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst"), 0
                data = record(i.as_py(), url.as_py(), payload.as_py(), refers.as_py(), date)
                index.append((i.as_py(), bundle.path, len(bundle.sizes), size, len(data)))
                held.append(data)
                size += len(data)
                total += len(data)
                if size >= frame_bytes:
                    flush()
                if total >= bundle_bytes:
                    if held:
                        flush()
                    yield told()
                    bundle = None
        if bundle is not None:
            if held:
                flush()
            yield told()

    return written(told.mapInArrow(work, INDEX))


def read_bundles(index: DataFrame, payloads: bool = True, task_bytes: int = 16 << 20) -> DataFrame:
    """The records of the bundles in the index, read frame by frame; a task unpacks about task_bytes."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = reader = None
        for batch in batches:
            for p, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != path:
                    path, reader = p, Reader(p)
                data, at, rows = reader.frame(k), 0, []
                while at < len(data):
                    row, at = parse(data, at)
                    rows.append(row if payloads else row | {"payload": None})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # Tasks by the bytes to unpack: the index itself is so small that its own size would give one.
    frames = index.groupBy("path", "frame").agg(F.sum("size").alias("size"))
    tasks = max(1, -(-(frames.agg(F.sum("size")).first()[0] or 0) // task_bytes))
    dealt = frames.repartitionByRange(tasks, "path", "frame") if tasks > 1 else frames
    return dealt.select("path", "frame").sortWithinPartitions("path", "frame").mapInArrow(work, RECORD)


def read_record(path: str, frame: int, at: int) -> dict:
    """One record, by its row of the index."""
    return Reader(path).record(frame, at)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """What the archives of pages say of each page, read back from them."""
    index = write_bundles(pages, f"{own_dir(spark)}/warc-{uuid.uuid4().hex}", least=least)
    return read_bundles(index, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
