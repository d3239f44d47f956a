"""Texts as media payloads in archives, read back through a Spark data source.

Payloads are stored as 8-bit greyscale PNG images of 192 samples a row inside
uncompressed zip archives. The data source lists archives, plans byte ranges
of them without looking inside, and each range's task reads the archive's
directory, streams its members in Arrow batches and retries each member by its
own offset.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import cut, scratch

ROW = 192
_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes) -> bytes:
    """``data`` padded with spaces to rows of 192 samples, as an 8-bit greyscale PNG that also notes the unpadded length."""
    rows = max(1, -(-len(data) // ROW))
    grid = np.zeros((rows, ROW + 1), np.uint8)  # a zero before each row: no filter
    grid[:, 1:] = np.frombuffer(data.ljust(rows * ROW), np.uint8).reshape(rows, ROW)
    return _MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"bytes\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(grid.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> tuple[int, bytes]:
    """(unpadded length, payload) of a picture made by ``to_png``."""
    at, size, packed, width = len(_MAGIC), 0, [], ROW
    while at < len(png):
        (n,), kind = struct.unpack(">I", png[at : at + 4]), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise OSError("damaged picture")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            size = int(body[6:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    grid = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    return size, grid[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, spread and entropy of the samples and a 64-bit gradient hash of a 9 x 8 thumbnail."""
    a = np.frombuffer(payload, np.uint8)
    p = np.bincount(a, minlength=256) / len(a)
    bits = p[p > 0]
    cells = np.add.reduceat(a.astype(np.int64), np.arange(72) * len(a) // 72)
    size = np.diff(np.append(np.arange(72) * len(a) // 72, len(a)))
    small = (cells / size).reshape(8, 9)
    mark = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    return f"{a.mean():.4f}:{a.std():.4f}:{-(bits * np.log2(bits)).sum():.4f}:{mark}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Store every text of (doc_id, text) as a member of some archive below ``folder``; returns (archive, members, bytes).

    An archive has a temporary name until it is whole, so that a task that
    dies leaves nothing that a reader takes up; a task that runs again writes
    archives of the same names. A null text is an empty one.
    """

    def work(batches):
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        part, made = TaskContext.get().partitionId(), 0
        done: list[tuple] = []
        members, out, temp, z = 0, None, "", None

        def close():
            nonlocal made, members, out, z
            z.close()
            out.close()
            final = f"{root}/part-{part:06d}-{made:04d}.zip"
            where.move(temp, final)
            done.append((final, members, where.get_file_info(final).size))
            made, members, out, z = made + 1, 0, None, None

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if z is None:
                    temp = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                    out = where.open_output_stream(temp)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                name = zipfile.ZipInfo(f"{members:08d}.{'null' if d is None else d}.png", (1980, 1, 1, 0, 0, 0))
                z.writestr(name, to_png((t or "").encode("utf-8", "surrogatepass")))
                members += 1
                if out.tell() >= archive_bytes:
                    close()
        if z is not None:
            close()
        cols = list(zip(*done, strict=True)) or [[], [], []]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["archive", "members", "bytes"])

    return cut(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(work, "archive string, members long, bytes long"))


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveSource(DataSource):
    """``spark.read.format("archives").option("path", folder)``: archive, member, offset, size, payload.

    Options: range_bytes (32 MiB) of an archive for each partition, batch_bytes
    (8 MiB) of payload for each Arrow batch, tries (4) for each member.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, member string, offset long, size long, payload binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", 32 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 8 << 20))
        self.tries = int(options.get("tries", 4))

    def partitions(self) -> list[InputPartition]:
        """Byte ranges from the archives' sizes alone; a member belongs to the range where it begins."""
        where, root = fs.FileSystem.from_uri(self.path)
        files = sorted((f.path, f.size) for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.path.endswith(".zip"))
        return [ByteRange(p, a, min(a + self.range_bytes, n)) for p, n in files for a in range(0, n, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        where, _ = fs.FileSystem.from_uri(self.path)
        entries = self._again(lambda: self._directory(where, partition))
        rows: list[tuple] = []
        held = 0
        for e in entries:
            payload = self._again(lambda e=e: self._member(where, partition.archive, e))
            rows.append((partition.archive, e.filename, e.header_offset, len(payload), payload))
            held += len(payload)
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _again(self, act):
        for k in range(self.tries):
            try:
                return act()
            except (OSError, zipfile.BadZipFile):
                if k + 1 == self.tries:
                    raise
                time.sleep(0.2 * 2**k)

    @staticmethod
    def _directory(where, partition: ByteRange) -> list[zipfile.ZipInfo]:
        with where.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            return sorted((e for e in z.infolist() if partition.start <= e.header_offset < partition.end), key=lambda e: e.header_offset)

    @staticmethod
    def _member(where, archive: str, e: zipfile.ZipInfo) -> bytes:
        """The member's bytes, read at its own offset and checked against the directory's CRC."""
        with where.open_input_file(archive) as f:
            f.seek(e.header_offset)
            head = f.read(30)
            if head[:4] != b"PK\x03\x04":
                raise OSError(f"no member at {e.header_offset} of {archive}")
            names = struct.unpack("<HH", head[26:30])
            f.seek(e.header_offset + 30 + sum(names))
            data = f.read(e.compress_size)
        if len(data) != e.compress_size or zlib.crc32(data) != e.CRC:
            raise OSError(f"damaged member {e.filename} of {archive}")
        return data

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "member", "offset", "size", "payload"])


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").option("path", folder).options(**options).load()


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text, read the stored bytes back, and compute from them.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature for every row of (doc_id, text). Null
    and empty texts give one row of spaces; equal texts give equal values; a
    null doc_id stays null; repeated rows are stored each.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "archives")
    write_archives(docs, folder)

    def work(batches):
        for b in batches:
            rows: list[tuple] = []
            for name, png in zip(b.column("member").to_pylist(), b.column("payload").to_pylist(), strict=True):
                n, data = from_png(png)
                d = name.split(".")[1]
                rows.append((None if d == "null" else int(d), n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(png), hashlib.sha256(png).hexdigest(), feature(data)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return read_archives(spark, folder).select("member", "payload").mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
