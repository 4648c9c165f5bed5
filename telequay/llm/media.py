"""Operator 2: media columns.

Payloads are kept as members of ZIP archives; each member is a grey-scale PGM
image whose 8-bit samples are the payload.  ``MediaArchive`` is a Spark data
source: it plans byte ranges of the archives, each task reads the archive's
directory, streams its range in large reads, yields Arrow batches, and reads a
member that fails again by its own offset.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import filesystem, shared_dir, written

WIDTH = 64
_HEADER = re.compile(rb"P5\n# bytes (\d+)\n(\d+) (\d+)\n255\n")


def to_media(text: str | None) -> bytes:
    """The PGM image of a text: UTF-8, bytes 0 appended up to a positive multiple of 64."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // WIDTH))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(raw), WIDTH, rows) + raw.ljust(rows * WIDTH, b"\0")


def from_media(media: bytes) -> tuple[int, bytes]:
    """(unpadded length, payload) of a PGM image made by ``to_media``."""
    m = _HEADER.match(media)
    if not m:
        raise ValueError("not a PGM image of a payload")
    payload = media[m.end():]
    if len(payload) != int(m[2]) * int(m[3]):
        raise ValueError("the image has another size than its header says")
    return int(m[1]), payload


def feature(payload: bytes) -> str:
    """Average hash of the image on an 8 x 8 grid, mean and spread, all in integers."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    h = image.shape[0]
    columns = image.reshape(h, 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    down = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(columns, axis=0)])
    lo = np.arange(8) * h // 8
    hi = np.maximum(lo + 1, (np.arange(8) + 1) * h // 8)
    cells = (down[hi] - down[lo]) * 1000 // ((hi - lo) * (WIDTH // 8))[:, None]
    bits = (cells.ravel() * 64 > cells.sum()).astype(np.uint8)
    total = int(image.sum(dtype=np.int64))
    squares = int(np.dot(np.bincount(image.ravel(), minlength=256), np.arange(256, dtype=np.int64) ** 2))
    n = image.size
    return f"{np.packbits(bits).tobytes().hex()}-{total // n}-{(squares * n - total * total) // (n * n)}"


def write_archives(rows: DataFrame, *, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write (doc_id, text) as archives in ``folder``; returns a row per archive: path, members.

    An archive is written under a name of its own and then moved to the name of
    its partition, so a task that runs twice leaves one archive.
    """

    def write(batches):
        import os
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        done, names, counts = 0, [], []
        sink = archive = temporary = None

        def close():
            nonlocal archive, done
            archive.close()
            sink.close()
            names.append(f"{root}/part-{task.partitionId():06d}-{done:04d}.zip")
            fs.move(temporary, names[-1])
            done, archive = done + 1, None

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if archive is None:
                    temporary = f"{root}/_{task.partitionId():06d}-{task.taskAttemptId()}-{os.getpid()}"
                    sink = fs.open_output_stream(temporary)
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                    counts.append(0)
                name = f"{counts[-1]:08d}.{'null' if doc_id is None else doc_id}.pgm"
                archive.writestr(zipfile.ZipInfo(name), to_media(text), zipfile.ZIP_DEFLATED, 1)
                counts[-1] += 1
                if sink.tell() >= archive_bytes:
                    close()
        if archive is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string()), "members": pa.array(counts, pa.int64())})

    return rows.select("doc_id", "text").mapInArrow(write, "path string, members long")


class _Range(InputPartition):
    def __init__(self, path: str, size: int, lo: int, hi: int):
        self.path, self.size, self.lo, self.hi = path, size, lo, hi


def read_member(f, info: zipfile.ZipInfo, chunk: memoryview | None) -> bytes:
    """The bytes of a member from ``chunk``, or from the file at the member's offset; checks its CRC."""
    if chunk is None:
        f.seek(info.header_offset)
        head = f.read(30)
        n, m = struct.unpack("<HH", head[26:30])
        f.seek(info.header_offset + 30 + n + m)
        raw = f.read(info.compress_size)
    else:
        n, m = struct.unpack("<HH", chunk[26:30])
        raw = chunk[30 + n + m:30 + n + m + info.compress_size]
    data = bytes(raw) if info.compress_type == zipfile.ZIP_STORED else zlib.decompressobj(-15).decompress(raw)
    if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise ValueError("a member's length or checksum is wrong")
    return data


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.step = int(options.get("rangebytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 8 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self):
        from pyarrow import fs as pafs

        fs, root = filesystem(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        return [_Range(x.path, x.size, lo, lo + self.step)
                for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".zip")
                for lo in range(0, max(1, x.size), self.step)] or [_Range("", 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        fs, _ = filesystem(self.folder)
        with fs.open_input_file(part.path) as f:
            infos = zipfile.ZipFile(io.BufferedReader(f, 1 << 20) if not hasattr(f, "seekable") else f).infolist()
            starts = [x.header_offset for x in infos]
            ends = dict(zip(starts, [*starts[1:], part.size]))
            own = [x for x in infos if part.lo <= x.header_offset < part.hi]
            at, out, held = 0, [], 0
            while at < len(own):
                lo, last = own[at].header_offset, at
                while last + 1 < len(own) and ends[own[last + 1].header_offset] - lo <= self.batch:
                    last += 1
                f.seek(lo)
                chunk = memoryview(f.read(ends[own[last].header_offset] - lo))  # members are views of it, not copies
                for info in own[at:last + 1]:
                    data, error = None, None
                    for attempt in range(self.retries + 1):
                        try:
                            data, error = read_member(f, info, chunk[info.header_offset - lo:] if not attempt else None), None
                            break
                        except (OSError, ValueError, struct.error, zlib.error) as x:
                            error = str(x)
                    out.append((part.path, info.filename, info.header_offset, data, error))
                    held += info.file_size
                    if held >= self.batch:
                        yield self.arrow(out)
                        out, held = [], 0
                at = last + 1
            if out:
                yield self.arrow(out)

    @staticmethod
    def arrow(rows):
        path, name, offset, media, error = map(list, zip(*rows))
        ids = [None if x.split(".")[1] == "null" else int(x.split(".")[1]) for x in name]
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "path": pa.array(path, pa.string()), "member": pa.array(name, pa.string()),
            "offset": pa.array(offset, pa.int64()), "media": pa.array(media, pa.binary()), "error": pa.array(error, pa.string())})


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``: one row per member.

    Options: rangeBytes (bytes of an archive that one task reads), batchBytes
    (bytes of an Arrow batch), retries (further reads of a failed member).  A
    member that still fails gives a row with ``media`` null and ``error`` set.
    """

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "doc_id long, path string, member string, offset long, media binary, error string"

    def reader(self, schema):
        return _Reader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The members of all archives in ``folder``."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(folder)


def media_columns(media: DataFrame) -> DataFrame:
    """Features of (doc_id, media): one row each, with the sizes and digests read back.

    A member that could not be read has nulls in all columns but doc_id; one that
    is no image of a payload has media_bytes and media_sha256 besides.  Equal ids
    and equal members stay rows of their own; an empty table gives an empty result.
    """

    def columns(batches):
        for batch in batches:
            out = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    out.append((doc_id, *[None] * 7))
                    continue
                try:
                    n, payload = from_media(data)
                except ValueError:  # readable, but no image of a payload
                    out.append((doc_id, *[None] * 4, len(data), hashlib.sha256(data).hexdigest(), None))
                    continue
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
                            len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)

    i64, s = pa.int64(), pa.string()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [i64, i64, i64, s, i64, i64, s, s]
    return media.select("doc_id", "media").mapInArrow(
        columns, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
                 " media_bytes long, media_sha256 string, feature string")


def media_of_documents(documents: DataFrame, *, folder: str | None = None) -> DataFrame:
    """Store every text as a media member, read the archives back, compute the columns.

    Null texts count as empty (one row of 64 zero samples); rows with equal or
    null doc_id stay separate rows; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    folder = folder or shared_dir(spark)
    written(write_archives(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), folder=folder))
    return media_columns(read_archives(spark, folder))
