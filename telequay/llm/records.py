"""Operator 8: token ids as length-delimited binary records.

A file holds an 8-byte magic and then records: length (u64), masked checksum of
the length (u32), body, masked checksum of the body (u32), little-endian.  A
body is the doc_id (i64), a flag byte (1: doc_id is null), the width of an id
(2 or 4) and the ids.  Beside each file lies an index: the offset of every
record as u64, so records can be read in any order.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import filesystem, shared_dir, written

MAGIC = b"TQREC01\n"
END_ID = 2
#: White space, and characters that only some tables take for it.
_SPACES = r"\s\x1c-\x1f\u180e\u200b"
#: No token spans such a place: a blank or line end after a character that no table takes for white space.
_CUT = re.compile(rf"(?<=[^{_SPACES}])(?=[ \n])")
_WIDE = re.compile(rf"[{_SPACES}][{_SPACES}]")
#: Without white space side by side these are all blanks and line ends.
_NARROW = re.compile("[ \n][^ \n]*").findall
#: Chunks that end in white space may be cut otherwise beside another.
_BLANKS = set(filter(re.compile(f"[{_SPACES}]").match, map(chr, range(0x3100))))


def chunks(text: str) -> list[str]:
    """A text cut where no token of a byte-level or marked-word vocabulary spans the place; all but the first begin with a blank or line end."""
    if _WIDE.search(text):
        return _CUT.split(text)
    if text[0] in " \n":
        return _NARROW(text)
    out = _NARROW(" " + text)
    out[0] = out[0][1:]
    return out


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted so that checksums of data holding checksums stay useful."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked(length)), body, struct.pack("<I", masked(body))))


def unframe(f, at: int | None = None) -> bytes | None:
    """The next body of an open file (or the one at an offset); None at its end."""
    if at is not None:
        f.seek(at)
    head = f.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    body = f.read(n + 4)
    if len(body) != n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise ValueError("a record's body is damaged")
    return body[:n]


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    return struct.pack("<qBB", doc_id or 0, doc_id is None, ids.dtype.itemsize) + ids.tobytes()


def unpack(body: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack("<qBB", body[:10])
    return None if null else doc_id, np.frombuffer(body, f"<u{width}", offset=10)


class Remembered:
    """Results by key; of what was not used for a while, the older half goes."""

    def __init__(self, keep: int):
        self.keep, self.young, self.old = keep, {}, {}

    def missing(self, keys) -> list:
        """Which keys have to be worked out; the others are in ``young`` from now on."""
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for k in keys:
            if k not in young:
                v = old.get(k)
                if v is None:
                    out.append(k)
                else:
                    young[k] = v
        return out


class Encoder:
    """Ids of whole texts by the tokenizers library, remembered by chunk.

    New chunks go to the library many at once, side by side: as no token spans
    two of them, their ids are told apart by the tokens' lengths in bytes.
    Texts that hold one of its added tokens go to it whole.
    """

    def __init__(self, path: str, keep: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Remembered(keep)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        top = max([self.tokenizer.get_vocab_size() - 1, END_ID, *self.tokenizer.get_added_tokens_decoder()])
        self.length = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(top + 1)], np.int64)  # a letter for each byte
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")

    def one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def learn(self, new: list[str]) -> None:
        known = self.known.young
        led = [c for c in new if c and c[0] in " \n" and c[-1] not in _BLANKS]
        for lo in range(0, len(led), 500):
            own = led[lo:lo + 500]
            ids = np.array(self.tokenizer.encode("".join(own), add_special_tokens=False).ids, self.dtype)
            at, ends = np.cumsum(self.length[ids]), np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in own])
            k = np.searchsorted(at, ends)
            if k[-1] < at.size and (at[k] == ends).all():  # else one by one
                cut, data = [0, *(self.dtype.itemsize * (k + 1)).tolist()], ids.tobytes()
                known.update(zip(own, [data[i:j] for i, j in zip(cut, cut[1:])]))
        for c in new:
            if c not in known:
                known[c] = self.one(c) if c else b""

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        cut = [None if any(s in t for s in self.special) else chunks(t) if t else [] for t in texts]
        self.learn(self.known.missing(set().union(*[c for c in cut if c])))
        of = self.known.young.__getitem__
        return [self.one(t) if c is None else b"".join(map(of, c)) for t, c in zip(texts, cut)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_records(rows: DataFrame, *, vocabulary: str, folder: str, end_id: int = END_ID, texts_at_once: int = 256) -> DataFrame:
    """Encode (doc_id, text) and write a file per partition, in ascending doc_id order over all files.

    Returns a row per file: part, path, n_docs, n_ids.  A file is written under
    a name of its own and then moved, so a task that runs twice leaves one.
    """

    def write(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}"
        temporary = f"{root}/_{task.partitionId():06d}-{task.taskAttemptId()}-{os.getpid()}"
        enc = encoder(vocabulary)
        tail = np.array([end_id], enc.dtype).tobytes()
        at, offsets, n_ids = len(MAGIC), [], 0
        with fs.open_output_stream(temporary, buffer_size=4 << 20) as f:
            f.write(MAGIC)
            for batch in batches:
                for lo in range(0, batch.num_rows, texts_at_once):
                    part = batch.slice(lo, texts_at_once)
                    texts = [x or "" for x in part.column(1).to_pylist()]
                    for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(texts)):
                        ids = np.frombuffer(ids + tail, enc.dtype)
                        record = frame(pack(doc_id, ids))
                        offsets.append(at)
                        at += len(record)
                        n_ids += ids.size
                        f.write(record)
        with fs.open_output_stream(f"{temporary}.idx") as f:
            f.write(np.array(offsets, "<u8").tobytes())
        fs.move(f"{temporary}.idx", f"{name}.idx")
        fs.move(temporary, f"{name}.rec")
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([task.partitionId()], pa.int64()), "path": pa.array([f"{name}.rec"], pa.string()),
            "n_docs": pa.array([len(offsets)], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long")


def read_records(files: DataFrame, folder: str) -> DataFrame:
    """Read files back record by record: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: those of earlier files,
    from the table of files (one row each), and those before it in its own.
    """

    def read(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                with fs.open_input_stream(path, buffer_size=4 << 20) as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError("not a file of records")
                    while (body := unframe(f)) is not None:
                        doc_id, ids = unpack(body)
                        out.append((doc_id, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes())))
                        start += ids.size
                        if len(out) == 10_000:
                            yield table(out)
                            out = []
                if out:
                    yield table(out)

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", before.alias("start")).repartition(n, "path").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(documents: DataFrame, *, vocabulary: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every whole text, with ``end_id`` after each, and read the files back.

    Null texts count as empty (only the end id); null doc_ids come first; rows
    with equal doc_id go by text; an empty table gives an empty result.
    """
    folder = folder or shared_dir(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read_records(written(write_records(rows, vocabulary=vocabulary, folder=folder, end_id=end_id)), folder)
