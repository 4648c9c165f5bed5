"""Operator 6: chat formatting by columnar byte assembly.

Turns are marked ``<|im_start|>role\\ntext<|im_end|>\\n``.  In roles and texts
every ``<|`` gets a backslash between its two characters (one more where there
are some), so control strings only occur where the template put them and
texts come back unchanged.  The loss mask is a list of byte spans.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spread

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
_TURN = re.compile(re.escape(START) + rb"([^\n]*)\n(.*?)" + re.escape(END), re.DOTALL)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(texts: pa.Array) -> pa.Array:
    """Put one more backslash into every ``<`` backslashes ``|``."""
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def unescape(text: bytes) -> bytes:
    return re.sub(rb"<(\\*)\\\|", rb"<\1|", text)


def escape_role(roles: pa.Array) -> pa.Array:
    """A role must stay on its line: backslash and newline are written as ``\\\\`` and ``\\n``."""
    lines = pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")
    return escape(lines)


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, lengths) of a string array without nulls."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]] if len(texts) else np.empty(0, np.uint8)
    return data, np.diff(at)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
    """Copy piece i of ``data`` to out[to[i]:]."""
    begins = np.cumsum(lengths) - lengths
    out[np.repeat(to - begins, lengths) + np.arange(data.size)] = data


def assemble(conv: pa.Array, roles: pa.Array, texts: pa.Array, first: np.ndarray) -> pa.RecordBatch:
    """Format turns in order; ``first`` marks the first turn of each conversation."""
    roles, texts = pc.fill_null(roles, ""), pc.fill_null(texts, "")
    role_data, role_len = _bytes(escape_role(roles))
    text_data, text_len = _bytes(escape(texts))
    n = len(texts)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2], lengths[:, 3], lengths[:, 4] = len(START), role_len, len(MIDDLE), text_len, len(END)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    begins = ends - lengths
    buffer = pa.allocate_buffer(int(ends[-1, -1]), resizable=False)
    out = np.frombuffer(buffer, np.uint8)
    for k, fixed in ((0, START), (2, MIDDLE), (4, END)):
        out[begins[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    _scatter(out, begins[:, 1], role_data, role_len)
    _scatter(out, begins[:, 3], text_data, text_len)

    at = np.flatnonzero(first)
    conv_begin = begins[at, 0]
    offsets = np.append(conv_begin, ends[-1, -1])
    formatted = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), buffer).cast(pa.string())
    loss = pc.fill_null(pc.equal(roles, "assistant"), False).to_numpy(zero_copy_only=False)
    own = np.cumsum(first) - 1
    of = own[loss]
    spans = pa.StructArray.from_arrays(
        [pa.array(begins[loss, 3] - conv_begin[of]), pa.array(ends[loss, 3] - conv_begin[of])], names=["start", "end"])
    list_at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(at)))]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(at)), pa.array(np.bincount(own, minlength=len(at)).astype(np.int64)), formatted,
         pa.ListArray.from_arrays(pa.array(list_at), spans).cast(_SPANS)], names=["conv_id", "n_turns", "formatted", "loss_spans"])


def format_chats(turns: DataFrame, *, chunk_bytes: int = 32 << 20) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, n_turns, formatted, loss_spans (byte spans).

    Turns go by ``turn`` (null first), equal ones by role, then text; repeated
    rows are turns of their own.  Null role or text counts as empty; rows with a
    null conv_id form one conversation.  The loss mask covers the texts of role
    ``assistant``.  An empty table gives an empty result; other columns are dropped.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(last: bool):
            nonlocal held, size
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("conv_id").combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else ids.chunk(0)
            known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
            null = pc.is_null(ids).to_numpy(zero_copy_only=False)
            first = np.append(True, (known[1:] != known[:-1]) | (null[1:] != null[:-1]))
            stop = t.num_rows if last else int(np.flatnonzero(first)[-1])  # the last one may go on in the next batch
            if stop:
                col = lambda c: t.column(c).slice(0, stop).combine_chunks()
                one = lambda a: a if isinstance(a, pa.Array) else (a.chunk(0) if a.num_chunks else pa.array([], a.type))
                yield assemble(one(col("conv_id")), one(col("role")), one(col("text")), first[:stop])
            held = t.slice(stop).to_batches()
            size = 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= chunk_bytes:
                yield from flush(False)
        if held:
            yield from flush(True)

    rows = spread(turns.select("conv_id", "turn", "role", "text"), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>")


def parse_chat(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The turns (role, text) of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return turns


def read_chats(chats: DataFrame) -> DataFrame:
    """Digests read back from formatted conversations and their loss spans."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, text, spans in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")]):
                raw = text.encode()
                turns = parse_chat(raw)
                whole = hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest()
                loss = b"".join(unescape(raw[s["start"]:s["end"]]) for s in spans)
                out.append((conv, len(turns), whole, len(loss.decode()), hashlib.sha256(loss).hexdigest(), len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)

    i64, s = pa.int64(), pa.string()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [i64, i64, s, i64, s, i64]
    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
