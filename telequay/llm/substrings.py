"""Operator 1: substring dedup by content-defined chunks.

A gear hash rolls over the words of a text: h = (h << 16) + gear(word), so it
depends on the last four words, whatever stands before them.  A cut comes where
the hash is the least of ``window`` words in a row: the same passage is cut alike
wherever it stands, an insertion only moves the cuts around it, and no stretch
stays without a cut, not even one word repeated.  A chunk runs from each cut to the
first cut at least ``least`` words on.

Chunks are deduplicated by digest.  A chunk whose digest stood in an earlier text
is aligned with its first occurrence there; runs of chunks with one alignment are
extended on either side as far as the words agree, and removed when they come to
more than ``min_words`` words.  Where chunks of one passage stood earlier in several
texts, the first of them need not be the one that has the whole passage, so
chains are sought as well: chunks that follow each other, up to more than half
of ``min_words`` words and to more than ``min_words``.  Repeats within a text are
found the same way, in the text itself.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import starts
from .shared import fresh, spread, written
from .words import Words, chunks, mix64, words

#: Words compared beyond either end of an aligned run.
CONTEXT = 64
#: Bits of the filter that says which texts are sources: 1 MB on every executor.  More sources than
#: bits let more texts through to a join, which sorts them out.
FILTER_BITS = 1 << 23
#: Rows that ask for the words at one place of a source and go to one task together.
SHARE = 4096
_GEAR, _BASE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Cutting(NamedTuple):
    """A common passage of ``min_words`` + 1 words is cut alike from its fourth word and one window on, up to a window
    before its end; that leaves 2 windows and ``least`` words, enough for the longest chunk that may begin at its first cut."""

    window: int
    least: int
    chains: tuple[int, int]  # words that the chains of chunks exceed

    @classmethod
    def of(cls, min_words: int) -> Cutting:
        window = max(1, (min_words + 1) // 5)
        return cls(window, max(1, min_words + 1 - 4 * window), (min_words // 2, min_words))


def gear_cuts(w: Words, window: int) -> np.ndarray:
    """The words (numbers in the column) at which a chunk may begin or end."""
    n = w.hashes.size
    if not n:
        return np.empty(0, np.int64)
    gear, one = mix64(w.hashes ^ _GEAR), np.uint64
    h = gear.copy()
    for k in (1, 2, 3):
        h[k:] += gear[:-k] << one(16 * k)
    many = np.diff(w.first)
    before = np.arange(n) - np.repeat(w.first[:-1], many)
    full = before >= 3
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)  # neighbours that are no less (left), greater (right)
    room = np.repeat(w.first[1:], many) - np.arange(n) - 1
    go_left, go_right = full.copy(), full.copy()
    for k in range(1, window):
        if k >= n:
            break
        go_left[:k] = False
        go_left[k:] &= (h[:-k] >= h[k:]) & (before[k:] - k >= 3)
        go_right[n - k:] = False
        go_right[:n - k] &= (h[k:] > h[:-k]) & (room[:n - k] >= k)
        left += go_left
        right += go_right
    return np.flatnonzero(full & (left + right + 1 >= window))


def chains(begin: np.ndarray, end: np.ndarray, more: int) -> np.ndarray:
    """Where the chain of chunks from each chunk on ends, the first to exceed ``more`` words; its own begin where the chunks run out before."""
    to, follows = end.copy(), np.searchsorted(begin, end)
    short = np.flatnonzero(to - begin <= more)
    at = short
    while short.size:
        at = follows[at]
        on = at < begin.size
        on[on] = begin[at[on]] == to[short[on]]
        to[short[~on]] = begin[short[~on]]
        short, at = short[on], at[on]
        to[short] = end[at]
        left = to[short] - begin[short] <= more
        short, at = short[left], at[left]
    return to


def chunk_column(texts: pa.Array, cutting: Cutting) -> tuple[dict[str, np.ndarray], Words]:
    """Chunks of a column: text (index), word (its first in the text), n_words, digest (of its words); and the words.

    half, half_words and whole, whole_words are the digests and sizes of the two chains from each chunk on; size 0
    where there is none, or where it is the shorter one (or the chunk) again.
    """
    w = words(texts)
    cuts = gear_cuts(w, cutting.window)
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))
    to = np.searchsorted(cuts, cuts + cutting.least)
    ok = to < cuts.size
    begin, end = cuts[ok], cuts[to[ok]]
    same = text[begin] == text[end] if begin.size else np.empty(0, bool)
    begin, end = begin[same], end[same]
    n = w.hashes.size
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _BASE)))
    inverse = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, _INVERSE)))
    sums = np.append(np.uint64(0), np.cumsum(mix64(w.hashes + _BASE) * power[:n]))
    digests = lambda to: mix64((sums[to] - sums[begin]) * inverse[begin] + (to - begin).astype(np.uint64))
    own = text[begin] if begin.size else np.empty(0, np.int64)
    half, whole = (chains(begin, end, more) for more in cutting.chains)
    whole, half = np.where(whole == half, begin, whole), np.where(half == end, begin, half)
    return {"text": own, "word": begin - w.first[own], "n_words": end - begin, "digest": digests(end), "half_words": half - begin, "half": digests(half),
            "whole_words": whole - begin, "whole": digests(whole)}, w


def _identified(documents: DataFrame) -> DataFrame:
    """dk (key of doc_id and text), doc_id, text: texts go by doc_id, then by dk."""
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").select(F.xxhash64("doc_id", F.xxhash64("text")).alias("dk"), "doc_id", "text")


def chunk_rows(documents: DataFrame, cutting: Cutting) -> DataFrame:
    """digest, dk, doc_id, word, n_words, half, half_words, whole, whole_words: the distinct chunks (with their chains) of each text, each at its first place there."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                c, _ = chunk_column(part.column("text"), cutting)
                own = np.lexsort((c["word"], c["whole"], c["half"], c["digest"], c["text"]))
                if own.size:
                    same = [c[k][own][1:] == c[k][own][:-1] for k in ("text", "digest", "half", "whole")]
                    own = own[np.append(True, ~np.logical_and.reduce(same))]
                at = pa.array(c["text"][own])
                long, short = (lambda k: pa.array(c[k][own].view(np.int64))), (lambda k: pa.array(c[k][own].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [long("digest"), part.column("dk").take(at), part.column("doc_id").take(at), short("word"), short("n_words"), long("half"), short("half_words"),
                     long("whole"), short("whole_words")], names=["digest", "dk", "doc_id", "word", "n_words", "half", "half_words", "whole", "whole_words"])

    return _identified(documents).mapInArrow(run, "digest long, dk long, doc_id long, word int, n_words int, half long, half_words int, whole long, whole_words int")


def runs_of(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs begin (indices) and end (words): stretches a to b - 1, sorted by group (not negative) and a, that overlap or touch within a group."""
    if not a.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    furthest = np.maximum.accumulate((group.astype(np.int64) << 32) + b)
    at = np.flatnonzero(np.append(True, (group.astype(np.int64)[1:] << 32) + a[1:] > furthest[:-1]))
    return at, np.maximum.reduceat(b, at)


def aligned(documents: DataFrame, cutting: Cutting) -> DataFrame:
    """dk, a, b, f_dk, f_a: words a to b - 1 of a text stand in the earlier text f_dk from word f_a on.

    Digests are counted in each task before they are shuffled; only chunks whose
    digest occurs twice are kept, and the first is sought among them and the
    chains that begin with them.  Chunks and chains that overlap and have one
    alignment make one run.
    """
    rows = chunk_rows(documents, cutting)
    twice = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    found = written(rows.join(twice, "digest", "left_semi"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "dk", "word")).alias("first")
    each = [F.struct(F.col(d).alias("digest"), F.col(n).alias("n_words")) for d, n in (("digest", "n_words"), ("half", "half_words"), ("whole", "whole_words"))]
    found = found.select("dk", "doc_id", "word", F.inline(F.filter(F.array(*each), lambda x: x["n_words"] > 0)))
    first = found.groupBy("digest").agg(first).select("digest", F.col("first.dk").alias("f_dk"), F.col("first.word").alias("f_word"))
    later = found.join(first, "digest").where("dk <> f_dk").select("dk", "word", "n_words", "f_dk", (F.col("f_word") - F.col("word")).alias("shift"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                dk, f_dk, shift, a, n = (batch.column(c).to_numpy() for c in ("dk", "f_dk", "shift", "word", "n_words"))
                group = np.cumsum(np.append(False, (dk[1:] != dk[:-1]) | (f_dk[1:] != f_dk[:-1]) | (shift[1:] != shift[:-1])))
                at, b = runs_of(group, a, a + n)
                yield pa.RecordBatch.from_arrays([pa.array(dk[at]), pa.array(a[at]), pa.array(b), pa.array(f_dk[at]), pa.array(a[at] + shift[at])],
                                                 names=["dk", "a", "b", "f_dk", "f_a"])

    # A run that two batches share is two runs; either is extended into the other.
    rows = spread(later, "dk").dropDuplicates().sortWithinPartitions("dk", "f_dk", "shift", "word")
    return rows.mapInArrow(run, "dk long, a int, b int, f_dk long, f_a int")


def words_at(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """f_dk, side, place, near: the words of f_dk before (side 0) or from (side 1) the place on, up to ``CONTEXT``, as 32-bit hashes.

    ``asked`` has f_dk and places (distinct structs of side and place, no more than two for each word of the text).
    Texts that are no source are left out by a filter of fixed size before the join.
    """
    bit = F.pmod("f_dk", F.lit(FILTER_BITS)) + 1  # buckets and their bits count from 1
    bitmap = asked.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS, bool)
    for bucket, raw in zip(bitmap["bucket"].to_pylist(), bitmap["bits"].to_pylist()):
        one = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").astype(bool)
        bits[(bucket - 1) * one.size:bucket * one.size] |= one
    packed = documents.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def pick(batches):
        own = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(own[batch.column("dk").to_numpy() % FILTER_BITS]))

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                w = words(part.column("text"))
                short = w.hashes.astype(np.uint32)
                places = part.column("places")
                flat, at = places.flatten(), np.append(0, np.cumsum(pc.list_value_length(places).to_numpy()))
                text = np.repeat(np.arange(part.num_rows), np.diff(at))
                side, place = flat.field("side").to_numpy(), flat.field("place").to_numpy().astype(np.int64) + w.first[text]
                lo = np.where(side == 0, np.maximum(place - CONTEXT, w.first[text]), place)
                hi = np.where(side == 0, place, np.minimum(place + CONTEXT, w.first[text + 1]))
                for s in range(0, text.size, 5000):
                    t = slice(s, s + 5000)
                    near = [short[x:y].tobytes() for x, y in zip(lo[t], hi[t])]
                    yield pa.RecordBatch.from_arrays([part.column("dk").take(pa.array(text[t])), pa.array(side[t]), flat.field("place").slice(s, 5000), pa.array(near, pa.binary())],
                                                     names=["f_dk", "side", "place", "near"])

    texts = _identified(documents).select("dk", "text").mapInArrow(pick, "dk long, text string").dropDuplicates(["dk"])
    return texts.join(asked.withColumnRenamed("f_dk", "dk"), "dk").mapInArrow(run, "f_dk long, side int, place int, near binary")


def candidates(documents: DataFrame, cutting: Cutting) -> DataFrame:
    """dk, runs (array of a, b, f_dk, side, near): the aligned runs of each text with the words beside them in their sources."""
    runs = written(aligned(documents, cutting))
    side = lambda k, place: F.struct(F.lit(k).alias("side"), place.cast("int").alias("place"))
    ends = runs.select("dk", "a", "b", "f_dk", F.explode(F.array(side(0, F.col("f_a")), side(1, F.col("f_a") + F.col("b") - F.col("a")))).alias("q")).select(
        "dk", "a", "b", "f_dk", "q.*")
    counts = written(ends.groupBy("f_dk", "side", "place").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")))
    near = words_at(documents, counts.groupBy("f_dk").agg(F.collect_list(F.struct("side", "place")).alias("places")))
    # A place that many runs ask for is dealt out, so its answer goes to several tasks.
    dealt = ends.join(counts, ["f_dk", "side", "place"]).withColumn("share", F.pmod(F.xxhash64("dk", "a"), F.col("shares")).cast("int")).drop("shares")
    near = near.join(counts, ["f_dk", "side", "place"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    got = dealt.join(near, ["f_dk", "side", "place", "share"])
    return got.groupBy("dk").agg(F.array_sort(F.collect_list(F.struct("a", "b", "f_dk", "side", "near"))).alias("runs"))


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements agree from the start on, in blocks that double: the work is that of what agrees."""
    n, at, step = min(x.size, y.size), 0, CONTEXT
    while at < n:
        to = min(n, at + step)
        other = np.flatnonzero(x[at:to] != y[at:to])
        if other.size:
            return at + int(other[0])
        at, step = to, 2 * step
    return n


def repeated_words(own: np.ndarray, runs: list[dict], word: np.ndarray, size: np.ndarray, digest: np.ndarray, min_words: int) -> np.ndarray:
    """Which words of a text (32-bit hashes) stood before: in earlier texts by ``runs``, in the text itself by its chunks and chains."""
    gone = np.zeros(own.size, bool)
    for left, right in zip(runs[0::2], runs[1::2]):  # of each run the side before it, then the one after it
        a, b = left["a"], left["b"]
        lo = _same(own[max(0, a - CONTEXT):a][::-1], np.frombuffer(left["near"], np.uint32)[::-1])
        hi = _same(own[b:b + CONTEXT], np.frombuffer(right["near"], np.uint32))
        if b - a + lo + hi > min_words:
            gone[a - lo:b + hi] = True
    order = np.lexsort((word, digest))
    d, at = digest[order], word[order]
    head = starts(d)
    first = np.repeat(at[head], np.diff(np.append(head, d.size)))
    later = np.flatnonzero(at > first)
    if later.size:
        again = order[later]
        k = np.lexsort((word[again], first[later] - word[again]))
        a, shift, b = word[again][k], (first[later] - word[again])[k], (word[again] + size[again])[k]
        new, ends = runs_of(np.cumsum(np.append(False, shift[1:] != shift[:-1])), a, b)
        turn = np.argsort(a[new], kind="stable")
        for x, y, s in zip(a[new][turn].tolist(), ends[turn].tolist(), shift[new][turn].tolist()):
            if gone[x:y].all():
                continue
            lo = _same(own[:x][::-1], own[:x + s][::-1])
            hi = _same(own[y:], own[y + s:])
            if y - x + lo + hi > min_words:
                gone[x - lo:y + hi] = True
    return gone


def deduplicate(documents: DataFrame, *, min_words: int = 50) -> DataFrame:
    """All columns of documents with the text cut, and removed_spans (bytes of the old text), removed_words.

    A word goes when it lies in a run of more than ``min_words`` words that
    stood before: in a text of smaller (doc_id, hash), or further to the front in
    the same one (the two may overlap).  Words are compared without case and
    white space.  Chunks and chains of them are compared with their first
    occurrence, chains of more than ``min_words`` words among them: a run of that
    length and a chunk and a window more has one and goes, but for the few words
    before its first and after its last chunk that only a later source shares.
    A shorter one can stay if all its chunks and chains stood earlier in other passages.
    Shorter repeats stay.  Exact copies of a long text lose all of it: their
    text becomes empty.  Null texts stay null; texts without repeats stay as
    they are, byte for byte; texts of any length are treated whole.  A null
    doc_id comes last.  Rows repeated with the same doc_id and text count as
    one occurrence.  An empty table gives an empty result.  Other columns keep
    names and values, but for columns named like the two new ones (in any
    case), which are replaced.
    """
    cutting = Cutting.of(min_words)
    columns = [c for c in documents.columns if c.lower() not in ("removed_spans", "removed_words")]
    runs = candidates(documents, cutting)
    dk, r_dk, r_runs = fresh(documents, 3)
    keyed = documents.select(*columns, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias(dk))
    joined = keyed.join(runs.toDF(r_dk, r_runs), F.col(dk) == F.col(r_dk), "left").select(*columns, r_runs)
    body = next(c for c in columns if c.lower() == "text")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, body):
                marks = part.column(r_runs).to_pylist()
                c, w = chunk_column(part.column(body), cutting)
                short = w.hashes.astype(np.uint32)
                bounds = np.searchsorted(c["text"], np.arange(part.num_rows + 1))
                texts, spans, counts = part.column(body).to_pylist(), [None] * part.num_rows, np.zeros(part.num_rows, np.int64)
                for i, mark in enumerate(marks):
                    s, lo, hi = slice(bounds[i], bounds[i + 1]), int(w.first[i]), int(w.first[i + 1])
                    size = np.concatenate([c[k][s] for k in ("n_words", "half_words", "whole_words")])
                    some = size > 0
                    digest = np.concatenate([c[k][s] for k in ("digest", "half", "whole")])[some]
                    gone = repeated_words(short[lo:hi], mark or [], np.tile(c["word"][s], 3)[some], size[some], digest, min_words)
                    if not gone.any():
                        continue
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    raw, done, out, spans[i] = texts[i].encode(), 0, [], []
                    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                        begin = int(w.starts[lo + a] - w.at[i])
                        end = int(w.starts[lo + b] - w.at[i]) if lo + b < hi else len(raw)
                        out.append(raw[done:begin])
                        spans[i].append({"start": begin, "end": end})
                        done = end
                    texts[i], counts[i] = b"".join([*out, raw[done:]]).decode(), gone.sum()
                arrays = [pa.array(texts, pa.string()) if f == body else part.column(f) for f in columns]
                lists = pa.array([x or [] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*arrays, lists, pa.array(counts, pa.int64())], names=[*columns, "removed_spans", "removed_words"])

    kinds = ", ".join(f"`{f.name}` {'string' if f.name == body else f.dataType.simpleString()}" for f in documents.schema if f.name in columns)
    return joined.mapInArrow(run, f"{kinds}, removed_spans array<struct<start:long,end:long>>, removed_words long")
