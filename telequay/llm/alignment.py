"""Operator 13: alignment of two tokenizers' tokens over the same bytes.

Tokens of either side end at ascending byte offsets; merging both lists and
cutting where they share an end gives the groups.  The merge is divided into
pieces of equal work: a binary search along each diagonal (how many tokens of
both sides come before) finds where the merge path crosses it, so a piece is a
slice of either list and is merged without its neighbours.  A piece gives the
overlaps it closes and what is left open at its end; stitching adds that to the
first overlap closed after it.

Every text's distinct linked pairs of ids are stored once, packed.  Counts of
pairs by text are summed over the corpus; the most frequent pairs, a stated
number of them, go to every task, and the others are joined by a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .packed import distinct, pack, pack_sorted, starts, unpack, unpack_sorted
from .records import _BLANKS, Remembered, chunks
from .shared import written
from .tiers import threshold

MARK = "▁"
#: Ends of both sides in a piece of the merge.
WORK = 1 << 15
#: At most this many pairs go to every task with their counts.
FREQUENT = 1 << 20
#: Distinct pairs that a task holds before it passes their counts on.
HELD = 1 << 21
#: Links of a group that are listed one by one; larger groups are counted by distinct ids.
LISTED = 1 << 16
class Sides:
    """Ids of both tokenizers for chunks of a text that begin with a blank or line end."""

    def __init__(self, path_a: str, path_b: str, keep: int = 400_000):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = {c: b for b, c in byte_letters().items()}
        added = self.a.get_added_tokens_decoder()
        n_a = max([self.a.get_vocab_size() - 1, *added]) + 1
        spelled = [self.a.id_to_token(i) or "" for i in range(n_a)]
        self.bytes_a = [t.encode() if i in added else bytes(letters[c] for c in t) for i, t in enumerate(spelled)]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(MARK, " ").encode()
                        for i, t in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.mark = self.b.piece_to_id(MARK)
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        if max(n_a, len(self.bytes_b)) > 1 << 16:
            raise ValueError("vocabularies of more than 65,536 ids")
        #: Decimal ids with what may follow them: of A , and |, of B , and ;
        self.said = np.array([f"{i}{x}" for i in range(n_a) for x in ",|"] + [f"{i}{x}" for i in range(len(self.bytes_b)) for x in ",;"], object)
        self.known_a, self.known_b, self.odd = Remembered(keep), {}, set()

    def forget(self) -> None:
        """Workers outlive tasks and should not hold on to what one of them met."""
        self.known_a, self.known_b, self.odd = Remembered(self.known_a.keep), {}, set()

    def learn(self, all_: set[str]) -> None:
        """Ids of chunks not met yet, of many in one call: as no token spans two, they are cut by their lengths."""
        before = self.known_a.old
        new = self.known_a.missing(all_)
        if self.known_a.old is not before:  # the older half went
            self.known_b = {c: self.known_b[c] for c in self.known_a.old if c in self.known_b}
        closed = [c for c in new if c[-1] not in _BLANKS]
        for lo in range(0, len(closed), 500):
            self.put(closed[lo:lo + 500])
        for c in new:
            if c not in self.known_a.young:
                self.put([c])

    def put(self, own: list[str]) -> None:
        text = "".join(own)
        raw = text.encode()
        a = self.a.encode(text, add_special_tokens=False).ids
        # B puts a blank in front of what it gets: that of the first chunk, or a token of its own before a line end;
        # to nothing at all it adds none, so the single blank that ends a text is its token
        b = [self.mark] if text == " " else self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        ends = np.cumsum([len(c.encode()) for c in own])
        cut = []
        for ids, of, length in ((a, self.bytes_a, self.length_a), (b, self.bytes_b, self.length_b)):
            ids = np.array(ids, "<u2")
            at = np.cumsum(length[ids])
            k = np.searchsorted(at, ends)
            if b"".join(map(of.__getitem__, ids.tolist())) != raw or not (at[k] == ends).all():
                if len(own) == 1:
                    self.odd.add(own[0])
                    self.known_a.young[own[0]] = self.known_b[own[0]] = b""
                return  # else they come one by one
            k, data = [0, *(2 * (k + 1)).tolist()], ids.tobytes()
            cut.append([data[i:j] for i, j in zip(k, k[1:])])
        self.known_a.young.update(zip(own, cut[0]))
        self.known_b.update(zip(own, cut[1]))

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text by A and B as 16-bit numbers; none where a side's bytes are not those of a blank and the text."""
        cut = [chunks(" " + t) if t and MARK not in t else [] for t in texts]
        self.learn(set().union(*cut))
        if self.odd:
            cut = [c if self.odd.isdisjoint(c) else [] for c in cut]
        of_a, of_b = self.known_a.young.__getitem__, self.known_b.__getitem__
        return [b"".join(map(of_a, c)) for c in cut], [b"".join(map(of_b, c)) for c in cut]


_SIDES: dict[tuple[str, str], Sides] = {}


def sides(path_a: str, path_b: str) -> Sides:
    """One pair of tokenizers for each pair of files and Python worker."""
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = Sides(path_a, path_b)
    return _SIDES[path_a, path_b]


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of the merge of two ascending lists begin and end: how many of a, how many of b.

    All diagonals are searched at once.  Of equal ends a's comes first, and both
    of them belong to one piece.
    """
    d = np.append(np.arange(0, a.size + b.size, work), a.size + b.size)
    low, high = np.maximum(0, d - b.size), np.minimum(d, a.size)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        take = open_ & (a[np.minimum(mid, a.size - 1)] <= b[np.clip(d - mid - 1, 0, b.size - 1)])
        low, high = np.where(take, mid + 1, low), np.where(open_ & ~take, mid, high)
    i, j = low, d - low
    if a.size and b.size:
        split = (i > 0) & (j < b.size) & (a[np.maximum(i - 1, 0)] == b[np.minimum(j, b.size - 1)])
        j = j + split
    return i, j


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """One piece: tokens of a and of b in each group that it closes, and those left open at its end."""
    if a.size and b.size:
        at = np.searchsorted(b, a)
        hit = np.flatnonzero(b[np.minimum(at, b.size - 1)] == a)
        of_b = at[hit]
    else:
        hit = of_b = np.empty(0, np.int64)
    n_a, n_b = np.diff(hit, prepend=-1), np.diff(of_b, prepend=-1)
    return n_a, n_b, a.size - int(n_a.sum()), b.size - int(n_b.sum())


def stitched(pieces) -> tuple[np.ndarray, np.ndarray]:
    """Group sizes of all pieces in order; what a piece left open goes to the first group closed after it."""
    all_a, all_b, left_a, left_b = [], [], 0, 0
    for n_a, n_b, more_a, more_b in pieces:
        if n_a.size:
            n_a[0] += left_a
            n_b[0] += left_b
            all_a.append(n_a)
            all_b.append(n_b)
            left_a = left_b = 0
        left_a, left_b = left_a + more_a, left_b + more_b
    if left_a or left_b:
        raise ValueError("the sides end at different bytes")
    none = np.empty(0, np.int64)
    return np.concatenate([none, *all_a]), np.concatenate([none, *all_b])


def groups(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of a and of b each group holds, for two ascending lists of ends with the same last one."""
    i, j = diagonals(a, b, work)
    return stitched([overlaps(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]]) for k in range(i.size - 1)])


def links(ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, pair of ids) and how many links each has; a pair is a << 16 | b.

    Groups with many links are counted by their distinct ids on either side.
    """
    begin_a, begin_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    size = n_a * n_b
    keys, counts = [], []
    listed = np.flatnonzero(size <= LISTED)
    g = np.repeat(listed, size[listed])
    at = np.arange(g.size) - np.repeat(np.cumsum(size[listed]) - size[listed], size[listed])
    one = (text[g].astype(np.int64) << 32) | (ids_a[begin_a[g] + at // n_b[g]].astype(np.int64) << 16) | ids_b[begin_b[g] + at % n_b[g]]
    k, c = distinct(one)
    keys.append(k)
    counts.append(c)
    for g in np.flatnonzero(size > LISTED):
        a, c_a = distinct(ids_a[begin_a[g]:begin_a[g] + n_a[g]].astype(np.int64))
        b, c_b = distinct(ids_b[begin_b[g]:begin_b[g] + n_b[g]].astype(np.int64))
        keys.append(((int(text[g]) << 32) | (a[:, None] << 16) | b[None, :]).ravel())
        counts.append((c_a[:, None] * c_b[None, :]).ravel())
    if len(keys) > 1:
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        at = starts(key)
        return key[at] >> 32, key[at] & 0xFFFFFFFF, np.add.reduceat(count, at)
    return k >> 32, k & 0xFFFFFFFF, c


def align(s: Sides, texts: list[str | None], work: int = WORK) -> list[tuple]:
    """Of each text: n_a, n_b, n_groups, n_links, groups_sha256, its distinct pairs and their links, packed."""
    raw_a, raw_b = s.encode(texts)
    ids_a, ids_b = np.frombuffer(b"".join(raw_a), "<u2"), np.frombuffer(b"".join(raw_b), "<u2")
    tokens_a, tokens_b = np.array([len(x) // 2 for x in raw_a]), np.array([len(x) // 2 for x in raw_b])
    text_of_a = np.repeat(np.arange(len(texts)), tokens_a)
    ends_a, ends_b = np.cumsum(s.length_a[ids_a]), np.cumsum(s.length_b[ids_b])
    n_a, n_b = groups(ends_a, ends_b, work)  # texts end on both sides at once, so no group spans two
    last_a = np.cumsum(n_a)
    text = text_of_a[last_a - 1] if n_a.size else n_a
    of, pair, count = links(ids_a, ids_b, n_a, n_b, text)

    # Decimal ids in order: a token's place is its number, and those of the other side before it.
    before_b, before_a = np.cumsum(n_b) - n_b, last_a
    code = np.empty(ids_a.size + ids_b.size, np.int64)
    closing_a, closing_b = np.zeros(ids_a.size, np.int64), np.zeros(ids_b.size, np.int64)
    closing_a[last_a - 1] = closing_b[np.cumsum(n_b) - 1] = 1
    code[np.arange(ids_a.size) + np.repeat(before_b, n_a)] = ids_a.astype(np.int64) * 2 + closing_a
    code[np.arange(ids_b.size) + np.repeat(before_a, n_b)] = 2 * len(s.bytes_a) + ids_b.astype(np.int64) * 2 + closing_b

    n_groups = np.bincount(text, minlength=len(texts))
    n_links = np.bincount(of, count, len(texts)).astype(np.int64) if count.sum() < 1 << 53 else np.array([int(count[of == i].sum()) for i in range(len(texts))])
    at, out_at = np.searchsorted(of, np.arange(len(texts) + 1)), np.append(0, np.cumsum(tokens_a + tokens_b))
    out = []
    for i in range(len(texts)):
        said = "".join(s.said[code[out_at[i]:out_at[i + 1]]])[:-1]
        lo, hi = at[i], at[i + 1]
        out.append((int(tokens_a[i]), int(tokens_b[i]), int(n_groups[i]), int(n_links[i]), hashlib.sha256(said.encode()).hexdigest() if said else "",
                    pack_sorted(pair[lo:hi].astype(np.uint64)), pack(count[lo:hi].astype(np.uint32) if hi == lo or count[lo:hi].max() < 1 << 32 else count[lo:hi].astype(np.uint64))))
    return out


KIND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"


def aligned(documents: DataFrame, *, vocabulary_a: str, vocabulary_b: str, chars_at_once: int = 1 << 20) -> DataFrame:
    """Each text's counts, digest and packed pairs."""

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        s = sides(vocabulary_a, vocabulary_b)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]

        def table(ids, texts):
            rows = [(i, *x) for i, x in zip(ids, align(s, texts))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split(" ")[0] for x in KIND.split(", ")])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "")
                if size >= chars_at_once:
                    yield table(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield table(ids, texts)
        s.forget()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, KIND)


def count_pairs(texts: DataFrame) -> DataFrame:
    """pair, n (texts that hold it linked), best (no pair of its A id has more)."""

    def run(batches):
        def table(held):
            key, n = total(held)
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        def total(held):
            key = np.concatenate([np.empty(0, np.uint64), *[k for k, _ in held]])
            n = np.concatenate([np.empty(0, np.int64), *[c for _, c in held]])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            at = starts(key)
            return key[at], np.add.reduceat(n, at) if at.size else n

        held, fresh, size = [], [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                fresh.append(unpack_sorted(raw).astype(np.uint64))
                size += fresh[-1].size
                if size >= HELD:
                    held = [total([*held, distinct(np.concatenate(fresh))])]
                    fresh, size = [], 0
                    if held[0][0].size >= HELD:
                        yield table(held)
                        held = []
        if fresh:
            held.append(distinct(np.concatenate(fresh)))
        yield table(held)

    counts = written(texts.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.shiftright("pair", 16)
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(documents: DataFrame, *, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text.

    Null and empty texts, and those whose tokens don't spell a blank and the
    text byte by byte, have no tokens: zeros and the empty string.  Repeated
    rows and null doc_ids stay, and each counts as a text; ties for an A id's
    best pair all count.  An empty table gives an empty result.
    """
    texts = written(aligned(documents, vocabulary_a=vocabulary_a, vocabulary_b=vocabulary_b).withColumn("row", F.monotonically_increasing_id()))
    counts = written(count_pairs(texts))
    bound = threshold(counts, "n", FREQUENT)
    common = counts.where(F.col("n") >= bound).toArrow()
    key = common.column("pair").to_numpy()
    order = np.argsort(key)
    sent = documents.sparkSession.sparkContext.broadcast(
        (key[order].astype(np.uint64), common.column("n").to_numpy()[order], common.column("best").to_numpy()[order]))
    own = ("n_best", "count_sum")

    def run(batches):
        key, n, best = sent.value
        for batch in batches:
            row, part = [], {"n_best": [], "count_sum": [], "rest": [], "rest_n": []}
            for i, pairs, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                pairs, count = unpack_sorted(pairs).astype(np.uint64), unpack(count).astype(np.int64)
                at = np.minimum(np.searchsorted(key, pairs), max(key.size - 1, 0))
                hit = key[at] == pairs if key.size else np.zeros(pairs.size, bool)
                at = at[hit]
                row.append(i)
                part["n_best"].append(int(count[hit] @ best[at]) if at.size else 0)
                part["count_sum"].append(int(count[hit] @ n[at]) if at.size else 0)
                part["rest"].append(pairs[~hit].astype(np.int64))
                part["rest_n"].append(count[~hit])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *[pa.array(v, t) for v, t in zip(part.values(), kinds)]], names=["row", *part])

    each = written(texts.select("row", "pairs", "links").mapInArrow(run, "row long, n_best long, count_sum long, rest array<long>, rest_n array<long>"))
    left = each.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("r")).select("row", F.col("r.rest").alias("pair"), F.col("r.rest_n").alias("m"))
    more = left.join(counts.where(F.col("n") < bound), "pair").select(
        "row", F.when(F.col("best"), F.col("m")).otherwise(0).alias("n_best"), (F.col("m") * F.col("n")).alias("count_sum"))
    sums = each.select("row", *own).unionByName(more).groupBy("row").agg(*[F.sum(c).alias(c) for c in own])
    return texts.join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
