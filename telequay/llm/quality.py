"""Operator 5: quality by perplexity under a model of trusted text.

An interpolated, modified Kneser-Ney bigram model over all words of trusted
documents; each text ends with an end mark.  In back-off form the log-probability
of a text is a sum over its features: with B(u) the discounted mass of context u,

    ln p(w | u) = ln back(u) + ln lower(w) + ln(1 + max(c(u, w) - D, 0) / (B(u) lower(w)))

so a word has one value, ln back + ln lower, and a bigram seen in trusted text a
correction.  The table of these values is dealt out by hash into shards that
grow in number with the trusted text; the features of all documents are dealt
out the same way, and the sums come back per document.  A document is rejected
when its perplexity exceeds a quantile of its language's trusted documents that
the model has not seen.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import Index, counted, distinct, pack, pack_sorted, starts, unpack, unpack_sorted
from .shared import discard, fresh, width, written
from .words import Words, chunks, mix64, words

#: Bytes of trusted text a shard of the model; a shard holds about as many bigrams as these have words.
SHARD_BYTES = 8 << 20
#: Bytes of text a block: its features are sent to the shards together.
BLOCK_BYTES = 4 << 20
#: Bits of a feature's key within its shard: of bigrams not in a shard of 2^20 features one in 2^12 is taken for one of them.
KEY_BITS = 32
#: Bits of the filter of words (8 MB) that every task has: words that are not in it are not in the model and are not asked for.
#: With far more words than bits it lets all pass; results are the same.
FILTER_BITS = 26
#: Values of the model are stored in steps of 1 / 2048 nat.
STEP = 2048
#: Trusted ids up to this number (64 MB at most) are broadcast; more are joined by a shuffle, with the same result.
BROADCAST_IDS = 1 << 21
#: Words whose values every task has (1 MB), so that texts don't send them; the most frequent ones of each shard.
COMMON = 1 << 16
BEGIN, END = np.uint64(1), np.uint64(2)
_WORD, _PAIR = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - KEY_BITS)


class Deal(NamedTuple):
    """Which shard a word and a bigram belong to.

    A bigram goes with its context; those of a context with more than half a
    shard's share of all words are spread over ``parts`` shards by their second word.
    """

    shards: int
    hot: np.ndarray  # sorted hashes of such contexts
    parts: np.ndarray

    def of_words(self, w: np.ndarray) -> np.ndarray:
        return ((mix64(w) >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def of_pairs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        home = self.of_words(u)
        if self.hot.size:
            at = np.minimum(np.searchsorted(self.hot, u), self.hot.size - 1)
            own = np.flatnonzero(self.hot[at] == u)
            home[own] += ((mix64(w[own] ^ _PAIR) >> np.uint64(33)).astype(np.int64) % self.parts[at[own]])
            home[own] %= self.shards
        return home


def _bigrams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word before, word) of every word and end mark of the texts that have words."""
    has = np.diff(w.first) > 0
    before = np.insert(w.hashes, w.first[:-1][has], BEGIN)
    word = np.insert(w.hashes, w.first[1:][has], END)
    return np.repeat(np.flatnonzero(has), np.diff(w.first)[has] + 1), before, word


def _pair_keys(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(mix64(u) + w * _PAIR) >> _SHIFT


def _word_keys(w: np.ndarray) -> np.ndarray:
    return mix64(w ^ _WORD) >> _SHIFT


def frequent_words(trusted: DataFrame, shards: int) -> DataFrame:
    """word (null: all), n: words with more than an eighth of a shard's share of the words of a task, and all words together.

    A task leaves a word out of its rows only where it has too few to matter: what is lost of a word is at most an
    eighth of a shard's share.
    """

    def run(batches):
        parts, n = [np.empty(0, np.uint64), np.empty(0, np.int64)], 0

        def out():
            keys, counts = counted(parts)
            own = counts > n / (8 * shards)
            yield pa.RecordBatch.from_arrays([pa.array([None, *keys[own].view(np.int64).tolist()], pa.int64()),
                                              pa.array([n, *counts[own].tolist()], pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in chunks(batch):
                _, before, _ = _bigrams(words(part.column("text")))
                parts += distinct(before)
                n += before.size
                if sum(p.size for p in parts[0::2]) > 4_000_000:
                    parts = list(counted(parts))
                    if parts[0].size > 2_000_000:
                        yield from out()
                        parts, n = [np.empty(0, np.uint64), np.empty(0, np.int64)], 0
        if n:
            yield from out()

    return trusted.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


_PACKED = "shard int, u binary, runs binary, w binary, ranks binary, counts binary"


def _pack_pairs(shard: int, u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row for bigrams in order of (u, w): each context once, each word as its rank among the row's words."""
    at = starts(u)
    known, ranks = np.unique(w, return_inverse=True)
    row = [pack_sorted(u[at]), pack(np.diff(np.append(at, u.size)).astype(np.uint32)), pack_sorted(known), pack(ranks.astype(np.uint32)), pack(counts.astype(np.uint32))]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *[pa.array([x], pa.binary()) for x in row]],
                                      names=["shard", "u", "runs", "w", "ranks", "counts"])


def _unpack_pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(unpack_sorted(row["u"]), unpack(row["runs"])), unpack_sorted(row["w"])[unpack(row["ranks"])], unpack(row["counts"]).astype(np.int64)


def _merged(u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams in order of (u, w), their counts summed."""
    order = np.lexsort((w, u))
    u, w, counts = u[order], w[order], counts[order]
    at = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1]))) if u.size else np.empty(0, np.int64)
    return u[at], w[at], (np.add.reduceat(counts, at) if at.size else counts)


def pair_counts(trusted: DataFrame, deal) -> DataFrame:
    """The bigrams of all trusted text with their counts, one packed row a shard."""

    def count(batches):
        held: list[tuple] = []

        def out():
            u, w, counts = _merged(*map(np.concatenate, zip(*held)))
            shard = deal.value.of_pairs(u, w)
            order = np.argsort(shard, kind="stable")
            at = np.append(0, np.cumsum(np.bincount(shard, minlength=deal.value.shards)))
            for s in np.flatnonzero(np.diff(at)):
                own = order[at[s]:at[s + 1]]
                yield _pack_pairs(int(s), u[own], w[own], counts[own])

        for batch in batches:
            for part in chunks(batch):
                _, u, w = _bigrams(words(part.column("text")))
                held.append(_merged(u, w, np.ones(u.size, np.int64)))
                if sum(x[0].size for x in held) > 3_000_000:
                    yield from out()
                    held.clear()
        if held:
            yield from out()

    def merge(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_pack_pairs(table.column("shard")[0].as_py(), *_merged(*map(np.concatenate, zip(*map(_unpack_pairs, table.to_pylist())))))])

    return written(trusted.select("text").mapInArrow(count, _PACKED).groupBy("shard").applyInArrow(merge, _PACKED))


def modified_discounts(n) -> np.ndarray:
    """Discounts for counts 0, 1, 2, 3+ from the numbers of n-grams that occur 1, 2, 3, 4 times."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in n)
    y = n1 / (n1 + 2 * n2)
    d = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


class Contexts(NamedTuple):
    """Discounts of the bigrams, and total and discounted mass of the contexts that are spread over several shards."""

    discounts: np.ndarray
    hot: np.ndarray
    total: np.ndarray
    mass: np.ndarray

    def of(self, u: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct contexts, total, mass) of a shard's bigrams; ``mass`` as in B(u)."""
        at = starts(u)
        u, total = u[at], np.add.reduceat(counts, at).astype(np.float64) if at.size else np.empty(0)
        mass = np.add.reduceat(self.discounts[np.minimum(counts, 3)], at) if at.size else np.empty(0)
        if self.hot.size and u.size:
            k = np.minimum(np.searchsorted(self.hot, u), self.hot.size - 1)
            own = self.hot[k] == u
            total[own], mass[own] = self.total[k[own]], self.mass[k[own]]
        return u, total, mass


def contexts(pairs: DataFrame, deal) -> Contexts:
    """How many bigrams occur 1, 2, 3, 4 times, and the sums of the spread contexts: a few numbers a shard, added by Spark."""

    def run(batches):
        hot = deal.value.hot
        for batch in batches:
            for row in batch.to_pylist():
                u, _, counts = _unpack_pairs(row)
                many = [int((counts == j).sum()) for j in (1, 2, 3, 4)]
                at = np.flatnonzero(np.isin(u, hot))
                k = np.searchsorted(hot, u[at])
                bc = lambda x: np.bincount(k, x, hot.size).astype(np.int64)  # noqa: B023, E731
                c = counts[at]
                sums = np.stack([bc(c), bc(c == 1), bc(c == 2), bc(c > 2)]) if at.size else np.zeros((4, hot.size), np.int64)
                own = np.flatnonzero(sums[0])
                yield pa.RecordBatch.from_arrays([pa.array([None, *hot[own].view(np.int64).tolist()], pa.int64()), *[
                    pa.array([many[j], *sums[j][own].tolist()], pa.int64()) for j in range(4)]], names=["word", "a", "b", "c", "d"])

    got = pairs.mapInArrow(run, "word long, a long, b long, c long, d long").groupBy("word").agg(*[F.sum(x).alias(x) for x in "abcd"]).toArrow()
    rows = got.to_pylist()
    discounts = modified_discounts(next(([r[x] for x in "abcd"] for r in rows if r["word"] is None), [0] * 4))
    hot = np.array([r["word"] for r in rows if r["word"] is not None], np.int64).view(np.uint64)
    sums = np.array([[r[x] for x in "abcd"] for r in rows if r["word"] is not None], np.float64).reshape(-1, 4)
    order = np.argsort(hot)
    return Contexts(discounts, hot[order], sums[order, 0], sums[order, 1:] @ discounts[1:])


_ANSWERS = "kind int, shard int, other int, keys binary, numbers binary, backs binary, n1 long, n2 long, n3 long, n4 long, total long, types long"


def word_rows(pairs: DataFrame, deal, ctx) -> DataFrame:
    """What each shard of words knows: rows of kind 1, one a shard (its words, how many words stand before each, ln back),
    and of kind 0, the answer to each shard of bigrams (``shard``) about the words it asked for (of shard ``other``)."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                u, _, counts = _unpack_pairs(row)
                known, before = unpack_sorted(row["w"]), np.bincount(unpack(row["ranks"]))
                own, total, mass = ctx.value.of(u, counts)
                back = np.log(mass / total).astype(np.float32)
                out = []
                for kind, w, x in ((0, known, before.astype(np.uint32)), (1, own, back)):
                    shard = deal.value.of_words(w)
                    order = np.argsort(shard, kind="stable")
                    at = np.append(0, np.cumsum(np.bincount(shard, minlength=deal.value.shards)))
                    for s in np.flatnonzero(np.diff(at)):
                        k = order[at[s]:at[s + 1]]
                        out.append((int(s), kind, row["shard"], pack_sorted(w[k]), pack(x[k])))
                for lo in range(0, len(out), 200):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[lo:lo + 200]), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                                     names=["at", "kind", "shard", "keys", "numbers"])

    def answer(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        asks = [(r["shard"], unpack_sorted(r["keys"]), unpack(r["numbers"])) for r in rows if r["kind"] == 0]
        lists = [(unpack_sorted(r["keys"]), unpack(r["numbers"])) for r in rows if r["kind"] == 1]
        parts = [np.empty(0, np.uint64), np.empty(0, np.int64)]
        for _, k, x in asks:
            parts += [k, x.astype(np.int64)]
        for k, _ in lists:
            parts += [k, np.zeros(k.size, np.int64)]
        every, before = counted(parts)
        back = np.zeros(every.size, np.float32)
        for k, x in lists:
            back[np.searchsorted(every, k)] = x
        out = [(1, rows[0]["at"], None, pack_sorted(every), pack(before), pack(back), *[int((before == j).sum()) for j in (1, 2, 3, 4)],
                int(before.sum()), int((before > 0).sum()))]
        out += [(0, s, rows[0]["at"], None, pack(before[np.searchsorted(every, k)].astype(np.uint32)), None, *[None] * 6) for s, k, _ in asks]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 6]
        return pa.table({name.split()[0]: pa.array(c, t) for name, c, t in zip(_ANSWERS.split(", "), zip(*out), kinds)})

    asked = pairs.mapInArrow(ask, "at int, kind int, shard int, keys binary, numbers binary")
    return written(asked.groupBy("at").applyInArrow(answer, _ANSWERS))


class Lower(NamedTuple):
    """The lower order: probabilities of words by how many different words stand before them."""

    discounts: np.ndarray
    total: float
    rest: float  # share of a word never seen

    def __call__(self, before: np.ndarray) -> np.ndarray:
        return np.maximum(before - self.discounts[np.minimum(before, 3)], 0) / self.total + self.rest


def lower_order(words_known: DataFrame) -> Lower:
    n = words_known.where("kind = 1").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n1", "n2", "n3", "n4", "total", "types")]).first()
    d = modified_discounts(n[:4])
    left = (d[1] * n[0] + d[2] * n[1] + d[3] * (n[5] - n[0] - n[1])) / max(1, n[4]) if n[4] else 1.0
    return Lower(d, float(max(1, n[4])), left / (n[5] + 1))


class Common(NamedTuple):
    """What every task knows: the values of frequent words, what they add to the log-probability of a text, and the filter of words."""

    index: Index
    values: np.ndarray
    bits: np.ndarray

    def may_know(self, w: np.ndarray) -> np.ndarray:
        at = (mix64(w) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def common_words(words_known: DataFrame, lower: Lower, shards: int) -> Common:
    """Of each shard of words those with most different words before them, ``COMMON`` in all, and the begin mark; and the filter of all.

    A shard has a range of the words' hashes, so it fills a stretch of the filter.
    """

    def run(batches):
        for batch in batches:
            for keys, numbers, backs in zip(*(batch.column(c).to_pylist() for c in ("keys", "numbers", "backs"))):
                w, before, back = unpack_sorted(keys), unpack(numbers), unpack(backs)
                own = np.argsort(-before, kind="stable")[:COMMON // shards]
                own = np.union1d(own, np.flatnonzero(w == BEGIN))
                at = (mix64(w) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                begin = int(at.min()) >> 3
                bits = np.zeros((int(at.max()) >> 3) - begin + 1, np.uint8)
                np.bitwise_or.at(bits, (at >> 3) - begin, np.uint8(1) << (at & 7).astype(np.uint8))
                yield pa.RecordBatch.from_pydict({
                    "words": pa.array([w[own].tobytes()], pa.binary()), "values": pa.array([_word_values(w, before, back, lower)[own].tobytes()], pa.binary()),
                    "begin": pa.array([begin], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    got = words_known.where("kind = 1").select("keys", "numbers", "backs").mapInArrow(run, "words binary, values binary, begin long, bits binary").toArrow()
    w = np.frombuffer(b"".join(got["words"].to_pylist()), np.uint64)
    values = np.frombuffer(b"".join(got["values"].to_pylist()), np.float32)
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for begin, raw in zip(got["begin"].to_pylist(), got["bits"].to_pylist()):
        bits[begin:begin + len(raw)] |= np.frombuffer(raw, np.uint8)
    order = np.argsort(w)
    return Common(Index(w[order]), values[order], bits)


def _word_values(w: np.ndarray, before: np.ndarray, back: np.ndarray, lower: Lower) -> np.ndarray:
    return np.where(w == BEGIN, back, np.log(lower(before) / lower.rest) + back).astype(np.float32)


_JOINED = "shard int, kind int, block string, a binary, b binary, c binary, d binary"


def requests(documents: DataFrame, deal, common) -> DataFrame:
    """The features of each block of texts by shard (kind 2), and a row for each block that says which texts it has and
    what their frequent words add up to (kind 3).

    A feature is sent once a block: its key, the number of texts that have it, their numbers, and how often each has it.
    """

    def run(batches):
        from pyspark import TaskContext

        shards, number = deal.value.shards, 0
        for batch in batches:
            for part in chunks(batch, size=BLOCK_BYTES):
                block = f"{TaskContext.get().partitionId()}-{number}"
                number += 1
                n_words, base, own_sums = np.zeros(part.num_rows, np.int64), 0, np.zeros(part.num_rows)
                held: list[list[np.ndarray]] = [[], [], []]
                for piece in chunks(part):
                    w = words(piece.column("text"))
                    text, u, v = _bigrams(w)
                    n_words[base:base + piece.num_rows] = np.diff(w.first)
                    at = np.flatnonzero(u == BEGIN)
                    every, of = np.concatenate([v, u[at]]), np.concatenate([text, text[at]])  # words, end marks, begin marks
                    known = common.value.index.find(every)
                    often = np.flatnonzero(known >= 0)
                    own_sums[base:base + piece.num_rows] = np.bincount(of[often], common.value.values[known[often]], piece.num_rows)
                    rare = np.flatnonzero((known < 0) & common.value.may_know(every))
                    pairs = np.flatnonzero(common.value.may_know(u) & common.value.may_know(v))
                    u, v, every = u[pairs], v[pairs], every[rare]
                    place = np.concatenate([deal.value.of_pairs(u, v), deal.value.of_words(every)]).astype(np.uint64) << np.uint64(KEY_BITS)
                    place |= np.concatenate([_pair_keys(u, v), _word_keys(every)])
                    own = np.concatenate([text[pairs], of[rare]]).astype(np.uint32) + np.uint32(base)
                    order = np.lexsort((own, place))
                    place, own = place[order], own[order]
                    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (own[1:] != own[:-1]))) if own.size else np.empty(0, np.int64)
                    for h, x in zip(held, (place[new], own[new], np.diff(np.append(new, own.size)).astype(np.uint32))):
                        h.append(x)
                    base += piece.num_rows
                place, own, counts = map(np.concatenate, held)
                order = np.argsort(place, kind="stable")
                place, own, counts = place[order], own[order], counts[order]
                at = np.searchsorted(place, np.arange(shards + 1, dtype=np.uint64) << np.uint64(KEY_BITS))
                meta = pa.BufferOutputStream()
                with pa.ipc.new_stream(meta, part.drop_columns(["text"]).schema) as out:
                    out.write_batch(part.drop_columns(["text"]))
                rows = [(zlib.crc32(block.encode()) % shards, 3, block, meta.getvalue().to_pybytes(), pack(n_words.astype(np.uint32)), pack(own_sums.astype(np.float32)), None)]
                for s in np.flatnonzero(np.diff(at)):
                    o = slice(at[s], at[s + 1])
                    k = place[o] & np.uint64((1 << KEY_BITS) - 1)
                    first = starts(k)
                    rows.append((int(s), 2, block, pack_sorted(k[first]), pack(np.diff(np.append(first, k.size)).astype(np.uint32)), pack(own[o]), pack(counts[o])))
                for lo in range(0, len(rows), 50):
                    yield _joined(rows[lo:lo + 50])

    return documents.mapInArrow(run, _JOINED)


def _joined(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _JOINED.split(", ")])


def model_values(pairs: DataFrame, words_known: DataFrame, deal, ctx, lower: Lower) -> DataFrame:
    """The model: shard, keys (sorted) and values of its features, in steps of 1 / ``STEP``; one packed row a shard."""

    def run(pair_rows: pa.Table, word_rows: pa.Table) -> pa.Table:
        keys, values, shard = [np.empty(0, np.uint64)], [np.empty(0, np.float32)], None
        answers = {}
        for row in word_rows.to_pylist():
            shard = row["shard"]
            if row["kind"] == 0:
                answers[row["other"]] = unpack(row["numbers"])
            else:
                w = unpack_sorted(row["keys"])
                keys.append(_word_keys(w))
                values.append(_word_values(w, unpack(row["numbers"]), unpack(row["backs"]), lower))
        for row in pair_rows.to_pylist():
            shard = row["shard"]
            u, w, counts = _unpack_pairs(row)
            mine = unpack_sorted(row["w"])
            home, before = deal.value.of_words(mine), np.zeros(mine.size, np.int64)
            for other, x in answers.items():
                before[home == other] = x
            context, _, mass = ctx.value.of(u, counts)
            share = np.maximum(counts - ctx.value.discounts[np.minimum(counts, 3)], 0)
            keys.append(_pair_keys(u, w))
            values.append(np.log1p(share / (mass[np.searchsorted(context, u)] * lower(before)[np.searchsorted(mine, w)])).astype(np.float32))
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        at = starts(key)
        steps = np.clip(np.rint(value[at] * STEP), -(1 << 15), (1 << 16) - 1).astype(np.int32)
        return pa.table({"shard": pa.array([shard], pa.int32()), "keys": pa.array([pack_sorted(key[at])], pa.binary()), "values": pa.array([pack(steps)], pa.binary())})

    return written(pairs.groupBy("shard").cogroup(words_known.select("shard", "kind", "other", "keys", "numbers", "backs").groupBy("shard")).applyInArrow(
        run, "shard int, keys binary, values binary"))


class Shard(NamedTuple):
    """Sorted keys of a shard's features and their values."""

    index: Index
    values: np.ndarray

    def sums(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the texts of a request, sum of the values of each one's features)."""
        at = self.index.find(unpack_sorted(row["a"]))
        value = np.where(at < 0, np.float32(0), self.values[at] if self.values.size else np.float32(0))
        text = unpack(row["c"])
        total = np.bincount(text, np.repeat(value, unpack(row["b"])) * unpack(row["d"]))
        own = np.flatnonzero(total)
        return own.astype(np.uint32), total[own].astype(np.float32)


def entropies(documents: DataFrame, trusted: DataFrame) -> DataFrame:
    """The columns of documents but the text, n_words, entropy (nats a word or end mark; null without words) of every row.

    Each partition of the join holds one shard of the model at a time and streams the requests past it.
    """
    spark = documents.sparkSession
    size = trusted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = width(spark)
    shards = max(n, -(-size // SHARD_BYTES))
    heavy = frequent_words(trusted, shards).toArrow().to_pylist()
    every = next((r["n"] for r in heavy if r["word"] is None), 0)
    heavy = [(r["word"] & (1 << 64) - 1, -(-2 * shards * r["n"] // every)) for r in heavy if r["word"] is not None and r["n"] * 2 * shards > every]
    heavy.sort()
    deal = spark.sparkContext.broadcast(Deal(shards, np.array([w for w, _ in heavy], np.uint64), np.array([min(k, shards) for _, k in heavy], np.int64)))
    pairs = pair_counts(trusted, deal)
    ctx = spark.sparkContext.broadcast(contexts(pairs, deal))
    known = word_rows(pairs, deal, ctx)
    lower = lower_order(known)
    common = spark.sparkContext.broadcast(common_words(known, lower, shards))

    model = model_values(pairs, known, deal, ctx, lower)
    discard(pairs, known)

    null = F.lit(None).cast("binary")
    rows = model.select("shard", F.lit(1).alias("kind"), F.lit("").alias("block"), F.col("keys").alias("a"), F.col("values").alias("b"), null.alias("c"), null.alias("d"))
    rows = rows.union(requests(documents, deal, common))

    def join(batches):
        at, shard = None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("shard", "kind", "block", "a", "b", "c", "d")}
                if row["shard"] != at:
                    at, shard = row["shard"], Shard(Index(np.empty(0, np.uint64)), np.empty(0, np.float32))
                if row["kind"] == 1:
                    shard = Shard(Index(unpack_sorted(row["a"])), unpack(row["b"]).astype(np.float32) / np.float32(STEP))
                elif row["kind"] == 2:
                    text, sums = shard.sums(row)
                    out.append((row["block"], pack(text), pack(sums), None))
                else:
                    out.append((row["block"], row["b"], row["c"], row["a"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.binary(), pa.binary(), pa.binary()))],
                                                 names=["block", "texts", "sums", "meta"])

    dealt = rows.repartitionById(n, F.pmod(F.col("shard"), F.lit(n))).sortWithinPartitions("shard", "kind")
    sums = dealt.mapInArrow(join, "block string, texts binary, sums binary, meta binary")
    schema = documents.drop("text").schema

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["meta"] is not None)
        own = pa.ipc.open_stream(head["meta"]).read_all()
        n_words = unpack(head["texts"]).astype(np.int64)
        total = (n_words + 1) * np.log(lower.rest) + unpack(head["sums"])
        for r in rows:
            if r["meta"] is None:
                total[unpack(r["texts"])] += unpack(r["sums"])
        own = own.append_column("n_words", pa.array(n_words))
        return own.append_column("entropy", pa.array(-total / (n_words + 1), mask=n_words == 0))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return sums.groupBy("block").applyInArrow(add, f"{kinds}, n_words long, entropy double")


def trusted_labels(labels: DataFrame) -> DataFrame:
    """doc_id and held_out (a fifth, by hash) of documents whose labels all say good and not toxic."""
    ok = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return ok.where("q = 1 and t = 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held_out"))


def score(documents: DataFrame, labels: DataFrame, *, quantile: float = 0.99, margin: float = 0.05) -> DataFrame:
    """doc_id, text_hash, n_words, entropy, perplexity, limit, kept for every row of documents.

    The model learns all words and bigrams of all trusted documents (labelled
    good and not toxic) but every fifth of them, by hash.  The limit of a language is
    the ``quantile`` of the entropies of those, times 1 + ``margin``, plus room
    for short texts: the spread of their entropies divided by the square root
    of the number of words.  Languages (null is one) with fewer than 20 of them
    take the limit of all; without any trusted document nothing is rejected.
    Texts that are null or have no words have no perplexity and are rejected.
    Repeated rows stay, whatever ids they have; texts of any length are scored
    whole; an empty table gives an empty result; other columns are dropped.
    """
    chosen = written(trusted_labels(labels))
    few = chosen.count() <= BROADCAST_IDS
    by_id = chosen.withColumnRenamed("doc_id", "c_id")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(
        F.broadcast(by_id) if few else by_id, F.col("doc_id") == F.col("c_id"), "left").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "lang", "held_out", "text")
    scored = written(entropies(docs, docs.where("not held_out").select("text")))
    calm = scored.where("held_out and entropy is not null")
    figures = [F.percentile_approx(F.when(F.col("n_words") >= 50, F.col("entropy")), F.lit(quantile), F.lit(10_000)).alias("q"),
               F.percentile_approx("entropy", F.lit(0.5), F.lit(10_000)).alias("middle"), F.count(F.lit(1)).alias("n")]
    overall = calm.agg(*figures).select(F.coalesce("q", "middle").alias("all_q"))
    by_lang = calm.groupBy(F.col("lang").alias("b_lang")).agg(*figures).where("n >= 20 and q is not null").select("b_lang", "q")
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("b_lang")), "left").crossJoin(F.broadcast(overall))
    limit = F.coalesce("q", "all_q") * (1 + margin) + F.lit(6.0) / F.sqrt(F.greatest("n_words", F.lit(1)))
    return out.withColumn("limit", limit).select(
        "doc_id", "text_hash", "n_words", "entropy", F.exp("entropy").alias("perplexity"), "limit",
        (F.col("entropy").isNotNull() & F.coalesce(F.col("entropy") <= F.col("limit"), F.lit(True))).alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of documents that ``score`` keeps, all columns unchanged, whatever their names."""
    bad = score(documents, labels, **options).where("not kept").select("doc_id", "text_hash").distinct()
    own_id, own_hash, b_id, b_hash = fresh(documents, 4)
    keyed = documents.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64("text")})
    bad = bad.toDF(b_id, b_hash)
    gone = F.col(own_id).eqNullSafe(F.col(b_id)) & (F.col(own_hash) == F.col(b_hash))
    return keyed.join(bad, gone, "left_anti").drop(own_id, own_hash)
