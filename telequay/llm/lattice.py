"""Operator 12: likelihood of texts over lattices of subwords.

A public vocabulary of pieces with scores spells every string in many ways: an
arc for each piece that fits, and for each character one of its byte pieces.
The forward recursion, in log space, sums the probabilities of all paths; it
runs over many words at once, one position after the other.  As a piece holds
no word boundary in its inside, a text's lattice falls apart at words, and the
lattice of each distinct word is worked out once for the whole corpus.

The scores of the vocabulary are the prior of the pieces' probabilities;
expected counts over all segmentations of all distinct training words (the
backward recursion) update them.  A word seen in training is one more arc over
its whole length, weighed by its count.  So

    P(word) = (1 - P(end)) ((1 - open) c(word) / C + open * lattice(word))

with C the training words, ``open`` the share of words seen once (what Good and
Turing leave for unseen words) and P(end) by the training documents.  All of it
sums to one over texts.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import starts
from .shared import width, written
from .tiers import threshold

MARK = "▁"
#: At most this many words go to every task with their scores.
FREQUENT = 1 << 17
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000
_LN10 = math.log(10)


class Pieces(NamedTuple):
    """Natural logarithms: of a piece that begins a word, of one that goes on, of ending a word."""

    first: np.ndarray
    more: np.ndarray
    stop: float


class Vocabulary:
    """Pieces of a sentencepiece model: those that begin with the word mark, those that don't, and bytes."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        texts = [m.id_to_piece(i) for i in range(n)]
        self.n, self.bytes = n, np.zeros(256, np.int64)
        self.length, self.begins, usable = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        weight = np.zeros(n)
        automaton = ahocorasick.Automaton()
        for i, text in enumerate(texts):
            if m.is_byte(i):
                self.bytes[int(text[3:5], 16)] = i
                usable[i] = True
                weight[i] = 1 / n
            elif not (m.is_control(i) or m.is_unknown(i) or MARK in text[1:]):
                automaton.add_word(text, i)
                self.length[i], self.begins[i], usable[i] = len(text), text[0] == MARK, True
                weight[i] = 1 / (2 + min(-m.get_score(i), n))  # scores fall with the rank: Zipf's law
        automaton.make_automaton()
        self.matches = automaton.iter
        self.first, self.more = usable & self.begins, usable & ~self.begins
        self.prior = weight

    def start(self) -> Pieces:
        """Probabilities by the vocabulary's own scores."""
        return self.pieces(np.zeros(self.n), 1.0, 0.0)

    def pieces(self, counts: np.ndarray, words: float, strength: float = 1000.0) -> Pieces:
        """Probabilities by expected counts, with the vocabulary's scores as ``strength`` more counts of either kind."""
        def logs(which, extra):
            prior = np.where(which, self.prior, 0)
            prior = prior / prior.sum()
            own = np.where(which, counts, 0)
            total = own.sum() + extra + (strength or 1.0)
            with np.errstate(divide="ignore"):
                return np.log((own + (strength or 1.0) * prior) / total), total
        first, _ = logs(self.first, 0.0)
        more, total = logs(self.more, words)
        return Pieces(first, more, math.log(words / total) if words else -math.log(2))


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each file and Python worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


class Lattice:
    """Arcs of many words' lattices; nodes of word w are base[w] ... base[w + 1] - 1, before, between and after its characters."""

    def __init__(self, v: Vocabulary, words: list[str]):
        marked = "".join([MARK + w for w in words])
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.append(0, np.cumsum(size))[:-1]  # of each marked word, in characters
        word_of = np.repeat(np.arange(len(words)), size)
        self.base = begin + np.arange(len(words))
        self.last = self.base + size
        hits = np.array(list(v.matches(marked)), np.int64).reshape(-1, 2)
        piece = hits[:, 1]
        src = hits[:, 0] + 1 - v.length[piece]
        inside = np.arange(src.size)[v.begins[piece] == (src == begin[word_of[src]])]  # the mark as a letter of a word is no word mark
        piece, src = piece[inside], src[inside]
        # a character as its bytes, but for the mark in front
        raw = np.frombuffer(marked.encode(), np.uint8)
        at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), raw.size)  # where each character begins
        self.byte_ids = v.bytes[raw]
        self.byte_at = at
        letters = np.ones(len(marked), bool)
        letters[begin] = False
        chars = np.flatnonzero(letters)
        n = piece.size
        self.piece = np.concatenate([piece, np.full(chars.size, -1)])
        src = np.concatenate([src, chars])
        end = src + np.concatenate([v.length[piece], np.ones(chars.size, np.int64)])
        word = word_of[src]
        self.begins = np.concatenate([v.begins[piece], np.zeros(chars.size, bool)])
        self.word, self.src, self.dst, self.level = word, src + word, end + word, end - begin[word]
        order = np.lexsort((self.dst, self.level))
        for name in ("piece", "begins", "word", "src", "dst", "level"):
            setattr(self, name, getattr(self, name)[order])
        self.chars = np.concatenate([np.full(n, -1), chars])[order]
        self.nodes = int(self.last[-1]) + 1 if len(words) else 0
        self.cuts = np.append(starts(self.level), self.level.size)

    def scores(self, p: Pieces) -> np.ndarray:
        """Of each arc; a character by bytes has the sum of its bytes' scores."""
        by_byte = np.append(0.0, np.cumsum(p.more[self.byte_ids]))
        chars = np.maximum(self.chars, 0)
        spelled = by_byte[self.byte_at[chars + 1]] - by_byte[self.byte_at[chars]]
        piece = np.maximum(self.piece, 0)
        return np.where(self.chars >= 0, spelled, np.where(self.begins, p.first[piece], p.more[piece]))

    def forward(self, score: np.ndarray, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """(log sum over the paths to each node, log sum over all paths of each word)."""
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.base] = 0
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:]):
            log_sums(alpha, self.dst[lo:hi], alpha[self.src[lo:hi]] + score[lo:hi])
        return alpha, alpha[self.last] + stop

    def backward(self, score: np.ndarray, stop: float) -> np.ndarray:
        """Log sum over the paths from each node to the end of its word."""
        beta = np.full(self.nodes, -np.inf)
        beta[self.last] = stop
        level = self.src - self.base[self.word]
        order = np.lexsort((self.src, -level))
        cuts = np.append(starts(level[order]), order.size)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            arcs = order[lo:hi]
            log_sums(beta, self.src[arcs], beta[self.dst[arcs]] + score[arcs])
        return beta

    def expected(self, v: Vocabulary, p: Pieces) -> np.ndarray:
        """How often each piece is used, expected over all segmentations of the words."""
        score = self.scores(p)
        alpha, total = self.forward(score, p.stop)
        beta = self.backward(score, p.stop)
        used = np.exp(alpha[self.src] + score + beta[self.dst] - total[self.word])
        counts = np.bincount(self.piece[self.piece >= 0], used[self.piece >= 0], v.n)
        by_char = np.zeros(self.byte_at.size)
        by_char[self.chars[self.chars >= 0]] = used[self.chars >= 0]
        return counts + np.bincount(self.byte_ids, np.repeat(by_char[:-1], np.diff(self.byte_at)), v.n)


def log_sums(out: np.ndarray, to: np.ndarray, values: np.ndarray) -> None:
    """out[t] = log of the sum of exp(values) of each run of equal ``to``."""
    at = starts(to)
    top = np.maximum.reduceat(values, at)
    out[to[at]] = top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, np.diff(np.append(at, to.size)))), at))


def lattices(v: Vocabulary, words: list[str], letters: int = 200_000):
    """(positions, Lattice) of words of about the same length, some at a time."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    lo = 0
    while lo < len(order):
        hi, n = lo, 0
        while hi < len(order) and (hi == lo or n + len(words[order[hi]]) <= letters):
            n += len(words[order[hi]]) + 1
            hi += 1
        yield order[lo:hi], Lattice(v, [words[i] for i in order[lo:hi]])
        lo = hi


def log_likelihood(v: Vocabulary, p: Pieces, words: list[str]) -> np.ndarray:
    """Natural logarithm of the lattice's probability of each word."""
    out = np.empty(len(words))
    for at, net in lattices(v, words):
        out[at] = net.forward(net.scores(p), p.stop)[1]
    return out


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; what is cut and lowered is ASCII only."""
    return (text or "").encode().lower().split()


def held_out(doc_id: Column) -> Column:
    """Whether a document is not learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def count_words(documents: DataFrame) -> DataFrame:
    """token, c (in training texts), total (in all); the token '' is the end of a text."""

    def run(batches):
        def table():
            keys = list(both)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()).cast(pa.string()), pa.array([train[k] for k in keys], pa.int64()), pa.array(list(both.values()), pa.int64())],
                names=["token", "c", "total"])

        both, train = Counter(), Counter()
        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                words.append(b"")
                both.update(words)
                if not held:
                    train.update(words)
                if len(both) > HELD:
                    yield table()
                    both, train = Counter(), Counter()
        yield table()

    rows = documents.select("text", held_out(F.col("doc_id")).alias("held"))
    return rows.mapInArrow(run, "token string, c long, total long").groupBy("token").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


class Model(NamedTuple):
    words: DataFrame  # token, c, total, base_logp, logp (base 10); '' is the end
    train_tokens: int
    distinct: int
    unseen_base: float


def learn_pieces(words: DataFrame, path: str, rounds: int) -> Pieces:
    """Expected counts of pieces over the lattices of all distinct training words, some rounds of them."""
    def of(p):
        def run(batches):
            v = vocabulary(path)
            counts, n = np.zeros(v.n), 0
            for batch in batches:
                own = batch.column(0).to_pylist()
                n += len(own)
                for _, net in lattices(v, own):
                    counts += net.expected(v, p)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), pa.array(np.append(counts[used], n), pa.float64())], names=["piece", "n"])
        return run

    v = vocabulary(path)
    p = v.start()
    for _ in range(rounds):  # at most as many rows as the vocabulary has pieces come to the driver
        got = {r.piece: r.n for r in words.mapInArrow(of(p), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
        n = got.pop(-1, 0.0)
        counts = np.zeros(v.n)
        counts[list(got)] = list(got.values())
        p = v.pieces(counts, n)
    return p


def learn(documents: DataFrame, *, vocabulary_path: str, rounds: int = 1) -> Model:
    """Counts of all words of all training texts, pieces' probabilities and every word's log-probability."""
    counts = written(count_words(documents))
    word = F.col("token") != ""
    got = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.sum(F.when(~word, F.col("c"))).alias("ends"),
                     F.count_if(word & (F.col("c") == 1)).alias("once")).first()
    n, ends, once = got.n or 0, got.ends or 0, got.once
    p = learn_pieces(counts.where(word & (F.col("c") > 0)).select("token").repartition(width(documents.sparkSession)), vocabulary_path, rounds)
    end = (ends + 0.5) / (n + 1)
    total = n - ends
    opened = (once + 0.5) / (total + 1) if total else 1.0
    add = n + 0.1 * (got.v + 1)

    def run(batches):
        v = vocabulary(vocabulary_path)
        for batch in batches:
            own = batch.column("token").to_pylist()
            c = batch.column("c").to_numpy(zero_copy_only=False).astype(np.float64)
            spelled = log_likelihood(v, p, own)
            with np.errstate(divide="ignore"):
                seen = np.log(c) - math.log(total) + math.log1p(-opened) if total else np.full(c.size, -np.inf)
            logp = math.log1p(-end) + np.logaddexp(seen, math.log(opened) + spelled)
            logp[np.array([w == "" for w in own], bool)] = math.log(end)
            base = np.log10((c + 0.1) / add) if n else np.log10(np.full(c.size, 0.1 / add))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base), pa.array(logp / _LN10)], names=["token", "c", "total", "base_logp", "logp"])

    words = counts.repartition(width(documents.sparkSession)).mapInArrow(run, "token string, c long, total long, base_logp double, logp double")
    return Model(written(words), n, got.v, math.log10(0.1 / add))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Scores of all texts under a model: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model has a row for every word of ``documents``.  Frequent words, at
    most ``FREQUENT``, go to every task; the others of a text are joined.
    """
    bound = threshold(model.words, "total", FREQUENT)
    common = model.words.where((F.col("total") >= bound) | (F.col("token") == "")).toArrow()
    known = dict(zip(common.column("token").cast(pa.binary()).to_pylist(),
                     zip((pc.greater(common.column("c"), 0)).to_pylist(), common.column("base_logp").to_pylist(), common.column("logp").to_pylist())))
    sent = documents.sparkSession.sparkContext.broadcast(known)
    kind = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
            "rest array<string>, rest_n array<long>")

    def run(batches):
        known = sent.value
        for batch in batches:
            out = []
            for doc_id, text, held in zip(*[c.to_pylist() for c in batch.columns]):
                words = tokens(text)
                words.append(b"")
                own, n_known, base, logp, rest = Counter(words), 0, 0.0, 0.0, []
                for w, n in own.items():
                    found = known.get(w)
                    if found is None:
                        rest.append(w)
                    else:
                        n_known += n * found[0]
                        base += n * found[1]
                        logp += n * found[2]
                out.append((doc_id, held, len(words), n_known, base, logp, rest, [own[w] for w in rest]))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array(cols[6], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(cols[7], pa.list_(pa.int64()))],
                names=[x.split(" ")[0] for x in kind.split(", ")])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    each = written(rows.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()))
    left = each.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("r")).select("row", F.col("r.rest").alias("token"), F.col("r.rest_n").alias("n"))
    rare = model.words.where(F.col("total") < bound).select("token", "c", "base_logp", "logp")
    more = left.join(rare, "token").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("m_known"), F.sum(F.col("n") * F.col("base_logp")).alias("m_base"), F.sum(F.col("n") * F.col("logp")).alias("m_score"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return each.drop("rest", "rest_n").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("m_known")).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("m_base")).alias("base_score"), (F.col("score") + zero("m_score")).alias("score"))


def score_documents(documents: DataFrame, *, vocabulary_path: str, rounds: int = 1) -> DataFrame:
    """Learn from the documents that are not held out and score all of them.

    Null and empty texts are one token, the end.  Null doc_ids count as the
    empty text (held out); repeated rows stay.  Texts and words of any length
    are treated whole.  Without a training text every word is spelled by the
    vocabulary's own scores.  An empty table gives an empty result.
    """
    return score(documents, learn(documents, vocabulary_path=vocabulary_path, rounds=rounds))
