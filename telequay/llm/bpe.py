"""Operator 3: exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can come last in its encoding.  An
automaton gives the tokens that are suffixes of the prefix; the one whose pair
with the last token of what stands before it survives the merges unchanged is
stored; back-pointers from the whole word give the ids.  A pair of tokens is
tested by undoing merges at the seam, without merging anything.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .records import Remembered

def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(sorted(set(range(256)) - set(own)))}


#: Characters on which all tables of letters, cases and compositions agree: printable ASCII and the letters of Latin-1 and
#: Latin Extended-A, but for the I with a dot.  Pieces with others are normalised and cut by the tokenizer's own tables.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ž]*")


class PairBpe:
    """A word-end BPE vocabulary with normalised, lower-case words (a tokenizers JSON file)."""

    def __init__(self, path: str, keep: int = 100_000):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        own = Tokenizer.from_file(path)  # for its normaliser and the cutting of words; the merges are done here
        self.normalize, self.cut = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = re.compile(split.replace(r"\p{L}", "a-zß-öø-ÿā-ž").replace(r"\p{N}", "0-9")).findall  # of plain pieces in lower case
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.keep = keep
        self.forget()

        # Symbols: a byte letter, or one that ends a word (shifted beyond all letters).
        self.shift = 0x1000
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(merges) if a in self.vocab and b in self.vocab}
        self.joined = {pair: self.vocab[merges[r][0] + merges[r][1]] for pair, r in self.rank.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        for pair in sorted(self.rank, key=self.rank.get):
            self.parts.setdefault(self.joined[pair], pair)
        spelled = {i: self.symbols(t) for t, i in self.vocab.items()}
        self.length = {i: len(s) for i, s in spelled.items()}
        self.whole = {}
        automaton = ahocorasick.Automaton()
        for i, s in spelled.items():
            if len(s) == 1 or self.reachable(i):
                automaton.add_word(s, i)
                self.whole[s] = i
        automaton.make_automaton()
        self.suffixes = automaton.iter

    def forget(self) -> None:
        """Drop what was remembered; workers outlive tasks and should not hold on to it."""
        self.pieces, self.words = Remembered(self.keep), Remembered(self.keep)
        self.pairs: dict[int, bool] = {}

    def symbols(self, token: str) -> str:
        """A token as one character for each symbol."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + self.shift)
        return token

    def reachable(self, token: int) -> bool:
        """A token can come out of the merges if its own two parts stay together."""
        return token in self.parts and self.compatible(*self.parts[token], self.rank[self.parts[token]])

    def compatible(self, left: int, right: int, until: int | None = None) -> bool:
        """Whether ``left`` and ``right`` side by side stay as they are.

        Undo, on either side of the seam, the later of the two merges that made
        the neighbours; if at some point the pair at the seam would have merged
        before both of them were made, the tokens don't stay.  With ``until``
        only merges before that rank count: are the parts of a token formed?
        """
        limit = len(self.rank) if until is None else until
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < limit:
                return False
            made = self.rank[self.parts[left]] if left in self.parts else -1
            made_right = self.rank[self.parts[right]] if right in self.parts else -1
            if made < 0 and made_right < 0:
                return True
            if made > made_right:
                limit, left = made, self.parts[left][1]
            else:  # of equal merges the leftmost comes first, so one at the seam comes before the right token's
                limit, right = made_right + 1, self.parts[right][0]

    def cut_piece(self, piece: str) -> list[str]:
        """The words of a piece without a blank, spelled in byte letters."""
        if piece.isascii() and piece.isprintable():
            return self.words_of(piece.lower())
        if PLAIN.fullmatch(piece):
            return ["".join([self.letters[b] for b in w.encode()]) for w in self.words_of(piece.lower())]
        return [w for w, _ in self.cut(self.normalize(piece))]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, spelled in byte letters, by the table over its prefixes."""
        s = word[:-1] + chr(ord(word[-1]) + self.shift) if self.end else word
        if (i := self.whole.get(s)) is not None:
            return [i]
        last: list[int | None] = [None] * len(s)
        pairs, length = self.pairs, self.length
        if len(pairs) > 500_000:
            pairs.clear()
        for at, token in self.suffixes(s):
            if last[at] is not None:
                continue
            before = at - length[token]
            if before < 0:
                last[at] = token
                continue
            other = last[before]
            if other is None:
                continue
            key = other << 20 | token
            ok = pairs.get(key)
            if ok is None:
                ok = pairs[key] = self.compatible(other, token)
            if ok:
                last[at] = token
        ids, at = [], len(s) - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: what a vocabulary without a decoder gives."""
        return " ".join([self.tokens[i] for i in ids])

    def encode_pieces(self, pieces: set[str]) -> dict[str, tuple[str, str, int]]:
        """For pieces without a blank: ids as text, the decoded text, the number of ids."""
        new = self.pieces.missing(pieces)
        words = [self.cut_piece(x) for x in new]
        fresh = self.words.missing(set().union(*words)) if words else ()
        known, out = self.words.young, self.pieces.young
        for w in fresh:
            ids = self.encode_word(w)
            known[w] = (" ".join(map(str, ids)), self.decode(ids), len(ids))
        for piece, ws in zip(new, words):
            got = [known[w] for w in ws]
            out[piece] = (" ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got]))
        return out

    def encode(self, texts: list[str]) -> list[tuple[str, str, int]]:
        """For each whole text: ids as decimals joined by spaces, the decoded text, the number of ids."""
        cut, distinct = [], set()
        for text in texts:
            parts = self.special.split(text) if self.special and any(a in text for a in self.added) else [text]
            rows = []
            for k, part in enumerate(parts):  # odd parts are added tokens
                rows.append((part,) if k % 2 else part.replace("\n", " ").split(" ") if part else ())
                distinct.update(() if k % 2 else rows[-1])
            cut.append(rows)
        known = self.encode_pieces(distinct)
        out = []
        for rows in cut:
            got = []
            for k, row in enumerate(rows):
                if k % 2:
                    got.append((str(self.added[row[0]]), row[0], 1))
                else:
                    got += [g for g in map(known.__getitem__, row) if g[2]]
            ids, text, n = zip(*got) if got else ((), (), ())
            out.append((" ".join(ids), " ".join(text), sum(n)))
        return out


_MODELS: dict[str, PairBpe] = {}


def model(path: str) -> PairBpe:
    """One model for each vocabulary and Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PairBpe(path)
    return _MODELS[path]


def encode_documents(documents: DataFrame, *, vocabulary: str, texts_at_once: int = 256) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    Null and empty texts have no ids: both digests are those of the empty
    string.  Repeated rows stay; an empty table gives an empty result; other
    columns are dropped.
    """

    def run(batches):
        bpe = model(vocabulary)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(lo, texts_at_once)
                got = bpe.encode([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[2] for g in got], pa.int64()), pa.array([sha(g[0]) for g in got]),
                     pa.array([sha(g[1]) for g in got])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(documents: DataFrame, *, vocabulary: str, texts_at_once: int = 256) -> DataFrame:
    """doc_id, ids (array of int): the ids themselves, for training."""

    def run(batches):
        bpe = model(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, texts_at_once):
                part = batch.slice(lo, texts_at_once)
                got = bpe.encode([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([list(map(int, g[0].split())) for g in got], pa.list_(pa.int32()))], names=["doc_id", "ids"])
        bpe.forget()

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")
