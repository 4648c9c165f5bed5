"""Whitening, lattice scoring and alignment against brute force, with odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from telequay.llm import alignment, lattice, tiers, whitening

from .test_operators import DOCS, ODD, documents, made

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# 11

def whitened(rows, k):
    """(n, deviation of each row, whitened columns up to sign, share of the variance) by numpy."""
    x = np.array([np.floor(np.array(r, np.float64) * 256) for r in rows]).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)
    e, v = e[order], v[:, order]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ (v[:, :k] / np.sqrt(e[:k])), e[:k] / e.sum()


@pytest.mark.parametrize("cols_per_block", [512, 3])
def test_whitening_equals_numpy(spark, monkeypatch, cols_per_block):
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(whitening, "COLS_PER_BLOCK", cols_per_block)
    r = np.random.default_rng(3)
    rows = (r.normal(size=(150, 7)) * [3, 2, 1.5, 1, .5, .3, .1] + 5).tolist()
    rows += [rows[0]] * 80  # one vector is a third of all rows and counts once
    d = spark.createDataFrame([(i, x, "other") for i, x in enumerate(rows)], "vec_id long, embedding array<double>, x string")
    got = whitening.whiten(d, components=4).toPandas()
    n, deviation, w, share = whitened(rows, 4)
    assert len(got) == 4 * len(rows) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    table = got.pivot_table(index="vec_id", columns="component", values="whitened").loc[range(len(rows))].to_numpy()
    assert np.abs(table * np.sign((table * w).sum(0)) - w).max() < 1e-9
    one = got[got.component == 2].set_index("vec_id").loc[range(len(rows))]
    assert (one.deviation.to_numpy() == deviation).all() and one.explained.iloc[0] == pytest.approx(share[1], rel=1e-9)


def test_whitening_of_odd_rows(spark):
    kind = "vec_id long, embedding array<float>"
    rows = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 2.0]), (6, [1.0]), (7, []), (7, [3.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((i, c) for i in ("None", "6", "7", "7") for c in (1, 2))
    assert {r.n for r in got} == {4} and all(r.whitened is not None for r in got)
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], kind)).collect()  # no variance at all
    assert len(same) == 10 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], kind)).collect()
    assert len(huge) == 4 and {r.deviation for r in huge} == {None}
    for none in ([], rows[:4]):
        empty = whitening.whiten(spark.createDataFrame(none, kind), components=4)
        assert empty.count() == 0 and dict(empty.dtypes)["whitened"] == "double"


# 12

def paths(v, p, word):
    """Probabilities of all segmentations of a word, one by one."""
    text, out = lattice.MARK + word, []
    ids = {m.id_to_piece(i): i for m in [__import__("sentencepiece").SentencePieceProcessor(model_file=B)] for i in range(v.n)}

    def walk(at, logp):
        if at == len(text):
            out.append(logp + p.stop)
            return
        for end in range(at + 1, len(text) + 1):
            i = ids.get(text[at:end])
            if i is not None and (p.first if at == 0 else p.more)[i] > -math.inf:
                walk(end, logp + (p.first if at == 0 else p.more)[i])
        if at:
            walk(at + 1, logp + sum(p.more[v.bytes[b]] for b in text[at].encode()))

    walk(0, 0.0)
    return out


WORDS = ["a", "the", "there", "ü", "日本", "xq7", "▁a", "a▁b", "été", "aaaa", "\x01", "👍🏽", "reading"]


def test_lattice_sums_all_segmentations():
    v = lattice.vocabulary(B)
    p = v.pieces(np.random.default_rng(1).random(v.n), 3.0)
    got = lattice.log_likelihood(v, p, WORDS)
    for w, x in zip(WORDS, got):
        assert x == pytest.approx(math.log(sum(map(math.exp, paths(v, p, w)))), rel=1e-9), w
    assert np.logaddexp.reduce(p.first) == pytest.approx(0, abs=1e-9) and np.logaddexp(np.logaddexp.reduce(p.more), p.stop) == pytest.approx(0, abs=1e-9)


def test_expected_counts_use_every_character_once():
    v = lattice.vocabulary(B)
    p = v.pieces(np.zeros(v.n), 1.0)
    for w in WORDS:
        counts = lattice.Lattice(v, [w]).expected(v, p)
        by_bytes = counts[v.bytes].sum()
        covered = (counts * v.length).sum()
        assert counts[v.begins].sum() == pytest.approx(1) and covered <= len(w) + 1 + 1e-9 and covered + by_bytes >= len(w) + 1 - 1e-9


def scored(texts):
    """Counts and base scores by brute force."""
    c = collections.Counter()
    words = [(t or "").encode().lower().split() + [b""] for t in texts]
    for i, w in enumerate(words):
        if zlib.crc32(str(i).encode()) % 10:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return n, [(zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + .1) / (n + .1 * (v + 1))) for x in w)) for i, w in enumerate(words)]


@pytest.mark.parametrize("frequent", [1 << 17, 3])
def test_scores_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    monkeypatch.setattr(lattice, "HELD", 5)
    texts = ODD + [made(s, 30) for s in range(40)] + ["held out only"] * 3
    got = {r.doc_id: r for r in lattice.score_documents(documents(spark, texts), vocabulary_path=B).collect()}
    n, want = scored(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (*w[:3], n) and r.base_score == pytest.approx(w[3]) and r.score < 0


def test_probabilities_of_words_follow_the_stated_mixture(spark):
    texts = ["a b b c", "b ü", "c c a", "z"] * 3
    model = lattice.learn(documents(spark, texts), vocabulary_path=B, rounds=0)
    rows = {r.token: r for r in model.words.collect()}
    v = lattice.vocabulary(B)
    p = v.pieces(np.zeros(v.n), 0.0)
    ends, once = rows[""].c, sum(r.c == 1 and r.token != "" for r in rows.values())
    n = model.train_tokens
    end, total = (ends + .5) / (n + 1), n - ends
    opened = (once + .5) / (total + 1)
    assert rows[""].logp == pytest.approx(math.log10(end))
    for w in "abcz":
        spelled = sum(map(math.exp, paths(v, v.start(), w)))
        assert rows[w].logp == pytest.approx(math.log10((1 - end) * ((1 - opened) * rows[w].c / total + opened * spelled)))
    assert p.stop < 0


def test_training_makes_texts_like_those_of_training_likelier(spark):
    texts = [made(s % 7, 60) for s in range(60)]
    got = lattice.score_documents(documents(spark, texts), vocabulary_path=B).toPandas()
    held = got[got.held_out]
    assert len(held) and (held.score / held.n_tokens).mean() > -4 and (held.n_known == held.n_tokens).all()


def test_scores_without_training_texts_and_without_rows(spark):
    d = spark.createDataFrame([(None, "a b", "x"), (None, None, "y")], "doc_id long, text string, token string")  # a null id is held out
    got = lattice.score_documents(d, vocabulary_path=B).collect()
    assert [r.n_known for r in got] == [0, 0] and all(r.train_tokens == 0 and math.isfinite(r.score) and r.held_out for r in got)
    assert lattice.score_documents(d.limit(0), vocabulary_path=B).count() == 0


def test_threshold_keeps_its_promise(spark):
    for counts in ([5] * 100, list(range(1, 300)), [1 << k for k in range(40)], []):
        d = spark.createDataFrame([(x,) for x in counts], "n long")
        for most in (0, 3, 50, 1000):
            kept = sum(x >= tiers.threshold(d, "n", most) for x in counts)
            assert kept <= most and (most < len(counts) or kept == len(counts))


# 13

def aligned(texts):
    """Both sides' tokens by the libraries, groups and links by loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: x for x, c in alignment.byte_letters().items()}
    docs, texts_with = [], collections.Counter()
    for t in texts:
        ia, ib = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append(None)
            continue
        end_a, end_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        of_a = [sum(c < e for c in sorted(set(end_a) & set(end_b))) for e in end_a]
        of_b = [sum(c < e for c in sorted(set(end_a) & set(end_b))) for e in end_b]
        groups = [([i for i, g in zip(ia, of_a) if g == k], [i for i, g in zip(ib, of_b) if g == k]) for k in range(of_a[-1] + 1)]
        pairs = [(x, y) for g, h in groups for x in g for y in h]
        texts_with.update(set(pairs))
        docs.append((len(ia), len(ib), groups, pairs))
    best = collections.Counter()
    for (x, _), n in texts_with.items():
        best[x] = max(best[x], n)
    for d in docs:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in d[2])
            yield (d[0], d[1], len(d[2]), len(d[3]), sum(texts_with[p] == best[p[0]] for p in d[3]), sum(texts_with[p] for p in d[3]), hashlib.sha256(said.encode()).hexdigest())


STRANGE = ["a▁b", "x\n\n\ny  z \t w", "\n", " ", "  lead", "tail  ", "</s><s> <|endoftext|>", "日本語テキスト 👍🏽👍🏽", "a​ b᠎ c\x1cd 　e", "aaaaaaaa" * 40, "1234567890" * 9,
           "ﬁ é \r\n;\r x", "=" * 300, " \u0085   x", "don't we'LL 's", "\x00\x01 ok"]


@pytest.mark.parametrize(("frequent", "listed"), [(1 << 20, 1 << 16), (4, 1)])
def test_alignment_equals_brute_force(spark, monkeypatch, frequent, listed):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "LISTED", listed)
    monkeypatch.setattr(alignment, "HELD", 50)
    texts = [t for t in ODD if not t or len(t) < 1000] + STRANGE + [made(s, 25) for s in range(20)] + [made(1, 25)]
    d = documents(spark, texts).withColumnRenamed("extra", "row")
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_documents(d, vocabulary_a=A, vocabulary_b=B).collect()}
    assert [got[i] for i in range(len(texts))] == list(aligned(texts))


def test_alignment_of_odd_rows(spark):
    d = spark.createDataFrame([(None, "same text"), (None, "same text"), (3, None)], "doc_id long, text string")
    got = alignment.align_documents(d, vocabulary_a=A, vocabulary_b=B).collect()
    assert len(got) == 3 and sorted(r.n_links > 0 for r in got) == [False, True, True] and {r.count_sum for r in got if r.n_links} == {2 * r.n_links for r in got if r.n_links}
    assert alignment.align_documents(d.limit(0), vocabulary_a=A, vocabulary_b=B).count() == 0


def test_encodings_equal_the_libraries_on_any_letters():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    r = random.Random(4)
    letters = [*"ab Z9'.,\n\t\r  \n", *map(chr, [0x85, 0xA0, 0x1C, 0x200B, 0x180E, 0x2028, 0x3000, 0x301, 0xE9, 0x130, 0x4E00, 0x1F44D, 0xFB01, 0x0]), "<|endoftext|>", "</s>", "'ll"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    s = alignment.Sides(A, B, keep=200)
    for lo in range(0, len(texts), 100):
        own = texts[lo:lo + 100]
        got = list(zip(*s.encode(own)))
        for t, (x, y) in zip(own, got):
            if x or y:
                assert np.frombuffer(x, "<u2").tolist() == a.encode(" " + t, add_special_tokens=False).ids and np.frombuffer(y, "<u2").tolist() == b.encode(t), repr(t)


def test_a_blank_at_the_end_of_a_text_is_a_token(spark):
    texts = ["word ", "x  ", "one\ntwo ", " ", "\n ", "it's </s> ", "plain"]
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_documents(documents(spark, texts).withColumnRenamed("extra", "row"), vocabulary_a=A, vocabulary_b=B).collect()}
    assert [got[i] for i in range(len(texts))] == list(aligned(texts)) and all(got[i][0] > 0 for i in range(len(texts)))


@pytest.mark.parametrize("work", [1, 2, 3, 7, 1000])
def test_pieces_of_the_merge_path(work):
    r = random.Random(work)
    for _ in range(200):
        top = r.randint(1, 60)
        a = np.array(sorted({*r.sample(range(1, top + 1), r.randint(0, top)), top}))
        b = np.array(sorted({*r.sample(range(1, top + 1), r.randint(0, top)), top}))
        n_a, n_b = alignment.groups(a, b, work)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert n_a.tolist() == [sum(lo < x <= hi for x in a) for lo, hi in zip([0, *both], both)]
        assert n_b.tolist() == [sum(lo < x <= hi for x in b) for lo, hi in zip([0, *both], both)]
        i, j = alignment.diagonals(a, b, work)
        assert (np.diff(i) + np.diff(j) <= work + 1).all() and i[-1] == a.size and j[-1] == b.size


def test_queries_of_the_round_are_registered():
    from telequay.llm import queries

    assert {"op11_embedding_whitening", "op12_lm_scoring", "op13_tokenizer_alignment"} <= set(queries.queries()) and DOCS
