"""The ten operators against brute force, round trips and held-out accuracy, with odd rows."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from telequay.llm import bpe, chat, language, media, minhash, mixing, quality, queries, records, substrings, vectors
from telequay.llm.components import components
from telequay.llm.packed import Index
from telequay.llm.words import shingles, words

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def documents(spark, texts, **columns):
    rows = [(i, t, (columns.get("lang") or ["en"] * len(texts))[i], (columns.get("source") or ["s"] * len(texts))[i], None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   \n ", "a", "A a", "long " * 30_000, "x<|endoftext|>y <|im_start|> </s>", "é\xa0ß 日本 👍🏽 ́", "tab\tand\x1codd\x85", "same text here", "same text here", "don't  WE'LL 's"]


def made(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 8))) for _ in range(n))


# 10

def test_mixing_equals_its_oracle(spark):
    from ..oracle import assert_equal

    name = "op10_source_mixing"
    assert_equal(spark, queries.queries()[name], queries.oracle_sql()[name], SMALL)


def test_mixing_meets_targets(spark):
    r = random.Random(1)
    rows = [(i, s, r.randint(0, 40), 1.0) for i, s in enumerate(["a"] * 900 + ["b"] * 300 + [None] * 600 + ["tiny"] * 3)]
    d = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows) and all(x.taken <= 2 * x.size for x in got)
    total = sum(x.size for x in got)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for x in got:
        by[x.source][0] += x.taken
        by[x.source][1:] = [x.target, x.source_size]
    assert sum(v[1] for v in by.values()) == pytest.approx(1.5 * total)
    assert all(abs(v[0] - v[1]) <= 20 and v[1] <= 2 * v[2] + 1e-9 for v in by.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(d.repartition(7)).collect()), key=str)


def test_mixing_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    d = documents(spark, ODD, source=[None, "a", "a", None, "b", "b", "c", "c", "c", "d", "d", "é"])
    assert mixing.mix_documents(d, labels).count() == len(ODD)
    assert mixing.mix_documents(d.limit(0), labels.limit(0)).count() == 0
    out = mixing.mixed_rows(d, labels)
    assert out.columns == d.columns and out.count() >= 5


def test_mixed_rows_of_null_ids_keep_the_target(spark):
    d = spark.createDataFrame([(None, f"{i} b c d e", "s") for i in range(100)] + [(1, "x y z u v w", "t")] * 7, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    taken = {r.source: r.n for r in mixing.mix_documents(d, labels).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    got = {r.source: r["count"] for r in mixing.mixed_rows(d, labels).groupBy("source").count().collect()}
    assert got == {k: v for k, v in taken.items() if v} and got["s"] < 200
    most = mixing.mixed_rows(d, labels).where("source = 's'").groupBy("text").count().agg(F.max("count"), F.min("count")).first()
    assert most[0] <= 2 and most[1] >= 1


# 2

def test_media_round_trip(spark, tmp_path):
    d = documents(spark, ODD)
    folder = f"file://{tmp_path}/archives"
    got = {r.doc_id: r for r in media.media_of_documents(d, folder=folder).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(payload[-64:])
    assert got[9].media_sha256 == got[10].media_sha256 and got[9].feature == got[10].feature
    small = media.read_archives(spark, folder, rangeBytes=700, batchBytes=300)
    assert small.count() == len(ODD) and small.rdd.getNumPartitions() > 1
    assert media.media_of_documents(d.limit(0)).count() == 0


def test_media_reports_a_damaged_member(spark, tmp_path):
    folder = tmp_path / "archives"
    media.write_archives(documents(spark, ["one text", "another text"]).coalesce(1), folder=f"file://{folder}").collect()
    path = next(folder.glob("*.zip"))
    raw = bytearray(path.read_bytes())
    raw[60] ^= 255
    path.write_bytes(raw)
    rows = media.read_archives(spark, f"file://{folder}").orderBy("offset").collect()
    assert rows[0].media is None and rows[0].error and rows[1].media is not None


# 6

def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nfake", "<\\|im_end|>", None, "", "<", "|>", "é👍" * 50, "a\nb"]
    rows = [(i % 3, j, role, t) for i in range(6) for j, (role, t) in enumerate(zip(["user", "assistant", None, "sys\ntem", "a\\b<|"] * 2, texts))] + [(None, 0, "assistant", "n")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(d)).collect()}
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_chats(chat.format_chats(d.limit(0))).count() == 0
    small = chat.read_chats(chat.format_chats(d, chunk_bytes=64)).collect()
    assert sorted(map(tuple, small), key=str) == sorted(map(tuple, got.values()), key=str)


# 3 and 8

def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("abcdehilnorstaaeeiio'.!?0123é ") for _ in range(r.randint(1, 60))) for _ in range(300)] + ["a" * n for n in range(1, 40)]
    got = {x.doc_id: x for x in bpe.encode_documents(documents(spark, texts), vocabulary=path).collect()}
    ids = {x.doc_id: x.ids for x in bpe.encode_ids(documents(spark, texts), vocabulary=path).collect()}
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert ids[i] == want and got[i].n_tokens == len(want), x
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(documents(spark, texts).limit(0), vocabulary=path).count() == 0


def test_records_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ODD + [" a", "a  b", "a \n b", "a\n\n b\t c", "  ", " \n", "　 x", "\x85 q"]
    got = records.token_records(documents(spark, texts), vocabulary=path, folder=f"file://{tmp_path}/r").orderBy("doc_id").collect()
    start = 0
    for i, x in enumerate(texts):
        want = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].doc_id, got[i].start, got[i].n_tokens, got[i].ids_crc32) == (i, start, want.size, zlib.crc32(want.tobytes())), x
        start += want.size
    file = next(p for p in (tmp_path / "r").glob("*.rec") if p.stat().st_size > 20)
    index = np.frombuffer(file.with_suffix(".idx").read_bytes(), "<u8")
    with file.open("rb") as f:
        assert records.unpack(records.unframe(f, int(index[-1])))[1][-1] == 2
    raw = bytearray(file.read_bytes())
    raw[-6] ^= 1
    file.write_bytes(raw)
    with file.open("rb") as f, pytest.raises(ValueError):
        records.unframe(f, int(index[-1]))
    assert records.token_records(documents(spark, texts).limit(0), vocabulary=path).count() == 0


ODD_LETTERS = ["\na'S \U00017a06\U000191b4\u1b60", "\u1e9e\U00011de0's\x85\x0b", "\U00018e22\u03a3\u03ff\ufffa\u05ef\u1e9e", "\u0130stanbul \u0391\u03a3 \u0149 \u017f \u00df"]


def odd_text(r):
    """Letters, marks, spaces and unassigned code points in any order."""
    def one():
        k = r.random()
        if k < 0.5:
            return r.choice(["a", "d", "'s", "'ll", "!", "0", "é", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u180e", "\u200b", "\u2028", "\u3000", "ß", "É", "ž"])
        return chr(r.choice([r.randint(0x300, 0x36F), r.randint(0x80, 0x2FFF), r.randint(0x3000, 0xD7FF), r.randint(0xE000, 0xFFFF), r.randint(0x10000, 0x1FFFF)]))
    return "".join(one() for _ in range(r.randint(1, 14)))


def test_encoders_equal_the_library_on_any_letters():
    from tokenizers import Tokenizer

    r = random.Random(17)
    texts = ODD_LETTERS + [odd_text(r) for _ in range(12_000)]
    for name, model in (("word_bpe_49k.json", bpe.PairBpe), ("byte_bpe_50k.json", records.Encoder)):
        path = public_tokenizers.path(name)
        library, own = Tokenizer.from_file(path), model(path)
        for lo in range(0, len(texts), 300):
            part = texts[lo:lo + 300]
            for x, want, got in zip(part, library.encode_batch(part, add_special_tokens=False), own.encode(part)):
                if isinstance(got, tuple):
                    assert got == (" ".join(map(str, want.ids)), library.decode(want.ids, skip_special_tokens=False), len(want.ids)), ascii(x)
                else:
                    assert np.frombuffer(got, own.dtype).tolist() == want.ids, ascii(x)


# 7

def test_vectors_equal_brute_force(spark):
    g = np.random.default_rng(0)
    base = g.standard_normal((25, 16))
    rows = []
    for i in range(400):
        v = base[i % 25] + g.standard_normal(16) * (0.05 if i % 2 else 0.28)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 25 % 3)))
    rows += [(400 + i, list(rows[0][1]), 0) for i in range(5)] + [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [1.0, None] + [0.0] * 14, 0), (504, rows[0][1], None)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [r for r in rows if r[0] < 500]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in ok])
    s = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(s, False)
    ids = np.array([r[0] for r in ok])
    c = ids.copy()
    while True:
        n = np.minimum(c, np.where(s, c[None, :], 10**9).min(axis=1))
        if (n == c).all():
            break
        c = n
    found = sum(got[i].n_links for i in ids)
    assert all(got[i].n_links <= d for i, d in zip(ids, s.sum(1))) and found >= 0.99 * s.sum()
    assert sum(got[i].component_id != k for i, k in zip(ids, c)) <= 4
    for i in (500, 501, 502, 503, 504):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_large_buckets_are_dealt_out_in_blocks(spark, monkeypatch):
    g = np.random.default_rng(2)
    v = g.standard_normal(8)
    rows = [(i, [float(x) for x in v + g.standard_normal(8) * 1e-3], 1) for i in range(60)]
    monkeypatch.setattr(vectors, "BLOCK", 7)
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.n_links == 59 and r.component_id == 0 for r in got)


def test_vectors_of_odd_rows(spark):
    """Null ids, rows that repeat, equal vectors under several labels, lengths that differ, numbers that need 64 bits, no rows."""
    v, w = [1.0, 2.0, 3.0, 0.1], [1.0, 2.0, 3.0, 0.2]
    rows = [(None, v, 1), (None, w, 1), (7, v, 1), (7, v, 1), (3, w, 2), (3, v, 2), (None, [5.0, -1.0], 1), (None, None, 1), (9, [1e300, 2e300, 3e300, 1e299], 1), (4, [-x for x in v], 1), (5, [], 1)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rid string")
    got = sorted(map(tuple, vectors.near_vectors(d).collect()), key=str)
    want = [(None, 4, 7, False), (None, 4, 7, False), (7, 4, 7, True), (7, 4, 7, True), (9, 4, 7, False), (3, 1, 3, True), (3, 1, 3, True),
            (None, 0, None, True), (None, 0, None, True), (4, 0, 4, True), (5, 0, 5, True)]
    assert got == sorted(want, key=str)
    assert vectors.near_vectors(d.limit(0)).count() == 0
    alone = vectors.near_vectors(d.where("vec_id is null")).collect()
    assert sorted((r.n_links, r.component_id, r.kept) for r in alone) == [(0, None, True)] * 2 + [(1, None, True)] * 2


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 200), r.randint(100, 200)) for _ in range(60)] + [(7, 7), (300, 300), (None, 1)]
    par = {}
    find = lambda x: x if par.setdefault(x, x) == x else find(par[x])
    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            par[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in par}


# 9

def test_language_models_sum_to_one(spark):
    """With all n-grams and with rare ones left out, the characters after any context come to 1, one never seen among them."""
    rows = spark.createDataFrame([("the cat sat on the mat", "en"), ("a dog and a cat", "en"), ("eine katze", "de"), ("zwei katzen", "de")], "text string, lang string")
    keys, _ = language.keys_of(["the cat sat on the mat", "a dog and a cat"])
    k = np.unique(keys)
    for entries in (4_000_000, 40):
        m = language.learn(rows, entries=entries)
        scorer = language.Scorer(m)
        assert m.languages == ["de", "en"] and (entries > 40 or max(map(len, m.keys)) <= 40)
        own = np.unique(keys & np.uint64(0xFFFF))
        for ctx in (*(k[:9] >> np.uint64(16)), np.uint64(0x0071_0071_0071)):  # seen and unseen contexts
            p = np.exp(scorer.logs((ctx << np.uint64(16)) | np.append(own, np.uint64(0x7777)))[:, 1].astype(float)).sum()
            assert p == pytest.approx(1, abs=1e-4)


def test_language_probabilities_equal_brute_force(spark):
    texts = ["abab ac", "abc \U00010400b", "b"]
    m = language.learn(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"))
    number = lambda c: 0xE000 + ord(c.lower()) % 6400 if ord(c) > 0xFFFF else ord(c)
    grams = [collections.Counter() for _ in range(4)]
    for t in texts:
        row = [1, 1, 1, *map(number, t)]
        grams[3].update(tuple(row[i:i + 4]) for i in range(len(t)))
    for n in (2, 1, 0):
        grams[n].update(g[1:] for g in grams[n + 1])

    def p(g):
        if not g:
            return 1 / (len(grams[0]) + 1)
        own = grams[len(g) - 1]
        n1, n2 = (sum(c == k for c in own.values()) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        ctx = {h: c for h, c in own.items() if h[:-1] == g[:-1]}
        total = sum(ctx.values())
        return max(own[g] - d, 0) / total + d * len(ctx) / total * p(g[1:]) if total else p(g[1:])

    want = np.array([np.mean([-np.log(p(tuple([1, 1, 1, *map(number, t)][i:i + 4]))) for i in range(len(t))]) for t in texts])
    got, n = language.Scorer(m).entropies(texts)
    assert n.tolist() == [len(t) for t in texts] and np.allclose(got[:, 0], want, rtol=1e-5)


def test_language_tables_leave_nothing_out(spark):
    """Every n-gram has the value of a model of all n-grams, whether it goes to every task or is joined."""
    texts = ["the cat sat on the mat", "a dog and a cat", "eine katze", "zwei katzen und ein hund", "", None, "12 34", "un gato y zwei dogs", "qqq \U00010400"] * 3
    langs = (["en", "en", "de", "de", "en", "de", "en", None, None]) * 3
    docs = documents(spark, texts, lang=langs)
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    m = language.learn(spark.createDataFrame([(t, x) for i, (t, x) in enumerate(zip(texts, langs)) if t is not None and x and fold(i) != 1], "text string, lang string"))
    want, n = language.Scorer(m).entropies([t or "" for t in texts])
    for entries in (4_000_000, 30, 2, 0):
        got = {r.doc_id: r for r in language.identify(docs, entries=entries).collect()}
        assert len(got) == len(texts)
        for i, r in got.items():
            if n[i]:
                assert r.entropy == pytest.approx(want[i].min(), rel=1e-5) and r.lang_pred == m.languages[want[i].argmin()]
            else:
                assert (r.lang_pred, r.entropy, r.score) == ("und", 0, 0)


def test_index_finds_keys():
    k = np.unique(np.random.default_rng(0).integers(0, 1 << 62, 5000).astype(np.uint64))
    index = Index(k)
    assert (index.find(k) == np.arange(k.size)).all() and (index.find(k + np.uint64(1 << 63)) == -1).all()


def test_language_of_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    odd = language.identify(documents(spark, ODD, lang=["en", None, "de"] * 4)).collect()
    assert len(odd) == len(ODD) and {r.lang_pred for r in odd if r.doc_id < 3} == {"und"}
    assert language.identify(documents(spark, ODD).limit(0)).count() == 0


# 4

@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = [made(i, 120) for i in range(25)]
    for i in range(25):
        for k in range(1 + i % 4):
            w = texts[i].split()
            w[10 * k + 3] = f"new{k}"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), f"  {texts[0]}\n"] + ODD
    d = documents(spark, texts)
    df, n = minhash.document_frequencies(d)
    idf = minhash.idf_table(df, n)
    s = shingles(words(pa.array(texts)))
    w = minhash.weigh(s, idf).astype(float)
    feats = [(s.keys[a:b], w[a:b]) for a, b in zip(s.first[:-1], s.first[1:])]
    par = list(range(len(texts)))
    find = lambda x: x if par[x] == x else find(par[x])
    for i in range(len(texts)):
        for j in range(i):
            if feats[i][0].size and feats[j][0].size and minhash.similarity(feats[i], feats[j]) >= 0.8:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in minhash.near_duplicates(d).collect()}
    assert [got[i].class_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    sizes = collections.Counter(find(i) for i in range(len(texts)))
    assert all(got[i].class_size == sizes[find(i)] and got[i].kept == (find(i) == i) for i in range(len(texts)))
    assert minhash.without_near_duplicates(d).count() == len(sizes)
    assert minhash.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("few", [1 << 27, 0])
def test_near_duplicates_within_a_large_group(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW", few)
    base, texts = made(700, 200).split(), []
    for k in range(80):  # near copies of one text, each with three words of its own: alike by 0.86, whatever the size of the group
        w = list(base)
        for x in range(3 * (k > 0)):
            w[5 * ((7 * k + 13 * x) % 39)] = f"own{k}x{x}"
        texts.append(" ".join(w))
    texts += [made(800 + i, 200) for i in range(40)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: 0 if i < 80 else i for i in range(120)}


def test_document_frequencies_are_those_of_each_shingle(spark):
    texts = [made(950 + i, 4000) for i in range(40)]  # so many shingles that some share the first 20 bits of their hash
    texts = [f"{t} {texts[0][:3000]}" if i % 3 else t for i, t in enumerate(texts)] + ["one two three four five " * 50, None, ""]
    d = documents(spark, texts).repartition(5)
    s = shingles(words(pa.array(texts)))
    want = collections.Counter(s.keys.tolist())
    n = len(texts) - 2
    weights = s.counts * (np.log((n + 1) / (np.array([want[k] for k in s.keys.tolist()]) + 1)) + 1)
    df, many = minhash.document_frequencies(d)
    assert many == n and max(want.values()) > 20 > 1 == min(want.values())
    assert np.allclose(minhash.weigh(s, minhash.idf_table(df, many)), weights, rtol=1e-6)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c, d, e, f, g = (made(900 + i, 60) for i in range(7))
    # null ids: a copy of 1, a unique text, twice the same one; 7 has two texts, one of them a copy of 2; 8 twice the same row
    rows = [(1, a), (None, a.upper()), (None, b), (None, c), (None, c), (2, d), (7, d), (7, e), (8, f), (8, f), (None, None), (None, ""), (9, g)]
    table = spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], DOCS)
    left = minhash.without_near_duplicates(table)
    assert left.columns == table.columns
    want = [(1, a), (2, d), (7, e), (8, f), (9, g), (None, ""), (None, None), (None, b), (None, c)]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(want, key=repr)
    got = minhash.near_duplicates(table).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True] == sorted(r.kept for r in got if r.doc_id == 8)


def test_samples_estimate_the_similarity():
    g = np.random.default_rng(5)
    a = np.sort(g.integers(0, 1 << 63, 4000).astype(np.uint64))
    keys = np.concatenate([a[:3000], a[1000:]])
    s = minhash.Shingles(keys, np.ones(6000, np.int64), np.array([0, 3000, 6000]))
    x = np.concatenate([minhash.samples(minhash.Shingles(keys, s.counts, s.first), np.ones(6000))])
    assert abs((x[0] == x[1]).mean() - 0.5) < 0.25


# 1

def stood_before(rows, min_words=50):
    """Brute force: by row, which words lie in a run of min_words + 1 words that stood earlier. Rows are (doc_id, dk, words) in order."""
    seen, out = set(), []
    for _, _, own in rows:
        gone, k = [False] * len(own), min_words + 1
        for i in range(len(own) - k + 1):
            if (run := tuple(own[i:i + k])) in seen:
                gone[i:i + k] = [True] * k
            seen.add(run)
        out.append(gone)
    return out


def check_substrings(spark, texts, ids=None, exact=True):
    ids = ids or list(range(len(texts)))
    d = spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in zip(ids, texts)], DOCS)
    keys = {(r.doc_id, r.text): r.dk for r in substrings._identified(d).collect()}
    rows = sorted({(i is None, i or 0, keys[i, t], t) for i, t in zip(ids, texts)}, key=lambda r: r[:3])
    want = dict(zip([(r[1] if not r[0] else None, r[3]) for r in rows], stood_before([(r[1], r[2], (r[3] or "").lower().split()) for r in rows])))
    keyed = d.select("*", F.monotonically_increasing_id().alias("row"))
    old = {r.row: r for r in keyed.collect()}
    got = substrings.deduplicate(keyed).collect()
    assert len(got) == len(texts)
    missed = total = 0
    for r in got:
        t, gone = old[r.row].text, want[r.doc_id, old[r.row].text]
        raw, left = (t or "").encode(), []
        for span in [*r.removed_spans, None]:  # the words are whole, so the places of those that stay tell which went
            left.append(raw[left and end or 0:span.start if span else len(raw)])
            end = span.end if span else 0
        assert b"".join(left).decode() == (r.text or "") and (r.text is None) == (t is None)
        went = [False] * len(gone)
        for span in r.removed_spans:
            a, n = len(raw[:span.start].decode().split()), len(raw[span.start:span.end].decode().split())
            went[a:a + n] = [True] * n
        assert sum(went) == r.removed_words and all(g for g, x in zip(gone, went) if x), r.doc_id
        missed, total = missed + sum(gone) - sum(went), total + sum(gone)
        i = 0
        while i < len(gone):  # of no run more than its ends stay
            j = next((k for k in range(i, len(gone)) if not gone[k]), len(gone))
            assert sum(went[i:j]) >= (j - i if exact else max(j - i - 12, (j - i) // 2)), (r.doc_id, i, j, sum(went[i:j]))
            i = j + 1
    assert missed <= 0.004 * total
    return got


def test_substrings_equal_brute_force(spark):
    """Passages of 45 to 58 words and longer ones at any place, whole and near copies, repeats within a text, runs of one word."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(10 ** 9)}"
    some = lambda n: [word() for _ in range(n)]
    short, shared = [some(45 + i) for i in range(6)], [some(51 + i) for i in range(8)] + [some(n) for n in (80, 150, 300, 700)]
    texts = []
    for i in range(260):
        body = some(r.randint(0, 70))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            body += r.choice(short if i % 4 == 1 else shared) + some(r.choice([0, 0, 1, 5, 40]))
        if i % 9 == 0:
            own = some(r.randint(48, 60))
            body += own + some(3) + own
        texts.append(r.choice([" ", "\n", "  \t"]).join(body))
    for i in range(40):  # near copies of texts before
        own = texts[4 * r.randrange(65)].split()
        for _ in range(r.randint(0, 3)):
            if own:
                own.insert(r.randrange(len(own)), "new")
        texts.append(" ".join(own).upper() if i % 5 == 0 else " ".join(own))
    texts += ["a " * 300, "x a " * 200, "a b c " * 90, " ".join(some(20)) + " a" * 130, None, "", *ODD]
    # A run may stay longer by the few words beside a passage that an earlier text had first, with other words beside it.
    check_substrings(spark, texts, exact=False)


def test_substrings_of_odd_rows(spark):
    a, b = made(700, 80), made(701, 90)
    got = check_substrings(spark, [a, f"{a} {b}", b, a, a, f"{b} x", None, None, ""], ids=[5, 5, None, None, 9, 9, None, 1, 1])
    assert got[0].extra == "x"
    d = spark.createDataFrame([(1, a, 7, 8, 9), (2, a, 7, 8, 9)], "doc_id long, TEXT string, tq_0 int, _dk int, Removed_Spans int")
    out = substrings.deduplicate(d)
    assert out.columns == ["doc_id", "TEXT", "tq_0", "_dk", "removed_spans", "removed_words"]
    assert sorted((r.doc_id, r.TEXT, r.tq_0, r._dk) for r in out.collect()) == [(1, a, 7, 8), (2, "", 7, 8)]
    assert substrings.deduplicate(documents(spark, ODD).limit(0)).count() == 0


def test_substrings_of_a_frequent_passage_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARE", 4)
    shared = made(800, 60)
    check_substrings(spark, [f"{made(810 + i, 12)} {shared} {made(910 + i, 9)}" for i in range(60)], exact=False)


def test_a_passage_whose_chunks_stood_in_other_texts_goes_whole(spark):
    """Every chunk of it has its first occurrence in a window of 45 words, which stays; a later text has it all."""
    passage = made(820, 200).split()
    texts = [f"{made(830 + i, 15)} {' '.join(passage[20 * i:20 * i + 45])} {made(850 + i, 15)}" for i in range(9)]
    texts += [f"{made(870 + i, 30)} {' '.join(passage)} {made(880 + i, 30)}" for i in range(2)]
    twice = f"{' '.join(passage[:45])} {made(890, 20)} {' '.join(passage[30:75])} {made(891, 20)} {' '.join(passage[60:105])}"
    own = [w.replace("a", "z") for w in f"{twice} {made(892, 9)} {' '.join(passage[:105])} {made(893, 9)} {' '.join(passage[:105])}".split()]
    got = check_substrings(spark, [*texts, " ".join(own)], exact=False)
    by = {r.doc_id: r.removed_words for r in got}
    assert by == {**{i: 0 for i in range(10)}, 10: 200, 11: by[11]} and by[11] >= 105


def test_a_text_of_repeats_takes_linear_time():
    """Passages of 60 words, each three times, at places without order; and one passage repeated."""
    r, cutting = random.Random(4), substrings.Cutting.of(50)
    for text in ([w for p in r.sample(3 * [[f"w{r.randrange(10 ** 9)}" for _ in range(60)] for _ in range(5000)], 15000) for w in p], "a b c d e f g".split() * 100_000):
        c, w = substrings.chunk_column(pa.array([" ".join(text)]), cutting)
        size = np.concatenate([c[k] for k in ("n_words", "half_words", "whole_words")])
        some = size > 0
        digest = np.concatenate([c[k] for k in ("digest", "half", "whole")])[some]
        begin = time.process_time()
        gone = substrings.repeated_words(w.hashes.astype(np.uint32), [], np.tile(c["word"], 3)[some], size[some], digest, 50)
        assert time.process_time() - begin < 10 and gone.sum() >= 0.66 * len(text)


def test_chunks_resist_shifts():
    cutting = substrings.Cutting.of(50)
    for seed in range(30):
        t = made(seed, 51)
        a, _ = substrings.chunk_column(pa.array([f"{made(seed + 100, 40)} {t} {made(seed + 200, 40)}"]), cutting)
        b, _ = substrings.chunk_column(pa.array(["odd words before", f"{made(seed + 300, 33)} {t.upper()}"]), cutting)
        assert set(a["digest"].tolist()) & set(b["digest"].tolist())
    c, w = substrings.chunk_column(pa.array(["a " * 1000]), cutting)
    assert len(set(c["digest"].tolist())) == 1 and w.hashes.size == 1000


# 5

def test_quality_rejects_junk_and_keeps_clean_texts(spark):
    sf = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(d, l).join(l, "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5
    odd = quality.score(documents(spark, ODD), l).collect()
    assert len(odd) == len(ODD) and not any(r.kept for r in odd if r.doc_id < 3)
    assert quality.score(d.limit(0), l).count() == 0
    assert quality.keep_good(d, l).columns == d.columns


def test_quality_model_equals_brute_force(spark):
    texts = ["a b a b c", "a b d", "b c a"] * 3
    d = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    learned = {r.doc_id for r in quality.trusted_labels(labels).where("not held_out").collect()}
    got = {r.doc_id: r.entropy for r in quality.score(d, labels).collect()}
    big = collections.Counter()
    pairs = lambda t: list(zip(["^", *t.split()], [*t.split(), "$"]))
    for i in learned:
        big.update(pairs(texts[i]))
    disc = quality.modified_discounts([sum(c == k for c in big.values()) for k in (1, 2, 3, 4)])
    before = collections.Counter(w for _, w in big)
    b = quality.modified_discounts([sum(c == k for c in before.values()) for k in (1, 2, 3, 4)])
    left = sum(b[min(c, 3)] for c in before.values()) / sum(before.values())

    def p(u, w):
        low = max(before[w] - b[min(before[w], 3)], 0) / sum(before.values()) + left / (len(before) + 1)
        total = sum(c for (x, _), c in big.items() if x == u)
        if not total:
            return low
        back = sum(disc[min(c, 3)] for (x, _), c in big.items() if x == u) / total
        return max(big[u, w] - disc[min(big[u, w], 3)], 0) / total + back * low

    for i, t in enumerate(texts):
        want = -np.mean([np.log(p(u, w)) for u, w in pairs(t)])
        assert got[i] == pytest.approx(want, rel=1e-4)
    assert sum(p("a", w) for w in [*before, "never seen"]) == pytest.approx(1)


def test_quality_deals_frequent_contexts_out(spark, monkeypatch):
    """The same entropies whatever the number of shards, also where few contexts hold most words."""
    r = random.Random(8)
    texts = [" ".join(r.choice(["the", "the", "the", "of", f"w{r.randint(0, 400)}"]) for _ in range(r.randint(1, 90))) for _ in range(120)] + ODD
    d = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    one = {r.doc_id: r for r in quality.score(d, labels).collect()}
    monkeypatch.setattr(quality, "SHARD_BYTES", 300)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2000)
    many = {r.doc_id: r for r in quality.score(d.repartition(7), labels).collect()}
    assert one.keys() == many.keys() and all(one[i].entropy == pytest.approx(many[i].entropy, rel=1e-5) for i in one if one[i].entropy is not None)
    assert all(one[i].kept == many[i].kept and one[i].limit == pytest.approx(many[i].limit) for i in one)


def test_quality_limits_and_decisions(spark):
    """``kept`` follows from entropy and the limit of the language, recomputed here from the rows."""
    texts = [made(i, 60 + i % 9) if i % 2 else f"a common text of {i % 5} words in it " * 8 for i in range(150)]
    langs = ["en" if i % 3 else None for i in range(150)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(140)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(documents(spark, texts, lang=langs), labels, quantile=0.5).collect()}
    held = {r.doc_id for r in quality.trusted_labels(labels).where("held_out").collect()}
    limits = {}
    for lang in ("en", None, "all"):
        e = sorted(got[i].entropy for i in held if lang == "all" or langs[i] == lang)
        limits[lang] = e[max(0, -(-len(e) // 2) - 1)] if lang == "all" or len(e) >= 20 else None
    for i, t in enumerate(texts):
        limit = (limits[langs[i]] or limits["all"]) * 1.05 + 6 / len(t.split()) ** 0.5
        assert got[i].limit == pytest.approx(limit, rel=1e-6) and got[i].kept == (got[i].entropy <= got[i].limit)


CLASH = ["_hash", "_dk", "_cuts", "_id", "d_id", "b_id", "c_id", "m_id", "m_own", "m_copy", "m_copies", "tq_0", "TQ_1", "tq_2", "tq_5", "first", "runs", "row", "words", "removed", "entropy", "kept", "class_id"]


def test_stages_keep_columns_of_any_name_and_odd_rows(spark):
    """Every stage of the pipeline on odd rows with columns named like inner ones: values unchanged, clean rows there."""
    import corpus_pipeline as c

    texts = [*ODD, *[made(500 + i, 80) for i in range(12)], made(500, 80)]
    rows = [(None if i in (4, 15) else i % 20, t, ["en", None][i % 5 == 0], ["a", "b", None][i % 3], 1, *[f"{n}-{i}" for n in CLASH]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in CLASH))
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        got = out.collect()
        for r in got:
            i = int(r["_hash"].split("-")[1])
            assert [r[n] for n in CLASH] == [f"{n}-{i}" for n in CLASH] and (r.doc_id, r.lang, r.source) == (rows[i][0], rows[i][2], rows[i][3]), name
            assert name == "substring dedup" or r.text == texts[i]
        seen = {int(r["_hash"].split("-")[1]) for r in got}
        assert {*texts[12:24]} <= {texts[i] for i in seen} or name == "quality classifier" or name == "source mixing", name
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    assert c.STAGES[-1][1](spark, docs, SMALL).count() == len(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in c.STAGES][1] == "minhash near-dedup" and len(c.STAGES) == 5
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        docs = quality.written(out)
    assert c.STAGES[-1][1](spark, docs, SMALL).count() == docs.count() > 50


def test_trusted_rows_by_hash(spark):
    assert quality.trusted_labels(spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")).select("doc_id").collect()[0][0] == 3
    assert F is not None
