"""Operator 4: near-duplicates by consistent weighted sampling.

A document is its set of five-word shingles, weighted by tf * idf.  Improved
consistent weighted sampling draws K samples whose agreement estimates the
weighted Jaccard similarity; bands of samples give candidate groups; every
link is verified by the exact weighted Jaccard similarity.  The document
frequency of every shingle is counted exactly, by shards of its hash.  Copies of
one text count once there: else what a large group of near copies shares would
weigh less than what one of them has alone, and the group fall apart as it grows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .packed import counted, distinct, pack, unpack
from .shared import fresh, spread, width, written
from .words import Shingles, chunks, mix64, random_table, shingles, words

#: Bytes of text in a block, and blocks a shard of shingles has to answer: a shard holds about as many shingles as these have words.
BLOCK_BYTES, BLOCKS_A_SHARD = 8 << 20, 8
BANDS, ROWS = 12, 4
_SEEDS = random_table(BANDS * ROWS, 41)
#: By so many least hashes of shingles copies are told; documents up to which a bit each (is it one) goes to every task.
_MARKS, FEW = random_table(4, 43), 1 << 27


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """n quantiles of the Gamma(2, 1) distribution, whose distribution function is 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.full(n, 1.0)
    for _ in range(60):  # Newton steps on the logarithm of the tail
        f = np.log1p(x) - x - np.log1p(-p)
        x = np.maximum(x - f / (1 / (1 + x) - 1), 1e-9 + x / 4)
    return x


_GAMMA: list[np.ndarray] = []


def _least(s: Shingles) -> pa.Array:
    """The least hash of each text's shingles under each seed of ``_MARKS``, text by text; null for texts without shingles."""
    has = np.diff(s.first) > 0
    out = np.zeros((has.size, len(_MARKS)), np.uint64)
    if has.any():
        for k, seed in enumerate(_MARKS):
            out[has, k] = np.minimum.reduceat(mix64(s.keys ^ seed), s.first[:-1][has])
    return pa.array(out.ravel().view(np.int64), mask=np.repeat(~has, len(_MARKS)))


def text_blocks(documents: DataFrame) -> DataFrame:
    """block, n (texts with words), texts (doc_id, text_hash and text of about ``BLOCK_BYTES`` of text, an Arrow stream), marks (``_least`` of the texts)."""

    def run(batches):
        from pyspark import TaskContext

        number = 0
        for batch in batches:
            for part in chunks(batch, size=BLOCK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                marks = pa.concat_arrays([_least(shingles(words(x.column("text")))) for x in chunks(part)])
                n = (len(marks) - marks.null_count) // len(_MARKS)
                yield pa.RecordBatch.from_pydict({"block": [f"{TaskContext.get().partitionId()}-{number}"], "n": [n],
                                                  "texts": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "marks": pa.ListArray.from_arrays([0, len(marks)], marks)})
                number += 1

    return _keyed(documents).mapInArrow(run, "block string, n long, texts binary, marks array<long>")


def _texts(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def originals(blocks: DataFrame) -> DataFrame:
    """block, firsts (packed bits, one for each text), many (how many are set): texts that are the first one with each of their marks.

    Two texts have a mark in common with the probability of their (unweighted) Jaccard similarity, so of copies of one
    text hardly more than one is a first.
    """
    k = len(_MARKS)
    marks = blocks.select("block", F.posexplode("marks").alias("pos", "mark")).where("mark is not null")
    won = marks.groupBy(F.pmod("pos", F.lit(k)).alias("k"), "mark").agg(F.min(F.struct("block", F.floor(F.col("pos") / k).cast("int").alias("at"))).alias("s"))
    won = won.select("s.*").groupBy("block", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k)

    def bits(own: pa.Table) -> pa.Table:
        at = own.column("at").to_numpy()
        set_ = np.zeros(at.max() + 1, bool)
        set_[at] = True
        return pa.table({"block": own.column("block").slice(0, 1), "firsts": pa.array([pack(np.packbits(set_))], pa.binary()), "many": pa.array([at.size])})

    return won.select("block", "at").groupBy("block").applyInArrow(bits, "block string, firsts binary, many long")


def document_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """block, shard, df (packed): in how many documents each of the block's distinct shingles is, by shard in ascending order.

    A shard has a range of the hashes.  Each block sends the shingles of the
    shard once with the number of its texts that have them; the shard adds them
    up over all blocks and answers each.  Where blocks have ``firsts`` (as
    ``originals`` gives them) only these texts count; what none of them has is in one.
    """
    sifted = "firsts" in blocks.columns

    def ask(batches):
        for batch in batches:
            for i, (block, raw) in enumerate(zip(batch.column("block").to_pylist(), batch.column("texts"))):
                parts = [shingles(words(x.column("text"))) for b in _texts(raw.as_py()).to_batches() for x in chunks(b)]
                many = np.concatenate([np.empty(0, np.int64), *(np.diff(s.first) for s in parts)])  # shingles of each text
                one = np.ones(many.size, np.int64)
                if sifted:
                    bits = batch.column("firsts")[i].as_py()
                    one[:] = np.unpackbits(unpack(bits), count=many.size) if bits is not None else 0  # bits end at the last first one
                keys, counts = counted([np.concatenate([np.empty(0, np.uint64), *(s.keys for s in parts)]), np.repeat(one, many)])
                at = np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
                own = np.flatnonzero(np.diff(at))
                cut = lambda x: pa.array([pack(x[at[k]:at[k + 1]]) for k in own], pa.binary())  # noqa: B023, E731
                gaps = np.diff(keys, prepend=np.uint64(0))
                gaps[at[own]] = keys[at[own]]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([block] * own.size, pa.string()), cut(gaps), cut(counts.astype(np.uint32))],
                                                 names=["shard", "block", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(x)) for x in table.column("keys").to_pylist()]
        counts = [unpack(x) for x in table.column("counts").to_pylist()]
        every, total = counted([x for pair in zip(keys, counts) for x in pair])
        total = np.maximum(total, 1)
        df = [pack(total[np.searchsorted(every, x)].astype(np.uint32)) for x in keys]
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "df": pa.array(df, pa.binary())})

    return blocks.select("block", "texts", *["firsts"] * sifted).mapInArrow(ask, "shard long, block string, keys binary, counts binary").groupBy("shard").applyInArrow(
        answer, "block string, shard long, df binary")


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequency, at least 1."""
    return (np.log((n + 1) / (df.astype(np.float64) + 1)).clip(0) + 1).astype(np.float32)


def weigh_by(s: Shingles, df: pa.Array, n: int) -> np.ndarray:
    """Weights of the shingles of a column of texts, from their packed document frequencies."""
    return s.counts * idf_of(np.concatenate([np.empty(0, np.uint32), *map(unpack, df.drop_null().to_pylist())]), n)


class Frequencies(NamedTuple):
    keys: np.ndarray  # sorted
    values: np.ndarray


def document_frequencies(documents: DataFrame) -> tuple[Frequencies, int]:
    """(number of documents that have each shingle, number of documents with words) of a small table, on the driver."""
    rows, n = sketches(documents)
    rows = rows.where("node is not null").select("text_hash", "df").dropDuplicates(["text_hash"])
    found = _keyed(documents).dropDuplicates(["text_hash"]).join(rows, "text_hash").select("text", "df").toArrow().combine_chunks()
    keys, df = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
    for batch in found.to_batches():
        keys.append(shingles(words(batch.column("text"))).keys)
        df += map(unpack, batch.column("df").to_pylist())
    every, at = np.unique(np.concatenate(keys), return_index=True)
    return Frequencies(every, np.concatenate(df)[at]), n


def idf_table(df: Frequencies, n: int) -> Frequencies:
    return Frequencies(df.keys, idf_of(df.values, n))


def weigh(s: Shingles, idf: Frequencies) -> np.ndarray:
    """Weights of shingles that are all in the table."""
    return s.counts * idf.values[np.searchsorted(idf.keys, s.keys)]


def samples(s: Shingles, weights: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """K consistent weighted samples of every text that has shingles: one row each, as hashes.

    r and c are Gamma(2, 1), beta uniform, all drawn from the shingle's hash:
    t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r; the least a wins.
    """
    if not _GAMMA:
        g = _gamma_quantiles()
        _GAMMA.extend([g.astype(np.float32), np.log(g).astype(np.float32), (1 / g).astype(np.float32)])
    r_of, ln_c_of, inverse = _GAMMA
    begin = s.first[:-1][np.diff(s.first) > 0]
    bounds = np.append(begin, s.keys.size)
    out = np.empty((begin.size, len(_SEEDS)), np.uint64)
    log_w = np.log(weights).astype(np.float32)
    lo = 0
    while lo < begin.size:  # blocks of whole texts that fit the cache
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + block, "right")) - 1)
        at = slice(bounds[lo], bounds[hi])
        keys, lw, own = s.keys[at], log_w[at], bounds[lo:hi] - bounds[lo]
        many = np.diff(np.append(own, keys.size))
        text = np.repeat(np.arange(hi - lo), many)
        for k, seed in enumerate(_SEEDS):
            h = mix64(keys ^ seed)
            bits = h.view(np.uint16).reshape(-1, 4)
            r_at = bits[:, 0]
            beta = bits[:, 1].astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(lw * inverse[r_at] + beta)
            a = ln_c_of[bits[:, 2]] - r_of[r_at] * (t - beta + np.float32(1))
            least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, own), many))
            _, first = np.unique(text[least], return_index=True)
            won = least[first]
            out[lo:hi, k] = mix64(keys[won] + t[won].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seed)
        lo = hi
    return out


def sketches(documents: DataFrame, sifted: bool = False) -> tuple[DataFrame, int]:
    """doc_id, text_hash, node (hash of the words; null without words), weight, bands (array of long), df (packed document
    frequencies of the text's shingles) of every row; and the number of documents with words.  ``sifted``: both are of ``originals`` only."""
    blocks = written(text_blocks(documents))
    n, many = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shards, asking = max(width(documents.sparkSession), -(-many // BLOCKS_A_SHARD)), blocks
    if sifted:
        firsts = written(originals(blocks))
        asking = blocks.join(F.broadcast(firsts) if n <= FEW else firsts, "block", "left")
        n = firsts.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]

    def sketch(own: pa.Table, answers: pa.Table) -> pa.Table:
        texts = [x for b in _texts(own.column("texts")[0].as_py()).to_batches() for x in chunks(b)]
        each = [shingles(words(x.column("text"))) for x in texts]
        keys, _ = distinct(np.concatenate([np.empty(0, np.uint64), *(s.keys for s in each)]))
        order = np.argsort(answers.column("shard").to_numpy())
        packed = answers.column("df").to_pylist()
        df = np.concatenate([np.empty(0, np.uint32), *(unpack(packed[k]) for k in order)])
        return pa.Table.from_batches([row for x, s in zip(texts, each) for row in sketched(x, s, df[np.searchsorted(keys, s.keys)])])

    def sketched(part, s, df):
        w = words(part.column("text"))
        weights = s.counts * idf_of(df, n)
        x = samples(s, weights)
        total = np.append(0, np.cumsum(weights, dtype=np.float64))
        bands = x.reshape(len(x), BANDS, ROWS)
        hashed = mix64(np.arange(BANDS, dtype=np.uint64) + mix64(bands[:, :, 0] + mix64(bands[:, :, 1] + mix64(bands[:, :, 2] + mix64(bands[:, :, 3])))))
        has = np.diff(w.first) > 0
        node = [int.from_bytes(hashlib.blake2b(w.hashes[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) if b > a else None
                for a, b in zip(w.first[:-1], w.first[1:])]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * BANDS)).astype(np.int32)), pa.array(hashed.ravel().view(np.int64)))
        own = [pack(df[a:b]) if b > a else None for a, b in zip(s.first[:-1], s.first[1:])]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(node, pa.int64()),
                                          pa.array(total[s.first[1:]] - total[s.first[:-1]]), lists, pa.array(own, pa.binary())],
                                         names=["doc_id", "text_hash", "node", "weight", "bands", "df"])

    rows = blocks.select("block", "texts").groupBy("block").cogroup(document_counts(asking, shards).groupBy("block")).applyInArrow(
        sketch, "doc_id long, text_hash long, node long, weight double, bands array<long>, df binary")
    return rows, n


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) text_hash", "text")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def similarities(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """a, b, sim of the pairs (a, b).

    Pairs of one ``a`` are dealt out in groups of about 64, each with one copy
    of its text, so neither a frequent ``a`` nor its text is a task's whole work.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 64).alias("groups"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("g"))
    members = dealt.join(texts.select(F.col("node").alias("b"), "text", "df"), "b").select("a", "g", "b", "text", "df")
    leaders = dealt.select("a", "g").distinct().join(texts.select(F.col("node").alias("a"), "text", "df"), "a").select(
        "a", "g", F.lit(None).cast("long").alias("b"), "text", "df")

    def run(batches):
        own, features = None, None
        for batch in batches:
            for part in chunks(batch):
                s = shingles(words(part.column("text")))
                w = weigh_by(s, part.column("df"), n).astype(np.float64)
                out = []
                for i, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist())):
                    x = slice(s.first[i], s.first[i + 1])
                    if b is None:
                        own, features = a, (s.keys[x].copy(), w[x].copy())
                    elif own == a:
                        out.append((a, b, similarity(features, (s.keys[x], w[x]))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "sim"])

    rows = spread(members.union(leaders), "a", "g").sortWithinPartitions(F.col("a"), F.col("g"), F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long, sim double")


#: Nodes of a block: larger groups of candidates are compared block by block.
BLOCK = 512


def _compare(rows: pa.Table, s: Shingles, w: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links (a, b, sim) between components of one block, among pairs of which at least one waits.

    Pairs that can't reach the threshold are passed over: the similarity is at
    most the ratio of the total weights and, as 1 - sim is a metric, at most 1
    minus the difference of the distances from the group's first node; so are
    pairs that meet in an earlier band and pairs already joined.
    """
    col = lambda c: rows.column(c).to_numpy()
    node, root, waits, weight, away, part = col("node"), col("comp").copy(), col("waits"), col("weight"), col("away"), col("part")
    i, j, band = rows.column("i")[0].as_py(), rows.column("j")[0].as_py(), rows.column("band")[0].as_py()
    bands = np.array(rows.column("bands").to_pylist(), np.int64)[:, :band - 1]
    _, slot = np.unique(s.keys, return_inverse=True)
    dense, begin, out = np.zeros(slot.max() + 1), s.first[:-1], []
    turn = np.arange(node.size)
    for u in np.flatnonzero(waits):
        v = (root != root[u]) & (np.minimum(weight, weight[u]) >= np.maximum(weight, weight[u]) * (threshold - 1e-6))
        v &= ~(np.abs(away - away[u]) > 1 - threshold + 1e-6) & ~(waits & (turn < u))
        v &= (part == i) | (part == j) if i == j else part != part[u]
        if not v.any() or band > 1 and not (v := v & ~(bands == bands[u]).any(axis=1)).any():
            continue
        own = slice(s.first[u], s.first[u + 1])
        dense[slot[own]] = w[own]
        both = np.add.reduceat(np.minimum(dense[slot], w), begin)
        dense[slot[own]] = 0
        sim = both / (weight + weight[u] - both)
        for x in np.flatnonzero(v & (sim >= threshold)):
            if root[x] != root[u]:
                out.append((int(node[u]), int(node[x]), float(sim[x])))
                root[root == root[x]] = root[u]
    return out


def block_links(blocks: DataFrame, n: int, threshold: float) -> DataFrame:
    """a, b, sim: links between the components of each block (bucket, i, j)."""
    key = ["bucket", "i", "j"]

    def run(batches):
        def links(tab):
            for chunk in chunks(tab.combine_chunks().to_batches()[0], size=1 << 60):
                s = shingles(words(chunk.column("text")))
                yield from _compare(pa.Table.from_batches([chunk]), s, weigh_by(s, chunk.column("df"), n).astype(np.float64), threshold)

        def done(tab, last):
            k = [tab.column(c).to_numpy() for c in key]
            new = np.append(True, np.any([x[1:] != x[:-1] for x in k], axis=0))
            at = np.append(np.flatnonzero(new), tab.num_rows)
            end = len(at) - 1 if last else len(at) - 2
            out = [x for g in range(end) if at[g + 1] - at[g] > 1 for x in links(tab.slice(at[g], at[g + 1] - at[g]))]
            a, b, sim = zip(*out) if out else ((), (), ())
            return None if last else tab.slice(at[-2]), pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

        held = None
        for batch in batches:
            for part in chunks(batch, size=8 << 20):
                tab = pa.Table.from_batches([part])
                held, out = done(pa.concat_tables([held, tab]).combine_chunks() if held is not None else tab, False)
                yield out
        if held is not None:
            yield done(held.combine_chunks(), True)[1]

    return spread(blocks, *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long, sim double")


def classes(documents: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_hash, linked (has words), n (rows), class_id, class_size, first (stands for its class) for every distinct (doc_id, text).

    Texts are linked at a weighted Jaccard similarity >= ``threshold``; classes
    are connected by links.  Document frequencies are those among ``originals``,
    so a group of copies of any size counts about once.  Texts with the same words (case and white space
    aside) are one node.  Null texts and texts without words are never linked
    and kept.  A text of fewer than five words has one shingle, of all its
    words.  The text with the smallest doc_id stands for its class, of several
    under that doc_id the one of smallest hash.  A null doc_id counts as larger
    than all others.

    Within a group of candidates one node, that with most copies, is compared
    with all others first.  Where that leaves the group in several components,
    the nodes outside its largest component wait to be compared with those of
    other components; that is done in blocks of at most ``BLOCK`` nodes against
    as many, so a group of any size spreads over many tasks and no pair but a
    link becomes a row.  No link that could join two classes is lost.
    """
    rows, n = sketches(documents, sifted=True)
    rows = written(rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep")
    nodes = written(rows.where("node is not null").groupBy("node").agg(
        first, F.count(F.lit(1)).alias("copies"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("df").alias("df")))
    banded = nodes.select("node", "weight", "copies", F.explode("bands").alias("bucket"))
    lead = F.min_by(F.struct("node", "weight"), F.struct(-F.col("copies"), F.col("node"))).alias("lead")
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), lead).where("m > 1")
    members = written(banded.drop("copies").join(sizes.select("bucket", "m", F.col("lead.node").alias("lead"), F.col("lead.weight").alias("lead_weight")), "bucket"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("rep.doc_id").alias("r_id"), F.col("rep.text_hash").alias("r_hash"), "df")
    of_rep = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash"))
    texts = written(_keyed(documents).join(wanted, of_rep).select("node", "text", "df").dropDuplicates(["node"]))

    near = F.least("weight", "lead_weight") >= F.greatest("weight", "lead_weight") * (threshold - 1e-6)
    stars = written(similarities(members.where(F.col("node") != F.col("lead")).where(near).select(
        F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), texts, n))
    links = stars.where(F.col("sim") >= threshold)
    comp = written(components(links)).withColumnRenamed("node", "c_node")
    away = stars.select(F.col("a").alias("lead"), F.col("b").alias("node"), (1 - F.col("sim")).alias("away"))
    now = (members.join(away, ["lead", "node"], "left").join(comp, F.col("node") == F.col("c_node"), "left").select(
        "bucket", "m", "node", "weight", F.when(F.col("node") == F.col("lead"), 0.0).otherwise(F.coalesce("away", F.lit(float("nan")))).alias("away"),
        F.coalesce("component", "node").alias("comp")))
    parts = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("size", "comp")).alias("top")).where(
        # two nodes in two components were compared as a star
        "comps > 1 and not (comps = 2 and top.size = 1)").select("bucket", F.col("top.comp").alias("top"))
    n_parts = F.ceil(F.col("m") / BLOCK).cast("int")
    tagged = now.join(largest, "bucket").withColumn("waits", F.col("comp") != F.col("top")).withColumn("part", F.pmod(F.xxhash64("node"), n_parts).cast("int"))
    # Only pairs of parts of which one has a node that waits are compared, so a lone one costs a copy of its bucket and no more.
    waiting = tagged.where("waits").groupBy("bucket").agg(F.collect_set("part").alias("waiting"))
    others = F.when(F.array_contains("waiting", F.col("part")), F.sequence(F.lit(0), n_parts - 1)).otherwise(F.col("waiting"))
    blocks = tagged.join(waiting, "bucket").withColumn("other", F.explode(others)).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("waiting")
    blocks = blocks.drop("other", "top", "m").join(nodes.select("node", "bands"), "node").withColumn("band", F.array_position("bands", F.col("bucket")).cast("int"))
    links = links.unionByName(block_links(blocks.join(texts, "node"), n, threshold))
    comp = written(components(written(links)))

    comp = comp.withColumnRenamed("node", "c_node")
    of_node = nodes.join(comp, F.col("node") == F.col("c_node"), "left").select(
        F.col("node").alias("k_node"), "rep", "copies", F.coalesce("component", "node").alias("component"))
    classes = of_node.groupBy("component").agg(F.min("rep").alias("least"), F.sum("copies").alias("class_size"))
    of_node = of_node.join(classes, "component").select("k_node", F.col("least.doc_id").alias("class_id"), F.col("least.text_hash").alias("class_hash"), "class_size")
    own = rows.groupBy("doc_id", "text_hash", "node").agg(F.count(F.lit(1)).alias("n"))
    out = own.join(of_node, F.col("node") == F.col("k_node"), "left")
    alone = F.col("k_node").isNull()
    return out.select("doc_id", "text_hash", (~alone).alias("linked"), "n", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("class_size", F.lit(1)).alias("class_size"),
                      (alone | F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))).alias("first"))


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), class_size (rows), kept for every row.

    The options and the classes are those of ``classes``.  One row of each class
    is kept, whatever doc_ids repeat or are null, and every row without words.
    An empty table gives an empty result; other columns are dropped.
    """
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("row")
    rows = classes(documents, **options).select("doc_id", "class_id", "class_size", "linked", "first", each)
    return rows.select("doc_id", "class_id", "class_size", (F.col("first") & (~F.col("linked") | (F.col("row") == 1))).alias("kept"))


def without_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One row of each near-duplicate class, and the rows without words; all columns unchanged.

    Rows go by doc_id and text, so a text is never lost for another one under
    its doc_id; of rows that repeat both one stays.
    """
    own_id, own_hash, d_id, d_hash, stays = fresh(documents, 5)
    found = classes(documents, **options).where("not first or linked and n > 1").select("doc_id", "text_hash", "first")
    found = written(found.toDF(d_id, d_hash, stays))
    keyed = documents.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64("text")})
    same = F.col(own_id).eqNullSafe(F.col(d_id)) & (F.col(own_hash) == F.col(d_hash))
    repeated = keyed.join(found.where(F.col(stays)), same, "left_semi").dropDuplicates([own_id, own_hash])
    return keyed.join(found, same, "left_anti").unionByName(repeated).drop(own_id, own_hash)
