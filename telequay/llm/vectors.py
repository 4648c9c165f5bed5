"""Operator 7: near-duplicate embeddings.

Signs of random hyperplanes give every vector a key in several tables; vectors
of one label with an equal key are compared exactly, by cosine in double
precision; components of the links are found by joins.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import spread, written

#: Rows of a block: larger buckets are compared block by block.
BLOCK = 2048
#: Vectors a key is planned to have on average.
BUCKET = 1000


def table_plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a key, number of tables) for n vectors: about ``BUCKET`` vectors a key, and
    so many tables that a pair at the threshold meets in one with ``recall``."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / BUCKET + 1)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def _valid_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, key (of equal vectors of a label; null: links with nothing), dim, data (its numbers, as 32-bit ones where nothing is lost)."""

    def run(batches):
        for batch in batches:
            ids, labels, lists = (batch.column(i) for i in range(3))
            at = lists.offsets.to_numpy()
            values = lists.values
            numbers = values.to_numpy(zero_copy_only=False).astype(np.float64)
            null = values.is_null().to_numpy(zero_copy_only=False)
            keys, data, dims = [], [], []
            for i, (label, known) in enumerate(zip(labels.to_pylist(), lists.is_valid().to_pylist())):
                v = numbers[at[i]:at[i + 1]]
                largest = np.abs(v).max(initial=0.0) if known else 0.0
                if label is None or not known or null[at[i]:at[i + 1]].any() or not np.isfinite(largest) or largest == 0:
                    keys.append(None)
                    data.append(None)
                    dims.append(None)
                else:
                    v = v + 0.0  # no negative zeros
                    keys.append(hashlib.blake2b(b"%d|" % label + v.tobytes(), digest_size=16).digest())
                    with np.errstate(over="ignore"):
                        short = v.astype(np.float32)
                    data.append(short.tobytes() if (short == v).all() else v.tobytes())
                    dims.append(v.size)
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(data, pa.binary())],
                                             names=["vec_id", "label", "key", "dim", "data"])

    return vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as long) label", "cast(embedding as array<double>) embedding").mapInArrow(
        run, "vec_id long, label long, key binary, dim int, data binary")


def _numbers(data: list[bytes], dim: int) -> np.ndarray:
    """Vectors of one length in double precision, one a row, scaled so that the largest number is 1."""
    x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in data])
    return x / np.abs(x).max(axis=1, keepdims=True)


def _signed(reps: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """The columns of ``reps`` and signs: on which side of each hyperplane the vector lies, ``bits`` of them a table, packed."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed).standard_normal((dim, bits * tables))
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                signs = np.packbits(_numbers(part.column("data").to_pylist(), dim) @ planes[dim] > 0, axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([s.tobytes() for s in signs], pa.binary())], names=[*part.schema.names, "signs"])

    return reps.mapInArrow(run, "rid long, label long, key binary, dim int, vec_id long, copies long, data binary, signs binary")


def _keys(signs: list[bytes], bits: int, tables: int) -> np.ndarray:
    """Keys of the first ``tables`` tables, a row for each vector."""
    raw = np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), -1)
    each = np.unpackbits(raw, axis=1, count=bits * tables).reshape(len(signs), tables, bits)
    return (each.astype(np.int64) << np.arange(bits, dtype=np.int64)).sum(axis=2)


def _of_table(signed: DataFrame, bits: int, t: int) -> DataFrame:
    """label, dim, sig (key in table t), rid, copies, data, signs (up to table t)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                signs = [x[:-(-bits * (t + 1) // 8)] for x in batch.column("signs").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("label", "dim")], pa.array(_keys(signs, bits, t + 1)[:, t]),
                                                  *[batch.column(c) for c in ("rid", "copies", "data")], pa.array(signs, pa.binary())],
                                                 names=["label", "dim", "sig", "rid", "copies", "data", "signs"])

    return signed.select("label", "dim", "rid", "copies", "data", "signs").mapInArrow(
        run, "label long, dim int, sig long, rid long, copies long, data binary, signs binary")


def _compare(group: pa.Table, bits: int, t: int, threshold: float) -> tuple[list, list, list]:
    """Links of one block: (rid, rid of the root among its rows, copies linked) columns."""
    dim, i, j = (group.column(c)[0].as_py() for c in ("dim", "i", "j"))
    part, copies, ids = (group.column(c).to_numpy() for c in ("part", "copies", "rid"))
    rows, columns = np.flatnonzero(part == i), np.flatnonzero(part == j)
    if not rows.size or not columns.size:
        return [], [], []
    x = _numbers(group.column("data").to_pylist(), dim)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = x[rows] @ x[columns].T >= threshold
    if i == j:
        near &= np.triu(np.ones_like(near), 1)
    a, b = np.nonzero(near)
    a, b = rows[a], columns[b]
    if a.size and t:  # pairs that met in an earlier table were counted there
        keys = _keys(group.column("signs").to_pylist(), bits, t)
        fresh = np.ones(a.size, bool)
        for lo in range(0, a.size, 1 << 16):
            s = slice(lo, lo + (1 << 16))
            fresh[s] = ~(keys[a[s]] == keys[b[s]]).any(axis=1)
        a, b = a[fresh], b[fresh]
    if not a.size:
        return [], [], []
    linked = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
    root = np.arange(len(x))  # places of rows, so ids of any value do
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], least)
        np.minimum.at(after, root[b], least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    touched = np.flatnonzero(linked)
    return ids[touched].tolist(), ids[root[touched]].tolist(), linked[touched].astype(np.int64).tolist()


def _block_links(blocks: DataFrame, bits: int, t: int, threshold: float) -> DataFrame:
    key = ["label", "dim", "sig", "i", "j"]

    def run(batches):
        held = None

        def done(tab, last):
            k = [tab.column(c).to_numpy() for c in key]
            new = np.append(True, np.any([x[1:] != x[:-1] for x in k], axis=0))
            at = np.append(np.flatnonzero(new), tab.num_rows)
            end = len(at) - 1 if last else len(at) - 2
            out = [[], [], []]
            for g in range(end):
                if at[g + 1] - at[g] > 1:
                    for o, v in zip(out, _compare(tab.slice(at[g], at[g + 1] - at[g]), bits, t, threshold)):
                        o += v
            rest = None if last else tab.slice(at[-2])
            return rest, pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["rid", "root", "links"])

        for batch in batches:
            if batch.num_rows:
                tab = pa.Table.from_batches([batch])
                held, out = done(pa.concat_tables([held, tab]).combine_chunks() if held is not None else tab, False)
                yield out
        if held is not None:
            yield done(held.combine_chunks(), True)[1]

    return spread(blocks, *key).sortWithinPartitions(*key).mapInArrow(run, "rid long, root long, links long")


def _table_links(signed: DataFrame, bits: int, t: int, threshold: float) -> DataFrame:
    """Links found in one table.  Only buckets of more than ``BLOCK`` vectors are dealt out as pairs of blocks."""
    keyed, bucket = _of_table(signed, bits, t), ["label", "dim", "sig"]
    large = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    large = written(large.select(*bucket, F.ceil(F.col("m") / BLOCK).cast("int").alias("parts")))
    dealt = keyed.join(large, bucket, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "parts")
    return written(_block_links(dealt, bits, t, threshold))


def near_vectors(vectors: DataFrame, *, threshold: float = 0.93, recall: float = 0.999, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors of equal, non-null label and equal length are linked at cosine >=
    ``threshold``.  Vectors that are null, zero, or hold null or non-finite
    components, or whose label is null, link with nothing and are their own
    component.  Equal vectors of a label are compared once and counted as often
    as they occur.  Repeated rows are vectors of their own; rows that share a
    vec_id share its component where they are linked.  A null vec_id counts as
    larger than all others: it names a component (component_id null, kept) only
    where all ids of that are null.  An empty table gives an empty result;
    other columns are dropped.

    The tables are worked off one after the other, so the vectors are on the way
    once at a time and not once for each table.  A bucket of more than ``BLOCK``
    vectors is dealt out as pairs of blocks, so no task holds more than two
    blocks; every pair is counted in the first table in which it meets.
    """
    rows = written(_valid_rows(vectors))
    reps = rows.where("key is not null").groupBy("label", "key").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("data").alias("data"))
    reps = reps.select(F.xxhash64("label", "key").alias("rid"), "label", "key", "dim", "vec_id", "copies", "data")
    bits, tables = table_plan(rows.where("key is not null").count(), threshold, recall)
    signed = written(_signed(reps, bits, tables, seed))
    found = [_table_links(signed, bits, t, threshold) for t in range(tables)]
    links = functools.reduce(DataFrame.union, found)
    joined = written(components(links, "rid", "root")).withColumnRenamed("node", "c_id")
    counted = links.groupBy(F.col("rid").alias("l_id")).agg(F.sum("links").alias("links"))
    by_key = written(signed.join(counted, F.col("rid") == F.col("l_id"), "left").join(joined, F.col("rid") == F.col("c_id"), "left").select(
        F.col("label").alias("k_label"), F.col("key").alias("k"), "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component", "rid").alias("component")))
    least = by_key.groupBy(F.col("component").alias("m_component")).agg(F.min("vec_id").alias("least"))
    by_key = by_key.join(least, F.col("component") == F.col("m_component")).select("k_label", "k", "links", "least")
    out = rows.select("vec_id", "label", "key").join(by_key, (F.col("key") == F.col("k")) & (F.col("label") == F.col("k_label")), "left")
    component = F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
