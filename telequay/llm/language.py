"""Operator 9: language identification by character models.

For every language an interpolated Kneser-Ney model of character n-grams is
learned from labelled texts.  All n-grams count, however rare: their
log-probabilities under every language are a table, whose frequent rows go to
every task while texts meet the others by a join.  The language with the lowest
cross-entropy per character wins, and a text whose entropy is above what the
language's own training texts have is marked as rejected.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import Index
from .shared import discard, written
from .tiers import threshold
from .words import chunks

ORDER = 4
UNKNOWN = "und"
_SEP, _BLANK = 1, 32


def _fold_table() -> np.ndarray:
    """Letters as 16-bit numbers of lower-case letters, everything else as a blank (U+FFFF: a boundary).

    Letters beyond U+FFFF share the numbers of the 6,400 private characters, which are no letters themselves.
    """
    out = np.full(0x110000, _BLANK, np.uint16)
    number = lambda cp: cp if cp < 1 << 16 else 0xE000 + cp % 6400
    for cp in [*range(0x41, 0xD800), *range(0xF900, 0xFFFF), *range(0x10000, 0x33480)]:
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            out[cp] = number(ord(low) if len(low) == 1 else cp)
    out[0xFFFF] = _SEP
    return out


_FOLD: list[np.ndarray] = []


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram key, text index) of each character: four characters of 16 bits, the last one lowest.

    Runs of non-letters count as one blank; contexts begin anew with each text.
    """
    if not _FOLD:
        _FOLD.append(_fold_table())
    joined = "\uffff" + "\uffff".join([x.replace("\uffff", " ") if "\uffff" in x else x for x in texts])
    a = _FOLD[0][np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(a.size, bool)
    keep[1:] = (a[1:] != _BLANK) | ((a[:-1] != _BLANK) & (a[:-1] != _SEP))
    a = a[keep].astype(np.uint64)
    one = np.uint64(_SEP)
    before = [np.append(np.full(k, one), a)[:a.size] for k in range(1, ORDER)]
    for k in range(1, ORDER - 1):
        before[k] = np.where(before[k - 1] == one, one, before[k])
    key = a.copy()
    for k, b in enumerate(before, 1):
        key |= b << np.uint64(16 * k)
    text = np.cumsum(a == one) - 1
    own = a != one
    return key[own], text[own]


class Models(NamedTuple):
    languages: list[str]
    keys: list[np.ndarray]  # of orders 1, 2, ...
    logs: list[np.ndarray]  # log-probability of the last character given the ones before it
    contexts: list[np.ndarray]
    backs: list[np.ndarray]  # log-weight of the lower order in that context
    floor: np.ndarray  # log-probability of a character never seen


class Level(NamedTuple):
    """The n-grams of one order that are kept: of each language its keys with what their counts give
    ((count - discount) / total of the context), and its contexts with the weight of the lower order."""

    keys: dict[str, tuple[np.ndarray, np.ndarray]]
    contexts: dict[str, tuple[np.ndarray, np.ndarray]]


def build(types: dict[str, int], levels: list[Level]) -> Models:
    """Interpolated models from the levels of order 1, 2, ...; ``types`` has the number of characters of each language."""
    names = sorted(types)
    floor = np.log(np.array([1.0 / (types[x] + 1) for x in names]))
    out = Models(names, [], [], [], [], floor)
    for n, level in enumerate(levels):
        union = np.unique(np.concatenate([k for k, _ in level.keys.values()]))
        ctx_union = np.unique(np.concatenate([k for k, _ in level.contexts.values()]))
        below = np.exp(Scorer(out).logs(union, n).astype(np.float64))
        back = np.ones((ctx_union.size, len(names)))
        seen = np.zeros((union.size, len(names)))
        for col, name in enumerate(names):
            if name in level.keys:
                k, x = level.keys[name]
                seen[np.searchsorted(union, k), col] = x
                k, x = level.contexts[name]
                back[np.searchsorted(ctx_union, k), col] = x
        weight = back[np.searchsorted(ctx_union, union >> np.uint64(16))]
        out.keys.append(union)
        out.logs.append(np.log(seen + weight * below).astype(np.float32))
        out.contexts.append(ctx_union)
        out.backs.append(np.log(np.maximum(back, 1e-12)).astype(np.float32))
    return out


class Scorer:
    def __init__(self, m: Models):
        self.m, self.order = m, len(m.keys)
        self.index = [Index(k) for k in m.keys]
        self.context = [Index(k) for k in m.contexts]

    def logs(self, keys: np.ndarray, order: int | None = None) -> np.ndarray:
        """Log-probability of each n-gram's last character under every language."""
        n = self.order if order is None else order
        if n == 0:
            return np.tile(self.m.floor.astype(np.float32), (keys.size, 1))
        keys = keys & np.uint64((1 << 16 * n) - 1) if n < ORDER else keys
        at = self.index[n - 1].find(keys)
        out = self.m.logs[n - 1][at]
        miss = np.flatnonzero(at < 0)
        if miss.size:
            lower = self.logs(keys[miss], n - 1)
            ctx = self.context[n - 1].find(keys[miss] >> np.uint64(16))
            out[miss] = lower + np.where((ctx >= 0)[:, None], self.m.backs[n - 1][ctx], np.float32(0))
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character under every language, number of characters) of each text."""
        keys, text = keys_of(texts)
        logs = self.logs(keys)
        n = np.bincount(text, minlength=len(texts))
        total = np.stack([np.bincount(text, logs[:, c], len(texts)) for c in range(logs.shape[1])], axis=1)
        return -total / np.maximum(n, 1)[:, None], n


def count_ngrams(rows: DataFrame, *, flush: int = 2_000_000) -> DataFrame:
    """lang, key, count over all characters of (text, lang; null is one of its values); counted in each task before the shuffle."""

    def run(batches):
        held: dict[str, list[np.ndarray]] = {}

        def merged(parts):
            keys, at = np.unique(np.concatenate(parts[0::2]), return_inverse=True)
            return [keys, np.bincount(at, np.concatenate(parts[1::2])).astype(np.int64)]

        def out(name):
            keys, counts = merged(held.pop(name))
            for lo in range(0, keys.size, 100_000):
                s = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([name] * keys[s].size, pa.string()), pa.array(keys[s].view(np.int64)), pa.array(counts[s])],
                                                 names=["lang", "key", "count"])

        for batch in batches:
            for part in chunks(batch):
                langs = part.column("lang").to_pylist()
                texts = part.column("text").to_pylist()
                for name in dict.fromkeys(langs):
                    keys, _ = keys_of([x for x, y in zip(texts, langs) if y == name])
                    keys = np.sort(keys)
                    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.empty(0, np.int64)
                    parts = held.setdefault(name, [])
                    parts += [keys[at], np.diff(np.append(at, keys.size))]
                    if sum(p.size for p in parts[0::2]) > flush:
                        held[name] = merged(parts)
                        if held[name][0].size > flush // 2:
                            yield from out(name)
        for name in list(held):
            yield from out(name)

    counted = rows.select("text", "lang").mapInArrow(run, "lang string, key long, count long")
    return counted.groupBy("lang", "key").agg(F.sum("count").alias("count"))


def orders(level: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """Tables (lang, key, count) of orders 1, 2, ... from that of the highest: a lower one counts what stands before it, once each."""
    tables = [level]
    for n in range(order - 1, 0, -1):
        level = written(level.groupBy("lang", F.col("key").bitwiseAND((1 << 16 * n) - 1).alias("key")).agg(F.count(F.lit(1)).alias("count")))
        tables.append(level)
    return tables[::-1]


def stats_of(level: DataFrame) -> list:
    """One row a language: n1, n2 (n-grams seen once, twice), total, types; its discount is ``discount``."""
    return level.groupBy("lang").agg(F.count_if(F.col("count") == 1).alias("n1"), F.count_if(F.col("count") == 2).alias("n2"), F.sum("count").alias("total"),
                                     F.count(F.lit(1)).alias("types")).collect()


def discount(r) -> float:
    return r.n1 / (r.n1 + 2 * r.n2) if r.n1 and r.n2 else 0.5


def log_table(counts: DataFrame, order: int = ORDER) -> tuple[list[str], DataFrame] | None:
    """(languages, key, n, logs): what every n-gram of ``counts`` (lang, key, count) has under every language, none left out.

    Learns from rows with a language; those without are only looked up.  ``n``: occurrences in all rows; ``logs``: the last
    character's log-probability given those before it, of each language.  None where no row has a language.
    """
    tables = orders(counts.where("lang is not null"), order)
    keys = counts.groupBy("key").agg(F.sum("count").alias("n"))
    below = names = None
    for n, level in enumerate(tables, 1):
        stats = stats_of(level)
        if not stats:
            return None
        if names is None:
            names = sorted(r.lang for r in stats)
            floors = {r.lang: 1.0 / (r.types + 1) for r in stats}
        rule = F.broadcast(level.sparkSession.createDataFrame([(r.lang, names.index(r.lang), discount(r), floors[r.lang]) for r in stats], "lang string, i int, discount double, floor double"))  # one row a language
        cut = level.join(rule.select("lang", "i", "discount"), "lang")
        seen = cut.select("i", "key", (F.col("count") - F.col("discount")).alias("x"))
        context = cut.groupBy("i", F.shiftrightunsigned("key", 16).alias("context")).agg(F.sum("count").alias("total"), (F.first("discount") * F.count(F.lit(1))).alias("kept_back"))
        low = (1 << 16 * n) - 1
        own = keys.select("key") if n == order else keys.select(F.col("key").bitwiseAND(low).alias("key")).distinct()
        d = own.join(rule.select("i", "floor")).withColumns({"context": F.shiftrightunsigned("key", 16), "lower": F.col("key").bitwiseAND((1 << 16 * (n - 1)) - 1)})
        d = d.join(context, ["i", "context"], "left").join(seen, ["i", "key"], "left")
        d = d.withColumn("p", F.col("floor")) if below is None else d.join(below, ["i", "lower"])
        d = written(d.select("i", "key", (F.coalesce(F.col("x") / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("kept_back") / F.col("total"), F.lit(1.0)) * F.col("p")).alias("p")))
        below = d.withColumnRenamed("key", "lower")
    logs = d.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: F.log(s["p"])).alias("logs"))  # one a language
    out = written(keys.join(logs, "key"))
    discard(d, *tables[:-1])
    return names, out


def learn(rows: DataFrame, *, order: int = ORDER, entries: int = 4_000_000) -> Models | None:
    """A model to keep and apply outside of Spark, from all rows (text, lang) without nulls; None if there are none.

    It is held in memory, so it leaves out what is rare, by one rule at every size: with L languages, n-grams that make
    up less than L / ``entries`` of those of their order in their language; their share goes to the lower order.  So no
    order has more than ``entries`` n-grams.  ``identify`` leaves out nothing and does not use it (``log_table``).
    """
    tables = orders(written(count_ngrams(rows)), order)
    types, levels = {}, []
    for n, level in enumerate(tables, 1):
        stats = stats_of(level)
        if not stats:
            return None
        if n == 1:
            types = {r.lang: r.types for r in stats}
        rule = level.sparkSession.createDataFrame(
            [(r.lang, discount(r), len(stats) * r.total / entries) for r in stats], "lang string, discount double, least double")
        share = F.when(F.col("count") >= F.col("least"), F.struct("key", (F.col("count") - F.col("discount")).alias("x")))
        context = level.join(F.broadcast(rule), "lang").groupBy("lang", F.shiftrightunsigned("key", 16).alias("context")).agg(  # one row a language
            F.sum("count").alias("total"), F.collect_list(share).alias("kept")).where("size(kept) > 0")
        context = written(context.select("lang", "context", "total", "kept", (1 - F.aggregate("kept", F.lit(0.0), lambda a, x: a + x["x"]) / F.col("total")).alias("back")))
        kept = context.select("lang", "total", F.explode("kept").alias("k")).select("lang", "k.key", (F.col("k.x") / F.col("total")).alias("x"))
        levels.append(Level(_by_language(kept.toArrow()), _by_language(context.select("lang", "context", "back").toArrow())))
    return build(types, levels)


def _by_language(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    names = np.array(table.column(0).to_pylist(), object)
    keys, values = table.column(1).to_numpy().view(np.uint64), table.column(2).to_numpy()
    return {x: (keys[names == x], values[names == x]) for x in sorted(set(names.tolist()))}


def predict(rows: DataFrame, model: tuple[list[str], DataFrame] | None, *, keep: list[str], entries: int = 4_000_000) -> DataFrame:
    """lang_pred, posterior, entropy and the columns ``keep`` for every row of ``text``.

    ``model``: what ``log_table`` gives for these texts' n-grams.  Its most frequent rows, up to ``entries`` numbers, go to
    every task; occurrences of the others stay with their text and are joined, with equal results.

    A text that is null or has no letter is ``und`` with posterior 0.  Equal
    entropies go to the first language by code point.  The posterior weighs a
    text as at most 50 characters, as neighbouring characters aren't independent.
    """
    names, table = model or ([], None)
    size = len(names)
    bound = threshold(table, "n", entries // size) if model else 0
    shared = None
    if model:
        hot = table.where(F.col("n") >= bound).select("key", "logs").toArrow().combine_chunks()
        found = hot.column("key").to_numpy().view(np.uint64)
        by_key = np.argsort(found)
        logs = np.concatenate([c.values.to_numpy() for c in hot.column("logs").chunks] or [np.empty(0)]).reshape(-1, size)
        shared = rows.sparkSession.sparkContext.broadcast((found[by_key], logs[by_key]))

    def run(batches):
        keys, logs = shared.value if shared else (np.empty(0, np.uint64), np.empty((0, 0)))
        index = Index(keys)
        for batch in batches:
            for part in chunks(batch):
                texts = [x or "" for x in part.column("text").to_pylist()]
                own, text = keys_of(texts)
                at = index.find(own)
                known, other = at >= 0, at < 0
                sums = np.stack([np.bincount(text[known], logs[at[known], c], len(texts)) for c in range(size)], axis=1) if size else np.empty((len(texts), 0))
                n = np.bincount(text, minlength=len(texts))
                letters = [bool(n[i]) or any(map(str.isalpha, x)) for i, x in enumerate(texts)]
                rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(text[other], minlength=len(texts)))), pa.int32()), pa.array(own[other].view(np.int64)))
                wide = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * size, pa.int32()), pa.array(sums.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], part.column("tq_row"), pa.array(n, pa.int64()), pa.array(letters), wide, rest],
                                                 names=[*keep, "tq_row", "chars", "letters", "sums", "rest"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    d = rows.select("text", *keep, F.monotonically_increasing_id().alias("tq_row")).mapInArrow(run, f"{kinds}, tq_row long, chars long, letters boolean, sums array<double>, rest array<long>")
    if not model:
        return d.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("posterior"), F.lit(0.0).alias("entropy"))
    if not table.where(F.col("n") < bound).isEmpty():
        d = written(d)
        more = d.select("tq_row", F.explode("rest").alias("key")).join(table.where(F.col("n") < bound).select("key", "logs"), "key").groupBy("tq_row").agg(
            F.array(*[F.sum(F.col("logs")[i]) for i in range(size)]).alias("more"))
        d = d.join(more, "tq_row", "left").withColumn("sums", F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b)))
    d = d.withColumn("e", F.transform("sums", lambda x: -x / F.greatest(F.col("chars"), F.lit(1)))).withColumn("low", F.array_min("e"))
    weights = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp((F.col("low") - x) * F.least(F.col("chars"), F.lit(50))))
    first = F.element_at(F.array(*map(F.lit, names)), F.array_position("e", F.col("low")).cast("int"))
    return d.select(*keep, F.when(F.col("letters"), first).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("letters"), 1 / weights).otherwise(0.0).alias("posterior"),
                    F.when(F.col("letters"), F.col("low")).otherwise(0.0).alias("entropy"))


def identify(documents: DataFrame, *, quantile: float = 0.999, entries: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for every document.

    Learns from documents with text and lang whose crc32(doc_id as text) mod 3
    is not 1 (a null doc_id is never learned from nor held out).  ``rejected``
    marks texts whose entropy exceeds the ``quantile`` of the training texts
    that were given the same language; the score of those is halved.  Repeated
    rows stay, an empty table gives an empty result, other columns are dropped.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("fold", fold)
    known = (F.col("fold") != 1) & F.col("lang").isNotNull()
    counts = written(count_ngrams(docs.where("text is not null").select("text", F.when(known, F.col("lang")).alias("lang"))))
    model = log_table(counts)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("fold") == 1, F.lit(False)).alias("held_out"),
                       F.coalesce(known, F.lit(False)).alias("trained"))
    scored = written(predict(rows, model, keep=["doc_id", "held_out", "trained"], entries=entries))
    limits = scored.where(F.col("trained") & (F.col("lang_pred") != UNKNOWN)).groupBy(F.col("lang_pred").alias("l")).agg(
        F.percentile_approx("entropy", F.lit(quantile), F.lit(10_000)).alias("limit"))
    rejected = F.coalesce(F.col("entropy") > F.col("limit"), F.lit(False))
    # One row for each language of the model, whose size was checked.
    out = scored.join(F.broadcast(limits), F.col("lang_pred") == F.col("l"), "left")
    return out.select("doc_id", "held_out", "lang_pred", F.when(rejected, F.col("posterior") / 2).otherwise(F.col("posterior")).alias("score"),
                      "entropy", rejected.alias("rejected"))
