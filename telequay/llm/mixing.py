"""Operator 10: mixing sources to target weights, by DataFrame functions alone.

Efraimidis-Spirakis sampling: each row draws an exponential key divided by its
quality weight; within a source the rows are taken in key order until their
prefix sum reaches the source's token budget.  A budget above the source's own
size first takes whole epochs (every row once each), then the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import fresh, uniform, written

WORD = r"[^\x20\x09-\x0D]+"


def text_size(text) -> F.Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, budget_ratio: float = 1.5, max_epochs: float = 2.0,
                   cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.

    Sources in code point order (null last) weigh ``cycle``, repeating.  The
    budget, ``budget_ratio`` times all sizes, is shared by weight; a target
    stops at ``max_epochs`` times its source's size and what is cut off goes to
    the others by weight, until none is above.  That is one level L with
    target = min(cap, weight * L); sorted by cap / weight, L follows from two
    prefix sums.  The input here is one row per source, so one task sorts it.
    Sources of size 0 get target 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    d = (by_source
         .withColumn("w", F.element_at(weights, (rank % len(cycle) + 1).cast("int")))
         .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
         .withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(budget_ratio))))
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    d = d.withColumn("level_here", (F.col("total") - F.coalesce(before, F.lit(0.0))) / rest)
    open_level = F.when(F.col("level_here") < F.col("cap") / F.col("w"), F.col("level_here"))
    d = d.withColumn("level", F.max(open_level).over(W.partitionBy()))
    return d.select("source", "source_size", "n_docs",
                    F.least(F.col("cap"), F.coalesce(F.col("w") * F.col("level"), F.col("cap"))).alias("target"))


def weight_classes(rows: DataFrame) -> DataFrame:
    """source, classes: how many rows have a weight of each power of two, and their mean weight (a few classes a source)."""
    by = rows.groupBy("source", F.floor(F.log2("weight")).alias("power")).agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("w"))
    return by.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("w", "n"))).alias("classes"))


def _share_below(key, classes, n_docs) -> F.Column:
    """About which share of a source's exponential keys is below ``key``; it never falls as the key grows."""
    below = F.aggregate(classes, F.lit(0.0), lambda a, c: a + c["n"] * (F.lit(1.0) - F.exp(-key * c["w"])))
    return below / n_docs


def mix(rows: DataFrame, *, seed: int = 0, **targets) -> DataFrame:
    """Decide how much of each row the mix takes.

    ``rows`` needs ``doc_id``, ``source``, ``size`` (long) and ``weight``
    (double > 0); further columns are dropped.  Returns doc_id, source, size,
    source_size, target, copies, taken (= copies * size).

    Of the fractional epoch the prefix nearest to the budget is taken: a row
    goes in when the middle of its span lies within the budget.  Null or
    non-positive weights count as the smallest positive weight used, 1e-6.
    Rows with equal doc_id are separate rows; equal keys are ordered by doc_id,
    then size.  An empty table gives an empty result.

    The prefix sum of a source has two levels, so a source with a third of all
    rows is no single task: rows fall into about sqrt(n) ranges of the key, sums
    of ranges are prefix-summed per source, rows within their range.  The ranges
    follow the distribution of the source's keys, so they hold about as many rows
    each whatever the weights are.
    """
    d = rows.select("doc_id", "source", "size",
                    F.greatest(F.coalesce("weight", F.lit(1e-6)), F.lit(1e-6)).alias("weight"))
    t = source_targets(d, **targets).withColumnRenamed("source", "t_source")
    t = t.join(weight_classes(d).withColumnRenamed("source", "c_source"), F.col("t_source").eqNullSafe(F.col("c_source"))).drop("c_source")
    d = d.join(t, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    d = (d.withColumn("epochs", epochs.cast("long"))
         .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
         .withColumn("key", -F.log(uniform(F.lit(seed), F.col("doc_id"), F.col("size"))) / F.col("weight"))
         .withColumn("range", F.floor(_share_below(F.col("key"), F.col("classes"), F.col("n_docs")) * F.ceil(F.sqrt(F.col("n_docs")))))
         .drop("classes"))
    sums = d.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    up_to = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("range").alias("s_range"),
                       F.coalesce(F.sum("range_size").over(up_to), F.lit(0)).alias("before_range"))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")), "left")
    within = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("before_range") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / F.lit(2.0)
    extra = F.when((F.col("rest") > 0) & (middle <= F.col("rest")), 1).otherwise(0)
    return (d.withColumn("copies", (F.col("epochs") + extra).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def quality_weights(labels: DataFrame, *, good: float = 1.0, bad: float = 0.25) -> DataFrame:
    """doc_id, weight from labels: ``good`` where quality is 1 in every label row, else ``bad``."""
    ok = F.min(F.coalesce(F.col("quality"), F.lit(0)))
    return (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.when(ok == 1, F.lit(good)).otherwise(F.lit(bad)).alias("weight")))


def mix_documents(documents: DataFrame, labels: DataFrame, *, unlabelled: float = 0.5, seed: int = 0) -> DataFrame:
    """``mix`` over documents, weighted by their quality labels (``unlabelled`` without one).

    The sizes are measured once and written to the shared folder, so the texts
    are scanned a single time.
    """
    sizes = documents.select("doc_id", "source", text_size(F.col("text")).alias("size"))
    w = quality_weights(labels).withColumnRenamed("doc_id", "w_id")
    sizes = sizes.join(w, F.col("doc_id") == F.col("w_id"), "left").select(
        "doc_id", "source", "size", F.coalesce("weight", F.lit(unlabelled)).alias("weight"))
    return mix(written(sizes), seed=seed)


def mixed_rows(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as many times as it was taken, columns unchanged.

    Rows with equal doc_id, source and size (as null ids) stand side by side in the mix, so its end falls within one
    such group of a source at most.  All rows of a group come as often as each is taken at least; of the groups in
    which some are taken once more, one a source, that many rows, by their texts' hashes, come once more.
    """
    m_id, m_source, m_size, low, more, own_size, copy, number = fresh(documents, 8)
    groups = mix_documents(documents, labels, **options).groupBy("doc_id", "source", "size").agg(
        F.min("copies").alias("low"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("more")).toDF(m_id, m_source, m_size, low, more)
    groups = written(groups)
    sized = documents.withColumn(own_size, text_size(F.col("text")))
    own = F.col("doc_id").eqNullSafe(F.col(m_id)) & F.col("source").eqNullSafe(F.col(m_source)) & (F.col(own_size) == F.col(m_size))
    out = sized.join(groups.where(F.col(low) > 0), own).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(low).cast("int"))))
    last = sized.join(F.broadcast(groups.where(F.col(more) > 0)), own)  # a group a source
    last = last.withColumn(number, F.row_number().over(W.partitionBy(m_id, m_source, m_size).orderBy(F.xxhash64("text"), "text"))).where(F.col(number) <= F.col(more))
    return out.select(*documents.columns).unionByName(last.select(*documents.columns))
