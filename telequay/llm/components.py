"""Connected components as rounds of joins: large star, small star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (long columns).

    Each round hangs nodes onto smaller ones until all edges are stars; every
    round is written to the shared folder, so lineage stays short and a lost
    executor costs at most one round.  Loops, repeated and reversed edges do no
    harm; an edge with a null end is ignored; no edges give an empty result.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = e.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"))
    loops = e.where("hi = lo").select(F.col("hi").alias("node"))
    e = written(e.where("hi > lo").distinct())
    nodes = e.select(F.col("hi").alias("node")).union(e.select("lo")).union(loops).distinct()
    check = _checksum(e)
    while check[0]:
        both = e.union(e.select("lo", "hi"))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = (small.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(small.select("hi", F.col("m").alias("lo"))).distinct())
        e = written(small)
        before, check = check, _checksum(e)
        if before == check:
            break
    return nodes.join(e.select(F.col("hi").alias("node"), F.col("lo").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def _checksum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
