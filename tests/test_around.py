"""Walks counted around hubs against the list of who reaches whom."""

import random

import pytest
from pyspark.sql import functions as F

from telequay.operators import detect as D
from telequay.operators import topology as G

MEMBERS = [("p", "s1", "required", "a", "anchor"), ("p", "s2", "required", "b", "neighbour"), ("p", "s3", "supporting", "c", "two-hop"),
           ("q", "s4", "required", "b", "anchor"), ("q", "s5", "required", "c", "two-hop"), ("q", "s6", "supporting", None, "neighbour"), ("r", "s7", "required", "c", "anchor"), ("r", "s8", "required", "a", "two-hop")]


@pytest.mark.parametrize("seed, types", [(1, ("runs-on",)), (2, None)])
def test_counted_walks_equal_listed_ones(spark, seed, types):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(14)] + [f"i|k|ns|Container|c|n{i}/x" for i in (0, 3, 99)]
    edges = {(t, r.choice(["runs-on", "mounts"]), r.choice(names[:14]), r.choice(names[:14])): r.choice([1, 2]) for t in (0, 1) for _ in range(24)}  # with loops and edges both ways
    links = spark.createDataFrame([(*k, v) for k, v in edges.items()], "tick_seq long, type string, from_key string, to_key string, verdict int").cache()
    c = spark.createDataFrame([(t, n, m, r.choice(["above", "above", "below"]), r.random() < 0.2) for t in (0, 1) for n in names for m in "abc" if r.random() < 0.6],
                              "tick_seq long, uid string, metric string, state string, stale boolean").cache()
    m = spark.createDataFrame(MEMBERS, "phenomenon string, signal string, role string, metric string, on_scope string")
    reached = G.reach_anchored(links, c.select("tick_seq", F.col("uid").alias("key")).distinct(), 2, types).cache()
    pairs = G.paired(links, types).cache()
    want, got = D.match_spanned(c, m, reached).cache(), D.match_around(c, m, pairs).cache()
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(want) == rows(got) and want.count() > 3
    assert rows(D.spanned_coverage(c, m, reached, want)) == rows(D.coverage_around(c, m, pairs, got).select("tick_seq", "uid", "metric", "phenomenon"))


def test_edges_are_held_once_for_all_ticks(spark):
    links = [(t, "runs-on", "a", f"b{k}", 1 + (t + k) % 2) for t in range(20) for k in range(3)] + [(3, "mounts", "b0", "a", 2), (4, "mounts", "b1", "a", 1)]
    links = spark.createDataFrame(links, "tick_seq long, type string, from_key string, to_key string, verdict int")
    got = {(r.lo, r.hi): r.at for r in G.paired(links).collect()}
    # a row a pair, the better verdict of edges both ways, a's runs-on told
    want = {("a", f"b{k}"): [16 * t + 4 + (2 if (t, k) == (3, 0) else 1 + (t + k) % 2) for t in range(20)] for k in range(3)}
    assert got == want
    back = G.by_tick(G.gathered(links))
    assert G.gathered(links).count() == 5 and sorted(back.select(links.columns).collect()) == sorted(links.collect())
