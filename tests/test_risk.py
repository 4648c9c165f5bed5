"""What is at risk around findings, told from edge intervals, against the lists that ``around`` makes."""

import random

import pytest
from pyspark.sql import functions as F

from telequay.operators import detect as D
from telequay.operators import signals as S
from telequay.operators import surfaces as U
from telequay.operators import topology as G

BUDGET = 30


def tables(spark, container=False):
    rnd = random.Random(5)
    keys = [f"k{i}" for i in range(12)] + (["i|k|ns|Container|c|k3/1", "i|k|ns|Container|c|k4/1"] if container else [])
    edges, seen = [], set()
    while len(edges) < 70:
        kind, a, b = rnd.choice(["runs-on", "mounts", "selects", "other"]), rnd.choice(keys), rnd.choice(keys)
        if (kind, a, b) not in seen:
            seen.add((kind, a, b))
            at = rnd.randrange(100)
            ok = at + rnd.randrange(60)
            edges.append((kind, a, b, at, ok, ok + 5 if rnd.random() < 0.3 else None))
    edges = spark.createDataFrame(edges, "type string, from_key string, to_key string, asserted_us long, confirmed_us long, retracted_us long")
    windows = spark.createDataFrame([(i, 40 * i, 40 * i + 20) for i in range(4)], "tick_seq long, start_us long, end_us long")
    found = spark.createDataFrame(sorted({(rnd.randrange(4), rnd.choice(keys), rnd.choice("pqr")) for _ in range(40)}), "tick_seq long, uid string, phenomenon string").withColumn("full", F.col("tick_seq") > 1)
    rel = spark.createDataFrame([("p", "q"), ("q", "r"), ("p", "r")], "trigger string, downstream string")
    tier = spark.createDataFrame(sorted({(rnd.choice(keys), rnd.choice("qr")) for _ in range(14)}), "uid string, phenomenon string")
    return found, rel, tier, edges, windows


@pytest.mark.parametrize("container", [False, True])
def test_risks_of_intervals_are_those_of_lists(spark, container):
    found, rel, tier, edges, windows = tables(spark, container)
    listed = D.blast_radius(found, rel, tier, D.around(found, G.edge_traverse(edges, windows, BUDGET)))
    rows = sorted(listed.collect())
    assert any(r.relation.endswith("(suspect)") for r in rows) and any(r.relation == "same-entity" for r in rows)
    assert sorted(D.blast_radius_over(found, rel, tier, edges, windows, BUDGET).select(*listed.columns).collect()) == rows
    counted = {(r.tick_seq, r.uid, r.phenomenon): r.at_risk for r in D.with_at_risk(found, listed).collect()}
    flagged = D.any_at_risk(found, rel, tier, edges, windows, BUDGET)
    assert {(r.tick_seq, r.uid, r.phenomenon): r.risky for r in flagged.collect()} == {k: n > 0 for k, n in counted.items()}
    assert 0 < sum(n > 0 for n in counted.values()) < len(counted)
    top = D.count_at_risk(U.on_call_top(flagged, 9), rel, tier, edges, windows, BUDGET).collect()
    assert len(top) == 9 and all(r.at_risk == counted[r.tick_seq, r.uid, r.phenomenon] for r in top)


def test_edges_among_keys_have_both_ends_there(spark):
    _, _, _, edges, _ = tables(spark)
    some = ["k1", "k2", "k3", "k4", "k5"]
    keys = spark.createDataFrame([(k,) for k in some], "key string")
    want = sorted((r.type, r.from_key, r.to_key) for r in edges.collect() if r.from_key in some and r.to_key in some)
    assert want and sorted(map(tuple, G.edges_among(edges, keys).select("type", "from_key", "to_key").collect())) == want
    assert G.edges_among(edges, keys.union(spark.createDataFrame([("i|k|ns|Container|c|k3/1",)], "key string"))).count() == edges.count()


def test_keys_without_a_pod_do_not_meet_in_one_task(spark):
    rows = spark.range(4000).select(F.lit(0).cast("long").alias("tick_seq"), F.concat(F.lit("e"), "id").alias("a"))
    pods = spark.createDataFrame([(0, "e7", "e7")], "tick_seq long, pod_uid string, pod_key string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = G.with_anchor(rows, "a", pods)
        sizes = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 2000 and d.where("a_anchor <> a").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_stay_where_they_are_when_they_meet_ticks(spark):
    ticks = spark.createDataFrame([(i, 100 * i) for i in range(1, 4)], "tick_seq long, now_us long")
    d = S.first_seen(spark.range(300).select(F.col("id").alias("at_us")), ticks)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(slot" not in plan
    assert {r.idx: r["count"] for r in d.groupBy("idx").count().collect()} == {1: 101, 2: 100, 3: 99}


def test_edges_are_dealt_out_before_equal_ones_are_sought(spark):
    pods = spark.createDataFrame([("p1", 5, "n1", ["c1", "c1", "c2"]), ("p2", 5, "n1", ["c1"])], "pod string, event_us long, node string, claims array<string>")
    slices = spark.createDataFrame([("s", 1, 5, ["p1", "p2"]), ("s", 2, 5, ["p1"])], "service string, slice long, event_us long, pods array<string>")
    leases = spark.createDataFrame([("n1", 7), ("n1", 7)], "node string, renewed_us long")
    names = [("Pod", "p1"), ("Pod", "p2"), ("Node", "n1"), ("Claim", "c1"), ("Claim", "c2"), ("Service", "s")]
    ends = spark.createDataFrame([(k, x, f"i|{x}", 0) for k, x in names], "kind string, name string, key string, since_us long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = G.derive_edges(pods, slices, leases, ends, spark.createDataFrame([(10,)], "snap_us long"))
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" not in plan[plan.index("Exchange"):plan.index("Union")] and len(d.collect()) == 2 + 3 + 2 + 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_steps_counted_in_rows_are_those_listed(spark):
    from telequay.operators import gate as T

    gate = T.Gate(min_future=2, lookback=2, min_forecasts=1, min_crossings=0, min_events=0)
    rnd = random.Random(3)
    samples = spark.createDataFrame([(s, 10 * i, float(rnd.randrange(20))) for s in "ab" for i in range(9)] + [("a", 30, 4.0)], "stream string, at_us long, value double")
    traces = [(f"{s}{b}", "c" if s == "a" else "d", s, b, 10 * b - 5, 12.0, "above", [5.0] * 4, [15.0] * (4 if b % 2 else 3), None if b % 2 else "no-crossing", 10, None, None) for s in "abx" for b in range(9)]
    traces = spark.createDataFrame(traces, "f_id string, class string, stream string, seq long, basis_us long, bar double, direction string, lo array<double>, hi array<double>, silence string, ttc_us long, earliest_us long, latest_us long")
    d = T.scored(traces, samples, gate, 10)
    assert d.where("place = 0").count() == 2
    listed, counted = (sorted(T.figures(d, samples, gate, h).collect()) for h in (None, 4))
    assert listed == counted and all(0 < r.inside < r.points for r in counted)
