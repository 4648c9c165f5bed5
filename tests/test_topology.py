"""Containment, relations and cascades over the topology, on streams too, by hand."""

import random

from pyspark.sql import functions as F

from telequay.operators import changes, signals
from telequay.operators import detect as D
from telequay.operators import topology as G
from telequay.params import MINUTE, SECOND
from telequay.streaming import live

POD, POD2, NODE, VOLUME = "i|c|ns|Pod|a|u1", "i|c|ns|Pod|b|u2", "i|c||Node|n|u3", "i|c|ns|Claim|v|u4"
C1, C2, LOST = "i|c|ns|Container|x|u1/x", "i|c|ns|Container|y|u1/y", "i|c|ns|Container|z|u9/z"
EDGES = [(0, "runs-on", POD, NODE, 2), (0, "runs-on", POD2, NODE, 1), (0, "mounts", POD, VOLUME, 1), (1, "runs-on", POD, NODE, 2)]


def edges(spark):
    return spark.createDataFrame(EDGES, "tick_seq long, type string, from_key string, to_key string, verdict int")


def test_containment(spark):
    asked = spark.createDataFrame([(0, x) for x in (POD, C1, LOST, NODE)], "tick_seq long, key string")
    got = {r.key: (r.anchor, r.note) for r in G.containment(asked, edges(spark)).collect()}
    assert got == {POD: (POD, None), NODE: (NODE, None), C1: (POD, None), LOST: (None, "containing pod absent from topology")}


def test_related(spark):
    pairs = [(POD, POD), (C1, C2), (C1, POD), (C1, NODE), (POD2, NODE), (POD, VOLUME), (POD, POD2), (LOST, NODE), (LOST, "i|c|ns|Container|q|u9/q")]
    got = {(r.a, r.b): r.relation for r in D.related(spark.createDataFrame([(0, *p) for p in pairs], "tick_seq long, a string, b string"), edges(spark)).collect()}
    assert got == {(POD, POD): "same-entity", (C1, C2): "same-entity", (C1, POD): "same-entity", (C1, NODE): "runs-on", (POD2, NODE): "runs-on (suspect)",
                   (POD, VOLUME): "mounts (suspect)", (LOST, "i|c|ns|Container|q|u9/q"): "same-entity"}


FINDINGS = [("r", 0, 0, NODE, "pressure"), ("r", 0, 60, POD, "slow"), ("r", 1, 120, C1, "slow"), ("r", 1, 120, POD2, "slow"), ("r", 1, 90, C2, "pressure"),
            ("r", 1, 130, C1, "pressure"), ("s", 1, 130, POD, "slow"), ("r", 1, 2000, POD, "slow")]
#: downstream's time and entity, trigger's entity and time, relation
WANT = {(60, POD, NODE, 0, "runs-on"), (120, C1, NODE, 0, "runs-on"), (120, C1, C2, 90, "same-entity")}


def found(spark):
    return spark.createDataFrame([(r, t, s * SECOND, u, p) for r, t, s, u, p in FINDINGS], "run_id string, tick_seq long, now_us long, uid string, phenomenon string")


def test_cascades_over_the_topology(spark):
    """Triggers on the node and on a container of the same pod; none from another run, later, too old, or unrelated."""
    rel = spark.createDataFrame([("pressure", "slow")], "trigger string, downstream string")
    got = D.cascade_pairs(found(spark), rel, edges(spark), 10 * MINUTE).collect()
    assert {(r.now_us // SECOND, r.uid, r.trigger_uid, r.trigger_us // SECOND, r.relation) for r in got} == WANT and len(got) == len(WANT)


def test_cascades_by_micro_batch(spark, tmp_path):
    rel = spark.createDataFrame([("pressure", "slow")], "trigger string, downstream string")
    table = found(spark)
    stream = live.file_stream(spark, live.backlog(table, "now_us", 4, "run_id"), "*.parquet", table.schema)
    folder = f"file://{tmp_path}/cascades"
    live.cascades_by_batch(stream, rel, edges(spark), 10 * MINUTE, folder)
    got = spark.read.parquet(f"{folder}/pairs/batch=*").collect()
    assert {(r.now_us // SECOND, r.uid, r.trigger_uid, r.trigger_us // SECOND, r.relation) for r in got} == WANT
    assert len(list((tmp_path / "cascades/tracker").iterdir())) >= 3


def test_closure_follows_each_phenomenons_own_edges(spark):
    pod, box, lost = "i|k|ns|Pod|web|u1", "i|k|ns|Container|app|u1/app", "i|k|ns|Container|app|u9/app"
    t = spark.createDataFrame([(1, "runs-on", pod, "node", 2), (1, "runs-on", "other", "node", 1), (1, "selects", "svc", pod, 2), (1, "selects", "svc", "other", 2),
                               (1, "runs-on", pod, "svc", 1), (1, "renews", "node", "node", 2)], "tick_seq long, type string, from_key string, to_key string, verdict int")
    tier = spark.createDataFrame([(box, "far"), (box, "near"), (box, "claims"), (box, "local"), (lost, "near"), ("node", "lease"), ("svc", "far")], "uid string, phenomenon string")
    spans = spark.createDataFrame([("far", 2, ["selects", "runs-on"]), ("near", 1, ["runs-on"]), ("claims", 1, ["mounts"]), ("local", 0, []), ("lease", 1, ["renews"])], "phenomenon string, depth int, types array<string>")
    keys = tier.select(F.lit(1).cast("long").alias("tick_seq"), F.col("uid").alias("key")).distinct()
    near, gaps = D.closure(tier, spans, t, G.containment(keys, t))
    got = {(r.uid, r.target, r.via, r.hop): (r.verdict, r.phenomena) for r in near.collect()}
    assert got == {
        (box, "node", "runs-on", 1): (2, "far,near"), (box, "svc", "selects", 1): (2, "far"), (box, "svc", "runs-on", 1): (1, "near"),
        (box, "other", "selects", 2): (2, "far"),  # met from svc before node, as selects comes first
        ("svc", pod, "selects", 1): (2, "far"), ("svc", "other", "selects", 1): (2, "far"), ("svc", "node", "runs-on", 2): (2, "far")}
    assert {(r.uid, r.phenomenon): r.reason for r in gaps.collect()} == {
        (box, "claims"): "no traversable neighbour along mounts in window", (lost, "near"): "containing pod absent from topology"}  # a self-edge is no gap


def test_selection_has_one_reason_each(spark):
    e = spark.createDataFrame([(x,) for x in "abcdef"], "uid string")
    tier = spark.createDataFrame([("a", "p"), ("a", "q")], "uid string, phenomenon string")
    b = spark.createDataFrame([("a", True), ("b", False), ("b", True), ("c", False)], "uid string, usable boolean")
    stale = spark.createDataFrame([("c",), ("d",), ("d",)], "uid string")
    got = {r.uid: (r.reason, r.phenomena) for r in D.selection_records(e, tier, b, stale).collect()}
    assert got == {"a": ("selected", 2), "b": ("no-phenomenon", 0), "c": ("no-evaluable-variable", 0), "d": ("stale", 0), "e": ("structural-entity", 0), "f": ("structural-entity", 0)}


def test_edges_meet_the_windows_they_overlap(spark):
    r = random.Random(3)
    edges = [("t", f"a{i}", "b", s := r.randrange(1000), r.choice([None, s + r.randrange(1, 300)]), s + r.randrange(50)) for i in range(200)]
    windows = [(i, 90 * i + r.randrange(40), 90 * i + 50 + r.randrange(200)) for i in range(12)] + [(12, 10, 260), (13, 300, 260 + 90)]
    want = {(w, e[1]) for e in edges for w, a, b in windows if e[3] <= b and (e[4] is None or e[4] > a)}
    e = spark.createDataFrame(edges, "type string, from_key string, to_key string, asserted_us long, retracted_us long, confirmed_us long")
    rows = G.edge_traverse(e, spark.createDataFrame(windows, "tick_seq long, start_us long, end_us long"), 20).collect()
    assert {(x.tick_seq, x.from_key) for x in rows} == want and len(rows) == len(want)


def test_the_last_n_arrivals_of_late_samples(spark):
    r = random.Random(5)
    rows = [(s, i, max(0, 10 * i - r.choice([0, 0, 0, 45, 170])), float(i)) for s in ("x", "y") for i in range(120)]
    ticks = [(k, 37 * k) for k in range(1, 30)]
    want = {(k, s, a, n) for k, now in ticks for s in ("x", "y") for n, a in enumerate(sorted((a for q, a, at, _ in rows if q == s and at <= now), reverse=True)[:7], 1)}
    d = signals.last_n_arrivals(spark.createDataFrame(rows, "stream_id string, arrival long, at_us long, value double"), spark.createDataFrame(ticks, "tick_seq long, now_us long"), 7)
    assert {(x.tick_seq, x.stream_id, x.arrival, x.back) for x in d.collect()} == want


def test_ranks_over_ranges_are_those_of_the_order(spark):
    d = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("k")).repartition(7)
    got = [(r["rank"], r.k, r.id) for r in changes.ranked(d, F.col("k").desc(), "id").collect()]
    assert sorted(got) == [(i, k, x) for i, (k, x) in enumerate(sorted(((r.k, r.id) for r in d.collect()), key=lambda r: (-r[0], r[1])), 1)]


def test_derived_edges_wait_for_their_ends(spark):
    pods = spark.createDataFrame([("a", 5, "n", ["v"]), ("a", 25, "m", ["v", "v"]), ("b", 5, None, []), ("ghost", 5, "n", None)], "pod string, event_us long, node string, claims array<string>")
    slices = spark.createDataFrame([("s", 1, 5, ["a", "b"]), ("s", 2, 5, ["b"]), ("s", 1, 15, []), ("s", 2, 25, ["a", "b", None])], "service string, slice int, event_us long, pods array<string>")
    known = spark.createDataFrame([("Pod", "a", "A", 0), ("Pod", "b", "B", 0), ("Node", "n", "N", 0), ("Node", "m", "M", 0), ("Claim", "v", "V", 12), ("Service", "s", "S", 0)], "kind string, name string, key string, since_us long")
    leases = spark.createDataFrame([("n", 7), ("n", 17), ("unknown", 8)], "node string, renewed_us long")
    out = G.derive_edges(pods, slices, leases, known, spark.createDataFrame([(10,), (20,), (30,)], "snap_us long"))
    assert sorted(map(tuple, out.collect())) == sorted([
        ("runs-on", "A", "N", 10), ("runs-on", "A", "N", 20), ("runs-on", "A", "M", 30), ("mounts", "A", "V", 20), ("mounts", "A", "V", 30),  # the claim is known from 12 on
        ("selects", "S", "A", 10), ("selects", "S", "B", 10), ("selects", "S", "B", 20), ("selects", "S", "A", 30), ("selects", "S", "B", 30),  # b moves from slice to slice
        ("node-lease", "N", "N", 7), ("node-lease", "N", "N", 17)])
    gone = {(r.type, r.to_key): r.event_us for r in G.reconcile_out(out).where("op = 'retract'").collect()}
    assert gone == {("runs-on", "N"): 30, ("selects", "A"): 20}
