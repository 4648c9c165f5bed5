"""The labelled run of eight ticks: a leak, throttling with pressure on its node, and a kill, under a grid of settings."""

import pytest

from telequay.operators import sweep as W
from telequay.operators import topology as G
from telequay.operators.surfaces import tick_digest
from telequay.params import MINUTE, SECOND, Params

BASE = 1_781_179_200 * SECOND
POD, NODE = "i|c|default|Pod|web-a|p1", "i|c||Node|n1|u1"
MIB = float(1 << 20)
LEAK, THROTTLE, KILL = "leak", "throttling", "kill"


def rows():
    out = []
    for i in range(8):
        for uid, metric, kind, value in ((POD, "working_set", "gauge", (110 + 4 * i) * MIB), (POD, "throttled", "counter", 10.0 * i), (POD, "periods", "counter", 15.0 * i),
                                         (NODE, "cpu_stall", "counter", 3.0 * i), (POD, "kills", "counter", 1.0 if i >= 6 else 0.0)):
            out.append((f"{uid}/{metric}", uid, metric, kind, BASE + i * 15 * SECOND, len(out), value))
    return out


GRID = [("pinned", 0.05, 1.1, 0.0, 10 * MINUTE), ("band 0.02", 0.02, 1.1, 0.0, 10 * MINUTE), ("band 0.10", 0.10, 1.1, 0.0, 10 * MINUTE), ("floor 0.25", 0.05, 1.1, 0.25, 10 * MINUTE),
        ("floor 0.5", 0.05, 1.1, 0.5, 10 * MINUTE), ("floor 0.9", 0.05, 1.1, 0.9, 10 * MINUTE), ("cascade 2m", 0.05, 1.1, 0.0, 2 * MINUTE), ("cascade 30s", 0.05, 1.1, 0.0, 30 * SECOND)]
MEMBERS = [(LEAK, "s1", "required", "working_set", "slope", "rising", "at-threshold", "anchor"), (LEAK, "s2", "required", None, None, None, None, "anchor"),
           (THROTTLE, "s3", "required", "throttle_ratio", "ratio", "crossed", None, "anchor"), (THROTTLE, "s4", "required", "cpu_stall", "level", "crossed", None, "neighbour"),
           (KILL, "s5", "required", "kills", "rate-guard", "breached", None, "anchor"), *[(KILL, f"x{i}", "required", None, None, None, None, "anchor") for i in range(7)]]
at = lambda s: BASE + s * SECOND


def replayed(spark, *, readings=None, runs=None):
    r = spark.createDataFrame(readings or rows(), "stream_id string, uid string, metric string, type string, at_us long, arrival long, value double")
    ticks = spark.createDataFrame([(i, at(15 * i + 1)) for i in range(8)], "tick_seq long, now_us long")
    level = spark.createDataFrame([(POD, "working_set", "r1", 0.95 * 128 * MIB, 0.95, "bytes", "above"), (NODE, "cpu_stall", "r2", 0.10, None, "native", "above")],
                                  "uid string, metric string, rule_id string, bar double, factor double, unit string, direction string")
    ratio = spark.createDataFrame([("throttled", "periods", "throttle_ratio", 0.25, None, "above")], "numerator string, divisor string, metric string, bar double, factor double, direction string")
    guard = spark.createDataFrame([(POD, "kills", "r3", 1.0)], "uid string, metric string, rule_id string, bar double")
    grid = spark.createDataFrame(GRID, "point_id string, band double, well_above double, floor double, cascade_us long")
    members = spark.createDataFrame(MEMBERS, "phenomenon string, signal string, role string, metric string, facet string, expect string, min_state string, on_scope string")
    events = spark.createDataFrame([("runs-on", POD, NODE, "assert", at(15 * i), i) for i in range(8)], "type string, from_key string, to_key string, op string, event_us long, seq long")
    edges = G.edge_intervals(events)
    # As of each tick: an edge is known from its first assertion on, and confirmed by the last one before the tick.
    windows = ticks.selectExpr("tick_seq", f"now_us - {10 * MINUTE} start_us", "now_us end_us")
    traversed = G.edge_traverse(edges, windows, 90 * SECOND)
    relations = spark.createDataFrame([(LEAK, KILL)], "trigger string, downstream string")
    seen = W.observations(r, ticks, level, ratio, guard, Params())
    return (*W.replay(seen, ticks, members, relations, traversed, grid, runs), grid)


def test_scores_of_the_grid(spark):
    found, cascades, grid = replayed(spark)
    labels = spark.createDataFrame([(1, LEAK, POD, at(25), at(120)), (2, THROTTLE, POD, at(10), at(120)), (3, KILL, POD, at(85), at(120))],
                                   "l_id long, phenomenon string, uid string, from_us long, to_us long")
    expected = spark.createDataFrame([(1, LEAK, KILL, at(85), at(120))], "c_id long, trigger string, downstream string, from_us long, to_us long")
    n = {r.phenomenon: r["count"] for r in found.where("point_id = 'pinned'").groupBy("phenomenon").count().collect()}
    assert n == {LEAK: 6, THROTTLE: 7, KILL: 2}
    got = {r.point_id: r for r in W.score(found, cascades, labels, expected, grid).collect()}
    want = {"pinned": (1.0, 1.0, 1), "band 0.02": (1.0, 1.0, 1), "band 0.10": (0.938, 1.0, 1), "floor 0.25": (1.0, 0.667, 0), "floor 0.5": (1.0, 0.667, 0),
            "floor 0.9": (1.0, 0.333, 0), "cascade 2m": (1.0, 1.0, 1), "cascade 30s": (1.0, 1.0, 1)}
    assert {k: (pytest.approx(r.precision, abs=5e-4), pytest.approx(r.recall, abs=5e-4), r.cascades_hit) for k, r in got.items()} == want
    assert all(r.cascades_false == 0 and r.cascades_expected == 1 for r in got.values())


def test_replay_has_the_same_digests_and_finds_a_changed_sample(spark):
    digests = lambda found: {r.tick_seq: r.digest for r in tick_digest(found.where("point_id = 'pinned'").drop("point_id"), "tick_seq").collect()}
    a, b = digests(replayed(spark)[0]), digests(replayed(spark, readings=rows()[::-1])[0])
    assert a == b and len(a) == 7
    other = [(*r[:6], r[6] - 20 * MIB) if r[2] == "working_set" and r[4] == at(60) else r for r in rows()]
    changed = digests(replayed(spark, readings=other)[0])
    assert changed.get(4) != a[4] and changed[2] == a[2]


def test_no_cascade_over_a_restart(spark):
    runs = spark.createDataFrame([(i, 0 if i < 7 else 1) for i in range(8)], "tick_seq long, run_id long")
    _, cascades, _ = replayed(spark, runs=runs)
    got = {(r.tick_seq, r.trigger_us) for r in cascades.where("point_id = 'pinned'").collect()}
    assert got == {(6, at(91)), (7, at(106))}  # at the tick after the restart only its own finding counts
