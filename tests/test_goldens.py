"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from telequay.functions import binding as B
from telequay.functions import identity as I
from telequay.functions import ladder as L
from telequay.operators import detect, identity, signals, topology
from telequay.params import SECOND, Params

P = Params()
NOW = 1000 * SECOND


def samples(spark, points, kind="counter"):
    rows = [("s", "u", "m", kind, int(t * SECOND), i, float(v)) for i, (t, v) in enumerate(points)]
    return spark.createDataFrame(rows, "stream_id string, uid string, metric string, type string, at_us long, arrival long, value double")


def ticks(spark, now=NOW):
    return spark.createDataFrame([(0, now)], "tick_seq long, now_us long")


@pytest.mark.parametrize("value,bar,direction,state", [
    (94.9, 100, "above", "below"), (95, 100, "above", "at-threshold"), (100, 100, "above", "above"), (110, 100, "above", "well-above"),
    (105.1, 100, "below", "below"), (105, 100, "below", "at-threshold"), (99, 100, "below", "above"), (90, 100, "below", "well-above"),
    (float("nan"), 100, "above", "unknown"), (float("inf"), 100, "above", "unknown"), (float("nan"), 100, "below", "unknown")])
def test_ladder(spark, value, bar, direction, state):
    d = spark.createDataFrame([(float(value), float(bar), direction)], "v double, b double, d string")
    line = L.well_above_line(F.col("b"), F.lit(0.0), F.lit(1.1), F.col("d"))
    if direction == "above":
        line = F.lit(110.0)
    assert d.select(L.ladder(F.col("v"), F.col("b"), line, F.lit(0.05), F.col("d"))).first()[0] == state


def test_well_above_line_is_the_raw_limit(spark):
    d = spark.range(1).select(L.well_above_line(F.lit(95.0), F.lit(0.95), F.lit(1.1), F.lit("above")).alias("a"), L.well_above_line(F.lit(100.0), F.lit(0.0), F.lit(1.1), F.lit("below")).alias("b"))
    assert d.first().a == pytest.approx(100.0) and d.first().b == pytest.approx(100 / 1.1)


@pytest.mark.parametrize("points,delta,resets,gap,elapsed", [
    ([(940, 0), (955, 5), (970, 9), (985, 12)], 12, 0, False, 45),  # monotone
    ([(940, 10), (955, 15), (970, 2), (985, 6)], 9, 1, False, 45),  # a reset isn't summed
    ([(800, 0), (815, 50), (955, 60), (970, 62)], 2, 0, True, 15),  # what stands before a gap is discarded
    ([(800, 0), (985, 9)], 0, 0, True, 0),  # a gap leaves one sample
    ([(985, 12), (940, 0), (970, 9), (955, 5)], 12, 0, False, 45),  # arrival order doesn't matter
    ([(100, 3)], None, None, None, None)])
def test_rate(spark, points, delta, resets, gap, elapsed):
    got = signals.rate(samples(spark, points), ticks(spark), P).first()
    if delta is None:
        assert got is None
    else:
        assert (got.delta, got.resets, got.gap_broken, got.elapsed_us) == (delta, resets, gap, elapsed * SECOND)


def test_slope_after_a_gap_is_inconclusive(spark):
    got = signals.gauge_slope(samples(spark, [(800, 1), (985, 9)], "gauge"), ticks(spark), P).first()
    assert got.inconclusive and got.samples == 1 and got.per_second == 0
    got = signals.gauge_slope(samples(spark, [(955, 9), (970, 5), (985, 3)], "gauge"), ticks(spark), P).first()
    assert got.per_second == pytest.approx(-0.2) and not got.inconclusive


def test_rows_in_any_order_give_the_same_rates(spark):
    d = samples(spark, [(900 + i * 15, (i * 7) % 20) for i in range(7)])
    a = signals.rate(d, ticks(spark), P).collect()
    b = signals.rate(d.orderBy(F.rand(3)).repartition(5), ticks(spark), P).collect()
    assert a == b


def test_first_arrival_wins_a_tie(spark):
    got = signals.latest_by_event_time(samples(spark, [(985, 1), (985, 2), (970, 3)]), ticks(spark)).first()
    assert got.value == 1


def test_edges_at_the_borders_of_a_window(spark):
    e = spark.createDataFrame([("t", "a", "b", 10, 10, None), ("t", "a", "c", 11, 11, None), ("t", "a", "d", 1, 1, 5), ("t", "a", "e", 1, 1, 6), ("t", "a", "f", 1, 2, None)],
                              "type string, from_key string, to_key string, asserted_us long, confirmed_us long, retracted_us long")
    w = spark.createDataFrame([(0, 5, 10)], "tick_seq long, start_us long, end_us long")
    got = {r.to_key: r.verdict for r in topology.edge_traverse(e, w, 5).collect()}
    assert got == {"b": 2, "e": 2, "f": 1}  # asserted at the end counts, retracted at the start doesn't, a late one is suspect


def test_reassertion_opens_a_new_interval(spark):
    ev = spark.createDataFrame([("t", "a", "b", op, t, t) for op, t in (("assert", 1), ("assert", 3), ("retract", 5), ("assert", 8))],
                               "type string, from_key string, to_key string, op string, event_us long, seq long")
    all_ = topology.edge_intervals(ev, current_only=False).orderBy("asserted_us").collect()
    assert [(r.asserted_us, r.confirmed_us, r.retracted_us) for r in all_] == [(1, 3, 5), (8, 8, None)]
    assert [r.asserted_us for r in topology.edge_intervals(ev).collect()] == [8]


def test_as_of_joins_agree(spark):
    lives = spark.createDataFrame([("p", "u1", 1, 0, 50), ("p", "u2", 2, 50, None)], "name string, uid string, seq long, born_us long, died_us long")
    asked = spark.createDataFrame([(1, "p", 49, 60), (2, "p", 50, 60), (3, "q", 1, 60)], "ask_id long, name string, at_us long, now_us long")
    for d in (identity.identity_asof(asked, lives, P), identity.identity_asof_bucketed(asked, lives, P, 20)):
        assert {r.ask_id: r.uid for r in d.collect()} == {1: "u1", 2: "u2", 3: None}


def test_keys(spark):
    d = spark.range(1).select(I.mint_instance(F.lit("c"), F.lit(None), F.lit("Node"), F.lit("n"), F.lit("u")).alias("a"),
                              I.mint_instance(F.lit("c"), F.lit("x|y"), F.lit("Node"), F.lit("n"), F.lit("u")).alias("b"), I.parse_key(F.lit("i|c||Node|n|u")).alias("p")).first()
    assert d.a.key == "i|c||Node|n|u" and d.b.error == "malformed-coordinates" and d.p.uid == "u" and d.p.ns == ""


@pytest.mark.parametrize("metric,labels,node,outcome,reason,scope", [
    ("machine_cpu", {}, "n", "resolve", None, "node"), ("machine_cpu", {}, "", "quarantine", "missing-scrape-source", None),
    ("container_x", {"id": "/system"}, "n", "drop", "non-pod-cgroup", None), ("container_x", {"namespace": "a"}, "n", "quarantine", "missing-identity-labels", None),
    ("container_x", {"namespace": "a", "pod_name": "p", "container_name": "POD"}, "n", "drop", "pause-sandbox-row", None),
    ("container_x", {"namespace": "a", "pod": "p", "image": "pause"}, "n", "drop", "pause-sandbox-row", None),
    ("container_x", {"namespace": "a", "pod": "p"}, "n", "resolve", None, "pod"), ("container_x", {"namespace": "a", "pod": "p", "container": "c"}, "n", "resolve", None, "container")])
def test_container_series(spark, metric, labels, node, outcome, reason, scope):
    d = spark.createDataFrame([(metric, labels, node)], "m string, l map<string,string>, n string")
    got = d.select(I.normalize_container_metrics(F.col("m"), F.col("l"), F.col("n")).alias("r")).first().r
    assert (got.outcome, got.reason, got.scope) == (outcome, reason, scope)


def test_cards_follow_drifting_sets(spark):
    u = spark.createDataFrame([(0, "e", "a"), (0, "e", "b"), (1, "e", "b"), (2, "e", "c"), (4, "e", "c")], "tick_seq long, uid string, metric string")
    t = spark.createDataFrame([(i, i) for i in range(6)], "tick_seq long, now_us long")
    got = sorted((r.tick_seq, r.signature, r.status, r.first_seen, r.occurrences) for r in detect.card_aging(u, t).collect())
    assert got == [(0, "a,b", "new", 0, 1), (1, "b", "aging", 0, 2), (2, "b", "resolved", 0, 2), (2, "c", "new", 2, 1), (3, "c", "resolved", 2, 1), (4, "c", "new", 4, 1), (5, "c", "resolved", 4, 1)]


def test_kernel_versions(spark):
    d = spark.createDataFrame([("4.18.0",), ("4.19",), ("5.1.2-x",), ("odd",), (None,)], "k string")
    assert [r[0] for r in d.select(B.kernel_at_least(F.col("k"), 4, 19)).collect()] == ["unmet", "met", "met", "indeterminate", "indeterminate"]
