"""Cards of unexplained crossings: superseded, resolved, restarted; the stream gives the rows of the batch form."""

import pytest
from pyspark.sql import functions as F

from telequay.operators import detect as D
from telequay.streaming import live

AT = "tick_seq long, uid string, metric string"
#: Loud metrics by tick and entity, and what covers them.
LOUD = [(0, "single", "a"), (0, "single", "b"), (1, "single", "a"), (1, "single", "b"),
        (0, "union", "a"), (0, "union", "b"), (1, "union", "a"), (1, "union", "b"),
        (0, "clears", "a"), (1, "clears", "a"), (3, "clears", "a"),
        (0, "half", "a"), (0, "half", "b"), (1, "half", "b"),
        (0, "narrows", "a"), (0, "narrows", "b"), (1, "narrows", "a"), (1, "narrows", "b"), (2, "narrows", "b"),
        (2, "runs", "a"), (3, "runs", "a"), (1, "gone", "c"), (2, "gone", "c"), (0, "never", "a")]
COVERED = [(1, "single", "a", "p2"), (1, "single", "b", "p2"), (1, "single", "a", "p3"), (1, "single", "b", "p3"), (1, "single", "a", "p1"),
           (1, "union", "a", "p1"), (1, "union", "b", "p2"), (1, "half", "b", "p1"), (1, "narrows", "a", "p1"), (0, "never", "a", "p1")]
RUNS = [(0, 0), (1, 0), (2, 0), (3, 1)]
WANT = {
    ("single", 0, "a,b", "new", 0, 1, ""), ("single", 1, "a,b", "superseded", 0, 1, "p2"),  # the smallest that covers both
    ("union", 0, "a,b", "new", 0, 1, ""), ("union", 1, "a,b", "superseded", 0, 1, "p1, p2"),
    ("clears", 0, "a", "new", 0, 1, ""), ("clears", 1, "a", "aging", 0, 2, ""), ("clears", 2, "a", "resolved", 0, 2, ""), ("clears", 3, "a", "new", 3, 1, ""),
    ("half", 0, "a,b", "new", 0, 1, ""), ("half", 1, "a,b", "resolved", 0, 1, ""),  # one metric cleared
    ("narrows", 0, "a,b", "new", 0, 1, ""), ("narrows", 1, "b", "aging", 0, 2, ""), ("narrows", 2, "b", "aging", 0, 3, ""),  # its run ends: not closed
    ("runs", 2, "a", "new", 2, 1, ""), ("runs", 3, "a", "new", 3, 1, ""),  # a restart forgets
    ("gone", 1, "c", "new", 1, 1, ""), ("gone", 2, "c", "aging", 1, 2, "")}


@pytest.fixture(scope="module")
def tables(spark):
    loud, covered = spark.createDataFrame(LOUD, AT), spark.createDataFrame(COVERED, AT + ", phenomenon string")
    ticks = spark.createDataFrame([(i, (i + 1) * 15_000_000) for i in range(4)], "tick_seq long, now_us long")
    return loud, covered, D.uncovered_loud(loud, covered), ticks, spark.createDataFrame(RUNS, "tick_seq long, run_id long")


def shown(rows):
    return {(r.uid, r.tick_seq, r.signature, r.status, r.first_seen, r.occurrences, r.superseded_by) for r in rows}


def test_cards(tables):
    loud, covered, left, ticks, runs = tables
    got = D.card_aging(left, ticks, loud, covered, runs).collect()
    assert shown(got) == WANT and len(got) == len(WANT)


def test_the_stream_gives_the_same_cards_over_restarts(spark, tables):
    loud, covered, left, ticks, runs = tables
    rows = D.entity_ticks(loud, left, covered, ticks).join(runs, "tick_seq")
    numbered = runs.withColumn("idx", F.col("tick_seq") + 1)
    got = live.in_steps(rows, "tick_seq", [0, 1, 2, 3], lambda e: live.card_state(e, numbered), "append").collect()
    assert shown(got) == WANT and len(got) == len(WANT)


def test_neighbours_that_met_a_member_are_covered(spark):
    c = spark.createDataFrame([(0, "pod", "t", "above", False), (0, "node", "cpu", "above", False), (0, "other", "cpu", "above", False), (0, "far", "cpu", "above", True)],
                              "tick_seq long, uid string, metric string, state string, stale boolean")
    members = spark.createDataFrame([("slow", "s1", "required", "t", "anchor"), ("slow", "s2", "required", "cpu", "neighbour")], "phenomenon string, signal string, role string, metric string, on_scope string")
    reached = spark.createDataFrame([(0, "pod", "node", 1, 2), (0, "pod", "far", 1, 2), (0, "pod", "other", 2, 2)], "tick_seq long, key string, target string, hop int, verdict int")
    found = D.match_spanned(c, members, reached)
    got = {(r.uid, r.metric, r.phenomenon) for r in D.spanned_coverage(c, members, reached, found).collect()}
    assert got == {("pod", "t", "slow"), ("node", "cpu", "slow")}
    loud = c.where("not stale").select("tick_seq", "uid", "metric")
    assert {r.uid for r in D.uncovered_loud(loud, D.spanned_coverage(c, members, reached, found)).collect()} == {"other"}


def test_evidence_of_bindings(spark):
    from telequay.operators.surfaces import binding_qa

    sample = lambda s, uid, metric, kind, type_, values: [(s, uid, metric, kind, type_, i, i * 15_000_000, float(x)) for i, x in enumerate(values)]
    samples = spark.createDataFrame(
        [*sample("1", "u1", "mem", "Container", "gauge", [5, 6, 7]), *sample("2", "u2", "mem", "Container", "counter", [5, 6]), *sample("3", "u3", "mem", "Pod", "gauge", [5, 6]),
         *sample("4", "u4", "mem", "Container", "gauge", [5, 2e12]), *sample("5", "u5", "mem", "Container", "gauge", [5, -1]), *sample("6", "u6", "mem", "Container", "gauge", [5]),
         *sample("7a", "u7", "mem", "Container", "gauge", [5]), *sample("7b", "u7", "mem", "Container", "gauge", [5]),
         *sample("8", "u8", "x_total", "Container", "counter", [5, 4, 6, 3]), *sample("9", "u9", "x_total", "Container", "counter", [5, 4, 6]), *sample("10", "u10", "x_total", "Container", "gauge", [1, 2]),
         *sample("11", "u11", "wait_total", "Node", "counter", [1000, 1001]), *sample("12", "u12", "wait_total", "Node", "counter", [1000, 1100]),
         *sample("13", "u13", "thr_total", "Container", "counter", [10, 20]), *sample("13d", "u13", "per_total", "Container", "counter", [40, 80]),
         *sample("14", "u14", "thr_total", "Container", "counter", [10, 200]), *sample("14d", "u14", "per_total", "Container", "counter", [40, 80]),
         *sample("15", "u15", "thr_total", "Container", "counter", [10, 20]), *sample("16", "u16", "mem", "Container", "gauge", [1, 2]),
         *sample("17", "u17", "x_total", "Container", "counter", [9, 1, 0, 1, 2, 3, 4, 5, 6, 7])],  # the two decreases stand before the last eight samples
        "stream_id string, uid string, metric string, kind string, type string, arrival long, at_us long, value double")
    plain = lambda uid, metric="mem", entity="Container", unit="bytes", divisor=None, gates=None: (uid, uid, metric, entity, unit, divisor, gates)
    bindings = spark.createDataFrame(
        [*[plain(f"u{i}") for i in range(1, 8)], *[plain(f"u{i}", "x_total", unit="native") for i in (8, 9, 10, 17)], *[plain(f"u{i}", "wait_total", "Node", "ratio") for i in (11, 12)],
         *[plain(f"u{i}", "thr_total", unit="ratio", divisor="per_total") for i in (13, 14, 15)], plain("u16", gates=["g"]), plain("nobody"), plain(None)],
        "pair string, uid string, metric string, entity string, unit string, divisor string, gates array<string>")
    got = {r.pair: (r.verdict, r.test) for r in binding_qa(bindings, samples).collect()}
    assert got == {"u1": ("verified", None), "u2": ("failed", "character"), "u3": ("failed", "scope"), "u4": ("failed", "range"), "u5": ("failed", "range"), "u6": ("suspect", "thin-evidence"),
                   "u7": ("failed", "ambiguous"), "u8": ("failed", "decreases"), "u9": ("verified", None), "u10": ("failed", "character"), "u11": ("verified", None), "u12": ("failed", "rate-range"),
                   "u13": ("verified", None), "u14": ("failed", "derived-range"), "u15": ("suspect", "divisor"), "u16": ("suspect", "gate"), "u17": ("verified", None),
                   "nobody": ("suspect", "no-stream"), None: ("suspect", "no-channel")}
