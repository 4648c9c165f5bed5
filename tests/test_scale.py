"""Queries that failed on larger tables, on small ones of the same kind."""

import datetime
import random

from telequay import plans
from telequay.operators import detect as D
from telequay.operators import forecast as P
from telequay.operators import topology as G
from telequay.streaming import live


def test_a_stream_that_ends_at_zero_has_a_spread(spark, tmp_path):
    at = lambda n: datetime.datetime(2024, 1, 2) + datetime.timedelta(minutes=n)
    rows = [(n, at(n), 1, "click", float(n % 5)) for n in range(101)] + [(200 + n, at(n), 2, "view", 0.0) for n in range(3)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.stream_id: r for r in plans.queries()["flat"](spark, str(tmp_path)).collect()}
    assert (got["1|click"].n, got["2|view"].n, got["2|view"].spread, got["2|view"].flat) == (101, 3, 0.0, True)
    assert got["1|click"].spread > 1 and not got["1|click"].flat


def test_labels_are_met_by_substrings_and_counted_with_their_copies(spark):
    findings = [(i, p, e, t) for i, (p, e, t) in enumerate([("a", "n12", 5), ("a", "n12", 5), ("a", "n1221", 9), ("a", "", 5), ("b", "x", 50), ("c", "12", 5)])]
    labels = [(i, *x) for i, x in enumerate([("a", "12", 0, 8), ("a", "12", 0, 8), ("a", "", 9, 9), ("a", "n1221", 9, 3), ("b", "xx", 0, 99), ("a", "2", 0, 1 << 40), ("d", "", 0, 9)])]
    f = spark.createDataFrame(findings, "f_id long, phenomenon string, entity string, at_us long")
    l = spark.createDataFrame(labels, "l_id long, phenomenon string, entity_contains string, from_us long, to_us long")
    want = {(a, b) for a, p, e, t in findings for b, q, x, lo, hi in labels if p == q and lo <= t <= hi and x in e}
    assert sorted((r.f_id, r.l_id) for r in P.label_match(f, l).collect()) == sorted(want)
    got = {r.phenomenon: (r.found, r.right, r.labels, r.caught) for r in P.precision_recall(f, l).collect()}
    count = lambda rows, k, c: sum(1 for r in rows if r[1] == k and (c is None or any(r[0] == w[c] for w in want)))
    assert got == {k: (count(findings, k, None), count(findings, k, 0), count(labels, k, None), count(labels, k, 1)) for k in "abcd"}


def test_steps_of_streams_carry_what_is_held(spark):
    r = random.Random(3)
    parts = [[(f"k{r.randrange(4)}", r.randrange(10 * b, 10 * b + 10) if b else r.randrange(8), 100 * b + n) for n in range(12)] for b in range(3)]
    whole = [x for p in parts for x in p]

    def stepped(step, rows, state):
        held, out = spark.createDataFrame([], state), []
        for p in parts:
            got, held = step(rows(p), held)
            out, held = out + got.collect(), held.localCheckpoint()
        return out

    # edges: the newest interval is that of all events at once
    events = lambda p: spark.createDataFrame([("t", k, "x", "retract" if n % 3 == 0 else "assert", at, n) for k, at, n in p], "type string, from_key string, to_key string, op string, event_us long, seq long")
    newest = {}
    for x in stepped(lambda rows, held: live.edges_held(rows, held, 1 << 40), events, live.EDGE):
        newest[x.from_key] = (x.asserted_us, x.confirmed_us, x.retracted_us)
    assert newest == {x.from_key: (x.asserted_us, x.confirmed_us, x.retracted_us) for x in G.edge_intervals(events(whole)).collect()} and newest
    # lives: each birth closes the one before
    births = lambda p: spark.createDataFrame([(k, str(n), n, at, at + 3 if n % 2 else None) for k, at, n in p], "name string, uid string, seq long, born_us long, deleted_us long")
    got = sorted((x.name, x.uid, x.born_us, x.died_us) for x in stepped(live.lives_closed, births, live.LIFE))
    want = []
    for k in {k for k, _, _ in whole}:
        own = sorted((at, n) for x, at, n in whole if x == k)
        want += [(k, str(n), at, max(at, min(end, at + 3) if n % 2 else end)) for (at, n), (end, _) in zip(own, own[1:])]
    assert got == sorted(want)
    # warnings: held from batch to batch until dropped or too old
    kinds = (None, "no-crossing", "band-too-wide", "no-crossing", "flat")
    outcomes = lambda p: spark.createDataFrame([(k, "m", 100 * at + n, kinds[n % 5]) for k, at, n in p], "uid string, metric string, now_us long, silence string")
    got = sorted((x.uid, x.now_us, x.aging, x.projected_us) for x in stepped(lambda rows, held: live.debounced(rows, held, 900), outcomes, live.LAST))
    want = []
    for k in {k for k, _, _ in whole}:
        last = -1
        for now, n in sorted((100 * at + n, n) for x, at, n in whole if x == k):
            if kinds[n % 5] is None:
                last = now
                want.append((k, now, False, now))
            elif kinds[n % 5] == "flat":
                last = -1
            elif last >= 0 and now - last <= 900:
                want.append((k, now, True, last))
    assert got == sorted(want) and any(x[2] for x in got)


def shuffled(spark, run):
    """Bytes that ``run`` shuffles."""
    executors = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    written = lambda: sum(e.apply(i).totalShuffleWrite() for e in [executors()] for i in range(e.size()))
    before = written()
    run()
    return written() - before


def around_a_hub(spark):
    """(edges, leaves) of a hub with 1,500 leaves."""
    leaves = [(1, "runs-on", f"leaf-{i}", "hub", 1 + i % 2) for i in range(1500)]
    t = spark.createDataFrame(leaves, "tick_seq long, type string, from_key string, to_key string, verdict int")
    return t, spark.createDataFrame([(1, x[2]) for x in leaves], "tick_seq long, key string")


def test_two_hops_around_a_hub_are_not_shuffled(spark):
    t, origins, n = *around_a_hub(spark), []
    assert shuffled(spark, lambda: n.append(G.reach(t, origins).where("hop = 2 and length(path) > 0").count())) < 2_000_000
    assert n == [1500 * 1499]


def test_two_hops_equal_their_definition(spark):
    r = random.Random(11)
    names = ["a", "b", "b>", "b>c", "c", "d-1", "d", "e", "f", "g"] + [f"x{i}" for i in range(12)]
    edges = sorted({(tick, r.choice(["runs", "runs-on", "mounts"]), r.choice(names), r.choice(names[:8]), r.randint(1, 2)) for tick in (1, 2) for _ in range(45)})
    edges += [(3, "runs", x, y, 2) for x in ("x1", "x2", "x3") for y in ("x1", "x2", "x3")] + [(3, "runs", "x4", y, 1) for y in ("x1", "x2", "x3")]  # all of them alike
    t = spark.createDataFrame(edges, "tick_seq long, type string, from_key string, to_key string, verdict int")
    near = {(k, a, b, y, v) for k, y, f, o, v in edges for a, b in ((f, o), (o, f))}
    want = {}
    for tick in (1, 2, 3):
        for key in names:
            best = lambda walks: min(walks, key=lambda w: (-w[0], w[1].encode()))
            one = {}
            for k, a, b, y, v in near:
                if (k, a) == (tick, key) and b != key:
                    one.setdefault(b, []).append((v, f"{key}>{y}>{b}"))
            one = {b: best(w) for b, w in one.items()}
            two = {}
            for k, a, b, y, v in near:
                if k == tick and a in one and b != key and b not in one:
                    two.setdefault(b, []).append((min(v, one[a][0]), f"{one[a][1]}>{y}>{b}"))
            want |= {(tick, key, b, 1): w for b, w in one.items()} | {(tick, key, b, 2): best(w) for b, w in two.items()}
    origins = spark.createDataFrame([(tick, key) for tick in (1, 2, 3) for key in names for _ in "12"], "tick_seq long, key string")
    got = G.reach(t, origins).collect()
    assert {(x.tick_seq, x.key, x.target, x.hop): (x.verdict, x.path) for x in got} == want and len(got) == len(want)


def test_closure_around_a_hub_is_not_shuffled(spark):
    t, origins, n = *around_a_hub(spark), []
    tier = origins.selectExpr("key AS uid", "explode(array('p', 'q')) AS phenomenon")
    spans = spark.createDataFrame([("p", 2, ["runs-on"]), ("q", 2, ["mounts", "runs-on"])], "phenomenon string, depth int, types array<string>")
    near = lambda: D.closure(tier, spans, t, G.containment(origins, t))[0].where("hop = 2 and phenomena = 'p,q' and length(path) > 0")
    assert shuffled(spark, lambda: n.append(near().count())) < 2_000_000 and n == [1500 * 1499]


def test_a_forecast_cycle_goes_through_samples_once(spark):
    r = random.Random(7)
    rows = [(f"s{k}", i, r.choice([1.0, 5.0, 50.0, 50.0 + i]), 60 * i, r.random() < 0.05) for k in range(40) for i in range(r.choice([3, 20, 90]))]
    series = spark.createDataFrame(rows, "target string, idx long, value double, at_us long, point boolean")
    targets = spark.createDataFrame([(f"s{k}", 60.0 + k, "above", "gauge", 1) for k in range(41)], "target string, bar double, direction string, type string, streams int")
    settings = dict(horizon=12, quantiles=(0.1, 0.5, 0.9), cadence_us=60, min_context=4, max_explained=0.9, flat_epsilon=0.005, max_band_ratio=0.5, drop=0.4)
    got = P.forecast_cycle(targets, series, **settings)
    assert "Window" not in got._jdf.queryExecution().toString()  # one row a target is left
    listed = P.forecast_cycle(targets, series.drop("point"), series.where("point").select("target", "idx"), **settings)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, listed.collect())) and got.select("outcome").distinct().count() > 3
    cuts = {x.target: x.splice_idx for x in P.splice_context(series, P.gauge_reset(series, 0.4), series.where("point").select("target", "idx"), 4, 0.9).collect()}
    assert {x.target: x.splice_idx for x in got.collect() if x.target != "s40"} == cuts and any(cuts.values())
