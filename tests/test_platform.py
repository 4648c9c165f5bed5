"""Roles of pods, tools, lint, eligibility, views of the topology, levels between deciles and honest forecasts, by hand."""

import pytest
from pyspark.sql import functions as F

from telequay.operators import catalogue as C
from telequay.operators import forecast as P
from telequay.operators import identity as O
from telequay.operators import surfaces as U
from telequay.operators import topology as G
from telequay.sources import tables as T
from telequay.streaming import live

OWNERS = "ns string, child_kind string, child_name string, owner_kind string, owner_name string, controller boolean"


def test_roles_of_pods(spark):
    pods = spark.createDataFrame([("a", "web-1", "n1", False), ("a", "job-1", "n1", None), ("a", "bare", "n1", False), ("a", "db-0", "n1", False), ("a", "orphan", "n1", False), ("b", "web-1", "n1", False),
                                  ("s", "apiserver-n1", "n1", False), ("s", "apiserver-n2", "n2", True), ("s", "odd", "n2", True), ("s", "etcd-", "", True), (None, "free", None, False)],
                                 "ns string, name string, node string, mirror boolean")
    owners = spark.createDataFrame([("a", "Pod", "web-1", "ReplicaSet", "web-x", True), ("a", "ReplicaSet", "web-x", "Deployment", "web", True), ("a", "Deployment", "web", "App", "shop", True),
                                    ("a", "Pod", "job-1", "Job", "j", True), ("a", "Job", "j", "CronJob", "nightly", True), ("a", "Pod", "bare", "ReplicaSet", "web-x", False),
                                    ("a", "Pod", "db-0", "StatefulSet", "db", True), ("a", "StatefulSet", "db", "Cluster", "pg", True), ("a", "Pod", "orphan", "ReplicaSet", "gone", True),
                                    ("s", "Pod", "apiserver-n1", "Node", "n1", True), (None, "Pod", "free", "Job", "once", True)], OWNERS)
    got = {(r.ns, r.name): (r.role_kind, r.role, r.bare) for r in O.pod_roles(pods, owners).collect()}
    assert got == {("a", "web-1"): ("Deployment", "Deployment/web", False), ("a", "job-1"): ("CronJob", "CronJob/nightly", False), ("a", "bare"): ("Pod", "Pod/bare", True),
                   ("a", "db-0"): ("StatefulSet", "StatefulSet/db", False), ("a", "orphan"): ("ReplicaSet", "ReplicaSet/gone", False), ("b", "web-1"): ("Pod", "Pod/web-1", True),
                   ("s", "apiserver-n1"): ("StaticPod", "StaticPod/apiserver", False), ("s", "apiserver-n2"): ("StaticPod", "StaticPod/apiserver", False),
                   ("s", "odd"): ("StaticPod", "StaticPod/odd", False), ("s", "etcd-"): ("StaticPod", "StaticPod/etcd-", False), (None, "free"): ("Job", "Job/once", False)}


def test_a_ring_of_controllers_ends(spark):
    owners = spark.createDataFrame([("a", "Pod", "p", "ReplicaSet", "x", True), ("a", "ReplicaSet", "x", "ReplicaSet", "y", True), ("a", "ReplicaSet", "y", "ReplicaSet", "x", True)], OWNERS)
    pods = spark.createDataFrame([("a", "p", "n", False)], "ns string, name string, node string, mirror boolean")
    assert O.pod_roles(pods, owners).first().role_kind == "ReplicaSet"


def test_tools(spark):
    pods = spark.createDataFrame([("Node-Exporter-7", ["Quay.io/Prom/node_exporter:1"]), ("web", None), (None, ["FELIX"])], "name string, images array<string>")
    corpus = T.workload_corpus(pods)
    assert sorted(r.entry for r in corpus.collect()) == ["felix", "node-exporter-7 quay.io/prom/node_exporter:1", "web "]
    tools = spark.createDataFrame([("kernel", "native", None), ("pprof", "undetectable", None), ("containerd", "runtime", None), ("cri-o", "runtime", None), ("calico", "needle", "calico"), ("calico", "needle", "felix"),
                                   ("web", "needle", None), ("loki", "needle", None)], "tool string, class string, needle string")
    facts = spark.createDataFrame([("ContainerD://1.7",)], "runtime string")
    got = {r.tool: r.present for r in C.detect_tools(tools, corpus, facts).collect()}
    assert got == {"kernel": True, "pprof": None, "containerd": True, "cri-o": False, "calico": True, "web": True, "loki": False}
    assert {r.tool: r.present for r in C.detect_tools(tools, corpus.limit(0)).collect()} == got | {"containerd": False, "calico": False, "web": False}


def test_lint_warns_of_organisational_edges_only(spark):
    nodes = spark.createDataFrame([("s", "Signal"), ("t", "Tool")], "id string, type string")
    edges = spark.createDataFrame([("s", "Signal", "t", "Tool", "uses"), ("s", "", "x", None, "uses"), ("s", "Tool", "t", "Tool", "owned_by_agent"), ("y", None, "t", "Signal", "owned_by_agent")],
                                  "src string, src_type string, dst string, dst_type string, type string")
    got = sorted((r.src, r.dst, r.end, r.problem, r.level) for r in C.catalogue_lint(edges, nodes).collect())
    assert got == [("s", "t", "src", "wrong-type", "warn"), ("s", "x", "dst", "missing", "error"), ("y", "t", "dst", "wrong-type", "warn"), ("y", "t", "src", "missing", "warn")]
    declared = spark.createDataFrame([("nodes_total", 2), ("edges_total", 9)], "what string, n long")
    assert [tuple(r) for r in C.declared_totals(nodes, edges, declared).collect()] == [("edges_total", 9, 4)]


def test_eligibility_by_the_first_reason(spark):
    b = [("a", "m1", "r1", "bound", 1.0, "level"), ("a", "m2", "r1", "unresolved", None, "level"), ("a", "m3", "r1", "bound", None, "level"), ("a", "m4", "r1", "bound", 1.0, "rate-of-change"),
         ("a", "m5", "r9", "bound", 1.0, "level"), ("a", "m6", "r2", "bound", 1.0, "level"), ("a", "m7", "r3", "bound", 1.0, "level"), ("a", "m8", "r4", "bound", 1.0, "level"), ("b", "m1", "r1", "bound", 1.0, "level"),
         ("b", "m2", "r0", "unresolved", None, "level"), ("b", "m2", "r1", "bound", 1.0, "level")]
    bindings = spark.createDataFrame([(*x, None) for x in b], "entity string, metric string, rule_id string, state string, bar double, kind string, container string")
    rules = spark.createDataFrame([("r0", "g", None), ("r1", "g", None), ("r2", "g", "d"), ("r3", "c", None), ("r4", "?", None)], "rule_id string, signal string, divisor string")
    shapes = spark.createDataFrame([("g", "gauge"), ("c", "counter")], "signal string, shape string")
    channels = spark.createDataFrame([("a", "u")], "entity string, stream_uid string")
    before = spark.createDataFrame([("g", ["p"])], "signal string, phenomena array<string>")
    got = {(r.entity, r.metric): (r.verdict, r.stream_uid) for r in U.forecast_eligibility(bindings, rules, shapes, channels, before).collect()}
    assert got == {("a", "m1"): ("target", "u"), ("a", "m2"): ("not-bound", None), ("a", "m3"): ("unbounded", None), ("a", "m4"): ("rate-guard-bar", None), ("a", "m5"): ("unknown-rule", None),
                   ("a", "m6"): ("derived-ratio-deferred", None), ("a", "m7"): ("counter-deferred", None), ("a", "m8"): ("non-series-signal", None), ("b", "m1"): ("no-stream-key", None),
                   ("b", "m2"): ("not-bound", None)}  # the first binding of a pair decides


def test_containers_walk_from_their_pod(spark):
    pod, box, lost = "i|k|ns|Pod|web|u1", "i|k|ns|Container|app|u1/app", "i|k|ns|Container|app|u9/app"
    t = spark.createDataFrame([(1, "runs-on", pod, "node", 1), (1, "runs-on", "other", "node", 2)], "tick_seq long, type string, from_key string, to_key string, verdict int")
    origins = spark.createDataFrame([(1, box), (1, lost), (1, "node")], "tick_seq long, key string")
    got = {(r.key, r.target): (r.hop, r.verdict) for r in G.reach_anchored(t, origins).collect()}
    assert got == {(box, "node"): (1, 1), (box, "other"): (2, 1), ("node", pod): (1, 1), ("node", "other"): (1, 2)}


@pytest.mark.parametrize("q,value", [(0.1, 10.0), (0.9, 90.0), (0.5, 50.0), (0.25, 25.0), (0.3, 30.0), (0.87, 87.0), (0.09, None), (0.95, None), (None, None)])
def test_levels_between_deciles(spark, q, value):
    d = spark.createDataFrame([([10.0 * i for i in range(1, 10)], q)], "d array<double>, q double")
    got = d.select(P.at_level(F.col("d"), F.col("q"))).first()[0]
    assert got == (None if value is None else pytest.approx(value))


def test_what_is_known_of_the_future_is_added(spark):
    s = spark.createDataFrame([("a", 1.0, 10.0), ("b", 1.0, 10.0)], "target string, sigma double, last double")
    future = spark.createDataFrame([("a", 1, 5.0)], "target string, h int, value double")
    got = {(r.target, r.h): r.value for r in P.flat_forecast(s, 2, (0.5,), future).collect()}
    assert got == {("a", 0): 10.0, ("a", 1): 15.0, ("b", 0): 10.0, ("b", 1): 10.0}


def test_flat_series_stay_flat(spark):
    d = spark.createDataFrame([(t, h, q, 100.0 + 2 * h * up + (q - 0.5)) for t, up in (("still", 1), ("grows", 3), ("free", 9)) for h in range(3) for q in (0.1, 0.5, 0.9)], "target string, h int, q double, value double")
    flat = spark.createDataFrame([("still", 100.0), ("grows", 100.0)], "target string, last double")
    assert [tuple(r) for r in live.forecast_contract(d, 3, flat).collect()] == [("grows", "not-flat")]


def test_view_of_the_topology(spark):
    uid = lambda *x: spark.createDataFrame([(i,) for i in x], "uid string")
    matched = spark.createDataFrame([("c", "q", True), ("c", "p", False), ("d", "p", True)], "uid string, phenomenon string, full boolean")
    view = U.topology_view(uid(*"abcde"), matched, uid("b"), uid("a", "c"), 4, uid("a"))
    got = {r.uid: (r.prio, r.matched, r.degraded, r.phenomena, r.loud, r.selected, r.warned, r.cut) for r in view.collect()}
    assert got == {"c": (0, True, True, "p,q", False, True, False, 1), "d": (0, True, False, "p", False, False, False, 1), "b": (1, False, False, "", True, False, False, 1), "a": (2, False, False, "", False, True, True, 1)}
    edges = spark.createDataFrame([("x", "a", "b", None, 90), ("x", "b", "c", None, 10), ("x", "c", "e", None, 90), ("x", "d", "a", 95, 90)], "type string, from_key string, to_key string, retracted_us long, confirmed_us long")
    e = U.topology_edges(view, edges, 100, 50)
    assert {(r.from_key, r.to_key): r.status for r in e.collect()} == {("a", "b"): "valid", ("b", "c"): "suspect", ("d", "a"): "retracted"}
    assert U.topology_summary(view, e).first().asDict() == {"nodes": 4, "matched": 2, "degraded": 1, "loud": 1, "selected": 2, "warned": 1, "cut": 1, "edges": 3, "valid_edges": 1, "suspect_edges": 1}
