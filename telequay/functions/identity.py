"""Canonical entity keys and the normalisation of metric series to entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "|"


def _bad(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "") | F.contains(x, F.lit(SEP))


def mint_instance(cluster: Column, ns: Column, kind: Column, name: Column, uid: Column) -> Column:
    """struct(key, error): ``i|cluster|ns|kind|name|uid``; ns may be empty, no other field blank, none with the separator."""
    bad = _bad(cluster) | _bad(kind) | _bad(name) | _bad(uid) | F.contains(F.coalesce(ns, F.lit("")), F.lit(SEP))
    key = F.concat_ws(SEP, F.lit("i"), cluster, F.coalesce(ns, F.lit("")), kind, name, uid)
    return F.struct(F.when(~bad, key).alias("key"), F.when(bad, F.lit("malformed-coordinates")).alias("error"))


def mint_role(cluster: Column, ns: Column, kind: Column, role: Column) -> Column:
    """struct(key, error): ``r|cluster|ns|kind|role``."""
    bad = _bad(cluster) | _bad(kind) | _bad(role) | F.contains(F.coalesce(ns, F.lit("")), F.lit(SEP))
    key = F.concat_ws(SEP, F.lit("r"), cluster, F.coalesce(ns, F.lit("")), kind, role)
    return F.struct(F.when(~bad, key).alias("key"), F.when(bad, F.lit("malformed-coordinates")).alias("error"))


def parse_key(key: Column) -> Column:
    """struct(layer, cluster, ns, kind, name, uid, error) of a key with six (i) or five (r) parts."""
    p = F.split(key, r"\|", -1)
    inst = (F.size(p) == 6) & (F.element_at(p, 1) == "i")
    role = (F.size(p) == 5) & (F.element_at(p, 1) == "r")
    part = lambda i: F.when(inst | role, F.get(p, F.lit(i)))
    return F.struct(part(0).alias("layer"), part(1).alias("cluster"), part(2).alias("ns"), part(3).alias("kind"), part(4).alias("name"),
                    F.when(inst, F.get(p, F.lit(5))).alias("uid"), F.when(~(inst | role), F.lit("malformed-key")).alias("error"))


def _label(labels: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(labels, F.lit(n)), F.lit("")) for n in names], F.lit(""))


def _outcome(outcome: str, reason: str | None, scope: str | None) -> Column:
    return F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).cast("string").alias("reason"), F.lit(scope).cast("string").alias("scope"))


def normalize_container_metrics(metric: Column, labels: Column, node: Column) -> Column:
    """struct(outcome, reason, scope) of a node agent's container series; outcome resolve, drop or quarantine.

    Rows with outcome resolve still need the pod's or node's uid at their time.
    """
    ns, pod, c = _label(labels, "namespace"), _label(labels, "pod", "pod_name"), _label(labels, "container", "container_name")
    concrete = (_label(labels, "image") != "") | (_label(labels, "name") != "")
    return (F.when(metric.startswith("machine_") & (F.coalesce(node, F.lit("")) == ""), _outcome("quarantine", "missing-scrape-source", None))
            .when(metric.startswith("machine_"), _outcome("resolve", None, "node"))
            .when((ns == "") & (pod == ""), _outcome("drop", "non-pod-cgroup", None))
            .when((ns == "") | (pod == ""), _outcome("quarantine", "missing-identity-labels", None))
            .when(c == "POD", _outcome("drop", "pause-sandbox-row", None))
            .when((c == "") & concrete, _outcome("drop", "pause-sandbox-row", None))
            .when(c == "", _outcome("resolve", None, "pod"))
            .otherwise(_outcome("resolve", None, "container")))


def normalize_state_metrics(metric: Column, labels: Column) -> Column:
    """struct(outcome, reason, scope) of a cluster-state series; the scope follows the class of the metric."""
    ns, pod, c = _label(labels, "namespace"), _label(labels, "pod"), _label(labels, "container")
    of_container = metric.startswith("kube_pod_container_") | metric.startswith("kube_pod_init_container_")
    out = (F.when(metric.startswith("kube_pod_") & ((ns == "") | (pod == "")), _outcome("quarantine", "missing-identity-labels", None))
           .when(of_container & (c == ""), _outcome("quarantine", "missing-identity-labels", None))
           .when(of_container, _outcome("resolve", None, "container"))
           .when(metric.startswith("kube_pod_"), _outcome("resolve", None, "pod"))
           .when(metric.startswith("kube_node_") & (_label(labels, "node") == ""), _outcome("quarantine", "missing-identity-labels", None))
           .when(metric.startswith("kube_node_"), _outcome("resolve", None, "node")))
    for kind in ("deployment", "statefulset", "daemonset"):
        mine = metric.startswith(f"kube_{kind}_")
        out = out.when(mine & ((ns == "") | (_label(labels, kind) == "")), _outcome("quarantine", "missing-identity-labels", None)).when(mine, _outcome("resolve", None, "role"))
    return out.otherwise(_outcome("quarantine", "unmapped-metric-class", None))


def normalize_node_metrics(node: Column) -> Column:
    """struct(outcome, reason, scope) of a node exporter's series: all identity is the scrape target."""
    return F.when(F.coalesce(node, F.lit("")) == "", _outcome("quarantine", "missing-scrape-source", None)).otherwise(_outcome("resolve", None, "node"))


def canonical_labels(labels: Column) -> Column:
    """``k=v`` pairs sorted by key, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def stream_key(family: Column, metric: Column, node: Column, labels: Column) -> Column:
    """One key for a series, whatever the order of its labels."""
    return F.concat(family, F.lit(SEP), metric, F.lit(SEP), F.coalesce(node, F.lit("")), F.lit("{"), canonical_labels(labels), F.lit("}"))


def stream_sub_id(family: Column, labels: Column) -> Column:
    """What tells several series of one node and metric apart: only node-exporter rows with labels have one."""
    return F.when((family == "node-exporter") & (F.size(labels) > 0), canonical_labels(labels)).otherwise(F.lit(""))


def pod_state(phase: Column) -> Column:
    return F.when(phase == "Running", "active").otherwise("discovered")


def node_ready(conditions: Column) -> Column:
    """Whether an array of struct(type, status) has Ready = True."""
    return F.coalesce(F.exists(conditions, lambda c: (c["type"] == "Ready") & (c["status"] == "True")), F.lit(False))


def death_time(own_us: Column, received_us: Column) -> Column:
    return F.coalesce(own_us, received_us)
