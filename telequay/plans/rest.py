"""Further queries: capabilities, closure, warnings, audits, feeds, with and without splicing."""

from __future__ import annotations

from pyspark.sql import functions as F

from telequay.functions import binding as B
from telequay.operators import detect as D
from telequay.operators import binding as OB
from telequay.operators import catalogue as C
from telequay.operators import surfaces as U
from telequay.operators import topology as G
from telequay.operators.lineage import cut
from telequay.sources import tables as T

from .detection import _CARD_CTE, _CTE, _SPANS, bindings, cards, obtainable, participants, spans, _OBTAIN, _SIGNALS, _CAPS, _values
from .identity import _NEIGHBOURS, _TRAVERSED, _WINDOWS, BUDGET, windows
from .registry import query
from .surfaces import _QA, binding_qa, normalize_cadvisor
from .views import with_views


@query("""SELECT o_orderkey, kind, CASE kind WHEN 'kernel' THEN CASE WHEN k >= 19 THEN 'ok' ELSE 'out-of-scope' END WHEN 'presence-sufficient' THEN CASE WHEN p THEN 'ok' ELSE 'indeterminate' END
    WHEN 'presence-necessary' THEN CASE WHEN NOT p THEN 'out-of-scope' ELSE 'indeterminate' END WHEN 'any-log-pipeline' THEN CASE WHEN p THEN 'ok' ELSE 'out-of-scope' END
    WHEN 'kubelet' THEN CASE WHEN k >= 22 THEN 'ok' ELSE 'out-of-scope' END ELSE 'indeterminate' END AS state FROM (
    SELECT o_orderkey, (['kernel', 'presence-sufficient', 'presence-necessary', 'any-log-pipeline', 'kubelet', 'other'])[(o_orderkey % 6 + 1)::INT] AS kind, o_custkey % 30 AS k, o_custkey % 2 = 0 AS p FROM orders)""")
def capability_state(v):
    o, k = v.table("orders"), F.col("o_custkey") % 30
    kinds = F.array(*[F.lit(x) for x in ("kernel", "presence-sufficient", "presence-necessary", "any-log-pipeline", "kubelet", "other")])
    kind, p = F.element_at(kinds, (F.col("o_orderkey") % 6 + 1).cast("int")), F.col("o_custkey") % 2 == 0
    return o.select("o_orderkey", kind.alias("kind"), B.capability_state(kind, F.concat(F.lit("4."), k, F.lit(".0")), p, p, F.concat(F.lit("v1."), k, F.lit(".3"))).alias("state"))


@query("""SELECT o_orderkey, gate, CASE gate WHEN 'dockershim' THEN k >= 24 AND NOT d ELSE o_custkey % 5 = 0 END AS active FROM (SELECT o_orderkey, o_custkey, (['dockershim', 'k3s'])[(o_orderkey % 2 + 1)::INT] AS gate, o_custkey % 30 AS k, o_custkey % 3 = 0 AS d FROM orders)""")
def distro_gates(v):
    k = F.col("o_custkey")
    gate = F.when(F.col("o_orderkey") % 2 == 0, "dockershim").otherwise("k3s")
    version = F.concat(F.lit("v1."), k % 30, F.when(k % 5 == 0, "+K3S1").otherwise(".2"))
    return v.table("orders").select("o_orderkey", gate.alias("gate"), B.gate_active(gate, version, F.when(k % 3 == 0, "docker://1").otherwise("containerd://1")).alias("active"))


_AROUND = _CTE | _SPANS | {
    "all_edges": "SELECT * FROM edges UNION ALL SELECT 'selects', concat('g', from_key[2:]::INT % 60), from_key, asserted_us, confirmed_us, retracted_us FROM edges WHERE from_key[2:]::INT % 2 = 0",
    "windows": _WINDOWS, "traversed": _TRAVERSED.replace("FROM edges", "FROM all_edges"), "neighbours": _NEIGHBOURS,
    "nb": "SELECT tick_seq, key, neighbour, type, max(verdict) AS verdict FROM neighbours GROUP BY ALL",
    "begin": "SELECT tick_seq, uid, phenomenon, depth, types FROM participates JOIN spans USING (phenomenon), windows WHERE depth > 0",
    "h1": """SELECT b.*, neighbour AS target, type AS via, verdict, list_position(types, type) AS turn, concat_ws('>', uid, type, neighbour) AS path FROM begin b JOIN nb ON nb.tick_seq = b.tick_seq AND key = uid
        AND list_contains(types, type) WHERE neighbour <> uid QUALIFY row_number() OVER (PARTITION BY b.tick_seq, uid, phenomenon, neighbour ORDER BY list_position(types, type)) = 1""",
    "h2": """SELECT h.tick_seq, uid, phenomenon, neighbour AS target, type AS via, nb.verdict, concat_ws('>', path, type, neighbour) AS path FROM h1 h JOIN nb ON nb.tick_seq = h.tick_seq AND key = target AND list_contains(types, type)
        WHERE depth = 2 AND neighbour <> uid AND NOT EXISTS (SELECT 1 FROM h1 o WHERE o.tick_seq = h.tick_seq AND o.uid = h.uid AND o.phenomenon = h.phenomenon AND o.target = neighbour)
        QUALIFY row_number() OVER (PARTITION BY h.tick_seq, uid, phenomenon, neighbour ORDER BY turn, target, list_position(types, type)) = 1"""}


def around_selected(v):
    """(neighbours, gaps) along customers' edges to nations and, of every second one, from groups that select them."""
    e = v.edges()
    k = F.substring("from_key", 2, 20).cast("int")
    picks = e.where(k % 2 == 0).select(F.lit("selects").alias("type"), F.concat(F.lit("g"), k % 60).alias("from_key"), F.col("from_key").alias("to_key"), "asserted_us", "confirmed_us", "retracted_us")
    t = cut(G.edge_traverse(e.unionByName(picks), windows(v), BUDGET))
    tier = cut(participants(v)[1])
    keys = tier.select(F.col("uid").alias("key")).distinct().join(F.broadcast(windows(v).select("tick_seq")))  # a few windows
    return D.closure(tier, spans(v).drop("metric"), t, G.containment(keys, t))


@query(with_views("""SELECT tick_seq, uid, target, via, hop, arg_min(verdict, phenomenon) AS verdict, arg_min(path, phenomenon) AS path, string_agg(phenomenon, ',' ORDER BY phenomenon) AS phenomena FROM (
    SELECT tick_seq, uid, phenomenon, target, via, 1 AS hop, verdict, path FROM h1 UNION ALL SELECT tick_seq, uid, phenomenon, target, via, 2, verdict, path FROM h2) GROUP BY tick_seq, uid, target, via, hop""", "edges", **_AROUND))
def closure(v):
    return around_selected(v)[0]


@query(with_views("""SELECT tick_seq, uid, phenomenon, concat('no traversable neighbour along ', array_to_string(types, '|'), ' in window') AS reason FROM begin b
    WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.tick_seq = b.tick_seq AND key = uid AND list_contains(types, type))""", "edges", **_AROUND))
def closure_gaps(v):
    return around_selected(v)[1]


@query("""SELECT c.c_custkey::VARCHAR AS uid, o_orderstatus AS metric, CASE WHEN c.c_custkey % 4 > 0 THEN c_name END AS name, min(epoch_us(o_orderdate)) AS crosses_us, coalesce(any_value(n), 0) AS at_risk
    FROM orders JOIN customer c ON c.c_custkey = o_custkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) r ON r.k = c.c_custkey GROUP BY ALL""")
def warning_cards(v):
    c, o = v.table("customer"), v.table("orders")
    p = o.groupBy(F.col("o_custkey").cast("string").alias("uid"), F.col("o_orderstatus").alias("metric")).agg(F.unix_micros(F.min("o_orderdate").cast("timestamp")).alias("crosses_us"))
    names = c.where("c_custkey % 4 > 0").select(F.col("c_custkey").cast("string").alias("uid"), F.col("c_name").alias("name"))
    return D.warning_cards(p, names, c.select(F.col("c_nationkey").cast("string").alias("uid"), F.col("c_custkey").alias("at_risk")))


@query("""SELECT r AS resolved, d AS dropped, q AS quarantined, round(q / (r + q)::DOUBLE, 6) AS orphan_rate, n AS verified, round(c / n::DOUBLE, 6) AS accuracy FROM (
    SELECT count(*) FILTER (NOT dr AND NOT qu) AS r, count(*) FILTER (dr) AS d, count(*) FILTER (qu) AS q FROM (SELECT o_custkey % 11 > 0 AND NOT (o_custkey % 4 > 0 AND o_custkey % 5 > 0) AND NOT (o_custkey % 4 = 0 AND o_custkey % 5 = 0) AS qu,
    o_custkey % 11 > 0 AND ((o_custkey % 4 = 0 AND o_custkey % 5 = 0) OR (o_custkey % 4 > 0 AND o_custkey % 5 > 0 AND (o_custkey % 3 = 1 OR (o_custkey % 3 = 0 AND o_custkey % 7 = 0)))) AS dr FROM orders)),
    (SELECT count(*) FILTER (o_custkey % 10 > 0) AS n, count(*) FILTER (o_custkey % 10 > 2) AS c FROM orders)""")
def stream_audit(v):
    verdict = F.when(F.col("o_custkey") % 10 == 0, "vanished").when(F.col("o_custkey") % 10 <= 2, "misjoin").otherwise("correct")
    d = U.stream_audit(normalize_cadvisor(v), v.table("orders").select(verdict.alias("verdict")))
    return d.withColumns({c: F.round(c, 6) for c in ("orphan_rate", "accuracy")})


@query(with_views("""SELECT r.*, x.*, p.* FROM (SELECT count(DISTINCT rule_id) AS rules, count(*) AS pairs, count(DISTINCT rule_id) FILTER (state = 'bound') AS rules_bound FROM b) r,
    (SELECT count(*) FILTER (kind = 'config-relative' AND state = 'bound') AS config_bound, count(*) FILTER (kind = 'config-relative' AND state = 'unresolved') AS unbounded,
     count(*) FILTER (flagged AND value IS NOT NULL) AS default_bars FROM b) x,
    (SELECT count(*) FILTER (s = 'full') AS phenomena_full, count(*) FILTER (s = 'partial') AS phenomena_partial, count(*) FILTER (s = 'none') AS phenomena_none FROM (
     SELECT CASE WHEN count(*) FILTER (state = 'out-of-scope') = count(*) THEN 'none' WHEN count(*) FILTER (state = 'ok') = count(*) THEN 'full' ELSE 'partial' END AS s FROM (SELECT c.cluster_id, m.signal, coalesce(o.state, 'out-of-scope') AS state
     FROM (SELECT DISTINCT cluster_id FROM obtain) c CROSS JOIN (SELECT DISTINCT signal FROM obtain) m LEFT JOIN obtain o ON o.cluster_id = c.cluster_id AND o.signal = m.signal)
     GROUP BY cluster_id, regexp_extract(signal, '\\d+')::INT % 400)) p""", **_CTE, signals=_SIGNALS, caps=_values(_CAPS, "capability, state"), obtain=_OBTAIN))
def coverage_view(v):
    b = bindings(v)
    s = obtainable(v)
    m = s.select("signal", (F.regexp_extract("signal", r"\d+", 0).cast("int") % 400).alias("phenomenon"), F.lit("required").alias("role"))
    return U.coverage_view(OB.rule_coverage(b), OB.resolvability(b).drop("resolvability"), C.phenomenon_observability(m, s))


@query(with_views("""SELECT 0 AS priority, 'unexplained:' || signature AS signature, count(*) AS recurrence FROM cards WHERE status IN ('new', 'aging') GROUP BY signature HAVING count(*) >= 5 OR count(DISTINCT uid) >= 5
    UNION ALL SELECT 1, 'unbounded:' || metric, count(*) FROM b WHERE reason = 'unbounded' GROUP BY metric
    UNION ALL SELECT 2, concat_ws(':', 'failed', pair, test), 1 FROM qa WHERE verdict = 'failed'""", "loud", "linked", **_CARD_CTE, **_QA, **_CTE))
def intake_feeds(v):
    return U.intake_feeds(D.candidates(cards(v), 5, 5), bindings(v).where("reason = 'unbounded'"), binding_qa(v).where("verdict = 'failed'"))


@query("""SELECT 'n' || c_nationkey AS ns, c_name AS pod, container, mem_limit_bytes, cpu_limit_milli FROM (SELECT *, 'a' AS container, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 * 100 END AS mem_limit_bytes, CASE WHEN c_custkey % 2 > 0 THEN 1 END AS cpu_limit_milli FROM customer
    UNION ALL SELECT *, 'b', 7, NULL FROM customer)""")
def declared_config_tables(v):
    k = F.col("c_custkey")
    c = lambda name, m, cpu: F.struct(F.lit(name).alias("name"), m.cast("long").alias("memory"), cpu.cast("long").alias("cpu"))
    return T.declared_containers(v.table("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("ns"), F.col("c_name").alias("pod"),
                                                            F.array(c("a", k % 3 * 100, k % 2), c("b", F.lit(7), F.lit(0))).alias("containers")))
