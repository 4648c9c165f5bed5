"""Queries over rules, bindings, findings and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from telequay.functions import binding as B
from telequay.operators import binding as OB
from telequay.operators import catalogue as C
from telequay.operators import detect as D
from telequay.operators import signals as S
from telequay.operators import topology as G
from telequay.operators.lineage import cut
from telequay.params import SLOW
from telequay.sources import tables as T

from .identity import _NEIGHBOURS, _TRAVERSED, _WINDOWS, BUDGET, windows
from .registry import query
from .views import FIRST_TICK, LINK_BUDGET, with_views

RULES = [("r-mem", "s-mem", "mem", "Customer", "config-relative", "limits.memory", None, 0.9, None, "above"),
         ("r-cpu", "s-cpu", "cpu", "Customer", "config-relative", "limits.cpu", "limits.cpu", 0.5, None, "above"),
         ("r-abs", "s-abs", "abs", "Customer", "absolute", None, None, None, 100.0, "above"),
         ("r-none", "s-none", "none", "Supplier", "absolute", None, None, None, None, "below"),
         ("r-gone", "s-gone", "gone", "Supplier", "rate-of-change", None, None, None, 3.0, "above")]
AVAILABILITY = [("s-gone", "out-of-scope"), ("s-abs", "indeterminate")]
MEMBERS = [("storm", "s-click", "required", "click"), ("storm", "s-error", "required", "error"), ("storm", "s-signup", "supporting", "signup"),
           ("drain", "s-purchase", "required", "purchase"), ("drain", "s-hidden", "required", None), ("spike", "s-signup", "required", "signup"),
           ("spike", "s-click", "supporting", "click")]
RELATIONS = [("drain", "storm"), ("spike", "drain"), ("storm", "spike")]


def _values(rows, names):
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names})"


_ENTITIES = """SELECT concat('c', c_custkey) AS entity, 'Customer' AS scope, concat('k', c_custkey % 2) AS container, c_mktsegment AS role,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS mem, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 50 * 10.0 END AS cpu FROM customer
    UNION ALL SELECT concat('s', s_suppkey), 'Supplier', NULL, 'suppliers', NULL, NULL FROM supplier"""
_BINDINGS = """SELECT entity, CASE WHEN gate = 'out-of-scope' THEN NULL ELSE container END AS container, role, rule_id, metric, kind,
    CASE WHEN gate = 'out-of-scope' OR (elig IS NOT NULL AND cpu IS NULL) THEN 'out-of-scope' WHEN value IS NOT NULL THEN 'bound' ELSE 'unresolved' END AS state,
    CASE WHEN gate = 'out-of-scope' THEN 'signal not observable here' WHEN elig IS NOT NULL AND cpu IS NULL THEN concat('not declared: ', elig)
         WHEN value IS NULL THEN CASE WHEN kind = 'config-relative' THEN 'unbounded' ELSE 'no-default' END END AS reason,
    CASE WHEN gate = 'out-of-scope' OR (elig IS NOT NULL AND cpu IS NULL) THEN NULL ELSE value END AS value, kind <> 'config-relative' AS flagged FROM (
    SELECT e.*, r.*, coalesce(a.state, 'ok') AS gate, CASE WHEN kind <> 'config-relative' THEN default_value WHEN path = 'limits.memory' THEN mem * factor ELSE cpu * factor END::DOUBLE AS value
    FROM entities e JOIN rules r ON r.scope = e.scope LEFT JOIN availability a ON a.signal = r.signal)"""
_CTE = {"entities": _ENTITIES, "rules": _values(RULES, "rule_id, signal, metric, scope, kind, path, elig, factor, default_value, direction"),
        "availability": _values(AVAILABILITY, "signal, state"), "b": _BINDINGS}


def bindings(v):
    c, s = v.table("customer"), v.table("supplier")
    mem, cpu = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 50 * 10.0)
    a = c.select(F.concat(F.lit("c"), "c_custkey").alias("entity"), F.lit("Customer").alias("scope"), F.concat(F.lit("k"), F.col("c_custkey") % 2).alias("container"),
                 F.col("c_mktsegment").alias("role"), F.create_map(F.lit("limits.memory"), mem.cast("double"), F.lit("limits.cpu"), cpu.cast("double")).alias("declared"))
    b = s.select(F.concat(F.lit("s"), "s_suppkey").alias("entity"), F.lit("Supplier").alias("scope"), F.lit(None).cast("string").alias("container"), F.lit("suppliers").alias("role"),
                 F.lit(None).cast("map<string,double>").alias("declared"))
    rules = v.spark.createDataFrame(RULES, "rule_id string, signal string, metric string, scope string, kind string, path string, eligibility_path string, factor double, default_value double, direction string")
    return OB.bind_rules(a.unionByName(b), rules, v.spark.createDataFrame(AVAILABILITY, "signal string, state string"))


@query(with_views("SELECT entity, container, role, rule_id, metric, state, reason, round(value, 6) AS bar FROM b", **_CTE))
def bind_rules(v):
    return bindings(v).select("entity", "container", "role", "rule_id", "metric", "state", "reason", F.round("bar.value", 6).alias("bar"))


@query(with_views("""SELECT rule_id, count(*) AS pairs, count(*) FILTER (state = 'bound' AND NOT flagged) AS config_bound, count(*) FILTER (state = 'bound' AND flagged) AS default_bound,
    count(*) FILTER (reason = 'unbounded') AS unbounded, count(*) FILTER (state = 'out-of-scope') AS out_of_scope, count(*) FILTER (reason = 'no-default') AS unresolved FROM b GROUP BY 1""", **_CTE))
def rule_coverage(v):
    return OB.rule_coverage(bindings(v))


@query(with_views("""SELECT a AS config_bound, u AS unbounded, d AS default_bars, a / (a + u)::DOUBLE AS resolvability FROM (SELECT count(*) FILTER (kind = 'config-relative' AND state = 'bound') AS a,
    count(*) FILTER (kind = 'config-relative' AND state = 'unresolved') AS u, count(*) FILTER (flagged AND value IS NOT NULL) AS d FROM b)""", **_CTE))
def resolvability(v):
    return OB.resolvability(bindings(v))


@query(with_views("""SELECT role, rule_id, container, count(DISTINCT entity) AS members, count(*) FILTER (state = 'bound') AS bound, count(*) FILTER (reason = 'unbounded') AS unbounded
    FROM b WHERE state <> 'out-of-scope' GROUP BY ALL""", **_CTE))
def role_rollup(v):
    return OB.role_rollup(bindings(v))


@query(with_views("""SELECT compile_seq, sum(n) OVER (ORDER BY compile_seq) AS epoch FROM (SELECT compile_seq, coalesce((h IS DISTINCT FROM lag(h) OVER (ORDER BY compile_seq))::INT, 1) AS n FROM (
    SELECT o_orderkey // 10 AS compile_seq, string_agg(concat(k, '=', val), ';' ORDER BY k, val) AS h FROM (SELECT o_orderkey, o_orderkey % 2 AS k, o_orderkey // 40 AS val FROM orders) GROUP BY 1))"""))
def bars_epochs(v):
    o = v.table("orders").select(F.floor(F.col("o_orderkey") / 10).alias("compile_seq"), (F.col("o_orderkey") % 2).cast("string").alias("key"), F.floor(F.col("o_orderkey") / 40).alias("value"))
    return OB.bars_epochs(o.select("compile_seq").distinct(), o)


_EV = {"members": _values(MEMBERS, "phenomenon, signal, role, metric"),
       "ev": """SELECT e.tick_seq, e.uid, m.phenomenon, m.signal, m.role, m.metric, coalesce(NOT c.stale, false) AS fresh, coalesce(NOT c.stale AND c.state IN ('above', 'well-above'), false) AS met
       FROM (SELECT DISTINCT tick_seq, uid FROM components) e CROSS JOIN members m LEFT JOIN
       (SELECT * FROM components QUALIFY count(*) OVER (PARTITION BY tick_seq, uid, metric) = 1) c ON c.tick_seq = e.tick_seq AND c.uid = e.uid AND c.metric = m.metric""",
       "found": """SELECT tick_seq, uid, phenomenon, met / n::DOUBLE AS completeness, unseen = 0 AS "full", supporting FROM (
       SELECT tick_seq, uid, phenomenon, count(*) FILTER (role = 'required') AS n, count(*) FILTER (role = 'required' AND met) AS met,
       count(*) FILTER (role = 'required' AND fresh AND NOT met) AS refuted, count(*) FILTER (role = 'required' AND NOT fresh) AS unseen, count(*) FILTER (role <> 'required' AND met) AS supporting
       FROM ev GROUP BY ALL) WHERE refuted = 0 AND met > 0"""}


def components(v):
    return S.threshold_components(v.readings(), v.ticks(), v.bindings(), SLOW)


def members(v):
    return v.spark.createDataFrame(MEMBERS, "phenomenon string, signal string, role string, metric string")


def findings(v, c=None):
    """Findings of components (``c``: those of a caller that has them already)."""
    return D.match_local(D.evidence(cut(components(v)) if c is None else c, members(v)))  # evidence reads components twice


def loud(v, c=None):
    return S.loud_states(components(v) if c is None else c, S.rate_guards(v.readings(), v.ticks(), v.bindings(), SLOW))


@query(with_views('SELECT tick_seq, uid, phenomenon, round(completeness, 6) AS completeness, "full", supporting FROM found', "components", **_EV))
def match_local(v):
    return findings(v).withColumn("completeness", F.round("completeness", 6))


SCOPES = {"s-error": "neighbour", "s-signup": "two-hop"}
_SCOPE = "CASE signal WHEN 's-error' THEN 'neighbour' WHEN 's-signup' THEN 'two-hop' ELSE 'anchor' END"


@query(with_views(f"""SELECT type, CASE WHEN retracted_us <= {FIRST_TICK} THEN 'retracted' WHEN {FIRST_TICK} - confirmed_us > {LINK_BUDGET} THEN 'suspect' ELSE 'valid' END AS status, count(*) AS n FROM links
    WHERE asserted_us <= {FIRST_TICK} GROUP BY ALL""", "links"))
def edge_health(v):
    return G.edge_health(v.links(), FIRST_TICK, LINK_BUDGET)


def linked(v):
    return G.edge_traverse(v.links(), v.tick_windows(), LINK_BUDGET)


_SPANNED = """SELECT tick_seq, uid, phenomenon, met / n::DOUBLE AS completeness, unseen = 0 AS "full", suspect > 0 AS suspect FROM (
    SELECT tick_seq, uid, phenomenon, count(*) FILTER (role = 'required') AS n, count(*) FILTER (role = 'required' AND met) AS met,
    count(*) FILTER (role = 'required' AND fresh AND NOT met) AS refuted, count(*) FILTER (role = 'required' AND NOT fresh) AS unseen,
    count(*) FILTER (role = 'required' AND met AND anchor) AS on_anchor, count(*) FILTER (met AND verdict = 1) AS suspect FROM (
    SELECT tick_seq, uid, phenomenon, signal, role, met, fresh, 2 AS verdict, true AS anchor FROM scoped WHERE on_scope = 'anchor'
    UNION ALL SELECT s.tick_seq, s.uid, s.phenomenon, s.signal, s.role, coalesce(bool_or(x.met), false), coalesce(bool_or(x.fresh), false), max(r.verdict) FILTER (x.met), false
    FROM scoped s LEFT JOIN reached r ON r.tick_seq = s.tick_seq AND r.uid = s.uid AND r.hop = CASE s.on_scope WHEN 'neighbour' THEN 1 ELSE 2 END
    LEFT JOIN scoped x ON x.tick_seq = s.tick_seq AND x.uid = r.target AND x.phenomenon = s.phenomenon AND x.signal = s.signal AND x.role = s.role
    WHERE s.on_scope <> 'anchor' GROUP BY ALL) GROUP BY ALL) WHERE refuted = 0 AND on_anchor > 0"""
_SPAN = {
    "scoped": f"SELECT *, {_SCOPE} AS on_scope FROM ev",
    "step": "SELECT tick_seq, from_key AS uid, to_key AS target, verdict FROM linked WHERE type = 'runs-on' UNION SELECT tick_seq, to_key, from_key, verdict FROM linked WHERE type = 'runs-on'",
    "one": "SELECT tick_seq, uid, target, max(verdict) AS verdict FROM step WHERE uid IN (SELECT uid FROM components) GROUP BY ALL",
    "reached": """SELECT tick_seq, uid, target, verdict, 1 AS hop FROM one UNION ALL SELECT o.tick_seq, o.uid, s.target, max(least(o.verdict, s.verdict)), 2 FROM one o JOIN step s ON s.tick_seq = o.tick_seq AND s.uid = o.target
    WHERE s.target <> o.uid AND NOT EXISTS (SELECT 1 FROM one x WHERE x.tick_seq = o.tick_seq AND x.uid = o.uid AND x.target = s.target) GROUP BY ALL"""}


def scoped_members(v):
    scope = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SCOPES.items() for x in kv]), F.col("signal")), F.lit("anchor"))
    return members(v).withColumn("on_scope", scope)


def linked_pairs(v):
    """Pairs along runs-on edges: several steps read them."""
    return cut(G.paired(linked(v).where("type = 'runs-on'"), ("runs-on",)))


@query(with_views('SELECT tick_seq, uid, phenomenon, round(completeness, 6) AS completeness, "full", suspect FROM sfound', "components", "linked", **_EV, **_SPAN, sfound=_SPANNED))
def match_spanned(v):
    return D.match_around(cut(components(v)), scoped_members(v), linked_pairs(v)).withColumn("completeness", F.round("completeness", 6))


_REL = _values(RELATIONS, '"trigger", downstream')


@query(with_views(f"""SELECT 0 AS run_id, p.tick_seq, p.now_us, p.uid, p.downstream, p."trigger", p.trigger_uid, p.trigger_us, CASE WHEN p.uid = p.trigger_uid THEN 'same-entity' ELSE e.how END AS relation FROM (
    SELECT d.tick_seq, d.now_us, d.uid, r.downstream, r."trigger", t.uid AS trigger_uid, max(t.now_us) AS trigger_us FROM timed d JOIN rel r ON r.downstream = d.phenomenon
    JOIN timed t ON t.phenomenon = r."trigger" AND t.now_us <= d.now_us AND t.now_us >= d.now_us - {SLOW.cascade_us} GROUP BY ALL) p
    LEFT JOIN (SELECT tick_seq, lo, hi, arg_min(CASE WHEN verdict = 1 THEN concat(type, ' (suspect)') ELSE type END, p * 10 - verdict) AS how FROM (
    SELECT tick_seq, least(from_key, to_key) AS lo, greatest(from_key, to_key) AS hi, type, verdict, list_position(['runs-on', 'mounts', 'selects'], type) AS p FROM linked) GROUP BY ALL) e
    ON e.tick_seq = p.tick_seq AND e.lo = least(p.uid, p.trigger_uid) AND e.hi = greatest(p.uid, p.trigger_uid) WHERE p.uid = p.trigger_uid OR e.how IS NOT NULL""",
    "components", "linked", **_EV, rel=_REL, timed="SELECT f.*, now_us FROM found f JOIN ticks USING (tick_seq)"))
def cascade_pairs(v):
    f = cut(findings(v).join(v.ticks(), "tick_seq").withColumn("run_id", F.lit(0)))
    links = G.edges_among(v.links(), f.select(F.col("uid").alias("key")))  # a cascade relates findings, so both ends have some
    return D.cascade_pairs(f, v.spark.createDataFrame(RELATIONS, "trigger string, downstream string"), cut(G.edge_traverse(links, v.tick_windows(), LINK_BUDGET)), SLOW.cascade_us)


_CONTAINERS = "SELECT DISTINCT t.tick_seq, CASE l_linenumber WHEN 1 THEN o_custkey::VARCHAR ELSE concat('i|k|ns|Container|c|', o_custkey, '/', l_linenumber) END AS key FROM orders JOIN lineitem ON o_orderkey = l_orderkey, ticks t"


def containers(v):
    li = v.table("orders").join(v.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    key = F.when(F.col("l_linenumber") == 1, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit("i|k|ns|Container|c|"), "o_custkey", F.lit("/"), "l_linenumber"))
    return li.select(key.alias("key")).distinct().join(F.broadcast(v.ticks().select("tick_seq")))  # a few ticks


@query(with_views("""SELECT tick_seq, key, CASE WHEN pod IS NULL THEN key WHEN known THEN pod END AS anchor, CASE WHEN pod IS NOT NULL AND NOT known THEN 'containing pod absent from topology' END AS note FROM (
    SELECT c.*, CASE WHEN contains(key, '/') THEN split_part(split_part(key, '|', 6), '/', 1) END AS pod, p.from_key IS NOT NULL AS known FROM containers c LEFT JOIN
    (SELECT DISTINCT tick_seq, from_key FROM linked WHERE type = 'runs-on') p ON p.tick_seq = c.tick_seq AND p.from_key = split_part(split_part(key, '|', 6), '/', 1))""", "linked", containers=_CONTAINERS))
def containment(v):
    return G.containment(containers(v), linked(v))


_PAIRS = "SELECT tick_seq, key AS a, CASE WHEN key LIKE '%1' THEN key WHEN key LIKE '%2' THEN 'x' ELSE neighbour END AS b FROM neighbours"


@query(with_views("""SELECT DISTINCT p.tick_seq, a, b, CASE WHEN a = b THEN 'same-entity' WHEN e.verdict = 1 THEN concat(e.type, ' (suspect)') ELSE e.type END AS relation FROM (SELECT DISTINCT * FROM pairs) p
    LEFT JOIN traversed e ON e.tick_seq = p.tick_seq AND least(e.from_key, e.to_key) = least(a, b) AND greatest(e.from_key, e.to_key) = greatest(a, b) WHERE a = b OR e.type IS NOT NULL""",
    "edges", windows=_WINDOWS, traversed=_TRAVERSED, neighbours=_NEIGHBOURS, pairs=_PAIRS))
def related(v):
    t = G.edge_traverse(v.edges(), windows(v), BUDGET)
    b = F.when(F.col("key").like("%1"), F.col("key")).when(F.col("key").like("%2"), "x").otherwise(F.col("neighbour"))
    return D.related(G.neighbours(t).select("tick_seq", F.col("key").alias("a"), b.alias("b")).distinct(), t)


_TIER = """SELECT DISTINCT b.uid, m.phenomenon FROM (SELECT DISTINCT uid, metric FROM bindings) b JOIN members m ON m.signal = concat('s-', b.metric) OR m.metric = b.metric"""


def tiers(v):
    b = v.bindings().select("uid", F.concat(F.lit("s-"), "metric").alias("signal"), "metric")
    return D.tier_a(b, members(v))


@query(with_views("SELECT * FROM tier", "bindings", members=_EV["members"], tier=_TIER))
def tier_a(v):
    return tiers(v)


_RADIUS = {
    "rel": _REL, "tier": _TIER,
    # the entity itself, and what one edge of a known type relates it to, by the first type
    "near": """SELECT tick_seq, uid AS a, uid AS b, 'same-entity' AS relation FROM (SELECT DISTINCT tick_seq, uid FROM found) UNION ALL SELECT tick_seq, a, b, arg_min(CASE WHEN verdict = 1 THEN concat(type, ' (suspect)') ELSE type END, p * 10 - verdict) FROM (
        SELECT f.tick_seq, f.uid AS a, CASE WHEN from_key = f.uid THEN to_key ELSE from_key END AS b, type, verdict, list_position(['runs-on', 'mounts', 'selects'], type) AS p
        FROM (SELECT DISTINCT tick_seq, uid FROM found) f JOIN linked l ON l.tick_seq = f.tick_seq AND (l.from_key = f.uid OR l.to_key = f.uid)) WHERE a <> b GROUP BY ALL""",
    "radius": """SELECT DISTINCT f.tick_seq, f.uid, r."trigger", r.downstream, n.b AS at_risk, n.relation FROM found f JOIN rel r ON r."trigger" = f.phenomenon JOIN near n ON n.tick_seq = f.tick_seq AND n.a = f.uid
        JOIN tier t ON t.uid = n.b AND t.phenomenon = r.downstream""",
    "risky": """SELECT f.*, (SELECT count(DISTINCT at_risk) FROM radius r WHERE r.tick_seq = f.tick_seq AND r.uid = f.uid AND r."trigger" = f.phenomenon) AS at_risk FROM found f"""}


def risk_inputs(v):
    """Findings, and what their blast radius is told from: relations, tiers, edges, windows and the budget of an edge."""
    return cut(findings(v)), v.spark.createDataFrame(RELATIONS, "trigger string, downstream string"), tiers(v), v.links(), v.tick_windows(), LINK_BUDGET


@query(with_views("SELECT * FROM radius", "components", "bindings", "linked", **_EV, **_RADIUS))
def blast_radius(v):
    return D.blast_radius_over(*risk_inputs(v))


_CARD_CTE = _EV | _SPAN | {
    "sfound": _SPANNED,
    # what findings consumed: on the anchor, and on every reached entity that met the member
    "covered": """SELECT DISTINCT s.tick_seq, s.uid, s.metric, s.phenomenon FROM scoped s JOIN sfound f ON f.tick_seq = s.tick_seq AND f.uid = s.uid AND f.phenomenon = s.phenomenon WHERE s.met AND on_scope = 'anchor'
        UNION SELECT x.tick_seq, x.uid, x.metric, x.phenomenon FROM scoped s JOIN sfound f ON f.tick_seq = s.tick_seq AND f.uid = s.uid AND f.phenomenon = s.phenomenon
        JOIN reached r ON r.tick_seq = s.tick_seq AND r.uid = s.uid AND r.hop = CASE s.on_scope WHEN 'neighbour' THEN 1 ELSE 2 END
        JOIN scoped x ON x.tick_seq = s.tick_seq AND x.uid = r.target AND x.phenomenon = s.phenomenon AND x.signal = s.signal AND x.role = s.role WHERE s.on_scope <> 'anchor' AND x.met""",
    "unc": "SELECT DISTINCT l.tick_seq, l.uid, l.metric FROM loud l ANTI JOIN covered c ON c.tick_seq = l.tick_seq AND c.uid = l.uid AND c.metric = l.metric"}


def loud_and_covered(v):
    """(loud, covered, uncovered): loud states, the metrics that findings around them consumed, and the rest."""
    c, m = cut(components(v)), scoped_members(v)  # the evidence and the loud states share one pass over the readings
    pairs = linked_pairs(v)
    covered = cut(D.coverage_around(c, m, pairs, cut(D.match_around(c, m, pairs))))
    loud = cut(S.loud_states(c, S.rate_guards(v.readings(), v.ticks(), v.bindings(), SLOW)))
    return loud, covered, D.uncovered_loud(loud, covered)


def cards(v):
    loud, covered, left = loud_and_covered(v)
    return D.card_aging(left, v.ticks(), loud, covered)


@query(with_views("SELECT * FROM unc", "loud", "linked", **_CARD_CTE))
def uncovered_loud(v):
    return loud_and_covered(v)[2]


_SETS = "SELECT tick_seq, uid, list_sort(list(DISTINCT metric)) AS ms FROM unc GROUP BY ALL"
_ISL = """SELECT *, min(tick_seq) OVER (PARTITION BY uid, island) AS fs, row_number() OVER (PARTITION BY uid, island ORDER BY tick_seq) AS occ,
    row_number() OVER (PARTITION BY uid, island ORDER BY tick_seq DESC) = 1 AS last FROM (SELECT *, sum(starts) OVER (PARTITION BY uid ORDER BY tick_seq) AS island FROM (
    SELECT tick_seq, uid, ms, array_to_string(ms, ',') AS sig, CASE WHEN lag(tick_seq) OVER w = tick_seq - 1 AND list_has_any(ms, lag(ms) OVER w) THEN 0 ELSE 1 END AS starts
    FROM sets WINDOW w AS (PARTITION BY uid ORDER BY tick_seq)))"""
# a closed card is superseded when the entity is still loud on all its metrics, by the one phenomenon that has them all or by those that have some
_CLOSED = """SELECT i.tick_seq + 1 AS tick_seq, i.uid, sig, fs, occ, list_has_all(coalesce(l.ms, []), i.ms) AS still,
    (SELECT min(phenomenon) FROM (SELECT phenomenon FROM covered c WHERE c.tick_seq = i.tick_seq + 1 AND c.uid = i.uid AND list_contains(i.ms, c.metric) GROUP BY phenomenon HAVING count(DISTINCT metric) = len(i.ms))) AS whole,
    (SELECT string_agg(DISTINCT phenomenon, ', ' ORDER BY phenomenon) FROM covered c WHERE c.tick_seq = i.tick_seq + 1 AND c.uid = i.uid AND list_contains(i.ms, c.metric)) AS parts
    FROM isl i LEFT JOIN (SELECT tick_seq, uid, list(DISTINCT metric) AS ms FROM loud GROUP BY ALL) l ON l.tick_seq = i.tick_seq + 1 AND l.uid = i.uid WHERE i.last AND i.tick_seq + 1 IN (SELECT tick_seq FROM ticks)"""
_CARDS = """SELECT tick_seq, uid, sig AS signature, CASE WHEN occ = 1 THEN 'new' ELSE 'aging' END AS status, fs AS first_seen, occ AS occurrences, '' AS superseded_by FROM isl
    UNION ALL SELECT tick_seq, uid, sig, CASE WHEN still THEN 'superseded' ELSE 'resolved' END, fs, occ, CASE WHEN still THEN coalesce(whole, parts, '') ELSE '' END FROM closed"""
_CARD_CTE = _CARD_CTE | {"sets": _SETS, "isl": _ISL, "closed": _CLOSED, "cards": _CARDS}


@query(with_views("SELECT * FROM cards", "loud", "linked", **_CARD_CTE))
def card_aging(v):
    return cards(v)


@query(with_views("""SELECT signature, count(*) AS windows, count(DISTINCT uid) AS entities, min(tick_seq) AS first_seen, max(tick_seq) AS last_seen FROM cards WHERE status IN ('new', 'aging')
    GROUP BY 1 HAVING count(*) >= 20 OR count(DISTINCT uid) >= 30""", "loud", "linked", **_CARD_CTE))
def candidates(v):
    return D.candidates(cards(v), 20, 30)


@query(with_views("""SELECT card_id, coalesce(array_to_string(CASE WHEN w IS NOT NULL THEN [w] ELSE ps END, ','), '') AS phenomena FROM (SELECT c.card_id, h.w, h.ps FROM (SELECT concat(tick_seq, '-', uid) AS card_id FROM unc GROUP BY ALL) c
    LEFT JOIN (SELECT card_id, min(phenomenon) FILTER (n = size) AS w, list_sort(list(DISTINCT phenomenon)) AS ps FROM (
    SELECT concat(u.tick_seq, '-', u.uid) AS card_id, phenomenon, count(DISTINCT u.metric) AS n, any_value(size) AS size FROM unc u JOIN (SELECT DISTINCT phenomenon, metric FROM members WHERE metric IS NOT NULL) m
    ON m.metric = u.metric JOIN (SELECT tick_seq, uid, count(DISTINCT metric) AS size FROM unc GROUP BY ALL) s ON s.tick_seq = u.tick_seq AND s.uid = u.uid GROUP BY 1, 2) GROUP BY 1) h ON h.card_id = c.card_id)""",
    "loud", "linked", **_CARD_CTE))
def covering_phenomena(v):
    cards = loud_and_covered(v)[2].groupBy(F.concat_ws("-", F.col("tick_seq").cast("string"), "uid").alias("card_id")).agg(F.array_sort(F.collect_set("metric")).alias("metrics"))
    return D.covering_phenomena(cards, members(v)).withColumn("phenomena", F.concat_ws(",", "phenomena"))


#: Phenomena of the selection: name, metric of a member, depth and edge types of the span.
SPANS = [("p-mem", "mem", 1, "runs-on"), ("p-cpu", "cpu", 2, "selects,runs-on"), ("p-claims", "mem", 1, "mounts"), ("p-local", "mem", 0, "")]
_SPANS = {"spans": f"SELECT * REPLACE (string_split(types, ',') AS types) FROM ({_values(SPANS, 'phenomenon, metric, depth, types')})",
          "participates": "SELECT DISTINCT entity AS uid, phenomenon FROM b JOIN spans s ON s.metric = b.metric WHERE b.state = 'bound'"}


def spans(v):
    return v.spark.createDataFrame(SPANS, "phenomenon string, metric string, depth int, types string").withColumn("types", F.split("types", ","))


def participants(v):
    """(bindings, which phenomena entities take part in)."""
    b = bindings(v).select(F.col("entity").alias("uid"), "metric", F.concat(F.lit("s-"), "metric").alias("signal"), (F.col("state") == "bound").alias("usable"))
    return b, D.tier_a(b.where("usable"), spans(v).select("phenomenon", "metric", F.lit("none").alias("signal")))


@query(with_views("""SELECT e.uid, CASE WHEN n IS NOT NULL THEN 'selected' WHEN bound > 0 THEN 'no-phenomenon' WHEN bound = 0 THEN 'no-evaluable-variable' WHEN late THEN 'stale' ELSE 'structural-entity' END AS reason, coalesce(n, 0) AS phenomena
    FROM (SELECT entity AS uid, false AS late FROM entities UNION ALL SELECT concat('n', n_nationkey), n_regionkey % 2 = 0 FROM nation) e
    LEFT JOIN (SELECT entity, count(*) FILTER (state = 'bound') AS bound FROM b GROUP BY 1) x ON x.entity = e.uid LEFT JOIN (SELECT uid, count(*) AS n FROM participates GROUP BY 1) t ON t.uid = e.uid""", **_CTE, **_SPANS))
def selection_records(v):
    n = v.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("uid"), "n_regionkey")
    e = v.table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("uid")).unionByName(v.table("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("uid")))
    b, tier = participants(v)
    return D.selection_records(e.unionByName(n.select("uid")), tier, b, n.where("n_regionkey % 2 = 0"))


@query(with_views("""SELECT uid, metric, precursor, CASE WHEN rank <= 50 THEN rank END AS rank, rank <= 50 AS budgeted FROM (SELECT *, row_number() OVER (ORDER BY precursor DESC, uid, metric) AS rank FROM
    (SELECT uid, metric, uid::INT % 9 = 0 AND metric = 'error' AS precursor FROM bindings))""", "bindings"))
def budget_top_k(v):
    t = v.bindings().select("uid", "metric", ((F.col("uid").cast("int") % 9 == 0) & (F.col("metric") == "error")).alias("precursor"))
    return D.budget_top_k(t, 50)


TOOLS = [("eng", "needle", "small"), ("agent", "native", None), ("exporter", "undetectable", None), ("missing", "needle", "zzz"), ("ring", "needle", None), ("plated", "needle", "nowhere"), ("plated", "needle", "plated brass"),
         ("Brand#1", "runtime", None), ("cri-o", "runtime", None)]
_CORPUS = "SELECT lower(concat_ws(' ', p_name, p_type, p_brand)) AS entry FROM part"


@query(with_views("""SELECT DISTINCT t.tool, CASE class WHEN 'native' THEN true WHEN 'runtime' THEN starts_with((SELECT lower(arg_min(p_brand, p_partkey)) FROM part), lower(tool))
    WHEN 'needle' THEN EXISTS (SELECT 1 FROM corpus, tools o WHERE o.tool = t.tool AND contains(entry, coalesce(o.needle, o.tool))) END AS present FROM tools t""",
                  tools=_values(TOOLS, "tool, class, needle"), corpus=_CORPUS))
def detect_tools(v):
    p = v.table("part")
    facts = T.platform_facts(p.select(F.col("p_partkey").alias("name"), F.col("p_type").alias("kernel"), F.col("p_brand").alias("runtime")))
    return C.detect_tools(v.spark.createDataFrame(TOOLS, "tool string, class string, needle string"), T.workload_corpus(p.select(F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("images"))), facts)


PATTERNS = [("g1", "economy-all", 0, "^ECONOMY"), ("g1", "promo", 1, "^PROMO"), ("g2", "any-o", 0, "MO$"), ("g3", "std", 0, "STANDARD"), ("g3", "std2", 1, "^STAND")]


@query(with_views("""SELECT n.name, CASE WHEN g IS NULL THEN 'outside' WHEN g = 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome, CASE WHEN g = 1 THEN c END AS canonical, CASE WHEN g = 1 THEN va END AS variant
    FROM (SELECT DISTINCT p_type AS name FROM part) n LEFT JOIN (SELECT name, count(*) AS g, min(c) AS c, min(va) AS va FROM (SELECT name, grp, arg_min(canonical, variant) AS c, min(variant) AS va
    FROM (SELECT DISTINCT p_type AS name FROM part) JOIN pat ON regexp_matches(name, pattern) GROUP BY ALL) GROUP BY name) h ON h.name = n.name""", pat=_values(PATTERNS, "grp, canonical, variant, pattern")))
def equivalence_resolve(v):
    return C.resolve_equivalents(v.table("part").select(F.col("p_type").alias("name")).distinct(), v.spark.createDataFrame(PATTERNS, "grp string, canonical string, variant long, pattern string"))


_PRESENCE = [("t0", True), ("t1", False), ("t2", None), ("t3", False)]
_CAPS = [("k0", "ok"), ("k1", "indeterminate"), ("k2", "out-of-scope")]
_SIGNALS = """SELECT concat('cl', p_partkey % 3) AS cluster_id, concat('s', p_partkey) AS signal, concat('k', p_partkey % 4) AS capability,
    CASE WHEN p_size % 5 = 0 THEN []::VARCHAR[] ELSE [concat('t', p_size % 4), concat('t', (p_size + p_partkey) % 4)] END AS tools FROM part"""
_OBTAIN = """SELECT cluster_id, signal, CASE WHEN t = 'out-of-scope' OR cap = 'out-of-scope' THEN 'out-of-scope' WHEN t = 'indeterminate' OR cap = 'indeterminate' THEN 'indeterminate' ELSE 'ok' END AS state FROM (
    SELECT s.cluster_id, s.signal, c.state AS cap, CASE WHEN len(tools) = 0 OR list_contains(tools, 't0') THEN 'ok' WHEN list_contains(tools, 't2') THEN 'indeterminate'
    ELSE 'out-of-scope' END AS t FROM signals s LEFT JOIN caps c ON c.capability = s.capability)"""


def obtainable(v):
    p = v.table("part")
    t = lambda c: F.concat(F.lit("t"), (c % 4).cast("string"))
    tools = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(t(F.col("p_size")), t(F.col("p_size") + F.col("p_partkey"))))
    s = p.select(F.concat(F.lit("cl"), F.col("p_partkey") % 3).alias("cluster_id"), F.concat(F.lit("s"), "p_partkey").alias("signal"), F.concat(F.lit("k"), F.col("p_partkey") % 4).alias("capability"), tools.alias("tools"))
    clusters = s.select("cluster_id").distinct()
    presence = clusters.crossJoin(F.broadcast(v.spark.createDataFrame(_PRESENCE, "tool string, present boolean")))
    caps = clusters.crossJoin(F.broadcast(v.spark.createDataFrame(_CAPS, "capability string, state string")))
    return C.signal_obtainability(s, presence, caps)


@query(with_views("SELECT * FROM obtain", signals=_SIGNALS, caps=_values(_CAPS, "capability, state"), obtain=_OBTAIN))
def signal_obtainability(v):
    return obtainable(v)


@query(with_views("""SELECT cluster_id, concat('p', regexp_extract(signal, '\\d+')::INT % 40) AS phenomenon, count(*) FILTER (state = 'ok') AS obtainable, count(*) FILTER (state = 'indeterminate') AS indeterminate,
    count(*) FILTER (state = 'out-of-scope') AS out_of_scope, count(*) AS n, CASE WHEN count(*) FILTER (state = 'out-of-scope') = count(*) THEN 'none' WHEN count(*) FILTER (state = 'ok') = count(*) THEN 'full'
    ELSE 'partial' END AS state FROM (SELECT c.cluster_id, m.signal, coalesce(o.state, 'out-of-scope') AS state FROM (SELECT DISTINCT cluster_id FROM obtain) c CROSS JOIN (SELECT DISTINCT signal FROM obtain) m
    LEFT JOIN obtain o ON o.cluster_id = c.cluster_id AND o.signal = m.signal) GROUP BY ALL""", signals=_SIGNALS, caps=_values(_CAPS, "capability, state"), obtain=_OBTAIN))
def phenomenon_observability(v):
    s = obtainable(v)
    m = s.select("signal", F.concat(F.lit("p"), (F.regexp_extract("signal", r"\d+", 0).cast("int") % 40).cast("string")).alias("phenomenon"), F.lit("required").alias("role"))
    return C.phenomenon_observability(m, s)


@query(with_views("""SELECT "trigger", downstream, why, pos FROM (SELECT *, row_number() OVER (PARTITION BY "trigger", downstream ORDER BY pos, why) AS k FROM (
    SELECT CASE WHEN o_orderkey % 2 = 0 THEN src ELSE dst END AS "trigger", CASE WHEN o_orderkey % 2 = 0 THEN dst ELSE src END AS downstream, why, pos FROM (
    SELECT o_orderkey, concat('p', o_custkey % 30) AS src, concat('p', o_custkey % 7) AS dst, o_orderpriority AS why, o_orderkey AS pos FROM orders))) WHERE k = 1"""))
def relation_normalize(v):
    o = v.table("orders")
    return C.relation_normalize(o.select(F.concat(F.lit("p"), F.col("o_custkey") % 30).alias("src"), F.concat(F.lit("p"), F.col("o_custkey") % 7).alias("dst"),
                                         F.when(F.col("o_orderkey") % 2 == 0, "downstream").otherwise("trigger").alias("role"), F.col("o_orderpriority").alias("why"), F.col("o_orderkey").alias("pos")))


@query("""SELECT src, dst, 'src' AS "end", CASE WHEN c.c_custkey IS NULL THEN 'missing' ELSE 'wrong-type' END AS problem, level FROM (SELECT concat('n', o_custkey * 2) AS src, concat('n', o_custkey) AS dst, o_custkey,
    CASE WHEN o_orderkey % 4 = 0 THEN 'warn' ELSE 'error' END AS level, CASE WHEN o_orderkey % 6 > 0 THEN 'Signal' END AS src_type FROM orders) o
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey * 2 WHERE c.c_custkey IS NULL OR (c.c_custkey % 3 > 0 AND src_type IS NOT NULL)
    UNION ALL SELECT concat('n', o_custkey * 2), concat('n', o_custkey), 'dst', 'wrong-type', CASE WHEN o_orderkey % 4 = 0 THEN 'warn' ELSE 'error' END FROM orders WHERE o_custkey % 3 > 0""")
def catalogue_lint(v):
    c, o = v.table("customer"), v.table("orders")
    nodes = c.select(F.concat(F.lit("n"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "Signal").otherwise("Tool").alias("type"))
    e = o.select(F.concat(F.lit("n"), F.col("o_custkey") * 2).alias("src"), F.when(F.col("o_orderkey") % 6 > 0, "Signal").alias("src_type"), F.concat(F.lit("n"), "o_custkey").alias("dst"), F.lit("Signal").alias("dst_type"),
                 F.when(F.col("o_orderkey") % 4 == 0, C.ORGANISATIONAL[0]).otherwise("participates_in").alias("type"))
    return C.catalogue_lint(e, nodes)


PHRASES = [("the ", "causal"), ("will ", "future-certainty"), ("license", "fusion"), ("que ", "causal")]


@query(with_views("SELECT doc_id AS id, class, phrase FROM documents JOIN ph ON contains(lower(text), phrase)", ph=_values(PHRASES, "phrase, class")))
def register_scan(v):
    return C.register_scan(v.table("documents").select(F.col("doc_id").alias("id"), "text"), v.spark.createDataFrame(PHRASES, "phrase string, class string"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'not declared: limits.memory' END AS reason FROM orders""")
def eligibility_gate(v):
    o = v.table("orders")
    return o.select("o_orderkey", B.eligibility(F.lit("limits.memory"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_totalprice"))).alias("reason"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(c_acctbal * 0.9::DOUBLE, 6) END AS bar, CASE WHEN c_acctbal > 0 THEN 'bytes' END AS unit, CASE WHEN NOT c_acctbal > 0 THEN 'unbounded' END AS reason FROM customer""")
def resolve_bar(v):
    c = v.table("customer")
    b = B.resolve_bar(F.lit("config-relative"), F.lit("limits.memory"), F.lit(0.9), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit(None).cast("double"), F.lit("above"))
    return c.select("c_custkey", b.alias("b")).select("c_custkey", F.round("b.bar.value", 6).alias("bar"), F.col("b.bar.unit").alias("unit"), F.col("b.reason").alias("reason"))
