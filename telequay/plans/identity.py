"""Queries over entities and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from telequay.functions import binding as B
from telequay.functions import identity as I
from telequay.functions import status as T
from telequay.operators import identity as O
from telequay.operators import topology as G
from telequay.params import DAY, Params

from .registry import query
from .views import VIEWS, with_views

#: Order dates are days apart, so tombstones last days here.
AGED = Params(full_tombstone_us=60 * DAY, stub_tombstone_us=400 * DAY)
NOW = 1_000_000_000 * 1_000_000
BUDGET = 300 * DAY

_LIVES = """SELECT name, uid, seq, born_us, CASE WHEN deleted_us IS NULL AND nb IS NULL THEN NULL ELSE greatest(born_us, least(deleted_us, nb)) END AS died_us,
    p AS predecessor, s AS successor FROM (SELECT *, lead(born_us) OVER w AS nb, lag(uid) OVER w AS p, lead(uid) OVER w AS s FROM lifecycle
    WINDOW w AS (PARTITION BY name ORDER BY born_us, seq))"""
_ASKED = f"""SELECT event_id AS ask_id, (event_id % 1500)::VARCHAR AS name, {NOW} - (event_id % 900) * {DAY} AS at_us, {NOW} AS now_us FROM events"""
_TRAVERSED = f"""SELECT tick_seq, type, from_key, to_key, CASE WHEN retracted_us IS NULL AND end_us - confirmed_us > {BUDGET} THEN 1 ELSE 2 END AS verdict
    FROM edges JOIN windows ON asserted_us <= end_us AND (retracted_us IS NULL OR retracted_us > start_us)"""
WINDOWS = [(i, NOW + (i * 200 - 100) * DAY, NOW + i * 200 * DAY) for i in range(3)]
_WINDOWS = "SELECT * FROM (VALUES " + ", ".join(str(w) for w in WINDOWS) + ") t(tick_seq, start_us, end_us)"


def asked(v):
    e = v.table("events")
    return e.select(F.col("event_id").alias("ask_id"), (F.col("event_id") % 1500).cast("string").alias("name"),
                    (F.lit(NOW) - (F.col("event_id") % 900) * F.lit(DAY)).alias("at_us"), F.lit(NOW).alias("now_us"))


def windows(v):
    return v.spark.createDataFrame(WINDOWS, "tick_seq long, start_us long, end_us long")


@query(with_views("SELECT * FROM lives", "lifecycle", lives=_LIVES))
def succession(v):
    return O.succession(v.lifecycle())


_FOUND = f"""SELECT ask_id, max(s.u) AS uid, coalesce(max(s.tier) = 'stub', false) AS degraded FROM (
    SELECT a.ask_id, CASE WHEN l.uid IS NOT NULL AND tier <> 'expired' THEN {{'u': l.uid, 'tier': tier}} END AS s,
    row_number() OVER (PARTITION BY a.ask_id ORDER BY l.uid IS NOT NULL AND tier <> 'expired' DESC, l.born_us DESC, l.seq DESC) AS k
    FROM asked a LEFT JOIN (SELECT *, CASE WHEN died_us IS NULL THEN 'alive' WHEN {NOW} - died_us < {AGED.full_tombstone_us} THEN 'full'
    WHEN {NOW} - died_us < {AGED.stub_tombstone_us} THEN 'stub' ELSE 'expired' END AS tier FROM lives) l
    ON a.name = l.name AND a.at_us >= l.born_us AND (l.died_us IS NULL OR a.at_us < l.died_us)) WHERE k = 1 GROUP BY ask_id"""


@query(with_views(_FOUND, "lifecycle", lives=_LIVES, asked=_ASKED))
def identity_asof(v):
    return O.identity_asof(asked(v), O.succession(v.lifecycle()), AGED)


@query(with_views(_FOUND, "lifecycle", lives=_LIVES, asked=_ASKED))
def identity_asof_bucketed(v):
    return O.identity_asof_bucketed(asked(v), O.succession(v.lifecycle()), AGED, 365 * DAY)


@query("""SELECT 'Customer' AS kind, c_name AS name, 'Region' AS role_kind, r_name AS role_name, 2 AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey""")
def owner_chain_role(v):
    c, n, r = v.table("customer"), v.table("nation"), v.table("region")
    a = c.join(n, c.c_nationkey == n.n_nationkey).select(F.lit("Customer").alias("child_kind"), F.col("c_name").alias("child_name"), F.lit("Nation").alias("owner_kind"),
                                                         F.col("n_name").alias("owner_name"), F.lit(True).alias("controller"))
    b = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit("Nation").alias("child_kind"), F.col("n_name").alias("child_name"), F.lit("Region").alias("owner_kind"),
                                                         F.col("r_name").alias("owner_name"), F.lit(True).alias("controller"))
    return O.owner_chain(c.select(F.lit("Customer").alias("kind"), F.col("c_name").alias("name")), a.unionByName(b))


_AUDIT = """SELECT t.name, t.uid, m.uid AS model_uid, CASE WHEN m.uid IS NULL THEN 'missing' WHEN m.uid = t.uid THEN 'correct' ELSE 'misjoin' END AS verdict
    FROM (SELECT name, uid FROM lives WHERE successor IS NULL) t LEFT JOIN (SELECT name, max(uid) AS uid FROM lives WHERE deleted GROUP BY name) m ON t.name = m.name"""
_LIVES_D = _LIVES.replace("s AS successor FROM", "s AS successor, deleted_us IS NULL AS deleted FROM", 1)


def audit(v):
    lives = O.succession(v.lifecycle())
    model = v.lifecycle().where("deleted_us is null").groupBy("name").agg(F.max("uid").alias("uid"))
    return O.join_audit(lives.where("successor is null").select("name", "uid"), model)


@query(with_views(_AUDIT, "lifecycle", lives=_LIVES_D))
def join_audit(v):
    return audit(v)


@query(with_views("""SELECT c AS correct, m AS misjoin, x AS missing, coalesce(c / nullif(c + m, 0), 1.0)::DOUBLE AS accuracy, coalesce(c / nullif(c + m + x, 0), 1.0)::DOUBLE AS coverage,
    m = 0 AND c / nullif(c + m + x, 0) >= 0.95 AND c + m + x > 0 AS passed FROM (SELECT count(*) FILTER (verdict = 'correct')::DOUBLE AS c,
    count(*) FILTER (verdict = 'misjoin') AS m, count(*) FILTER (verdict = 'missing') AS x FROM audit)""".replace("SELECT c AS correct", "SELECT c::BIGINT AS correct"), "lifecycle", lives=_LIVES_D, audit=_AUDIT))
def join_accuracy(v):
    return O.join_accuracy(audit(v))


@query(with_views("""SELECT l.seq AS stream_id, kind, CASE WHEN kind = 'Node' THEN 'unverifiable' WHEN kind = 'Container' THEN CASE WHEN live.uid IS NOT NULL THEN 'correct' ELSE 'vanished' END
    WHEN named.uid IS NULL THEN 'vanished' WHEN named.uid = l.uid THEN 'correct' ELSE 'misjoin' END AS verdict
    FROM (SELECT *, CASE seq % 3 WHEN 0 THEN 'Pod' WHEN 1 THEN 'Container' ELSE 'Node' END AS kind FROM lives) l
    LEFT JOIN (SELECT * FROM lives WHERE died_us IS NULL) named ON named.name = l.name LEFT JOIN (SELECT * FROM lives WHERE died_us IS NULL) live ON live.uid = l.uid""",
    "lifecycle", lives=_LIVES))
def verify_stream(v):
    lives = O.succession(v.lifecycle())
    kind = F.when(F.col("seq") % 3 == 0, "Pod").when(F.col("seq") % 3 == 1, "Container").otherwise("Node")
    uid = F.when(kind == "Container", F.concat("uid", F.lit("/main"))).otherwise(F.col("uid"))
    return O.verify_streams(lives.select(F.col("seq").alias("stream_id"), kind.alias("kind"), "name", uid.alias("uid")), lives.where("died_us is null"))


@query(with_views(f"""SELECT CASE WHEN d IS NULL THEN 'alive' WHEN {NOW} - d < {AGED.full_tombstone_us} THEN 'full' WHEN {NOW} - d < {AGED.stub_tombstone_us} THEN 'stub' ELSE 'expired' END AS tier,
    count(*) AS n, count(predecessor) AS successions FROM (SELECT *, CASE WHEN died_us <= {NOW} THEN died_us END AS d FROM lives WHERE born_us <= {NOW}) GROUP BY 1""",
    "lifecycle", lives=_LIVES))
def identity_health(v):
    return O.identity_health(O.succession(v.lifecycle()), NOW, AGED)


@query(with_views(f"""SELECT seq, CASE WHEN died_us IS NULL THEN 'alive' WHEN {NOW} - died_us < {AGED.full_tombstone_us} THEN 'full'
    WHEN {NOW} - died_us < {AGED.stub_tombstone_us} THEN 'stub' ELSE 'expired' END AS tier FROM lives""", "lifecycle", lives=_LIVES))
def tombstone_tier(v):
    return O.succession(v.lifecycle()).select("seq", T.tombstone_tier(F.col("died_us"), F.lit(NOW), AGED.full_tombstone_us, AGED.stub_tombstone_us).alias("tier"))


@query(with_views(f"""SELECT from_key, to_key, CASE WHEN retracted_us IS NOT NULL THEN 'retracted' WHEN {NOW} - confirmed_us > {BUDGET} THEN 'suspect' ELSE 'valid' END AS status
    FROM edges""", "edges"))
def edge_status(v):
    return v.edges().select("from_key", "to_key", T.edge_status(F.col("retracted_us"), F.col("confirmed_us"), F.lit(None).cast("long"), F.lit(NOW), BUDGET).alias("status"))


@query(with_views("SELECT * FROM traversed", "edges", windows=_WINDOWS, traversed=_TRAVERSED))
def edge_traverse(v):
    return G.edge_traverse(v.edges(), windows(v), BUDGET)


_NEIGHBOURS = """SELECT tick_seq, from_key AS key, to_key AS neighbour, type, true AS "out", verdict FROM traversed
    UNION ALL SELECT tick_seq, to_key, from_key, type, false, verdict FROM traversed"""


@query(with_views("SELECT * FROM neighbours", "edges", windows=_WINDOWS, traversed=_TRAVERSED, neighbours=_NEIGHBOURS))
def neighbours(v):
    return G.neighbours(G.edge_traverse(v.edges(), windows(v), BUDGET))


@query(with_views("""SELECT tick_seq, key, target, 1 AS hop, verdict, path FROM one UNION ALL SELECT tick_seq, key, target, 2, verdict, path FROM (
    SELECT o.tick_seq, o.key, n.neighbour AS target, least(o.verdict, n.verdict) AS verdict, concat(o.path, '>', n.type, '>', n.neighbour) AS path,
    row_number() OVER (PARTITION BY o.tick_seq, o.key, n.neighbour ORDER BY least(o.verdict, n.verdict) DESC, concat(o.path, '>', n.type, '>', n.neighbour)) AS k
    FROM one o JOIN neighbours n ON n.tick_seq = o.tick_seq AND n.key = o.target WHERE n.neighbour <> o.key
    AND NOT EXISTS (SELECT 1 FROM one x WHERE x.tick_seq = o.tick_seq AND x.key = o.key AND x.target = n.neighbour)) WHERE k = 1""",
    "edges", windows=_WINDOWS, traversed=_TRAVERSED, neighbours=_NEIGHBOURS,
    one="""SELECT * FROM (SELECT tick_seq, key, neighbour AS target, verdict, concat(key, '>', type, '>', neighbour) AS path,
    row_number() OVER (PARTITION BY tick_seq, key, neighbour ORDER BY verdict DESC, concat(key, '>', type, '>', neighbour)) AS k
    FROM neighbours WHERE key IN (SELECT concat('c', user_id) FROM events)) WHERE k = 1"""))
def reach_two_hop(v):
    t = G.edge_traverse(v.edges(), windows(v), BUDGET)
    seen = v.table("events").select(F.concat(F.lit("c"), "user_id").alias("key")).distinct()  # walks start from entities that have samples
    origins = seen.join(windows(v).select("tick_seq"))
    return G.reach(t, origins)


_EDGE_EVENTS = """SELECT 'selects' AS type, concat('o', o_custkey) AS from_key, concat('p', o_orderkey % 5) AS to_key,
    CASE WHEN o_orderstatus = 'F' THEN 'retract' ELSE 'assert' END AS op, epoch_us(o_orderdate) AS event_us, o_orderkey AS seq FROM orders"""


def edge_events(v):
    o = v.table("orders")
    return o.select(F.lit("selects").alias("type"), F.concat(F.lit("o"), F.col("o_custkey")).alias("from_key"), F.concat(F.lit("p"), F.col("o_orderkey") % 5).alias("to_key"),
                    F.when(F.col("o_orderstatus") == "F", "retract").otherwise("assert").alias("op"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("event_us"),
                    F.col("o_orderkey").alias("seq"))


@query(with_views("""SELECT type, from_key, to_key, asserted_us, confirmed_us, retracted_us FROM (SELECT *, row_number() OVER (PARTITION BY type, from_key, to_key ORDER BY island DESC) AS k FROM (
    SELECT type, from_key, to_key, island, min(event_us) FILTER (op = 'assert') AS asserted_us, max(event_us) FILTER (op = 'assert') AS confirmed_us,
    min(event_us) FILTER (op = 'retract') AS retracted_us FROM (SELECT *, coalesce(sum((op = 'retract')::INT) OVER (PARTITION BY type, from_key, to_key ORDER BY event_us, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM ev) GROUP BY ALL) WHERE asserted_us IS NOT NULL) WHERE k = 1""", ev=_EDGE_EVENTS))
def edge_intervals(v):
    return G.edge_intervals(edge_events(v))


@query(with_views("""SELECT type, from_key, to_key, 'assert' AS op, event_us FROM snap UNION ALL SELECT s.type, s.from_key, s.to_key, 'retract', n.next_us FROM snap s
    JOIN (SELECT *, lead(event_us) OVER (PARTITION BY type, from_key ORDER BY event_us) AS next_us FROM (SELECT DISTINCT type, from_key, event_us FROM snap)) n
    ON n.type = s.type AND n.from_key = s.from_key AND n.event_us = s.event_us WHERE n.next_us IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM snap x WHERE x.type = s.type AND x.from_key = s.from_key AND x.to_key = s.to_key AND x.event_us = n.next_us)""", ev=_EDGE_EVENTS,
    snap="SELECT DISTINCT type, from_key, to_key, event_us FROM ev"))
def reconcile_out(v):
    return G.reconcile_out(edge_events(v).select("type", "from_key", "to_key", "event_us").distinct())


SNAPSHOTS = [(NOW + i * 150 * DAY,) for i in range(-6, 3)]
_DERIVE = {
    "snaps": "SELECT * FROM (VALUES " + ", ".join(f"({s[0]})" for s in SNAPSHOTS) + ") t(snap_us)",
    "o": "SELECT o_custkey AS c, epoch_us(o_orderdate) AS event_us, max(o_orderkey) AS k FROM orders GROUP BY ALL",
    "instances": f"""SELECT 'Node' AS kind, concat('node', n_nationkey) AS name, concat('i|Node|', n_nationkey) AS key, (SELECT min(event_us) FROM o) + n_nationkey * {90 * DAY} AS since_us FROM nation
        UNION ALL SELECT 'Claim', concat('claim', k % 40), concat('i|Claim|', k % 40), min(event_us) + k % 40 * {60 * DAY} FROM o GROUP BY k % 40
        UNION ALL SELECT 'Service', o_orderpriority, concat('i|Service|', o_orderpriority), epoch_us(min(o_orderdate)) + {400 * DAY} FROM orders GROUP BY 2 UNION ALL SELECT 'Pod', c::VARCHAR, concat('i|Pod|', c), min(event_us) + {20 * DAY} FROM o GROUP BY c""",
    "pods": "SELECT snap_us, c::VARCHAR AS pod, k FROM snaps JOIN o ON event_us <= snap_us QUALIFY row_number() OVER (PARTITION BY snap_us, c ORDER BY event_us DESC) = 1",
    "slices": """SELECT snap_us, service, pods FROM snaps JOIN (SELECT o_orderpriority AS service, o_custkey % 20 AS slice, epoch_us(date_trunc('month', o_orderdate)) AS event_us, list(DISTINCT o_custkey::VARCHAR) AS pods FROM orders GROUP BY ALL)
        ON event_us <= snap_us QUALIFY row_number() OVER (PARTITION BY snap_us, service, slice ORDER BY event_us DESC) = 1""",
    "derived": """SELECT DISTINCT 'runs-on' AS type, a.key AS from_key, b.key AS to_key, snap_us AS event_us FROM pods p JOIN instances a ON a.kind = 'Pod' AND a.name = pod AND a.since_us <= snap_us
            JOIN instances b ON b.kind = 'Node' AND b.name = concat('node', k % 25) AND b.since_us <= snap_us WHERE k % 9 > 0
        UNION SELECT 'mounts', a.key, b.key, snap_us FROM (SELECT *, unnest([concat('claim', k % 40), concat('claim', k % 7)]) AS claim FROM pods) JOIN instances a ON a.kind = 'Pod' AND a.name = pod AND a.since_us <= snap_us
            JOIN instances b ON b.kind = 'Claim' AND b.name = claim AND b.since_us <= snap_us
        UNION SELECT 'selects', a.key, b.key, snap_us FROM (SELECT snap_us, service, unnest(pods) AS pod FROM slices) JOIN instances a ON a.kind = 'Service' AND a.name = service AND a.since_us <= snap_us
            JOIN instances b ON b.kind = 'Pod' AND b.name = pod AND b.since_us <= snap_us
        UNION SELECT 'node-lease', a.key, a.key, event_us FROM o JOIN instances a ON a.kind = 'Node' AND a.name = concat('node', k % 25) AND a.since_us <= event_us"""}


@query(with_views("SELECT * FROM derived", **_DERIVE))
def derive_edges(v):
    o, day = v.table("orders"), F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    k = o.groupBy(F.col("o_custkey").alias("c"), day.alias("event_us")).agg(F.max("o_orderkey").alias("k"))
    name = lambda kind, number: F.concat(F.lit(kind), number.cast("string"))
    pods = k.select(F.col("c").cast("string").alias("pod"), "event_us", F.when(F.col("k") % 9 > 0, name("node", F.col("k") % 25)).alias("node"), F.array(name("claim", F.col("k") % 40), name("claim", F.col("k") % 7)).alias("claims"))
    month = F.unix_micros(F.date_trunc("month", "o_orderdate").cast("timestamp"))
    slices = o.groupBy(F.col("o_orderpriority").alias("service"), (F.col("o_custkey") % 20).alias("slice"), month.alias("event_us")).agg(F.collect_set(F.col("o_custkey").cast("string")).alias("pods"))
    leases = k.select(name("node", F.col("k") % 25).alias("node"), F.col("event_us").alias("renewed_us"))
    own = lambda kind, d, n, since: d.select(F.lit(kind).alias("kind"), n.alias("name"), F.regexp_replace(n, "^(node|claim)", "").alias("key"), since.alias("since_us"))
    first = F.min("event_us").alias("first")
    known = own("Node", v.table("nation"), name("node", F.col("n_nationkey")), k.agg(first).scalar() + F.col("n_nationkey") * 90 * DAY)
    known = known.unionByName(own("Claim", k.groupBy((F.col("k") % 40).alias("n")).agg(first), name("claim", F.col("n")), F.col("first") + F.col("n") * 60 * DAY))
    known = known.unionByName(own("Service", o.groupBy("o_orderpriority").agg(F.min(day).alias("first")), F.col("o_orderpriority"), F.col("first") + 400 * DAY))
    known = known.unionByName(own("Pod", k.groupBy("c").agg(first), F.col("c").cast("string"), F.col("first") + 20 * DAY))
    return G.derive_edges(pods, slices, leases, known.withColumn("key", F.concat_ws("|", F.lit("i"), "kind", "key")), v.spark.createDataFrame(SNAPSHOTS, "snap_us long"))


@query("""SELECT o_orderkey, CASE WHEN bad THEN NULL ELSE concat_ws('|', 'i', 'cl', o_orderstatus, 'Pod', name, o_custkey) END AS key, CASE WHEN bad THEN 'malformed-coordinates' END AS error,
    concat_ws('|', 'r', 'cl', o_orderstatus, 'Deployment', o_orderpriority) AS role_key
    FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a|b' ELSE o_orderpriority END AS name, o_orderkey % 5 < 2 AS bad FROM orders)""")
def mint_cei(v):
    o = v.table("orders")
    name = F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 5 == 1, "a|b").otherwise(F.col("o_orderpriority"))
    m = I.mint_instance(F.lit("cl"), F.col("o_orderstatus"), F.lit("Pod"), name, F.col("o_custkey").cast("string"))
    r = I.mint_role(F.lit("cl"), F.col("o_orderstatus"), F.lit("Deployment"), F.col("o_orderpriority"))
    return o.select("o_orderkey", m["key"].alias("key"), m["error"].alias("error"), r["key"].alias("role_key"))


@query("""SELECT o_orderkey, CASE WHEN ok THEN p[1] END AS layer, CASE WHEN ok THEN p[2] END AS cluster, CASE WHEN ok THEN p[3] END AS ns, CASE WHEN ok THEN p[4] END AS kind,
    CASE WHEN ok THEN p[5] END AS name, CASE WHEN ok AND p[1] = 'i' THEN p[6] END AS uid, CASE WHEN NOT ok THEN 'malformed-key' END AS error FROM (
    SELECT o_orderkey, p, (len(p) = 6 AND p[1] = 'i') OR (len(p) = 5 AND p[1] = 'r') AS ok FROM (SELECT o_orderkey, string_split(CASE o_orderkey % 4 WHEN 0 THEN concat('i|c||Pod|x|', o_custkey)
    WHEN 1 THEN concat('r|c|n|Deployment|', o_custkey) WHEN 2 THEN concat('i|c|', o_custkey) ELSE concat('q|c|n|Pod|x|', o_custkey) END, '|') AS p FROM orders))""")
def parse_cei(v):
    o, k = v.table("orders"), F.col("o_orderkey") % 4
    key = (F.when(k == 0, F.concat(F.lit("i|c||Pod|x|"), "o_custkey")).when(k == 1, F.concat(F.lit("r|c|n|Deployment|"), "o_custkey"))
           .when(k == 2, F.concat(F.lit("i|c|"), "o_custkey")).otherwise(F.concat(F.lit("q|c|n|Pod|x|"), "o_custkey")))
    return o.select("o_orderkey", I.parse_key(key).alias("p")).select("o_orderkey", "p.*")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat(o_custkey % 6, '.', o_custkey % 20, '.3-generic') END AS kernel, CASE WHEN o_custkey % 7 = 0 THEN 'indeterminate'
    WHEN o_custkey % 6 > 4 OR (o_custkey % 6 = 4 AND o_custkey % 20 >= 19) THEN 'met' ELSE 'unmet' END AS state FROM orders""")
def kernel_at_least(v):
    o = v.table("orders")
    kernel = F.when(F.col("o_custkey") % 7 > 0, F.concat(F.col("o_custkey") % 6, F.lit("."), F.col("o_custkey") % 20, F.lit(".3-generic")))
    return o.select("o_orderkey", kernel.alias("kernel"), B.kernel_at_least(kernel, 4, 19).alias("state"))


_TYPES = ["Gauges (state-derived)", "counter", "Histogram of latency", "summary", "JSON event", " gauge/counter ", "free form", ""]


@query("SELECT p_partkey, data_type, CASE p_partkey % 8 WHEN 0 THEN 'gauge' WHEN 1 THEN 'counter' WHEN 2 THEN 'histogram' WHEN 3 THEN 'histogram' WHEN 4 THEN 'non-series' "
       "WHEN 5 THEN 'gauge+counter' ELSE 'unknown' END AS shape FROM (SELECT p_partkey, ([" + ", ".join(f"'{t}'" for t in _TYPES) + "])[(p_partkey % 8 + 1)::INT] AS data_type FROM part)")
def series_shape(v):
    t = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return v.table("part").select("p_partkey", t.alias("data_type"), B.series_shape(t).alias("shape"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'no-label' WHEN o_orderpriority = '5-LOW' THEN 'unknown-kind' WHEN e < s THEN 'ends-before-start' WHEN o_orderkey % 13 = 0 THEN 'no-author' END AS error,
    o_orderkey % 11 <> 0 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT coalesce(e < s, false) AND o_orderkey % 13 <> 0 AS splice_eligible FROM (
    SELECT *, epoch_us(o_orderdate) AS s, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN epoch_us(o_orderdate) - 1 ELSE epoch_us(o_orderdate) + 5 END AS e FROM orders)""")
def context_window_check(v):
    o, k = v.table("orders"), F.col("o_orderkey")
    kind = (F.when(F.col("o_orderpriority") == "1-URGENT", "deploy").when(F.col("o_orderpriority") == "2-HIGH", "config-change")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "incident").when(F.col("o_orderpriority") == "5-LOW", "party").otherwise("maintenance"))
    s = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    end = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, s - 1).otherwise(s + 5)
    c = T.context_window_check(F.when(k % 11 > 0, "x").otherwise(""), kind, F.when(k % 13 > 0, "me"), s, end)
    return o.select("o_orderkey", c["error"].alias("error"), c["splice_eligible"].alias("splice_eligible"))


@query(with_views("SELECT uid, age_us > 86400000000 AS stale, age_us FROM (SELECT uid, greatest(1706000000000000 - max(at_us), 0) AS age_us FROM readings GROUP BY uid)", "readings"))
def finding_freshness(v):
    d = v.readings().groupBy("uid").agg(F.max("at_us").alias("seen"))
    return d.select("uid", T.freshness(F.col("seen"), F.lit(1_706_000_000_000_000), DAY).alias("f")).select("uid", "f.*")
