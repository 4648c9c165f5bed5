"""Queries over ingest, sinks, surfaces and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from telequay.functions import identity as I
from telequay.operators import detect as D
from telequay.operators import surfaces as U
from telequay.operators.lineage import cut
from telequay.params import DAY
from telequay.sources import exposition as E
from telequay.sources import tables as T

from .detection import _CTE, _EV, _RADIUS, _TIER, _values, bindings, components, findings, loud, risk_inputs, scoped_members, tiers
from .registry import query
from .views import with_views


@query(with_views("SELECT metric, type, uid, at_us // 1000 * 1000 AS at_us, value, 'sample' AS outcome FROM readings", "readings"))
def exposition_to_samples(v):
    rows = E.exposition_rows(E.payload_union(E.render(v.readings())))
    return rows.select("metric", "type", F.element_at("labels", "uid").alias("uid"), "at_us", "value", "outcome")


@query(with_views("SELECT 'sample' AS outcome, NULL AS reason, count(*) AS n FROM readings WHERE arrival % 5 > 2 UNION ALL SELECT 'non-finite', NULL, count(*) FROM readings WHERE arrival % 5 = 0 "
                  "UNION ALL SELECT 'malformed', 'line', count(*) FROM readings WHERE arrival % 5 = 1 UNION ALL SELECT 'skipped-family', 'histogram', count(*) FROM readings WHERE arrival % 5 = 2 "
                  "UNION ALL SELECT 'fetch-failed', CASE metric WHEN 'view' THEN 'refused' ELSE 'timeout' END, count(DISTINCT stream_id) FROM readings GROUP BY 2", "readings"))
def ingest_summary(v):
    k = F.col("arrival") % 5
    line = (F.when(k == 0, "up NaN").when(k == 1, "!! what").when(k == 2, 'lat_bucket{le="1"} 4').otherwise(F.concat(F.lit("up "), F.col("value").cast("string"))))
    body = v.readings().groupBy("stream_id").agg(F.concat_ws("\n", F.lit("# TYPE up gauge"), F.lit("# TYPE lat histogram"), F.collect_list(line)).alias("body"))
    p = body.select(F.lit("node-exporter").alias("family"), F.col("stream_id").alias("node"), F.lit(7).cast("long").alias("received_us"), "body", F.lit(None).cast("string").alias("err"))
    failed = p.select("family", F.concat(F.lit("x"), "node").alias("node"), "received_us", F.lit(None).cast("string").alias("body"), F.when(F.col("node").endswith("|view"), "refused").otherwise("timeout").alias("err"))
    both = E.payload_union(p, failed)
    return E.ingest_summary(E.exposition_rows(both), both)


@query(with_views("SELECT uid, metric, at_us, value FROM readings WHERE (at_us // 7200000000 + 1) * 7200000000 > 1706000000000000 - 864000000000", "readings"))
def readings_retained(v):
    return T.retained(v.readings(), 1_706_000_000_000_000, 10 * DAY).select("uid", "metric", "at_us", "value")


@query(with_views("SELECT arrival, at_us, value, s.stream_id, s.uid, s.metric, s.type FROM readings r JOIN (SELECT DISTINCT stream_id, uid, metric, type FROM readings) s ON s.stream_id = r.stream_id", "readings"))
def readings_export(v):
    r = v.readings()
    return T.readings_export(r.select("stream_id", "arrival", "at_us", "value"), r.select("stream_id", "uid", "metric", "type").distinct())


@query("SELECT o_custkey, max(o_orderkey) AS last_seen FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def recent_reads(v):
    return T.recent(v.table("orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_seen")), 50, "o_custkey")


@query("SELECT min(p_type) FILTER (p_partkey = 0) AS kernel, min(p_brand) FILTER (p_partkey = 0) AS runtime, count(DISTINCT p_type) > 1 AS mixed_kernels FROM part")
def platform_facts(v):
    return T.platform_facts(v.table("part").select(F.col("p_partkey").alias("name"), F.col("p_type").alias("kernel"), F.col("p_brand").alias("runtime")))


@query("SELECT DISTINCT c_nationkey AS node FROM customer WHERE starts_with(c_name, 'Customer#00000000') AND c_mktsegment <> 'BUILDING'")
def scrape_targets(v):
    c = v.table("customer").select(F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") != "BUILDING", "Running").otherwise("Pending").alias("phase"), F.col("c_nationkey").alias("node"))
    return T.scrape_targets(c, "Customer#00000000")


_SERIES = """SELECT o_orderkey, ns, pod, c, img, m FROM (SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN 'ns' ELSE '' END AS ns, CASE WHEN o_custkey % 5 > 0 THEN 'p' ELSE '' END AS pod,
    CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'POD' ELSE 'main' END AS c, CASE WHEN o_custkey % 7 = 0 THEN 'pause' ELSE '' END AS img, o_custkey % 11 = 0 AS m FROM orders)"""


@query(with_views("""SELECT o_orderkey, CASE WHEN m THEN 'resolve' WHEN ns = '' AND pod = '' THEN 'drop' WHEN ns = '' OR pod = '' THEN 'quarantine' WHEN c = 'POD' OR (c = '' AND img <> '') THEN 'drop' ELSE 'resolve' END AS outcome,
    CASE WHEN m THEN NULL WHEN ns = '' AND pod = '' THEN 'non-pod-cgroup' WHEN ns = '' OR pod = '' THEN 'missing-identity-labels' WHEN c = 'POD' OR (c = '' AND img <> '') THEN 'pause-sandbox-row' END AS reason,
    CASE WHEN m THEN 'node' WHEN ns = '' OR pod = '' OR c = 'POD' OR (c = '' AND img <> '') THEN NULL WHEN c = '' THEN 'pod' ELSE 'container' END AS scope FROM s""", s=_SERIES))
def normalize_cadvisor(v):
    k = F.col("o_custkey")
    labels = F.create_map(F.lit("namespace"), F.when(k % 4 > 0, "ns").otherwise(""), F.lit("pod_name"), F.when(k % 5 > 0, "p").otherwise(""),
                          F.lit("container"), F.when(k % 3 == 0, "").when(k % 3 == 1, "POD").otherwise("main"), F.lit("image"), F.when(k % 7 == 0, "pause").otherwise(""))
    metric = F.when(k % 11 == 0, "machine_cpu_cores").otherwise("container_memory")
    return v.table("orders").select("o_orderkey", I.normalize_container_metrics(metric, labels, F.lit("n")).alias("r")).select("o_orderkey", "r.*")


@query("""SELECT o_orderkey, CASE WHEN k = 4 OR d THEN 'quarantine' ELSE 'resolve' END AS outcome, CASE WHEN d THEN 'missing-identity-labels' WHEN k = 4 THEN 'unmapped-metric-class' END AS reason,
    CASE WHEN d OR k = 4 THEN NULL ELSE (['container', 'pod', 'node', 'role'])[k + 1] END AS scope FROM (SELECT o_orderkey, (o_custkey % 5)::INT AS k, o_custkey % 5 < 4 AND o_custkey % 6 = 0 AS d FROM orders)""")
def normalize_ksm(v):
    k, drop = F.col("o_custkey") % 5, F.col("o_custkey") % 6 == 0
    metric = F.when(k == 0, "kube_pod_container_limits").when(k == 1, "kube_pod_info").when(k == 2, "kube_node_info").when(k == 3, "kube_deployment_spec").otherwise("kube_replicaset_x")
    val = F.when(drop, "").otherwise("x")
    labels = F.create_map(F.lit("namespace"), val, F.lit("pod"), val, F.lit("container"), val, F.lit("node"), val, F.lit("deployment"), val)
    return v.table("orders").select("o_orderkey", I.normalize_state_metrics(metric, labels).alias("r")).select("o_orderkey", "r.*")


@query(with_views("""SELECT outcome, reason, count(*) AS n FROM (SELECT CASE WHEN m THEN 'resolve' WHEN ns = '' AND pod = '' THEN 'drop' WHEN ns = '' OR pod = '' THEN 'quarantine' WHEN c = 'POD' OR (c = '' AND img <> '') THEN 'drop' ELSE 'resolve' END AS outcome,
    CASE WHEN m THEN NULL WHEN ns = '' AND pod = '' THEN 'non-pod-cgroup' WHEN ns = '' OR pod = '' THEN 'missing-identity-labels' WHEN c = 'POD' OR (c = '' AND img <> '') THEN 'pause-sandbox-row' END AS reason FROM s) GROUP BY ALL""", s=_SERIES))
def stream_outcomes(v):
    return U.outcomes_by_reason(normalize_cadvisor(v))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'quarantine' ELSE 'resolve' END AS outcome, CASE WHEN o_custkey % 2 = 0 THEN 'missing-scrape-source' END AS reason, CASE WHEN o_custkey % 2 = 1 THEN 'node' END AS scope FROM orders")
def normalize_node_exporter(v):
    return v.table("orders").select("o_orderkey", I.normalize_node_metrics(F.when(F.col("o_custkey") % 2 == 1, "n")).alias("r")).select("o_orderkey", "r.*")


@query("SELECT o_orderkey, concat('f|m|n{a=', o_orderstatus, ',b=', o_orderpriority, '}') AS key, concat('a=', o_orderstatus, ',b=', o_orderpriority) AS sub_id FROM orders")
def stream_key(v):
    labels = F.create_map(F.lit("b"), F.col("o_orderpriority"), F.lit("a"), F.col("o_orderstatus"))
    return v.table("orders").select("o_orderkey", I.stream_key(F.lit("f"), F.lit("m"), F.lit("n"), labels).alias("key"), I.stream_sub_id(F.lit("node-exporter"), labels).alias("sub_id"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'discovered' END AS state, o_orderstatus = 'F' AS ready, CASE WHEN o_custkey % 2 = 0 THEN 5 ELSE 9 END AS died_us FROM orders""")
def lifecycle_event_fields(v):
    o = v.table("orders")
    cond = F.array(F.struct(F.lit("Disk").alias("type"), F.lit("True").alias("status")), F.struct(F.lit("Ready").alias("type"), F.when(F.col("o_orderstatus") == "F", "True").otherwise("False").alias("status")))
    return o.select("o_orderkey", I.pod_state(F.when(F.col("o_orderstatus") == "O", "Running").otherwise("Pending")).alias("state"), I.node_ready(cond).alias("ready"),
                    I.death_time(F.when(F.col("o_custkey") % 2 == 0, F.lit(5)), F.lit(9)).alias("died_us"))


#: What the catalogue says of the rules' signals; one rule is in no release.
_ASKED = [("r-mem", "s-mem", None), ("r-cpu", "s-cpu", "quota"), ("r-abs", "s-abs", None), ("r-cnt", "s-cnt", None), ("r-log", "s-log", None), ("r-rate", "s-mem", None)]
_SHAPES = [("s-mem", "gauge"), ("s-cpu", "gauge"), ("s-abs", "gauge+counter"), ("s-cnt", "counter"), ("s-log", "non-series")]
_BEFORE = [("s-mem", "drain,storm")]
_EXTRA = [("r-cnt", "cnt", "absolute"), ("r-log", "log", "absolute"), ("r-rate", "rate", "rate-of-change"), ("r-lost", "lost", "absolute"), ("r-zmem", "mem", "absolute")]


@query(with_views("""SELECT entity, metric, rule_id, verdict, CASE WHEN verdict = 'target' THEN concat(entity, '/s') END AS stream_uid, CASE WHEN verdict = 'target' THEN phenomena END AS phenomena FROM (SELECT e.*, w.phenomena, CASE WHEN state <> 'bound' THEN 'not-bound' WHEN value IS NULL THEN 'unbounded'
    WHEN kind = 'rate-of-change' THEN 'rate-guard-bar' WHEN r.rule_id IS NULL THEN 'unknown-rule' WHEN r.divisor IS NOT NULL THEN 'derived-ratio-deferred' WHEN contains(shape, 'gauge') THEN
    CASE WHEN entity[2:]::INT % 4 = 0 THEN 'no-stream-key' ELSE 'target' END WHEN contains(shape, 'counter') THEN 'counter-deferred' ELSE 'non-series-signal' END AS verdict FROM (
    SELECT * FROM (SELECT entity, container, rule_id, metric, kind, state, CASE WHEN entity[2:]::INT % 13 > 0 THEN value END AS value FROM b UNION ALL
    SELECT concat('c', c_custkey), 'k0', x.rule_id, x.metric, x.kind, 'bound', 1.0 FROM customer, extra x)
    QUALIFY row_number() OVER (PARTITION BY entity, metric ORDER BY rule_id, container NULLS FIRST) = 1) e
    LEFT JOIN asked r ON r.rule_id = e.rule_id LEFT JOIN shapes s ON s.signal = r.signal LEFT JOIN before w ON w.signal = r.signal)""",
    **_CTE, asked=_values(_ASKED, "rule_id, signal, divisor"), shapes=_values(_SHAPES, "signal, shape"), extra=_values(_EXTRA, "rule_id, metric, kind"), before=_values(_BEFORE, "signal, phenomena")))
def forecast_eligibility(v):
    b = bindings(v).select("entity", "container", "rule_id", "metric", "kind", "state", F.when(F.substring("entity", 2, 20).cast("int") % 13 > 0, F.col("bar.value")).alias("bar"))
    extra = v.spark.createDataFrame(_EXTRA, "rule_id string, metric string, kind string")
    c = v.table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("entity"))
    more = c.crossJoin(F.broadcast(extra)).select("entity", F.lit("k0").alias("container"), "rule_id", "metric", "kind", F.lit("bound").alias("state"), F.lit(1.0).alias("bar"))  # a few authored rules
    scraped = b.select("entity").distinct().where(F.substring("entity", 2, 20).cast("int") % 4 > 0).select("entity", F.concat("entity", F.lit("/s")).alias("stream_uid"))
    t = lambda rows, schema: v.spark.createDataFrame(rows, schema)
    return U.forecast_eligibility(b.unionByName(more), t(_ASKED, "rule_id string, signal string, divisor string"), t(_SHAPES, "signal string, shape string"), scraped, t(_BEFORE, "signal string, phenomena string"))


@query("SELECT p_type AS signal, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS phenomena FROM part WHERE p_size % 4 < 2 GROUP BY 1")
def precursors(v):
    k = F.col("p_size") % 4
    order = F.when(k == 0, "T0-early").when(k == 1, "T-1").when(k == 2, "T0").otherwise("T+1")
    d = U.precursors(v.table("part").select(F.col("p_type").alias("signal"), F.col("p_brand").alias("phenomenon"), order.alias("temporal_order")))
    return d.select("signal", F.concat_ws(",", "phenomena").alias("phenomena"))


_OUT = "SELECT uid, metric, at_us AS now_us, CASE arrival % 4 WHEN 0 THEN NULL WHEN 1 THEN 'band-too-wide' WHEN 2 THEN 'no-crossing' ELSE CASE WHEN arrival % 8 = 3 THEN 'flat' ELSE 'no-crossing' END END AS silence FROM readings"


@query(with_views(f"""SELECT uid, metric, now_us, silence IS NOT NULL AS aging, w AS projected_us FROM (SELECT *, max(CASE WHEN silence IS NULL THEN now_us END) OVER x AS w,
    max(CASE WHEN silence = 'flat' THEN now_us END) OVER x AS h FROM o WINDOW x AS (PARTITION BY uid, metric ORDER BY now_us)) WHERE silence IS NULL OR (w IS NOT NULL AND (h IS NULL OR h < w) AND now_us - w <= {4 * DAY})""", "readings", o=_OUT))
def warning_debounce(v):
    k = F.col("arrival") % 4
    s = F.when(k == 1, "band-too-wide").when(k == 2, "no-crossing").when((k == 3) & (F.col("arrival") % 8 == 3), "flat").when(k == 3, "no-crossing")
    return U.warning_debounce(v.readings().select("uid", "metric", F.col("at_us").alias("now_us"), s.alias("silence")), 4 * DAY)


@query(with_views("""SELECT uid, matched, loud, selected, prio, greatest((SELECT count(*) FROM marked) - 400, 0) AS cut FROM marked ORDER BY prio, uid LIMIT 400""", "loud", **_EV, tier=_TIER,
    marked="""SELECT *, CASE WHEN matched THEN 0 WHEN loud THEN 1 WHEN selected THEN 2 ELSE 3 END AS prio FROM (SELECT c_custkey::VARCHAR AS uid, c_custkey::VARCHAR IN (SELECT uid FROM found) AS matched,
    c_custkey::VARCHAR IN (SELECT uid FROM loud) AS loud, c_custkey::VARCHAR IN (SELECT uid FROM tier) AS selected FROM customer)"""))
def topology_view(v):
    c = cut(components(v))  # findings and loud states read them
    return U.topology_view(v.table("customer").select(F.col("c_custkey").cast("string").alias("uid")), findings(v, c), loud(v, c), tiers(v), 400).drop("degraded", "phenomena", "warned")


@query("""SELECT lane, id, start_us, coalesce(end_us, start_us + 1000) AS end_us FROM (SELECT o_orderstatus AS lane, o_orderkey AS id, epoch_us(o_orderdate) AS start_us, CASE WHEN o_custkey % 3 > 0 THEN epoch_us(o_orderdate) + o_custkey END AS end_us FROM orders)""")
def timeline(v):
    s = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return U.timeline(v.table("orders").select(F.col("o_orderstatus").alias("lane"), F.col("o_orderkey").alias("id"), s.alias("start_us"), F.when(F.col("o_custkey") % 3 > 0, s + F.col("o_custkey")).alias("end_us")), 1000)


_WIDE = "phenomenon IN (SELECT phenomenon FROM members WHERE signal IN ('s-error', 's-signup'))"


def risky(v):
    """Findings, whether anything is at risk around them, and whether their phenomenon looks beyond the entity."""
    wide = scoped_members(v).where("on_scope <> 'anchor'").select("phenomenon", F.lit(True).alias("spanned")).distinct()
    return D.any_at_risk(*risk_inputs(v)).join(F.broadcast(wide), "phenomenon", "left").na.fill(False, ["spanned"])  # a few authored phenomena


@query(with_views(f"""SELECT tick_seq, count(*) AS total, count(*) FILTER ("full") AS "full", count(*) FILTER (NOT "full") AS degraded, count(*) FILTER (supporting > 0) AS supported, count(*) FILTER ({_WIDE}) AS spanned,
    count(*) FILTER (at_risk > 0) AS at_risk FROM risky GROUP BY 1""", "components", "bindings", "linked", **_EV, **_RADIUS))
def insight_rollup(v):
    return U.insight_rollup(risky(v))


def _hash(*cols):
    row = "concat_ws(chr(1), " + ", ".join(f"coalesce({c}::VARCHAR, chr(2))" for c in cols) + ")"
    return f"sum(('0x' || substr(md5({row}), 1, 15))::BIGINT)::VARCHAR"


@query(with_views(f"SELECT tick_seq, {_hash('rule_id', 'stale', 'state', 'uid')} AS digest, count(*) AS n FROM components GROUP BY 1", "components"))
def tick_digest(v):
    return U.tick_digest(components(v).select("tick_seq", "uid", "rule_id", "state", "stale"), "tick_seq")


@query(f"SELECT c_mktsegment, {_hash('c_name')} AS fingerprint FROM (SELECT DISTINCT c_mktsegment, c_name FROM customer) GROUP BY 1")
def set_fingerprint(v):
    d = v.table("customer").select("c_mktsegment", "c_name").distinct()
    return d.groupBy("c_mktsegment").agg(U.combined_hash("c_name").alias("fingerprint"))


_GRID = [("pinned", 0.05, 1.1), ("wide", 0.1, 1.1), ("deep", 0.05, 1.5), ("wider", 0.5, 1.1)]


@query(with_views("""SELECT point_id, hits, said, "true", round(coalesce(hits / said::DOUBLE, 1), 6) AS precision, round(coalesce(hits / "true"::DOUBLE, 1), 6) AS recall FROM (SELECT point_id, count(*) FILTER (s AND t) AS hits, count(*) FILTER (s) AS said, count(*) FILTER (t) AS "true" FROM (
    SELECT point_id, state IN ('above', 'well-above') AS t, CASE WHEN direction = 'below' THEN value <= bar * (1 + band) ELSE value >= bar * (1 - band) END AS s FROM components, grid) GROUP BY 1)""", "components", grid=_values(_GRID, "point_id, band, well_above")))
def sensitivity_sweep(v):
    c = components(v).join(v.bindings().select("uid", "rule_id", "direction"), ["uid", "rule_id"])
    truth = c.where("state in ('above', 'well-above')").select("tick_seq", "uid", "metric")
    return U.sensitivity_sweep(c, v.spark.createDataFrame(_GRID, "point_id string, band double, well_above double"), truth).withColumns({x: F.round(x, 6) for x in ("precision", "recall")})


_CHECKED = [("click", "bytes", None, "Container"), ("view", "native", None, "Container"), ("purchase_total", "ratio", None, "Container"), ("signup", "ratio", None, "Container"), ("error", "ratio", "click", "Deployment")]
_QA = {
    "checked": _values(_CHECKED, "metric, unit, divisor, entity"),
    "evidence": """SELECT uid, CASE metric WHEN 'purchase' THEN 'purchase_total' ELSE metric END AS metric, concat(stream_id, CASE WHEN metric = 'click' AND uid::INT % 7 = 0 THEN concat('#', arrival % 2) ELSE '' END) AS stream_id,
        CASE WHEN uid::INT % 11 = 0 THEN 'Pod' ELSE 'Container' END AS kind, type, arrival, at_us, CASE WHEN metric = 'purchase' AND uid::INT % 2 = 0 THEN arrival * CASE WHEN uid::INT % 3 = 0 THEN 1000000.0::DOUBLE ELSE 1.0::DOUBLE END
        WHEN metric = 'signup' THEN value / 200.0::DOUBLE WHEN metric = 'click' THEN value - 0.5::DOUBLE ELSE value END AS value FROM readings""",
    "recent": """SELECT *, value < lag(value) OVER (PARTITION BY stream_id ORDER BY arrival) AS fell FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY arrival DESC) AS back FROM evidence) WHERE back <= 8""",
    "streams": """SELECT stream_id, any_value(uid) AS uid, any_value(metric) AS metric, any_value(kind) AS kind, any_value(type) AS type, count(*) AS n, count(*) FILTER (fell) AS decreases, min(value) AS lowest, max(value) AS highest,
        arg_min(value, arrival) AS first, arg_max(value, arrival) AS last, (arg_max(at_us, arrival) - arg_min(at_us, arrival)) / 1e6::DOUBLE AS seconds FROM recent GROUP BY 1""",
    "paired": """SELECT concat(c.uid, '|', k.metric) AS pair, k.*, c.uid::INT % 5 = 0 AS gated, (SELECT count(*) FROM streams s WHERE s.uid = c.uid AND s.metric = k.metric) AS streams, s.kind, s.type, n, decreases, lowest, highest, first, last, seconds,
        (SELECT count(*) FROM streams s WHERE s.uid = c.uid AND s.metric = k.divisor) AS d_streams, (SELECT max(last) FROM streams s WHERE s.uid = c.uid AND s.metric = k.divisor) AS d_last
        FROM (SELECT c_custkey::VARCHAR AS uid FROM customer) c CROSS JOIN checked k LEFT JOIN streams s ON s.uid = c.uid AND s.metric = k.metric""",
    # every test in the order in which the checks are made; the first that speaks counts
    "qa": """SELECT DISTINCT pair, CASE WHEN test IS NULL THEN 'verified' WHEN test IN ('no-stream', 'divisor', 'thin-evidence', 'gate') THEN 'suspect' ELSE 'failed' END AS verdict, test FROM (SELECT pair, CASE
        WHEN streams = 0 THEN 'no-stream' WHEN streams > 1 THEN 'ambiguous' WHEN entity IN ('Container', 'Pod', 'Node') AND kind <> entity THEN 'scope'
        WHEN (ends_with(metric, '_total') AND type = 'gauge') OR (NOT ends_with(metric, '_total') AND type = 'counter') THEN 'character' WHEN (type = 'counter' OR ends_with(metric, '_total')) AND decreases > 1 THEN 'decreases'
        WHEN lowest < 0 THEN 'range' WHEN divisor IS NULL AND unit = 'bytes' AND highest > 1099511627776 THEN 'range' WHEN divisor IS NULL AND unit = 'ratio' AND type <> 'counter' AND highest > 1.5 THEN 'range'
        WHEN divisor IS NULL AND type = 'counter' AND unit = 'ratio' AND n >= 2 AND seconds > 0 AND last >= first AND (last - first) / seconds > 1.5 THEN 'rate-range'
        WHEN divisor IS NOT NULL AND d_streams <> 1 THEN 'divisor' WHEN divisor IS NOT NULL AND (d_last < 0 OR (d_last > 0 AND last / d_last > 1.5)) THEN 'derived-range'
        WHEN n < 2 THEN 'thin-evidence' WHEN gated THEN 'gate' END AS test FROM paired)""",
}


@query(with_views("SELECT * FROM qa", "readings", **_QA))
def binding_qa(v):
    r, uid = v.readings(), F.col("uid").cast("int")
    stream = F.concat("stream_id", F.when((F.col("metric") == "click") & (uid % 7 == 0), F.concat(F.lit("#"), F.col("arrival") % 2)).otherwise(""))
    value = (F.when((F.col("metric") == "purchase") & (uid % 2 == 0), F.col("arrival") * F.when(uid % 3 == 0, 1e6).otherwise(1.0)).when(F.col("metric") == "signup", F.col("value") / 200.0)
             .when(F.col("metric") == "click", F.col("value") - 0.5).otherwise(F.col("value")))
    e = r.select(stream.alias("stream_id"), "uid", F.when(F.col("metric") == "purchase", "purchase_total").otherwise(F.col("metric")).alias("metric"), F.when(uid % 11 == 0, "Pod").otherwise("Container").alias("kind"),
                 "type", "arrival", "at_us", value.alias("value"))
    rules = v.spark.createDataFrame(_CHECKED, "metric string, unit string, divisor string, entity string")
    b = v.table("customer").select(F.col("c_custkey").cast("string").alias("uid")).crossJoin(F.broadcast(rules))  # a few authored rules
    return U.binding_qa(b.withColumns({"pair": F.concat_ws("|", "uid", "metric"), "gates": F.when(uid % 5 == 0, F.array(F.lit("g1")))}), e)


@query(with_views("""SELECT tick_seq, uid, phenomenon, round(completeness, 6) AS completeness, "full", at_risk FROM risky ORDER BY at_risk > 0 DESC, "full" DESC, uid, phenomenon, tick_seq LIMIT 20""", "components", "bindings", "linked", **_EV, **_RADIUS))
def on_call_top(v):
    f, *around = risk_inputs(v)
    top = cut(U.on_call_top(D.any_at_risk(f, *around), 20))  # only their number of entities is shown
    return U.in_call_order(D.count_at_risk(top, *around)).select("tick_seq", "uid", "phenomenon", F.round("completeness", 6).alias("completeness"), "full", "at_risk")


@query("""SELECT o_custkey AS entity, rank, o_orderkey AS id, epoch_us(o_orderdate) AS start_us FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders)""")
def context_list(v):
    o = v.table("orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("start_us"))
    return U.context_list(o)
