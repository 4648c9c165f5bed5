"""Queries over streams of samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telequay.functions import ladder as L
from telequay.operators import signals as S
from telequay.params import SLOW

from .registry import query
from .views import with_views

_R = lambda c: F.round(c, 6).alias(c)


@query(with_views("SELECT tick_seq, stream_id, value, at_us, arrival FROM latest", "latest"))
def latest_by_event_time(v):
    return S.latest_by_event_time(v.readings(), v.ticks()).drop("now_us")


@query(with_views("""SELECT tick_seq, stream_id, arrival, value, back FROM (SELECT *, row_number() OVER (PARTITION BY tick_seq, stream_id ORDER BY arrival DESC) AS back
    FROM readings JOIN ticks ON at_us <= now_us) WHERE back <= 11""", "readings", "ticks"))
def last_n_arrivals(v):
    return S.last_n_arrivals(v.readings(), v.ticks(), SLOW.rate_window_us // SLOW.interval_us + 4).select("tick_seq", "stream_id", "arrival", "value", "back")


@query(with_views("SELECT tick_seq, stream_id, samples, round(delta, 6) AS delta, round(per_second, 9) AS per_second, elapsed_us, resets, gap_broken FROM rates", "rates"))
def rate(v):
    return S.rate(v.readings(), v.ticks(), SLOW).withColumns({"delta": F.round("delta", 6), "per_second": F.round("per_second", 9)})


@query(with_views("SELECT tick_seq, stream_id, samples, round(delta, 6) AS delta, round(per_second, 9) AS per_second, elapsed_us, gap_broken, inconclusive FROM slopes", "slopes"))
def gauge_slope(v):
    return S.gauge_slope(v.readings(), v.ticks(), SLOW).withColumns({"delta": F.round("delta", 6), "per_second": F.round("per_second", 9)})


@query(with_views("""SELECT b.uid, b.rule_id, b.metric, r.stream_id FROM bindings b JOIN (SELECT DISTINCT uid, metric, stream_id FROM readings) r
    ON r.uid = b.uid AND r.metric = b.metric QUALIFY count(*) OVER (PARTITION BY b.uid, b.metric, b.rule_id) = 1""", "bindings", "readings"))
def binding_stream(v):
    return S.usable_bindings(v.bindings(), v.readings().select("uid", "metric", "stream_id", "type").distinct()).select("uid", "rule_id", "metric", "stream_id")


@query(with_views(f"""SELECT n.tick_seq, n.uid, round(n.q / d.q, 6) AS ratio, n.now_us - least(n.at_us, d.at_us) > {SLOW.watermark_us} AS stale FROM
    (SELECT * FROM q WHERE metric = 'purchase') n JOIN (SELECT * FROM q WHERE metric = 'view') d ON n.tick_seq = d.tick_seq AND n.uid = d.uid
    WHERE d.q <> 0 AND n.q IS NOT NULL""", "latest", "rates",
    q="""SELECT l.*, CASE WHEN l.type <> 'counter' THEN l.value WHEN r.samples >= 2 THEN r.delta END AS q
    FROM latest l LEFT JOIN rates r ON r.tick_seq = l.tick_seq AND r.stream_id = l.stream_id"""))
def ratio_pair(v):
    return S.ratio_pair(v.readings(), v.ticks(), "purchase", "view", SLOW).withColumn("ratio", F.round("ratio", 6))


@query(with_views("""SELECT tick_seq, uid, rule_id, metric, stream_id, round(value, 6) AS value, round(bar, 6) AS bar, round(line, 6) AS line, state, stale,
    round(coalesce(slope0, 0), 9) AS slope, coalesce(samples0, 0) AS slope_samples, coalesce(inconclusive0, false) AS slope_inconclusive FROM components""", "components"))
def threshold_component(v):
    d = S.threshold_components(v.readings(), v.ticks(), v.bindings(), SLOW)
    return d.withColumns({c: F.round(c, 6) for c in ("value", "bar", "line")} | {"slope": F.round("slope", 9)})


@query(with_views("""SELECT tick_seq, uid, rule_id, metric, round(delta, 6) AS delta, round(per_second, 9) AS per_second, resets, gap_broken, inconclusive, breached, stale
    FROM guards""", "guards"))
def rate_guard(v):
    return S.rate_guards(v.readings(), v.ticks(), v.bindings(), SLOW).withColumns({"delta": F.round("delta", 6), "per_second": F.round("per_second", 9)})


@query(with_views("""SELECT tick_seq, uid, string_agg(concat_ws('/', rule_id, metric, state, CASE WHEN stale THEN 'true' ELSE 'false' END), ';' ORDER BY rule_id, metric) AS thresholds
    FROM components GROUP BY ALL""", "components"))
def fingerprint(v):
    d = S.fingerprints(S.threshold_components(v.readings(), v.ticks(), v.bindings(), SLOW))
    text = F.transform("thresholds", lambda t: F.concat_ws("/", t["rule_id"], t["metric"], t["state"], t["stale"].cast("string")))
    return d.select("tick_seq", "uid", F.concat_ws(";", text).alias("thresholds"))


@query(with_views("""SELECT tick_seq, uid, bool_or(hit) AS crossed FROM (SELECT tick_seq, uid, state IN ('above', 'well-above') AND NOT stale AS hit FROM components
    UNION ALL SELECT tick_seq, uid, breached AND NOT stale AND NOT inconclusive FROM guards) GROUP BY ALL""", "components", "guards"))
def entity_crossed(v):
    return S.entity_crossed(S.threshold_components(v.readings(), v.ticks(), v.bindings(), SLOW), S.rate_guards(v.readings(), v.ticks(), v.bindings(), SLOW))


@query(with_views("""SELECT tick_seq, uid, CASE WHEN n = 0 THEN 'unknown' WHEN n = n_met THEN 'all-met' WHEN n_met = 0 THEN 'none' ELSE 'partial' END AS state, n_met, n
    FROM (SELECT tick_seq, uid, count(met) AS n, count(*) FILTER (met) AS n_met FROM
    (SELECT tick_seq, uid, CASE WHEN NOT stale THEN state IN ('above', 'well-above') END AS met FROM components) GROUP BY ALL)""", "components"))
def cooccurrence(v):
    d = S.threshold_components(v.readings(), v.ticks(), v.bindings(), SLOW)
    return S.cooccurrence(d.select("tick_seq", "uid", F.when(~F.col("stale"), L.crossed(F.col("state"))).alias("met")), "tick_seq", "uid")


@query(with_views("SELECT tick_seq, uid, metric, how FROM loud", "loud"))
def loud_states(v):
    return S.loud_states(S.threshold_components(v.readings(), v.ticks(), v.bindings(), SLOW), S.rate_guards(v.readings(), v.ticks(), v.bindings(), SLOW))


@query(with_views("""SELECT tick_seq, uid, concat_ws(',', list_sort(list(DISTINCT metric))) AS signature FROM loud GROUP BY ALL""".replace(
    "concat_ws(',', list_sort(list(DISTINCT metric)))", "string_agg(DISTINCT metric, ',' ORDER BY metric)"), "loud"))
def signature(v):
    return loud_states(v).groupBy("tick_seq", "uid").agg(F.concat_ws(",", F.array_sort(F.collect_set("metric"))).alias("signature"))


@query(with_views("""SELECT arrival, bar, direction, factor, round(CASE WHEN direction = 'below' THEN bar / 1.1::DOUBLE WHEN factor > 0 AND factor < 1 THEN bar / factor
    ELSE bar * 1.1::DOUBLE END, 6) AS line FROM readings r JOIN bindings b ON r.uid = b.uid AND r.metric = b.metric""", "readings", "bindings"))
def well_above_line(v):
    d = v.readings().join(v.bindings(), ["uid", "metric"])
    return d.select("arrival", "bar", "direction", "factor", F.round(L.well_above_line(F.col("bar"), F.col("factor"), F.lit(1.1), F.col("direction")), 6).alias("line"))


@query(with_views("""SELECT arrival, direction, CASE WHEN direction = 'below' THEN CASE WHEN value <= bar / 1.1::DOUBLE THEN 'well-above' WHEN value < bar THEN 'above'
    WHEN value <= bar * 1.05::DOUBLE THEN 'at-threshold' ELSE 'below' END
    WHEN value >= bar * 1.1::DOUBLE THEN 'well-above' WHEN value >= bar THEN 'above' WHEN value >= bar * 0.95::DOUBLE THEN 'at-threshold' ELSE 'below' END AS state
    FROM readings r JOIN bindings b ON r.uid = b.uid AND r.metric = b.metric""", "readings", "bindings"))
def threshold_ladder(v):
    d = v.readings().join(v.bindings(), ["uid", "metric"])
    line = F.when(F.col("direction") == "below", F.col("bar") / 1.1).otherwise(F.col("bar") * 1.1)
    return d.select("arrival", "direction", L.ladder(F.col("value"), F.col("bar"), line, F.lit(0.05), F.col("direction")).alias("state"))


@query(with_views(f"SELECT tick_seq, stream_id, now_us - at_us > {SLOW.watermark_us} AS stale FROM latest", "latest"))
def staleness(v):
    d = S.latest_by_event_time(v.readings(), v.ticks())
    return d.select("tick_seq", "stream_id", L.stale(F.col("at_us"), F.col("now_us"), SLOW.watermark_us).alias("stale"))


_CHECKS = [("level", "crossed", ""), ("level", "at-or-above", ""), ("slope", "rising", "at-threshold"), ("slope", "falling", ""), ("ratio", "other", ""), ("odd", "crossed", "")]


@query(with_views("""SELECT tick_seq, uid, rule_id, facet, expect,
    CASE WHEN facet = 'slope' THEN (NOT ns) AND rk >= mk AND CASE expect WHEN 'rising' THEN slope > 0 ELSE slope < 0 END
         WHEN facet IN ('level', 'ratio') THEN NOT stale AND expect IN ('crossed', 'at-or-above') AND rk >= 3 ELSE false END AS met,
    CASE WHEN facet = 'slope' THEN NOT ns WHEN facet IN ('level', 'ratio') THEN NOT stale ELSE false END AS fresh,
    CASE WHEN facet = 'slope' THEN CASE WHEN ns THEN 'no-slope' ELSE state END WHEN facet IN ('level', 'ratio') THEN CASE WHEN stale THEN 'no-sample' ELSE state END
         ELSE 'unknown-facet' END AS seen FROM (
    SELECT c.*, k.*, coalesce(slope0, 0) AS slope, stale OR coalesce(inconclusive0, false) OR coalesce(samples0, 0) < 2 AS ns,
    list_position(['unknown', 'below', 'at-threshold', 'above', 'well-above'], state) - 1 AS rk,
    CASE min_state WHEN 'at-threshold' THEN 2 WHEN 'above' THEN 3 WHEN 'well-above' THEN 4 ELSE 0 END AS mk FROM components c,
    (VALUES """.replace("\n", "\n") + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _CHECKS) + ") k(facet, expect, min_state))", "components"))
def member_check(v):
    d = S.threshold_components(v.readings(), v.ticks(), v.bindings(), SLOW)
    checks = v.spark.createDataFrame(_CHECKS, "facet string, expect string, min_state string")
    none = F.lit(None).cast("boolean")
    c = L.member_check(F.col("facet"), F.col("expect"), F.col("min_state"), F.col("state"), F.col("stale"), F.col("slope"), F.col("slope_samples"),
                       F.col("slope_inconclusive"), none, none)
    return d.crossJoin(F.broadcast(checks)).withColumn("c", c).select("tick_seq", "uid", "rule_id", "facet", "expect", "c.met", "c.fresh", "c.seen")


@query(with_views("""SELECT tick_seq, stream_id, round(value, 6) AS value, value >= 100 AS crossed_above, value <= 100 AS crossed_below FROM latest""", "latest"))
def already_crossed(v):
    d = S.latest_by_event_time(v.readings(), v.ticks())
    return d.select("tick_seq", "stream_id", F.round("value", 6).alias("value"), L.already_crossed(F.col("value"), F.lit(100.0), F.lit("above")).alias("crossed_above"),
                    L.already_crossed(F.col("value"), F.lit(100.0), F.lit("below")).alias("crossed_below"))


@query(with_views("""SELECT stream_id, n, round(s, 9) AS spread, s < 0.5::DOUBLE AS flat FROM (SELECT stream_id, count(*) AS n, stddev_pop(value) FILTER (k <= 64)
    / CASE WHEN abs(max(value) FILTER (k = 1)) > 0 THEN abs(max(value) FILTER (k = 1)) ELSE 1 END AS s FROM
    (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY arrival DESC) AS k FROM readings) GROUP BY ALL)""", "readings"))
def flat(v):
    newest = F.row_number().over(W.partitionBy("stream_id").orderBy(F.col("arrival").desc()))
    tail = F.collect_list(F.when(F.col("k") <= 64, F.struct("arrival", "value")))  # only the last are held
    d = v.readings().select("stream_id", "arrival", "value", newest.alias("k")).groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(tail), lambda x: x["value"]).alias("series"))
    return d.select("stream_id", "n", F.round(L.spread(F.col("series")), 9).alias("spread"), L.is_flat(F.col("series"), 0.5).alias("flat"))


@query(with_views("""SELECT arrival, CASE WHEN late IS NULL THEN 'wide' WHEN (late - early) / 240.0::DOUBLE <= 0.2::DOUBLE THEN 'tight'
    WHEN (late - early) / 240.0::DOUBLE <= 0.45::DOUBLE THEN 'moderate' ELSE 'wide' END AS class FROM
    (SELECT arrival, arrival % 60 AS early, CASE WHEN arrival % 5 > 0 THEN arrival % 60 + arrival % 170 END AS late FROM readings)""", "readings"))
def confidence_class(v):
    d = v.readings().select("arrival", (F.col("arrival") % 60).alias("early"), F.when(F.col("arrival") % 5 > 0, F.col("arrival") % 60 + F.col("arrival") % 170).alias("late"))
    return d.select("arrival", L.confidence_class(F.col("early"), F.col("late"), F.lit(240.0)).alias("class"))
