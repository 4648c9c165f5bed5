"""Queries of the replay: every tick under the bars of its epoch, and digests against recorded ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from telequay.operators import binding as OB
from telequay.operators import detect as D
from telequay.operators import signals as S
from telequay.operators import surfaces as U
from telequay.operators import sweep
from telequay.operators.lineage import cut
from telequay.params import DAY, SLOW

from .detection import _EV, _SPAN, _SPANNED, _values, components, linked, members
from .registry import query
from .surfaces import _hash
from .views import FIRST_TICK, VIEWS, with_views

#: Compiles of the bars: when, and what epoch they began; the second halves every tenth entity's bars.
COMPILES = [(FIRST_TICK - DAY, 0), (FIRST_TICK + 12 * DAY, 1)]
_E = {
    "bars": "SELECT b.* EXCLUDE (bar), CASE WHEN epoch = 1 AND uid::INT % 10 = 0 THEN bar * 0.5::DOUBLE ELSE bar END AS bar, epoch FROM bindings b, (VALUES (0), (1)) t(epoch)",
    "epochs": f"SELECT tick_seq, CASE WHEN now_us >= {COMPILES[1][0]} THEN 1 ELSE 0 END AS epoch FROM ticks",
    "components_e": VIEWS["components"].replace("JOIN bindings b ON l.uid = b.uid AND l.metric = b.metric", "JOIN epochs e ON e.tick_seq = l.tick_seq JOIN bars b ON l.uid = b.uid AND l.metric = b.metric AND b.epoch = e.epoch"),
    "members": _EV["members"], **{f"{k}_e": text.replace("components", "components_e").replace("FROM ev", "FROM ev_e") for k, text in _EV.items() if k != "members"}}


def replayed(v):
    """Components of every tick under the bars of its epoch."""
    epochs = OB.epoch_of_ticks(v.ticks(), v.spark.createDataFrame(COMPILES, "at_us long, epoch long"))
    two = v.bindings().crossJoin(F.broadcast(v.spark.createDataFrame([(e,) for _, e in COMPILES], "epoch long")))  # a row an epoch
    half = (F.col("epoch") == 1) & (F.col("uid").cast("int") % 10 == 0)
    return S.threshold_components(v.readings(), v.ticks(), two.withColumn("bar", F.when(half, F.col("bar") * 0.5).otherwise(F.col("bar"))), SLOW, epochs)


@query(with_views('SELECT tick_seq, uid, phenomenon, round(completeness, 6) AS completeness, "full", supporting FROM found_e', "components", **_E))
def as_of_replay(v):
    return D.match_local(D.evidence(cut(replayed(v)), members(v))).withColumn("completeness", F.round("completeness", 6))


_ROW = ("rule_id", "stale", "state", "uid")


@query(with_views(f"""SELECT coalesce(a.tick_seq, b.tick_seq) AS tick_seq, CASE WHEN b.d IS NULL THEN 'missing' WHEN a.d IS NULL THEN 'unrecorded' WHEN a.d = b.d THEN 'equal' ELSE 'differs' END AS state FROM
    (SELECT tick_seq, {_hash(*_ROW)} AS d FROM components GROUP BY 1) a FULL JOIN (SELECT tick_seq, {_hash(*_ROW)} AS d FROM components_e GROUP BY 1) b ON a.tick_seq = b.tick_seq""", "components", **_E))
def replay_digests(v):
    """What one set of bars recorded against the replay by epochs: ticks differ from the second epoch on."""
    digest = lambda c: U.tick_digest(c.select("tick_seq", *_ROW), "tick_seq")
    return U.compare_digests(digest(components(v)), digest(replayed(v)))


#: The settings of the sweep, the checks that it makes, and the relations that it looks along.
GRID = [("pinned", 0.05, 1.1, 0.0, 28 * DAY), ("wide", 0.3, 1.1, 0.0, 28 * DAY), ("floor", 0.05, 1.1, 0.75, 28 * DAY), ("short", 0.05, 1.1, 0.0, 5 * DAY)]
CHECKS = [("storm", "s-click", "required", "click", "level", "crossed", None, "anchor"), ("storm", "s-error", "required", "error", "level", "at-or-above", None, "neighbour"), ("storm", "s-hidden", "supporting", None, None, None, None, "two-hop"),
          ("drain", "s-purchase", "required", "purchase", "rate-guard", "breached", None, "anchor"), ("drain", "s-hidden", "required", None, None, None, None, "anchor"),
          ("spike", "s-signup", "required", "signup", "slope", "rising", "at-threshold", "anchor"), ("spike", "s-error", "supporting", "error", "level", "crossed", None, "two-hop"), ("spike", "s-view", "required", "view", "level", "crossed", None, "anchor")]
LEADS = [("drain", "storm"), ("spike", "drain"), ("storm", "spike"), ("storm", "storm")]
EXPECTED = [(1, "drain", "storm", FIRST_TICK, FIRST_TICK + 8 * DAY), (2, "storm", "storm", FIRST_TICK + 4 * DAY, FIRST_TICK + 12 * DAY), (3, "spike", "drain", FIRST_TICK, FIRST_TICK + 4 * DAY)]
_GRID, _CHECKS = "point_id string, band double, well_above double, floor double, cascade_us long", "phenomenon string, signal string, role string, metric string, facet string, expect string, min_state string, on_scope string"
_LABELS = f"""SELECT c_custkey AS l_id, (['storm', 'drain', 'spike'])[(c_custkey % 3 + 1)::INT] AS phenomenon, c_custkey::VARCHAR AS uid, {FIRST_TICK} + (c_custkey % 5) * {5 * DAY} - {DAY} AS from_us,
    {FIRST_TICK} + (c_custkey % 5) * {5 * DAY} + (c_custkey % 7) * {2 * DAY} AS to_us FROM customer"""
_RANK = "(CASE {} WHEN 'well-above' THEN 4 WHEN 'above' THEN 3 WHEN 'at-threshold' THEN 2 WHEN 'below' THEN 1 ELSE 0 END)"
_SWEEP = {
    "grid": _values(GRID, "point_id, band, well_above, floor, cascade_us"), "checks": _values(CHECKS, "phenomenon, signal, role, metric, facet, expect, min_state, on_scope"),
    "leads": _values(LEADS, '"trigger", downstream'), "expected": _values(EXPECTED, 'c_id, "trigger", downstream, from_us, to_us'), "labels": _LABELS,
    # every observation under every setting
    "seen": """SELECT concat(point_id, '|', tick_seq) AS tick_seq, uid, metric, CASE WHEN direction = 'below' THEN CASE WHEN value <= bar / well_above THEN 'well-above' WHEN value < bar THEN 'above' WHEN value <= bar * (1 + band) THEN 'at-threshold' ELSE 'below' END
        WHEN value >= CASE WHEN factor > 0 AND factor < 1 THEN bar / factor ELSE bar * well_above END THEN 'well-above' WHEN value >= bar THEN 'above' WHEN value >= bar * (1 - band) THEN 'at-threshold' ELSE 'below' END AS state,
        stale, slope0 AS slope, samples0 AS samples, inconclusive0 AS no_slope, NULL::BOOLEAN AS breached, NULL::BOOLEAN AS inconclusive FROM (SELECT c.*, b.factor FROM components c JOIN bindings b USING (uid, metric, rule_id) WHERE c.metric <> 'purchase'), grid
        UNION ALL SELECT concat(point_id, '|', tick_seq), uid, metric, NULL, stale, NULL, NULL, NULL, breached, inconclusive FROM guards, grid WHERE metric = 'purchase'""",
    "results": f"""SELECT tick_seq, uid, concat_ws('/', phenomenon, signal, role, metric) AS metric, CASE facet WHEN 'slope' THEN CASE WHEN stale OR no_slope OR samples < 2 OR slope IS NULL THEN NULL ELSE slope > 0 AND {_RANK.format('state')} >= {_RANK.format('min_state')} END
        WHEN 'level' THEN CASE WHEN NOT stale THEN state IN ('above', 'well-above') END ELSE CASE WHEN NOT stale AND NOT inconclusive THEN breached END END AS met FROM seen JOIN checks USING (metric)""",
    "checked": "SELECT tick_seq, uid, metric, CASE WHEN met THEN 'above' ELSE 'below' END AS state, met IS NULL AS stale FROM results",
    "members": "SELECT phenomenon, signal, role, CASE WHEN metric IS NOT NULL THEN concat_ws('/', phenomenon, signal, role, metric) END AS metric, on_scope FROM checks",
    "ev": _EV["ev"].replace("m.metric, coalesce", "m.metric, on_scope, coalesce").replace("components", "checked"), "scoped": "SELECT * FROM ev",
    "linked_p": "SELECT concat(point_id, '|', tick_seq) AS tick_seq, from_key, to_key, verdict FROM linked, grid WHERE type = 'runs-on'",
    "step": "SELECT tick_seq, from_key AS uid, to_key AS target, verdict FROM linked_p UNION SELECT tick_seq, to_key, from_key, verdict FROM linked_p",
    "one": _SPAN["one"].replace("components", "checked"), "reached": _SPAN["reached"], "sfound": _SPANNED,
    "kept": """SELECT f.*, point_id, t.tick_seq AS tick, now_us, cascade_us FROM sfound f JOIN grid g ON f.tick_seq[:length(point_id) + 1] = concat(point_id, '|') JOIN ticks t ON t.tick_seq::VARCHAR = split_part(f.tick_seq, '|', 2) WHERE "full" OR completeness >= floor""",
    "pairs": f"""SELECT d.point_id, d.tick, d.now_us, d.cascade_us, d.tick_seq, d.uid, r.downstream, r."trigger", t.uid AS trigger_uid, max(t.now_us) AS trigger_us FROM kept d JOIN leads r ON r.downstream = d.phenomenon
        JOIN kept t ON t.point_id = d.point_id AND t.phenomenon = r."trigger" AND t.now_us BETWEEN d.now_us - {28 * DAY} AND d.now_us AND (t.phenomenon <> d.phenomenon OR t.uid <> d.uid)
        WHERE t.uid = d.uid OR EXISTS (SELECT 1 FROM step s WHERE s.tick_seq = d.tick_seq AND s.uid = d.uid AND s.target = t.uid) GROUP BY ALL""",
    "cascades": 'SELECT *, EXISTS (SELECT 1 FROM expected e WHERE e."trigger" = p."trigger" AND e.downstream = p.downstream AND now_us BETWEEN from_us AND to_us) AS hit FROM pairs p WHERE trigger_us >= now_us - cascade_us'}


def swept(v):
    """(findings, cascades) of every tick under every setting: levels of gauges, rate guards of one counter, checks on the entity and around it."""
    bound, t = v.bindings(), v.spark.createDataFrame
    none = t([], "numerator string, divisor string, metric string, bar double, factor double, direction string")
    seen = sweep.observations(v.readings(), v.ticks(), bound.where("metric <> 'purchase'"), none, bound.where("metric = 'purchase'"), SLOW)
    return sweep.replay(seen, v.ticks(), t(CHECKS, _CHECKS), t(LEADS, "trigger string, downstream string"), linked(v).where("type = 'runs-on'"), t(GRID, _GRID))


@query(with_views("""SELECT point_id, tick AS tick_seq, now_us, uid, phenomenon, round(completeness, 6) AS completeness, "full", suspect FROM kept""", "components", "guards", "linked", **_SWEEP))
def replay_under_settings(v):
    return swept(v)[0].withColumn("completeness", F.round("completeness", 6))


@query(with_views("""SELECT g.point_id, coalesce(found, 0) AS found, coalesce("right", 0) AS "right", coalesce(caught, 0) AS caught, coalesce(cascades_hit, 0) AS cascades_hit, coalesce(cascades_false, 0) AS cascades_false,
    (SELECT count(*) FROM labels) AS labels, 3 AS cascades_expected, round(coalesce("right" / found::DOUBLE, 1), 6) AS precision, round(coalesce(caught, 0) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS recall FROM grid g
    LEFT JOIN (SELECT point_id, count(*) AS found, count(*) FILTER (EXISTS (SELECT 1 FROM labels l WHERE l.phenomenon = k.phenomenon AND l.uid = k.uid AND now_us BETWEEN from_us AND to_us)) AS "right" FROM kept k GROUP BY 1) a ON a.point_id = g.point_id
    LEFT JOIN (SELECT point_id, count(DISTINCT l_id) AS caught FROM kept k JOIN labels l ON l.phenomenon = k.phenomenon AND l.uid = k.uid AND now_us BETWEEN from_us AND to_us GROUP BY 1) b ON b.point_id = g.point_id
    LEFT JOIN (SELECT point_id, count(DISTINCT c_id) AS cascades_hit FROM cascades c JOIN expected e ON e."trigger" = c."trigger" AND e.downstream = c.downstream AND now_us BETWEEN from_us AND to_us GROUP BY 1) h ON h.point_id = g.point_id
    LEFT JOIN (SELECT point_id, count(*) AS cascades_false FROM cascades WHERE NOT hit GROUP BY 1) x ON x.point_id = g.point_id""", "components", "guards", "linked", **_SWEEP))
def sweep_scores(v):
    """Precision, recall and cascades of the replay under every setting, against labels."""
    c = v.table("customer")
    k, kind = F.col("c_custkey"), F.array(*map(F.lit, ("storm", "drain", "spike")))
    start = FIRST_TICK + (k % 5) * F.lit(5 * DAY)
    labels = c.select(k.alias("l_id"), F.element_at(kind, (k % 3 + 1).cast("int")).alias("phenomenon"), k.cast("string").alias("uid"), (start - DAY).alias("from_us"), (start + (k % 7) * F.lit(2 * DAY)).alias("to_us"))
    expected = v.spark.createDataFrame(EXPECTED, "c_id long, trigger string, downstream string, from_us long, to_us long")
    d = sweep.score(*swept(v), labels, expected, v.spark.createDataFrame(GRID, _GRID))
    return d.withColumns({x: F.round(x, 6) for x in ("precision", "recall")})
