"""Queries of the forecast gate: every sample as an origin, its forecast, what came of it, and a verdict a metric."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telequay.operators import gate as T
from telequay.params import HOUR

from .registry import query
from .views import with_views

HORIZON, LAST_N, Z, CADENCE, RATIO = 12, 16, 1.2815515655446004, 12 * HOUR, 0.9
GATE = T.Gate(min_future=4, lookback=8, min_lead=2, min_crossings=3, min_events=3, coverage=(0.5, 0.98), recall=0.2, false_rate=0.5, in_band=0.5)

# Samples of five neighbouring users of a metric are one stream, smoothed over eight; errors are warned of below 30, other metrics above 42.
_LEVELS = """SELECT metric AS class, concat(metric, '|', uid::INT // 5) AS stream, at_us, avg(value) OVER (PARTITION BY metric, uid::INT // 5 ORDER BY at_us, arrival ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS value FROM readings"""
_BAR = "CASE WHEN class = 'error' THEN 30.0::DOUBLE ELSE 42.0::DOUBLE END AS bar, CASE WHEN class = 'error' THEN 'below' ELSE 'above' END AS direction"
_CTE = {
    "levels": _LEVELS,
    "s": "SELECT *, row_number() OVER (PARTITION BY stream ORDER BY at_us, value) AS pos FROM levels",
    "o": f"""SELECT *, {_BAR} FROM (SELECT class, stream, at_us AS basis_us, value AS last, pos, greatest(coalesce(stddev_pop(d) OVER w, 0), 1e-9) AS sigma, coalesce(avg(d) OVER w, 0) AS drift
        FROM (SELECT *, value - lag(value) OVER (PARTITION BY stream ORDER BY pos) AS d FROM s) WINDOW w AS (PARTITION BY stream ORDER BY pos ROWS BETWEEN {LAST_N - 1} PRECEDING AND CURRENT ROW)) WHERE pos >= 4""",
    "f": f"""SELECT stream, pos, h, last + drift * (h + 1) AS point, last + drift * (h + 1) - {Z} * sigma * sqrt(h + 1) AS lo, last + drift * (h + 1) + {Z} * sigma * sqrt(h + 1) AS hi FROM o, (SELECT unnest(range({HORIZON})) AS h)""",
    "c": f"""SELECT o.*, p, e, l, CASE WHEN CASE direction WHEN 'below' THEN last <= bar ELSE last >= bar END THEN 'already-crossed' WHEN p IS NULL THEN 'no-crossing'
        WHEN (coalesce(l, {HORIZON}) - least(coalesce(e, p), p)) / {HORIZON}::DOUBLE > {RATIO}::DOUBLE THEN 'band-too-wide' END AS silence FROM o JOIN (
        SELECT o.stream, o.pos, min(h) FILTER (CASE direction WHEN 'below' THEN point <= bar ELSE point >= bar END) AS p, min(h) FILTER (CASE direction WHEN 'below' THEN lo <= bar ELSE hi >= bar END) AS e,
        min(h) FILTER (CASE direction WHEN 'below' THEN hi <= bar ELSE lo >= bar END) AS l FROM o JOIN f ON f.stream = o.stream AND f.pos = o.pos GROUP BY ALL) x ON x.stream = o.stream AND x.pos = o.pos""",
    # each forecast with every sample after its basis, counted from 0
    "after_basis": f"SELECT c.stream, c.pos, c.bar, c.direction, s.at_us, s.value, row_number() OVER (PARTITION BY c.stream, c.pos ORDER BY s.pos) - 1 AS h FROM c JOIN s ON s.stream = c.stream AND s.at_us > c.basis_us",
    "future": f"""SELECT c.*, coalesce(n, 0) AS n, least(coalesce(n, 0), {HORIZON}) AS steps FROM c LEFT JOIN (SELECT stream, pos, count(*) AS n FROM after_basis GROUP BY ALL) a ON a.stream = c.stream AND a.pos = c.pos""",
    "hit": """SELECT a.stream, a.pos, min(a.h) AS h FROM after_basis a JOIN future u ON u.stream = a.stream AND u.pos = a.pos WHERE a.h < u.steps AND CASE a.direction WHEN 'below' THEN a.value <= a.bar ELSE a.value >= a.bar END GROUP BY ALL""",
    "crossing": f"""SELECT h.stream, h.pos, h.h, a.at_us, NOT coalesce(CASE a.direction WHEN 'below' THEN b.value > a.bar * (1 + {GATE.band}::DOUBLE) ELSE b.value < a.bar * (1 - {GATE.band}::DOUBLE) END, false) AS hover
        FROM hit h JOIN after_basis a ON a.stream = h.stream AND a.pos = h.pos AND a.h = h.h JOIN (SELECT stream, at_us, min(pos) AS k FROM s GROUP BY ALL) i ON i.stream = a.stream AND i.at_us = a.at_us
        LEFT JOIN s b ON b.stream = a.stream AND b.pos = i.k - {GATE.lookback}""",
    "r": f"""SELECT u.*, u.steps < {GATE.min_future} AS skipped, n >= {HORIZON} AS full_obs, x.h AS actual_h, x.at_us AS crossing_us, x.hover, CASE WHEN silence IS NULL AND x.h IS NOT NULL THEN p - x.h END AS err,
        x.at_us >= basis_us + (least(coalesce(e, p), p) + 1) * {CADENCE} AND (l IS NULL OR x.at_us <= basis_us + (l + 1) * {CADENCE}) AS within_band
        FROM future u LEFT JOIN crossing x ON x.stream = u.stream AND x.pos = u.pos AND u.steps >= {GATE.min_future}""",
    "ledger": """SELECT class, stream, crossing_us, bool_or(hover) AS hover, arg_min(hover, pos) AS first_hover, CASE WHEN NOT bool_or(hover) THEN max(actual_h + 1) FILTER (silence IS NULL) END AS lead
        FROM r WHERE crossing_us IS NOT NULL GROUP BY ALL""",
    "cover": """SELECT r.class, count(*) AS points, count(*) FILTER (a.value BETWEEN f.lo AND f.hi) AS inside FROM r JOIN after_basis a ON a.stream = r.stream AND a.pos = r.pos AND a.h < r.steps
        JOIN f ON f.stream = r.stream AND f.pos = r.pos AND f.h = a.h WHERE NOT skipped GROUP BY ALL""",
    "fig": f"""SELECT a.*, points, inside, events, events_warned, hover_excluded, inside / points::DOUBLE AS coverage, CASE WHEN events > 0 THEN events_warned / events::DOUBLE END AS event_recall,
        CASE WHEN observed > 0 THEN false_warnings / observed::DOUBLE END AS false_rate, CASE WHEN warned > 0 THEN in_band / warned::DOUBLE END AS in_band_rate FROM (SELECT class, count(*) FILTER (NOT skipped) AS forecasts,
        count(*) FILTER (skipped) AS skipped, count(actual_h) AS crossings, count(actual_h) FILTER (silence IS NULL) AS warned, count(actual_h) FILTER (silence IS NOT NULL) AS missed,
        count(*) FILTER (NOT skipped AND silence IS NULL AND (actual_h IS NOT NULL OR full_obs)) AS observed, count(*) FILTER (NOT skipped AND silence IS NULL AND actual_h IS NULL AND full_obs) AS false_warnings,
        count(*) FILTER (NOT skipped AND silence IS NOT NULL AND actual_h IS NULL) AS silences_correct, count(*) FILTER (silence IS NULL AND actual_h IS NOT NULL AND within_band) AS in_band,
        median(err) AS median_err, median(abs(err) / (actual_h + 1)::DOUBLE) AS median_frac FROM r GROUP BY 1) a LEFT JOIN cover c ON c.class = a.class
        LEFT JOIN (SELECT class, count(*) FILTER (NOT hover) AS events, count(*) FILTER (lead >= {GATE.min_lead}) AS events_warned, count(*) FILTER (first_hover) AS hover_excluded FROM ledger GROUP BY 1) g ON g.class = a.class""",
}


def levels(v):
    group = F.floor(F.col("uid").cast("int") / 5)
    smooth = F.avg("value").over(W.partitionBy("metric", group).orderBy("at_us", "arrival").rowsBetween(-7, 0))
    return v.readings().select(F.col("metric").alias("class"), F.concat_ws("|", "metric", group.cast("string")).alias("stream"), "at_us", smooth.alias("value"))


def traces(v, with_drift=True):
    s = levels(v)
    idx = F.row_number().over(W.partitionBy("stream").orderBy("at_us", "value")) - 1
    origins = T.rolling_origins(s.select(F.col("stream").alias("target"), idx.alias("idx"), "at_us", "value"), LAST_N, 4)
    error = F.substring_index("target", "|", 1) == "error"
    origins = origins.withColumns({"class": F.substring_index("target", "|", 1), "bar": F.when(error, 30.0).otherwise(42.0), "direction": F.when(error, "below").otherwise("above")})
    return T.forecast_traces(origins, HORIZON, Z, CADENCE, RATIO, with_drift)


def outcomes(v):
    return T.scored(traces(v), levels(v), GATE, CADENCE)


@query(with_views("SELECT stream, pos - 1 AS seq, basis_us, round(last, 6) AS last, round(sigma, 6) AS sigma, floor(drift * 1000 + 0.31::DOUBLE)::BIGINT AS drift_milli FROM o", "readings", **{k: _CTE[k] for k in ("levels", "s", "o")}))
def rolling_origins(v):
    s = levels(v)
    idx = F.row_number().over(W.partitionBy("stream").orderBy("at_us", "value")) - 1
    o = T.rolling_origins(s.select(F.col("stream").alias("target"), idx.alias("idx"), "at_us", "value"), LAST_N, 4)
    return o.select(F.col("target").alias("stream"), F.col("idx").cast("long").alias("seq"), "basis_us", *[F.round(c, 6).alias(c) for c in ("last", "sigma")],
                    F.floor(F.col("drift") * 1000 + 0.31).cast("long").alias("drift_milli"))  # drifts are often exact ties of a rounding to places


@query(with_views("SELECT stream, pos - 1 AS seq, steps, skipped, full_obs, actual_h, crossing_us, hover, silence, err, CASE WHEN err IS NOT NULL THEN within_band END AS in_band FROM r", "readings", **_CTE))
def forecast_outcomes(v):
    return outcomes(v).select("stream", "seq", "steps", "skipped", "full_obs", "actual_h", "crossing_us", "hover", "silence", F.col("err").cast("long").alias("err"), "in_band")


@query(with_views("SELECT class, stream, crossing_us, hover, first_hover, lead FROM ledger", "readings", **_CTE))
def event_ledger(v):
    return T.event_ledger(outcomes(v))


@query(with_views("SELECT class, warned AS n, median_err AS median_error, round(median_frac, 6) AS median_relative FROM fig", "readings", **_CTE))
def ttc_error(v):
    f = T.figures(outcomes(v), levels(v), GATE, HORIZON)
    return f.select("class", F.col("warned").alias("n"), F.col("median_err").alias("median_error"), F.round("median_frac", 6).alias("median_relative"))


@query(with_views("SELECT class, silence AS reason, count(*) AS n FROM r WHERE actual_h IS NOT NULL AND silence IS NOT NULL GROUP BY ALL", "readings", **_CTE))
def gate_misses(v):
    return T.misses(outcomes(v))


_SHOWN = ("forecasts", "skipped", "crossings", "warned", "missed", "observed", "false_warnings", "silences_correct", "in_band", "points", "inside", "events", "events_warned", "hover_excluded")


@query(with_views(f"""SELECT class, {', '.join(_SHOWN)}, CASE WHEN thin IS NOT NULL THEN 'insufficient' WHEN failed <> '' THEN 'failed' ELSE 'passed' END AS verdict, coalesce(thin, failed) AS reasons FROM (
    SELECT *, CASE WHEN forecasts < {GATE.min_forecasts} THEN 'thin-corpus' WHEN crossings < {GATE.min_crossings} THEN 'crossing-evidence' WHEN events < {GATE.min_events} THEN 'event-evidence' END AS thin,
    concat_ws(',', CASE WHEN NOT coverage BETWEEN {GATE.coverage[0]} AND {GATE.coverage[1]} THEN 'coverage' END, CASE WHEN event_recall < {GATE.recall} THEN 'event-recall' END,
    CASE WHEN false_rate > {GATE.false_rate} THEN 'false-warnings' END, CASE WHEN in_band_rate < {GATE.in_band} THEN 'in-band' END) AS failed FROM fig)""", "readings", **_CTE))
def gate_verdict(v):
    return T.forecast_gate(traces(v), levels(v), GATE, CADENCE, HORIZON).select("class", *_SHOWN, "verdict", "reasons")


DROP = 0.15
_AB = _CTE | {
    "levels0": _LEVELS, "levels": "SELECT concat(arm, '|', class) AS class, concat(arm, '|', stream) AS stream, at_us, value FROM levels0, (VALUES ('with'), ('without')) t(arm)",
    "cut": f"""SELECT *, CASE WHEN class LIKE 'without|%' THEN 0 ELSE sum(fell) OVER (PARTITION BY stream ORDER BY pos) END AS seg FROM (
        SELECT *, coalesce(((lag(value) OVER w) > 0 AND (lag(value) OVER w) - value > {DROP}::DOUBLE * (lag(value) OVER w))::INT, 0) AS fell FROM s WINDOW w AS (PARTITION BY stream ORDER BY pos))""",
    "o": f"""SELECT *, CASE WHEN class LIKE '%|error' THEN 30.0::DOUBLE ELSE 42.0::DOUBLE END AS bar, CASE WHEN class LIKE '%|error' THEN 'below' ELSE 'above' END AS direction FROM (
        SELECT class, stream, at_us AS basis_us, value AS last, pos, greatest(coalesce(stddev_pop(d) OVER w, 0), 1e-9) AS sigma, coalesce(avg(d) OVER w, 0) AS drift
        FROM (SELECT *, value - lag(value) OVER (PARTITION BY stream, seg ORDER BY pos) AS d FROM cut) WINDOW w AS (PARTITION BY stream, seg ORDER BY pos ROWS BETWEEN {LAST_N - 1} PRECEDING AND CURRENT ROW)) WHERE pos >= 4"""}
_ORDER = ["levels0", "levels", "s", "cut", *[k for k in _CTE if k not in ("levels", "s")]]


@query(with_views("""SELECT split_part(class, '|', 1) AS arm, split_part(class, '|', 2) AS class, forecasts, crossings, missed AS hidden, points, inside, events, events_warned, false_warnings FROM fig""", "readings", **{k: _AB[k] for k in _ORDER}))
def ab_compare(v):
    """Every origin of every stream forecast twice, with what stood before its last fall and without: crossings that stayed hidden, and coverage."""
    arms = v.spark.createDataFrame([("with",), ("without",)], "arm string")
    s = levels(v).join(F.broadcast(arms)).select(F.concat_ws("|", "arm", "class").alias("class"), F.concat_ws("|", "arm", "stream").alias("stream"), "at_us", "value")
    idx = F.row_number().over(W.partitionBy("stream").orderBy("at_us", "value")) - 1
    numbered = s.select(F.col("stream").alias("target"), idx.alias("idx"), "at_us", "value")
    spliced = F.when(F.col("target").startswith("with|"), F.col("segment")).otherwise(F.lit(0))
    origins = T.rolling_origins(T.segments(numbered, DROP).withColumn("segment", spliced), LAST_N, 4)
    metric = F.element_at(F.split("target", r"\|"), 2)
    origins = origins.withColumns({"class": F.substring_index("target", "|", 2), "bar": F.when(metric == "error", 30.0).otherwise(42.0), "direction": F.when(metric == "error", "below").otherwise("above")})
    f = T.figures(T.scored(T.forecast_traces(origins, HORIZON, Z, CADENCE, RATIO), s, GATE, CADENCE), s, GATE, HORIZON)
    return f.select(F.substring_index("class", "|", 1).alias("arm"), F.substring_index("class", "|", -1).alias("class"), "forecasts", "crossings", F.col("missed").alias("hidden"), "points", "inside", "events", "events_warned", "false_warnings")
