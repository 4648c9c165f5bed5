"""The forecast gate: forecasts of every origin, scored against the samples that followed, by class.

A trace is one forecast: f_id, class, stream, seq (its place in the recording), basis_us, bar, direction, lo and hi (a
number for each step), silence (null: it warned), ttc_us, earliest_us and latest_us (null: beyond the horizon).  A
stream's samples are numbered once; everything that a trace asks of the future (where it begins, how long it is, the
next crossing, what stood some positions before that) is arithmetic on those numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut


@dataclass(frozen=True)
class Gate:
    """Criteria of the verdict and of what counts."""

    min_future: int = 8
    lookback: int = 32  # positions before a crossing at which its series has to be clear of the bar
    band: float = 0.05
    min_lead: int = 8
    min_forecasts: int = 5
    min_crossings: int = 3
    min_events: int = 3
    coverage: tuple[float, float] = (0.65, 0.98)
    recall: float = 1.0
    false_rate: float = 0.30
    in_band: float = 0.8


def rolling_origins(series: DataFrame, last_n: int = 64, min_context: int = 2) -> DataFrame:
    """Every basis of each series (target, idx, at_us, value) as an origin, from one pass over it.

    target, idx, basis_us, last, sigma and drift of the ``last_n`` first differences up to there (population spread, at least 1e-9; mean).
    With a column ``segment`` nothing before an origin's own segment counts, as after a splice.
    """
    order = W.partitionBy("target", *[c for c in ("segment",) if c in series.columns]).orderBy("idx")
    near = order.rowsBetween(1 - last_n, 0)
    d = series.withColumn("diff", F.col("value") - F.lag("value").over(order))
    return d.select("target", "idx", F.col("at_us").alias("basis_us"), F.col("value").alias("last"), F.greatest(F.coalesce(F.stddev_pop("diff").over(near), F.lit(0.0)), F.lit(1e-9)).alias("sigma"),
                    F.coalesce(F.avg("diff").over(near), F.lit(0.0)).alias("drift")).where(F.col("idx") + 1 >= min_context)


def segments(series: DataFrame, drop: float) -> DataFrame:
    """Series with ``segment``: how many falls by more than ``drop`` of the value before stand up to each sample."""
    order = W.partitionBy("target").orderBy("idx")
    prev = F.lag("value").over(order)
    d = series.withColumn("fell", F.coalesce((prev > 0) & (prev - F.col("value") > drop * prev), F.lit(False)).cast("int"))
    return d.withColumn("segment", F.sum("fell").over(order)).drop("fell")


def past(value: Column, bar: Column, direction: Column) -> Column:
    return F.when(direction == "below", value <= bar).otherwise(value >= bar)


def forecast_traces(origins: DataFrame, horizon: int, z: float, cadence_us: int, max_band_ratio: float, with_drift: bool = True) -> DataFrame:
    """Forecasts of origins that have class, bar and direction: last + drift (h + 1), give or take z sigma sqrt(h + 1).

    A forecast is an array in its origin's row, so no row is made for a step.  The earliest crossing is that of the
    band's side towards the bar, the latest that of the other; silence: already-crossed, no-crossing or band-too-wide.
    """
    steps = F.sequence(F.lit(1), F.lit(horizon))
    slope = F.col("drift") if with_drift else F.lit(0.0)
    line = lambda side: F.transform(steps, lambda h: F.col("last") + slope * h + F.lit(side * z) * F.col("sigma") * F.sqrt(h))
    d = origins.withColumns({"point": line(0), "lo": line(-1), "hi": line(1)})
    first = lambda band: F.nullif(F.array_position(F.transform(band, lambda x: past(x, F.col("bar"), F.col("direction"))), F.lit(True)), F.lit(0)) - 1
    below = F.col("direction") == "below"
    d = d.withColumns({"point_h": first(F.col("point")), "early_h": F.when(below, first(F.col("lo"))).otherwise(first(F.col("hi"))), "late_h": F.when(below, first(F.col("hi"))).otherwise(first(F.col("lo")))})
    soon = F.least("early_h", "point_h")
    silence = (F.when(past(F.col("last"), F.col("bar"), F.col("direction")), "already-crossed").when(F.col("point_h").isNull(), "no-crossing")
               .when((F.coalesce("late_h", F.lit(horizon)) - soon) / horizon > max_band_ratio, "band-too-wide"))
    at = lambda h: F.when(silence.isNull(), F.col("basis_us") + (h + 1) * cadence_us)
    return d.select(F.concat_ws("@", "target", F.col("idx").cast("string")).alias("f_id"), "class", F.col("target").alias("stream"), F.col("idx").cast("long").alias("seq"), "basis_us", "bar", "direction",
                    "lo", "hi", silence.alias("silence"), F.when(silence.isNull(), (F.col("point_h") + 1) * cadence_us).alias("ttc_us"), at(soon).alias("earliest_us"), at(F.col("late_h")).alias("latest_us"))


def numbered_samples(samples: DataFrame, lookback: int) -> DataFrame:
    """stream, at_us, value, pos (1, 2, ... by time and value) and prior: what stood ``lookback`` positions before the first sample of that time."""
    order = W.partitionBy("stream").orderBy("at_us", "value")
    d = samples.select("stream", "at_us", "value").withColumns({"pos": F.row_number().over(order), "prior": F.lag("value", lookback).over(order)})
    return d.withColumn("prior", F.first("prior").over(W.partitionBy("stream", "at_us").orderBy("pos")))


def scored(traces: DataFrame, samples: DataFrame, gate: Gate, cadence_us: int) -> DataFrame:
    """What happened after each trace: place (samples up to its basis), steps that can be compared, the crossing among them.

    The columns of ``traces`` and place, steps, skipped (too little future), full_obs, actual_h, crossing_us, hover,
    err (steps that the warning came late), frac, in_band.  Traces of streams without samples or without a bar are left
    out.  The next crossing after a place is a running minimum over samples and bases in falling order of time: one
    sort, whatever the number of traces.
    """
    own = ["stream", "bar", "direction"]
    s = numbered_samples(samples, gate.lookback)
    none = F.lit(None)
    rows = s.join(traces.select(*own).distinct(), "stream").select(*own, "at_us", F.lit(0).alias("kind"), "value", "pos", "prior", none.cast("string").alias("f_id"))
    marks = traces.select(*own, F.col("basis_us").alias("at_us"), F.lit(1), none.cast("double"), none.cast("int"), none.cast("double"), "f_id")
    whole = W.partitionBy(*own)
    hit = (F.col("kind") == 0) & past(F.col("value"), F.col("bar"), F.col("direction"))
    back = whole.orderBy(F.col("at_us").desc(), F.col("kind").desc(), F.col("pos").desc()).rowsBetween(W.unboundedPreceding, 0)
    d = rows.union(marks).withColumns({
        "place": F.coalesce(F.max("pos").over(whole.orderBy("at_us", "kind", "pos").rowsBetween(W.unboundedPreceding, 0)), F.lit(0)),
        "n": F.max("pos").over(whole), "next": F.min(F.when(hit, F.struct("pos", "at_us", "prior"))).over(back)})
    d = d.where("kind = 1 and n > 0").select("f_id", "place", "n", F.col("next.pos").alias("pos"), F.col("next.at_us").alias("next_us"), F.col("next.prior").alias("prior"))
    d = traces.join(d, "f_id").withColumn("steps", F.least(F.size("lo"), F.col("n") - F.col("place")))
    d = d.withColumns({"skipped": F.col("steps") < gate.min_future, "full_obs": F.col("n") - F.col("place") >= F.size("lo"), "actual_h": F.col("pos") - F.col("place") - 1})
    d = d.withColumn("actual_h", F.when(~F.col("skipped") & (F.col("actual_h") < F.col("steps")), F.col("actual_h")))
    clear = F.when(F.col("direction") == "below", F.col("prior") > F.col("bar") * (1 + gate.band)).otherwise(F.col("prior") < F.col("bar") * (1 - gate.band))
    crossed = F.col("actual_h").isNotNull()
    warned = crossed & F.col("silence").isNull()
    err = F.rint(F.col("ttc_us") / cadence_us) - 1 - F.col("actual_h")
    return d.select(*traces.columns, "place", "steps", "skipped", "full_obs", "actual_h", F.when(crossed, F.col("next_us")).alias("crossing_us"), F.when(crossed, ~F.coalesce(clear, F.lit(False))).alias("hover"),
                    F.when(warned, err).alias("err"), F.when(warned, F.abs(err) / (F.col("actual_h") + 1)).alias("frac"),
                    F.when(warned, (F.col("next_us") >= F.col("earliest_us")) & (F.col("latest_us").isNull() | (F.col("next_us") <= F.col("latest_us")))).alias("in_band"))


def covered(d: DataFrame, samples: DataFrame) -> DataFrame:
    """f_id, class, h, lo, hi, realized of every comparable step of scored traces, by equality of a sample's number."""
    s = numbered_samples(samples, 1).select("stream", "pos", F.col("value").alias("realized"))
    steps = d.where("not skipped").select("f_id", "class", "stream", "place", "steps", F.posexplode(F.arrays_zip("lo", "hi")).alias("h", "b")).where("h < steps")
    return steps.withColumn("pos", F.col("place") + F.col("h") + 1).join(s, ["stream", "pos"]).select("f_id", "class", "h", "b.lo", "b.hi", "realized")


def with_coverage(d: DataFrame, samples: DataFrame, horizon: int) -> DataFrame:
    """Scored traces of at most ``horizon`` steps with points and inside: how many of their steps can be compared (``covered``), and how many lie in the band.

    A sample knows the next ``horizon`` ones, so a trace meets one row and no row is made for a step.
    """
    s = numbered_samples(samples, 1).select("stream", "pos", "value")
    s = s.withColumn("ahead", F.collect_list(F.struct("value")).over(W.partitionBy("stream").orderBy("pos").rowsBetween(1, horizon)))
    own = F.struct(F.col("pos").alias("place"), "ahead")
    start = F.struct((F.col("pos") - 1).alias("place"), F.slice(F.concat(F.array(F.struct("value")), F.col("ahead")), 1, horizon).alias("ahead"))  # nothing stands before the first sample
    s = s.select("stream", F.explode(F.when(F.col("pos") == 1, F.array(start, own)).otherwise(F.array(own))).alias("s")).select("stream", "s.*")
    steps = F.slice(F.arrays_zip("lo", "hi", "ahead"), F.lit(1), F.col("steps").cast("int"))
    inside = F.size(F.filter(steps, lambda x: x["ahead"]["value"].between(x["lo"], x["hi"])))
    shown = lambda c: F.when(~F.col("skipped"), c).otherwise(F.lit(0)).cast("long")
    return d.join(s, ["stream", "place"]).withColumns({"points": shown(F.col("steps")), "inside": shown(inside)})


def event_ledger(d: DataFrame) -> DataFrame:
    """Physical crossings: class, stream, crossing_us, hover (sticky), first_hover (what its first trace said) and the best lead; null: never warned ahead."""
    e = d.where("crossing_us is not null").groupBy("class", "stream", "crossing_us").agg(
        F.bool_or("hover").alias("hover"), F.min_by("hover", "seq").alias("first_hover"), F.max(F.when(F.col("silence").isNull(), F.col("actual_h") + 1)).alias("lead"))
    return e.withColumn("lead", F.when(~F.col("hover"), F.col("lead")))


def figures(d: DataFrame, samples: DataFrame, gate: Gate, horizon: int | None = None) -> DataFrame:
    """One row a class.  With ``horizon`` (no trace has more steps) traces are scored once and their steps counted in their rows.

    Errors are whole steps within a horizon, so the exact medians keep a number for each of a few values.
    """
    n = lambda c: F.count_if(c)
    if horizon is not None:
        d = cut(with_coverage(d, samples, horizon).select("class", "stream", "seq", "silence", "skipped", "full_obs", "actual_h", "crossing_us", "hover", "err", "frac", "in_band", "points", "inside"))
    ok, crossed, warns = ~F.col("skipped"), F.col("actual_h").isNotNull(), F.col("silence").isNull()
    a = d.groupBy("class").agg(
        n(ok).alias("forecasts"), n(F.col("skipped")).alias("skipped"), n(crossed).alias("crossings"), n(crossed & warns).alias("warned"), n(crossed & ~warns).alias("missed"),
        n(ok & warns & (crossed | F.col("full_obs"))).alias("observed"), n(ok & warns & ~crossed & F.col("full_obs")).alias("false_warnings"), n(ok & ~warns & ~crossed).alias("silences_correct"),
        n(F.col("in_band")).alias("in_band"), F.percentile("err", 0.5).alias("median_err"), F.percentile("frac", 0.5).alias("median_frac"))
    inside = F.col("realized").between(F.col("lo"), F.col("hi"))
    if horizon is None:
        c = covered(d, samples).groupBy("class").agg(F.count(F.lit(1)).alias("points"), n(inside).alias("inside"))
    else:
        c = d.groupBy("class").agg(F.sum("points").alias("points"), F.sum("inside").alias("inside"))
    e = event_ledger(d).groupBy("class").agg(n(~F.col("hover")).alias("events"), n(F.col("lead") >= gate.min_lead).alias("events_warned"), n(F.col("first_hover")).alias("hover_excluded"))
    out = a.join(c, "class", "left").join(e, "class", "left").na.fill(0, ["points", "inside", "events", "events_warned", "hover_excluded"])
    share = lambda x, y: F.try_divide(x, y)
    return out.withColumns({"coverage": share("inside", "points"), "event_recall": share("events_warned", "events"), "false_rate": share("false_warnings", "observed"), "in_band_rate": share("in_band", "warned")})


def misses(d: DataFrame) -> DataFrame:
    """class, reason, n: why crossings went without a warning."""
    return d.where("actual_h is not null and silence is not null").groupBy("class", F.col("silence").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def verdicts(f: DataFrame, gate: Gate) -> DataFrame:
    """``figures`` with verdict and reasons: insufficient (thin evidence is never a pass), failed or passed."""
    thin = (F.when(F.col("forecasts") < gate.min_forecasts, "thin-corpus").when(F.col("crossings") < gate.min_crossings, "crossing-evidence").when(F.col("events") < gate.min_events, "event-evidence"))
    failed = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("coverage").between(*gate.coverage), F.lit(False)), F.lit("coverage")), F.when(F.col("event_recall") < gate.recall, F.lit("event-recall")),
        F.when(F.col("false_rate") > gate.false_rate, F.lit("false-warnings")), F.when(F.col("in_band_rate") < gate.in_band, F.lit("in-band"))))
    return f.withColumns({"verdict": F.when(thin.isNotNull(), "insufficient").when(F.size(failed) > 0, "failed").otherwise("passed"),
                          "reasons": F.coalesce(thin, F.concat_ws(",", failed))})


def forecast_gate(traces: DataFrame, samples: DataFrame, gate: Gate, cadence_us: int, horizon: int | None = None) -> DataFrame:
    """Traces (with ``horizon``: of so many steps at most) and samples to one verdict a class."""
    return verdicts(figures(scored(traces, samples, gate, cadence_us), samples, gate, horizon), gate)
