"""Streams of samples at many instants: latest values, rates, slopes, components, fingerprints.

``ticks`` (tick_seq, now_us) drives everything: one instant or a whole backtest
is the same job.  Times are joined by equality of a time slot, so a sample only
meets the ticks near it; what holds at later ticks is carried on from the tick
at which it was first seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telequay.functions.ladder import crossed, finite, ladder, stale, well_above_line
from telequay.params import SECOND, Params

KEY = ["tick_seq", "stream_id"]


def in_windows(rows: DataFrame, windows: DataFrame, width_us, at: str = "at_us") -> DataFrame:
    """Rows with each window (start_us, end_us, ...) that holds their time, both ends included.

    Windows are a small authored table and go to every task: dealt by slot, rows would meet in as many tasks as there are slots.
    ``width_us`` (a number, or a column without names) is the width of the slots that
    are joined; windows about as wide have two of them.
    """
    width = width_us if isinstance(width_us, Column) else F.lit(width_us)
    slot = lambda t: F.floor(t / width)
    w = windows.withColumn("slot", F.explode(F.sequence(slot(F.col("start_us")), slot(F.col("end_us")))))
    d = rows.withColumn("slot", slot(F.col(at))).join(F.broadcast(w), "slot")
    return d.where(F.col(at).between(F.col("start_us"), F.col("end_us"))).drop("slot", "start_us", "end_us")


def first_seen(readings: DataFrame, ticks: DataFrame) -> DataFrame:
    """Readings with the number (idx) of the first tick at or after their time; none for those after the last tick."""
    numbered = number_ticks(ticks)
    first, last = numbered.agg(F.min("now_us")).scalar(), numbered.agg(F.max("now_us")).scalar()
    width = F.greatest(F.lit(1), F.floor((last - first) / numbered.agg(F.count(F.lit(1))).scalar()))
    start = F.coalesce(F.lag("now_us").over(W.orderBy("idx")) + 1, F.col("now_us"))  # what is older than the first tick counts as of its time
    windows = numbered.select("idx", start.alias("start_us"), F.col("now_us").alias("end_us"))
    own = readings.withColumn("seen_us", F.greatest("at_us", first))
    return in_windows(own, windows, width, "seen_us").drop("seen_us")


def number_ticks(ticks: DataFrame) -> DataFrame:
    """tick_seq, now_us, idx: 1, 2, ... in order of time.  Ticks are a small authored table."""
    return ticks.select("tick_seq", "now_us", F.row_number().over(W.orderBy("now_us", "tick_seq")).alias("idx"))


def latest_by_event_time(readings: DataFrame, ticks: DataFrame) -> DataFrame:
    """The sample with the newest own time up to each tick; of equal times the first to arrive."""
    best = F.max_by(F.struct("value", "at_us", "arrival"), F.struct(F.col("at_us"), -F.col("arrival")))
    d = first_seen(readings, ticks).groupBy("stream_id", "idx").agg(best.alias("s"))
    until = F.coalesce(F.lead("idx").over(W.partitionBy("stream_id").orderBy("idx")) - 1, ticks.agg(F.count(F.lit(1))).scalar())
    d = d.withColumn("until", until.cast("int")).withColumn("idx", F.explode(F.sequence("idx", "until"))).join(F.broadcast(number_ticks(ticks)), "idx")
    return d.select(*KEY, "now_us", F.col("s.value").alias("value"), F.col("s.at_us").alias("at_us"), F.col("s.arrival").alias("arrival"))


#: Samples a stream keeps at most, as a live store does.
RING = 240


def last_n_arrivals(readings: DataFrame, ticks: DataFrame, n: int) -> DataFrame:
    """The last n samples (at most ``RING``) of each stream in order of arrival, up to each tick.

    A sample is among them from the tick that sees it first until n later arrivals
    have been seen, so it is carried on over these ticks only: n rows a tick where
    arrivals and times agree, whatever the number of ticks.
    """
    n = min(n, RING)
    next_n = W.partitionBy("stream_id").orderBy("arrival").rowsBetween(1, n)
    over = F.when(F.count(F.lit(1)).over(next_n) == n, F.max("idx").over(next_n) - 1)  # at the tick after it n later arrivals have been seen
    d = first_seen(readings, ticks).withColumn("until", F.coalesce(over, ticks.agg(F.count(F.lit(1))).scalar()).cast("int"))
    d = d.where(F.col("until") >= F.col("idx")).withColumn("idx", F.explode(F.sequence("idx", "until"))).drop("until").join(F.broadcast(number_ticks(ticks)), "idx").drop("idx")
    back = F.row_number().over(W.partitionBy(*KEY).orderBy(F.col("arrival").desc()))  # late samples may be seen after their next ones
    return d.withColumn("back", back).where(F.col("back") <= n)


def _runs(readings: DataFrame, ticks: DataFrame, p: Params) -> DataFrame:
    """Samples of the window before each tick, with what stands before each and whether it is in the last unbroken run."""
    windows = ticks.select("tick_seq", "now_us", (F.col("now_us") - p.rate_window_us).alias("start_us"), F.col("now_us").alias("end_us"))
    inside = in_windows(readings, windows, p.rate_window_us)
    order = W.partitionBy(*KEY).orderBy("at_us", "arrival")
    whole = W.partitionBy(*KEY)
    gap = F.col("at_us") - F.lag("at_us").over(order) > 2 * p.interval_us
    d = inside.withColumn("prev", F.lag("value").over(order)).withColumn("gap", F.coalesce(gap, F.lit(False)))
    d = d.withColumn("gap_at", F.max(F.when(F.col("gap"), F.col("at_us"))).over(whole))
    # Only what follows the last gap counts; the sample after a gap has none before it.
    return d.withColumn("in_run", F.col("gap_at").isNull() | (F.col("at_us") >= F.col("gap_at"))).withColumn(
        "step", F.when(F.col("in_run") & ~(F.col("gap") & (F.col("at_us") == F.col("gap_at"))), F.col("value") - F.col("prev")))


def rate(readings: DataFrame, ticks: DataFrame, p: Params) -> DataFrame:
    """Increase of counters over the window: resets start anew, a gap of over two intervals discards what stood before it.

    tick_seq, stream_id, samples (in the window), delta, per_second, elapsed_us, resets, gap_broken.
    """
    run = F.col("in_run")
    n = F.count_if(run)
    elapsed = F.when(n >= 2, F.max(F.when(run, F.col("at_us"))) - F.min(F.when(run, F.col("at_us")))).otherwise(F.lit(0))
    d = _runs(readings, ticks, p).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum(F.when(F.col("step") >= 0, F.col("step"))), F.lit(0.0)).alias("delta"),
        F.count_if(F.col("step") < 0).alias("resets"), elapsed.alias("elapsed_us"),
        F.coalesce(F.bool_or("gap"), F.lit(False)).alias("gap_broken"))
    per_second = F.when(F.col("elapsed_us") > 0, F.col("delta") / (F.col("elapsed_us") / SECOND)).otherwise(F.lit(0.0))
    return d.withColumn("per_second", per_second)


def gauge_slope(readings: DataFrame, ticks: DataFrame, p: Params) -> DataFrame:
    """Signed change of gauges per second over the last unbroken run of the window.

    tick_seq, stream_id, samples (in the run), delta, per_second, elapsed_us, gap_broken, inconclusive.
    """
    run = F.col("in_run")
    at = F.struct("at_us", "arrival")
    d = _runs(readings, ticks, p).groupBy(*KEY).agg(
        F.count_if(run).alias("samples"),
        F.max_by(F.when(run, F.col("value")), F.when(run, at)).alias("last"), F.min_by(F.when(run, F.col("value")), F.when(run, at)).alias("first"),
        (F.max(F.when(run, F.col("at_us"))) - F.min(F.when(run, F.col("at_us")))).alias("span"),
        F.coalesce(F.bool_or("gap"), F.lit(False)).alias("gap_broken"))
    enough = F.col("samples") >= 2
    d = d.withColumn("delta", F.when(enough, F.col("last") - F.col("first")).otherwise(F.lit(0.0)))
    d = d.withColumn("elapsed_us", F.when(enough, F.col("span")).otherwise(F.lit(0)))
    per_second = F.when(F.col("elapsed_us") > 0, F.col("delta") / (F.col("elapsed_us") / SECOND)).otherwise(F.lit(0.0))
    return d.select(*KEY, "samples", "delta", per_second.alias("per_second"), "elapsed_us", "gap_broken", (F.col("gap_broken") & ~enough).alias("inconclusive"))


def usable_bindings(bindings: DataFrame, streams: DataFrame) -> DataFrame:
    """Bindings (uid, metric, ...) with their stream, where exactly one stream fits."""
    found = bindings.join(streams.select("uid", "metric", "stream_id", "type"), ["uid", "metric"])
    alone = F.count(F.lit(1)).over(W.partitionBy("uid", "metric", "rule_id", *[c for c in ("epoch",) if c in bindings.columns]))
    return found.withColumn("n", alone).where("n = 1").drop("n")


def window_value(readings: DataFrame, ticks: DataFrame, p: Params) -> DataFrame:
    """What a stream is worth in a ratio: a counter's increase (two samples at least), a gauge's latest value.

    tick_seq, now_us, stream_id, uid, metric, quantity, at_us.
    """
    last = latest_by_event_time(readings, ticks)
    grown = rate(readings.where("type = 'counter'"), ticks, p).select(*KEY, "delta", "samples")
    kind = readings.select("stream_id", "uid", "metric", "type").distinct()
    d = last.join(kind, "stream_id").join(grown, KEY, "left")
    quantity = F.when(F.col("type") != "counter", F.col("value")).when(F.col("samples") >= 2, F.col("delta"))
    return d.select(*KEY, "now_us", "uid", "metric", quantity.alias("quantity"), "at_us").where("quantity is not null")


def ratio_pair(readings: DataFrame, ticks: DataFrame, numerator: str, divisor: str, p: Params) -> DataFrame:
    """tick_seq, uid, ratio, stale of two metrics of one entity; no row without a finite, non-zero divisor."""
    v = window_value(readings, ticks, p)
    den = v.where(F.col("metric") == divisor).select("tick_seq", "uid", F.col("quantity").alias("den"), F.col("at_us").alias("den_at"))
    d = v.where(F.col("metric") == numerator).join(den, ["tick_seq", "uid"]).where((F.col("den") != 0) & finite(F.col("quantity")) & finite(F.col("den")))
    return d.select("tick_seq", "uid", (F.col("quantity") / F.col("den")).alias("ratio"),
                    stale(F.least("at_us", "den_at"), F.col("now_us"), p.watermark_us).alias("stale"))


def as_bound(last: DataFrame, bound: DataFrame, epochs: DataFrame | None) -> DataFrame:
    """Latest samples with their bars: those of the epoch of the tick (``epochs``: tick_seq, epoch), where bars have epochs."""
    if epochs is None:
        return last.join(bound, "stream_id")
    return last.join(F.broadcast(epochs), "tick_seq").join(bound, ["stream_id", "epoch"]).drop("epoch")  # a row a tick


def threshold_components(readings: DataFrame, ticks: DataFrame, bindings: DataFrame, p: Params, epochs: DataFrame | None = None) -> DataFrame:
    """Each bound stream at each tick on the ladder of its bar.

    ``bindings``: uid, metric, rule_id, bar, factor, unit, direction.  A counter
    is taken as a rate (times 1000 for millicores), a gauge by its latest value
    with its slope.  Components that aren't finite are left out.  With ``epochs``
    (tick_seq, epoch) bindings have an epoch, and a tick sees those of its own.
    """
    bound = usable_bindings(bindings, readings.select("uid", "metric", "stream_id", "type").distinct())
    last = latest_by_event_time(readings, ticks)
    r = rate(readings.where("type = 'counter'"), ticks, p).select(*KEY, F.col("per_second").alias("rate"), F.col("elapsed_us").alias("rate_elapsed"))
    s = gauge_slope(readings.where("type <> 'counter'"), ticks, p).select(
        *KEY, F.col("per_second").alias("slope"), F.col("samples").alias("slope_samples"), F.col("inconclusive").alias("slope_inconclusive"))
    d = as_bound(last, bound, epochs).join(r, KEY, "left").join(s, KEY, "left")
    counter = F.col("type") == "counter"
    d = d.withColumn("level", F.when(~counter, F.col("value")).when(F.col("rate_elapsed") > 0, F.col("rate") * F.when(F.col("unit") == "millicores", 1000.0).otherwise(1.0)))
    d = d.withColumn("line", well_above_line(F.col("bar"), F.col("factor"), F.lit(p.well_above), F.col("direction")))
    d = d.where(finite(F.col("level")) & finite(F.coalesce("slope", F.lit(0.0))) & finite(F.col("line")))
    return d.select("tick_seq", "uid", "rule_id", "metric", "stream_id", F.col("level").alias("value"), "bar", "line",
                    ladder(F.col("level"), F.col("bar"), F.col("line"), F.lit(p.band), F.col("direction")).alias("state"),
                    stale(F.col("at_us"), F.col("now_us"), p.watermark_us).alias("stale"),
                    F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("slope_samples", F.lit(0)).alias("slope_samples"),
                    F.coalesce("slope_inconclusive", F.lit(False)).alias("slope_inconclusive"))


def rate_guards(readings: DataFrame, ticks: DataFrame, bindings: DataFrame, p: Params, epochs: DataFrame | None = None) -> DataFrame:
    """Increase over the window against a guard: breached unless a gap left nothing to measure."""
    bound = usable_bindings(bindings, readings.select("uid", "metric", "stream_id", "type").distinct())
    last = latest_by_event_time(readings, ticks).select(*KEY, "now_us", "at_us")
    r = rate(readings, ticks, p)
    d = as_bound(last, bound, epochs).join(r, KEY, "left").na.fill({"delta": 0.0, "per_second": 0.0, "resets": 0, "elapsed_us": 0}).withColumn(
        "gap_broken", F.coalesce("gap_broken", F.lit(False)))
    inconclusive = F.col("gap_broken") & (F.col("elapsed_us") <= 0)
    return d.where(finite(F.col("delta")) & finite(F.col("per_second"))).select(
        "tick_seq", "uid", "rule_id", "metric", "delta", "per_second", "resets", "gap_broken", inconclusive.alias("inconclusive"),
        ((F.col("delta") >= F.col("bar")) & ~inconclusive).alias("breached"), stale(F.col("at_us"), F.col("now_us"), p.watermark_us).alias("stale"))


def fingerprints(components: DataFrame) -> DataFrame:
    """Components nested per entity and tick, sorted by rule and metric."""
    return components.groupBy("tick_seq", "uid").agg(F.array_sort(F.collect_list(F.struct("rule_id", "metric", "state", "stale"))).alias("thresholds"))


def entity_crossed(components: DataFrame, guards: DataFrame) -> DataFrame:
    """Whether an entity has a fresh crossed threshold or a fresh, conclusive breach at a tick."""
    a = components.select("tick_seq", "uid", (crossed(F.col("state")) & ~F.col("stale")).alias("hit"))
    b = guards.select("tick_seq", "uid", (F.col("breached") & ~F.col("stale") & ~F.col("inconclusive")).alias("hit"))
    return a.unionByName(b).groupBy("tick_seq", "uid").agg(F.bool_or("hit").alias("crossed"))


def cooccurrence(conditions: DataFrame, *keys: str) -> DataFrame:
    """all-met, partial, none, or unknown without conditions: per key over the boolean ``met`` (null: no condition)."""
    n, met = F.count("met"), F.count_if("met")
    state = F.when(n == 0, "unknown").when(n == met, "all-met").when(met == 0, "none").otherwise("partial")
    return conditions.groupBy(*keys).agg(state.alias("state"), met.alias("n_met"), n.alias("n"))


def loud_states(components: DataFrame, guards: DataFrame) -> DataFrame:
    """Fresh crossed thresholds and fresh breaches: tick_seq, uid, metric, how."""
    a = components.where(crossed(F.col("state")) & ~F.col("stale")).select("tick_seq", "uid", "metric", F.col("state").alias("how"))
    b = guards.where("breached and not stale and not inconclusive").select("tick_seq", "uid", "metric", F.lit("breached").alias("how"))
    return a.unionByName(b).distinct()
