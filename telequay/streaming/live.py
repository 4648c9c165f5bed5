"""The operators on streams.

Micro-batches are atomic, so a scrape's samples become visible together.  A
watermark only bounds state: raw rows go to the sink whatever their age, and
later ticks see them (``foreachBatch`` over the table of readings).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from telequay.operators.detect import cascade_pairs, latest_triggers
from telequay.operators.lineage import shared_folder


_STORE = "spark.sql.streaming.stateStore.providerClass"


def file_stream(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream; ``backlog`` writes ``width`` files for a range."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed(readings: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Count, sum and newest value per stream in sliding windows of event time (``at`` is a timestamp); late rows beyond ``late`` leave the state alone."""
    return (readings.withWatermark("at", late).groupBy(F.window("at", width, slide), "stream_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max_by("value", F.struct(F.col("at"), -F.col("arrival"))).alias("newest")))


def latest_state(readings: DataFrame) -> DataFrame:
    """The newest sample of each stream so far (update or complete mode)."""
    return readings.groupBy("stream_id").agg(F.max_by(F.struct("value", "at_us", "arrival"), F.struct(F.col("at_us"), -F.col("arrival"))).alias("s")).select(
        "stream_id", "s.value", "s.at_us", "s.arrival")


def debounced(rows: DataFrame, held: DataFrame, clear_us: int) -> tuple[DataFrame, DataFrame]:
    """A step of ``carried``: the batch operator's warnings of (uid, metric, now_us, silence), and when each key last warned (uid, metric, last).

    Rows of a micro-batch are taken in order of now_us.  A warning is without a silence; another one than
    band-too-wide and no-crossing drops it.
    """
    kind = F.when(F.col("silence").isNull(), 0).when(F.col("silence").isin("band-too-wide", "no-crossing"), 2).otherwise(1)
    none = F.lit(None)
    d = rows.select("uid", "metric", "now_us", kind.alias("kind"), F.lit(1).alias("new")).unionByName(held.select("uid", "metric", F.col("last").alias("now_us"), F.lit(0).alias("kind"), F.lit(0).alias("new")))
    order = W.partitionBy("uid", "metric").orderBy("new", "now_us", "kind")
    last = F.last(F.when(F.col("kind") == 0, F.col("now_us")).when(F.col("kind") == 1, F.lit(-1)), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumns({"last": last, "final": F.lead("new").over(order).isNull()})
    fresh = (F.col("kind") == 0) | ((F.col("kind") == 2) & (F.col("last") >= 0) & (F.col("now_us") - F.col("last") <= clear_us))
    out = d.where((F.col("new") == 1) & fresh).select("uid", "metric", "now_us", (F.col("kind") == 2).alias("aging"), F.when(fresh, F.col("last")).otherwise(none).alias("projected_us"))
    return out, d.where(F.col("final") & (F.col("last") >= 0)).select("uid", "metric", "last")


DEBOUNCED, LAST = "uid string, metric string, now_us long, aging boolean, projected_us long", "uid string, metric string, last long"


def lives_closed(rows: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A step of ``carried``: births (name, uid, seq, born_us, deleted_us) in order close the life before them; the open lives are held (LIFE)."""
    d = rows.select("name", "uid", "seq", "born_us", "deleted_us", F.lit(1).alias("new")).unionByName(held.withColumn("new", F.lit(0)))
    next_born = F.lead("born_us").over(W.partitionBy("name").orderBy("new", "born_us", "seq"))
    d = d.withColumn("next_us", next_born)
    closed = d.where("next_us is not null").select("name", "uid", "born_us", F.greatest("born_us", F.least("deleted_us", "next_us")).alias("died_us"))
    return closed, d.where("next_us is null").drop("new", "next_us")


LIVED, LIFE = "name string, uid string, born_us long, died_us long", "name string, uid string, seq long, born_us long, deleted_us long"


def edges_held(rows: DataFrame, held: DataFrame, horizon_us: int) -> tuple[DataFrame, DataFrame]:
    """A step of ``carried``: intervals of edges from events (type, from_key, to_key, op, event_us, seq); each edge's newest interval is held (EDGE).

    A row for every micro-batch that touches an edge; the one with the largest seen_us is its newest interval.
    A retracted edge is no longer held once events are ``horizon_us`` past its retraction; a later assertion begins anew.
    """
    key = ["type", "from_key", "to_key"]
    was = lambda c, op, n: F.when(F.col(c).isNotNull(), F.struct(F.lit(op).alias("op"), F.col(c).alias("event_us"), F.lit(n).cast("long").alias("seq")))
    old = held.select(*key, F.explode(F.filter(F.array(was("asserted_us", "assert", 0), was("confirmed_us", "assert", 1), was("retracted_us", "retract", 2)), lambda x: x.isNotNull())).alias("e"))
    d = rows.select(*key, "op", "event_us", "seq", F.lit(1).alias("new")).unionByName(old.select(*key, "e.*", F.lit(0).alias("new")))
    # what is held comes first, as asserted, confirmed and retracted
    place = F.struct("new", F.when(F.col("new") == 1, F.col("event_us")).otherwise(F.col("seq")).alias("at"), "seq")
    d = d.withColumn("place", place)
    ended = F.coalesce(F.sum((F.col("op") == "retract").cast("int")).over(W.partitionBy(*key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    asserted = F.col("op") == "assert"
    d = d.withColumn("island", ended).groupBy(*key, "island").agg(
        F.min_by("event_us", F.when(asserted, F.col("place"))).alias("asserted_us"), F.max_by("event_us", F.when(asserted, F.col("place"))).alias("confirmed_us"),
        F.min_by("event_us", F.when(~asserted, F.col("place"))).alias("ended_us"), F.max(F.when(F.col("new") == 1, F.col("event_us"))).alias("seen_us"))
    whole = F.col("asserted_us").isNotNull()
    d = d.groupBy(*key).agg(F.max_by(F.struct("asserted_us", "confirmed_us", "ended_us"), F.when(whole, F.col("island"))).alias("s"), F.max("seen_us").alias("seen_us"))
    ended_us = F.when(F.col("s.ended_us").isNotNull(), F.greatest("s.ended_us", "s.asserted_us"))
    d = d.select(*key, "s.asserted_us", "s.confirmed_us", ended_us.alias("retracted_us"), "seen_us").where("asserted_us is not null")
    newest = rows.agg(F.max("event_us")).scalar()
    return d.where("seen_us is not null"), d.where(F.col("retracted_us").isNull() | (F.col("retracted_us") + horizon_us > newest)).drop("seen_us")


EDGE = "type string, from_key string, to_key string, asserted_us long, confirmed_us long, retracted_us long"
EDGE_SEEN = f"{EDGE}, seen_us long"


def carried(stream: DataFrame, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], out: str, state: str, path: str | None = None) -> DataFrame:
    """All that ``step`` (a micro-batch's rows, what is held) gives for the input that is there now; it returns (rows, what is held from then on).

    What is held is a table of its own for each batch, so a batch that runs again starts from the same one, and no
    history is read.  With the ``path`` of an earlier call its checkpoint is taken up, as after a restart.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    seen = []

    def job(rows: DataFrame, batch: int) -> None:
        seen[:] = [batch]
        own = rows.sparkSession
        held = own.read.schema(state).parquet(f"{path}/held/batch={batch - 1}") if batch else own.createDataFrame([], state)
        for name, d in zip(("rows", "held"), step(rows, held)):
            d.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")

    each_batch(stream, job, f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(out).parquet(f"{path}/rows/batch=*") if seen else spark.createDataFrame([], out)


class Cards(StatefulProcessor):
    """An entity's open card (its metrics, first tick, occurrences, last tick): rows of ``detect.entity_ticks``, with run_id, become cards.

    An entity that is not loud at the next tick has no row there; a timer just after its last tick's time fires once
    the watermark has passed it, and closes the card at the tick that follows.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", "metrics string, first_seen long, occurrences long, idx long, run_id long")

    def close(self) -> None:
        pass

    def _out(self, rows) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["uid", "run_id", "idx", "signature", "status", "first_seen", "occurrences", "superseded_by"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        card = self.card.get() if self.card.exists() else None
        d, out = pd.concat(list(rows)).sort_values("idx"), []
        for r in d.itertuples(index=False):
            loud, uncovered = set(r.loud), sorted(r.uncovered)
            if card is not None and card[4] != r.run_id:
                card = None  # a restart forgets it
            if card is not None and r.idx > card[3] + 1:
                out.append((key[0], card[4], card[3] + 1, card[0], "resolved", card[1], card[2], ""))
                card = None
            if card is not None:
                metrics = card[0].split(",")
                if set(metrics) & set(uncovered):
                    card = (",".join(uncovered), card[1], card[2] + 1, r.idx, r.run_id)
                    out.append((key[0], r.run_id, r.idx, card[0], "aging", card[1], card[2], ""))
                    continue
                still = set(metrics) <= loud
                out.append((key[0], r.run_id, r.idx, card[0], "superseded" if still else "resolved", card[1], card[2], covering(metrics, r.covers) if still else ""))
                card = None
            if uncovered:
                card = (",".join(uncovered), r.tick_seq, 1, r.idx, r.run_id)
                out.append((key[0], r.run_id, r.idx, card[0], "new", card[1], 1, ""))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if card is None:
            self.card.clear()
        else:
            self.card.update(card)
            self.handle.registerTimer(int(d["now_us"].max()) // 1000 + 1)
        yield from self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.card.exists():
            metrics, first_seen, occurrences, idx, run = self.card.get()
            self.card.clear()
            yield from self._out([(key[0], run, idx + 1, metrics, "resolved", first_seen, occurrences, "")])


def covering(metrics: list[str], covers) -> str:
    """The smallest phenomenon that covers all metrics, else all that contribute."""
    by: dict[str, set[str]] = {}
    for x in covers:
        metric, phenomenon = x.split("\u0001")
        if metric in metrics:
            by.setdefault(phenomenon, set()).add(metric)
    whole = [p for p, m in by.items() if len(m) == len(set(metrics))]
    return min(whole) if whole else ", ".join(sorted(by))


def card_state(rows: DataFrame, ticks: DataFrame) -> DataFrame:
    """The cards of ``detect.card_aging`` on a stream of ``detect.entity_ticks`` rows (with run_id), one open card an entity as state.

    ``ticks``: idx, tick_seq, run_id; a card whose run ended is not closed there, as that tick is none of its run.
    """
    out = "uid string, run_id long, idx long, signature string, status string, first_seen long, occurrences long, superseded_by string"
    d = rows.withColumn("at", F.timestamp_micros("now_us")).withWatermark("at", "0 seconds").groupBy("uid").transformWithStateInPandas(
        statefulProcessor=Cards(), outputStructType=out, outputMode="append", timeMode="eventTime")
    return d.join(F.broadcast(ticks), ["idx", "run_id"]).select("tick_seq", "uid", "signature", "status", "first_seen", "occurrences", "superseded_by")


def cascades_by_batch(findings: DataFrame, relations: DataFrame, traversed: DataFrame, window_us: int, folder: str):
    """Run ``cascade_pairs`` for every micro-batch of findings; pairs go to ``folder``/pairs.

    The tracker (the latest finding of each phenomenon and entity within the window) is a table of its own
    for each batch, so a batch that runs again starts from the same one; no history is read.
    """

    def job(rows: DataFrame, batch: int) -> None:
        tracker = f"{folder}/tracker/batch={batch - 1}"
        held = rows.sparkSession.read.schema(rows.schema).parquet(tracker) if batch else rows.limit(0)
        triggers = rows.unionByName(held)
        cascade_pairs(rows, relations, traversed, window_us, triggers).write.mode("overwrite").parquet(f"{folder}/pairs/batch={batch}")
        latest_triggers(triggers, window_us).write.mode("overwrite").parquet(f"{folder}/tracker/batch={batch}")

    each_batch(findings, job, f"{folder}/checkpoint").awaitTermination()


def backlog(rows: DataFrame, by: str, batches: int, *keys: str) -> str:
    """Write ``rows`` by ranges of ``by``, oldest first, for a stream that takes ``width`` files at a time; returns the folder.

    A range is written by as many tasks as the session has shuffle partitions, each key by one of them, so a key's
    rows come in order of range whatever the batches.  The files' times of change follow the ranges.
    """
    folder = f"{shared_folder(rows.sparkSession)}/backlog-{uuid.uuid4().hex}"
    bounds = rows.stat.approxQuantile(by, [k / batches for k in range(1, batches)], 0.01)
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:]):
        part = rows.where((F.lit(True) if lo is None else F.col(by) > lo) & (F.lit(True) if hi is None else F.col(by) <= hi))
        part.repartition(width(rows.sparkSession), *keys).write.mode("append").parquet(folder)
    return folder


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def each_batch(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch job for every micro-batch, all input that is there, then stop."""
    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """All that a stream gives for the input that is there now, as a table: batches are written as Parquet in the shared folder.

    In complete mode that is the last batch, otherwise all of them.  A batch run again replaces its own rows.  With the
    ``path`` of an earlier call its checkpoint is taken up, as after a restart.
    """
    spark = stream.sparkSession
    path = path or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    seen = []

    def write(rows: DataFrame, batch: int) -> None:
        seen[:] = [batch]
        rows.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={batch}")

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # state with timers needs it, and none has to fit in memory
    try:
        q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before)
    q.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch=*")


def in_steps(rows: DataFrame, by: str, steps: list, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a stream gives that gets the rows of one step after the other, and is stopped and taken up again between them."""
    spark = rows.sparkSession
    folder, path = (f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("steps", "stream"))
    out = None
    for step in steps:
        rows.where(F.col(by) == step).write.mode("append").parquet(folder)
        out = drained(build(file_stream(spark, folder, "*.parquet", rows.schema, 1 << 30)), mode, path)
    return out


def forecaster_hook(series: DataFrame, fn: Callable, horizon: int, quantiles: tuple[float, ...]) -> DataFrame:
    """Any forecaster on series (target, idx, value): target, h, q, value and error.

    ``fn(values, horizon, quantiles)`` gives one list of ``horizon`` numbers for
    each quantile.  An answer of another shape or an exception gives one row
    with ``error`` and no number: a row is never made up.
    """

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for target, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    bands = fn([float("nan") if x is None else x for x in values], horizon, quantiles)
                    if len(bands) != len(quantiles) or any(len(b) != horizon for b in bands):
                        raise ValueError("the forecaster's answer has another shape")
                    rows += [(target, h, q, float(x), None) for q, b in zip(quantiles, bands) for h, x in enumerate(b)]
                except Exception as x:  # noqa: BLE001  a failed forecast is an outcome
                    rows.append((target, None, None, None, str(x)[:200]))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["target", "h", "q", "value", "error"])

    whole = series.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s"))  # a forecaster gets its target's whole series
    return whole.select("target", F.transform("s", lambda x: x["value"].cast("double")).alias("values")).mapInArrow(run, "target string, h long, q double, value double, error string")


def forecast_contract(forecasts: DataFrame, horizon: int, flat: DataFrame | None = None, slack: float = 0.05) -> DataFrame:
    """Violations of the forecaster's contract: length, order of quantiles, a band without width, or a trend out of nothing.

    ``flat`` (target, last): targets whose history doesn't move; no step of their middle quantile may be farther than
    ``slack`` of the last value from it.
    """
    by = forecasts.groupBy("target", "h").agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("v"), F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("point"))
    values = F.transform("v", lambda x: x["value"])
    sorted_ = values == F.array_sort(values)
    width = F.element_at(values, -1) - F.element_at(values, 1)
    d = by.select("target", "point", sorted_.alias("sorted"), width.alias("width"))
    d = d.join(flat.select("target", "last"), "target", "left") if flat is not None else d.withColumn("last", F.lit(None).cast("double"))
    away = F.abs(F.col("point") - F.col("last")) > slack * F.abs("last")
    d = d.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.bool_and("sorted").alias("ordered"), F.min("width").alias("width"), F.coalesce(F.bool_or(away), F.lit(False)).alias("moved"))
    problem = F.when(F.col("n") != horizon, "length").when(~F.col("ordered"), "quantile-order").when(F.col("width") <= 0, "no-width").when(F.col("moved"), "not-flat")
    return d.select("target", problem.alias("problem")).where("problem is not null")
