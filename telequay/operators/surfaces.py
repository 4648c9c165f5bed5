"""Operators behind the surfaces: eligibility, debounced warnings, topology marks, timelines, digests, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telequay.functions.ladder import ladder
from telequay.functions.status import edge_status


def forecast_eligibility(bindings: DataFrame, rules: DataFrame, signals: DataFrame, channels: DataFrame, precursors: DataFrame) -> DataFrame:
    """One verdict per (entity, metric): the first binding by (rule_id, entity, container) decides.

    ``bindings``: entity, metric, rule_id, container, state, bar (null: none), kind; ``rules``: rule_id, signal, divisor;
    ``signals``: signal, shape; ``channels``: entity, stream_uid (what is scraped of it); ``precursors``: signal, phenomena.
    What isn't a target says why, by the first reason that holds; a target has its stream and the phenomena it comes before.
    """
    first = F.row_number().over(W.partitionBy("entity", "metric").orderBy("rule_id", F.col("container").asc_nulls_first()))
    d = bindings.withColumn("k", first).where("k = 1").drop("k")
    known = rules.select("rule_id", "signal", "divisor", F.lit(True).alias("known"))  # authored, as signals and precursors are
    d = d.join(known, "rule_id", "left").join(signals.select("signal", "shape"), "signal", "left").join(channels.select("entity", "stream_uid"), "entity", "left")
    d = d.join(precursors.select("signal", "phenomena"), "signal", "left")
    shape = F.coalesce("shape", F.lit("unknown"))
    reason = (F.when(F.col("state") != "bound", "not-bound").when(F.col("bar").isNull(), "unbounded").when(F.col("kind") == "rate-of-change", "rate-guard-bar")
              .when(F.col("known").isNull(), "unknown-rule").when(F.col("divisor").isNotNull(), "derived-ratio-deferred")
              .when(F.contains(shape, F.lit("gauge")), F.when(F.col("stream_uid").isNull(), "no-stream-key").otherwise("target"))
              .when(F.contains(shape, F.lit("counter")), "counter-deferred").otherwise("non-series-signal"))
    d = d.withColumn("verdict", reason)
    own = lambda c: F.when(F.col("verdict") == "target", F.col(c)).alias(c)
    return d.select("entity", "metric", "rule_id", "verdict", own("stream_uid"), own("phenomena"))


def precursors(members: DataFrame) -> DataFrame:
    """signal -> phenomena in which it comes before the event (a tag T0-... or T-1)."""
    early = F.col("temporal_order").startswith("T0-") | (F.col("temporal_order") == "T-1")
    return members.where(early).groupBy("signal").agg(F.array_sort(F.collect_set("phenomenon")).alias("phenomena"))


def warning_debounce(outcomes: DataFrame, clear_us: int) -> DataFrame:
    """Warnings by cycle: fresh ones, and held ones while only marginally silent.

    ``outcomes``: uid, metric, now_us, silence (null: warned).  After a warning
    the next cycles show it as aging while their silence is band-too-wide or
    no-crossing and no more than ``clear_us`` has passed since it was last
    projected; any other silence drops it at once.
    """
    order = W.partitionBy("uid", "metric").orderBy("now_us")
    warned = F.col("silence").isNull()
    hard = ~warned & ~F.col("silence").isin("band-too-wide", "no-crossing")
    d = outcomes.withColumn("last_warned", F.max(F.when(warned, F.col("now_us"))).over(order)).withColumn("last_hard", F.max(F.when(hard, F.col("now_us"))).over(order))
    held = F.col("last_warned").isNotNull() & (F.col("last_hard").isNull() | (F.col("last_hard") < F.col("last_warned"))) & (F.col("now_us") - F.col("last_warned") <= clear_us)
    return d.where(warned | held).select("uid", "metric", "now_us", (~warned).alias("aging"), F.col("last_warned").alias("projected_us"))


def topology_view(entities: DataFrame, matched: DataFrame, loud: DataFrame, selected: DataFrame, cap: int, warned: DataFrame | None = None) -> DataFrame:
    """Entities with marks, matched first, then loud, selected and others, by key; at most ``cap`` (a view's size), with how many were cut.

    ``matched`` (uid, phenomenon, full): an entity with a finding that isn't full is degraded.
    """
    mark = lambda d, name: d.select(F.col("uid"), F.lit(True).alias(name)).distinct()
    found = matched.groupBy("uid").agg(F.lit(True).alias("matched"), F.bool_or(~F.col("full")).alias("degraded"), F.concat_ws(",", F.array_sort(F.collect_set("phenomenon"))).alias("phenomena"))
    d = entities.select("uid").distinct().join(found, "uid", "left").join(mark(loud, "loud"), "uid", "left").join(mark(selected, "selected"), "uid", "left")
    d = d.join(mark(warned, "warned"), "uid", "left") if warned is not None else d.withColumn("warned", F.lit(False))
    d = d.na.fill(False, ["matched", "degraded", "loud", "selected", "warned"]).na.fill("", ["phenomena"])
    prio = F.when(F.col("matched"), 0).when(F.col("loud"), 1).when(F.col("selected"), 2).otherwise(3)
    total = d.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("cut"))
    return d.withColumn("prio", prio).orderBy("prio", "uid").limit(cap).crossJoin(F.broadcast(total))


def topology_edges(view: DataFrame, edges: DataFrame, now_us: int, budget_us: int) -> DataFrame:
    """Edges between entities of a view (at most its cap, so they go to every task): type, from_key, to_key, status now."""
    kept = F.broadcast(view.select("uid"))
    d = edges.join(kept, F.col("from_key") == F.col("uid"), "left_semi").join(kept, F.col("to_key") == F.col("uid"), "left_semi")
    status = edge_status(F.col("retracted_us"), F.col("confirmed_us"), F.lit(budget_us), F.lit(now_us), budget_us)
    return d.select("type", "from_key", "to_key", status.alias("status"))


def topology_summary(view: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes of a view by mark, its edges by status, and how many entities were cut."""
    n = [F.count_if(c).alias(c) for c in ("matched", "degraded", "loud", "selected", "warned")]
    a = view.agg(F.count(F.lit(1)).alias("nodes"), *n, F.coalesce(F.max("cut"), F.lit(0)).alias("cut"))
    of = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_edges")
    return a.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"), of("valid"), of("suspect"))))  # one row each


def timeline(lanes: DataFrame, horizon_us: int) -> DataFrame:
    """Spans (lane, id, start_us, end_us) by start; an open one closes at its start plus the horizon."""
    return lanes.select("lane", "id", "start_us", F.coalesce("end_us", F.col("start_us") + horizon_us).alias("end_us")).orderBy("start_us", "lane", "id")


def context_list(entries: DataFrame) -> DataFrame:
    """What an operator noted on an entity (entity, id, start_us): newest start first, then by id; rank says the place."""
    return entries.withColumn("rank", F.row_number().over(W.partitionBy("entity").orderBy(F.col("start_us").desc(), "id")))


def insight_rollup(findings: DataFrame) -> DataFrame:
    """Totals by tick: all, full, degraded, with supporting members met, over more than the entity (``spanned``), with something at risk (``risky``)."""
    n = lambda c, name: F.count_if(c).alias(name)
    return findings.groupBy("tick_seq").agg(F.count(F.lit(1)).alias("total"), n("full", "full"), n(~F.col("full"), "degraded"), n(F.col("supporting") > 0, "supported"), n("spanned", "spanned"), n(F.col("risky"), "at_risk"))


def on_call_top(findings: DataFrame, k: int) -> DataFrame:
    """The k findings to look at first: those with something at risk (``risky``), then full ones, then by key.  Every task keeps k rows of its own."""
    return in_call_order(findings).limit(k)


def in_call_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.col("risky").desc(), F.col("full").desc(), "uid", "phenomenon", "tick_seq")


def compare_digests(recorded: DataFrame, replayed: DataFrame, key: str = "tick_seq") -> DataFrame:
    """key, state: equal, differs, missing (recorded only) or unrecorded, of digests (key, digest)."""
    d = recorded.select(key, F.col("digest").alias("was")).join(replayed.select(key, F.col("digest").alias("now")), key, "full_outer")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unrecorded").when(F.col("was") == F.col("now"), "equal").otherwise("differs")
    return d.select(key, state.alias("state"))


def tick_digest(rows: DataFrame, key: str) -> DataFrame:
    """A digest of each key's rows, whatever their order, and their number: equal outputs have equal digests.

    Row hashes are added, so tasks combine them before the shuffle and no group is ever collected.
    """
    cols = sorted(c for c in rows.columns if c != key)
    return rows.groupBy(key).agg(combined_hash(*cols).alias("digest"), F.count(F.lit(1)).alias("n"))


def combined_hash(*cols: str) -> F.Column:
    """Sum over rows of 60 bits of the md5 of their values (nulls as a mark of their own), as text."""
    row = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in cols]))
    return F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def sensitivity_sweep(components: DataFrame, grid: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of crossed rungs against a truth, for every setting of (point_id, band, well_above), in one job.

    The grid is a handful of authored settings, so it is broadcast.
    """
    d = components.crossJoin(F.broadcast(grid))
    line = F.when(F.col("direction") == "below", F.col("bar") / F.col("well_above")).otherwise(F.col("bar") * F.col("well_above"))
    state = ladder(F.col("value"), F.col("bar"), line, F.col("band"), F.col("direction"))
    d = d.withColumn("said", state.isin("at-threshold", "above", "well-above")).join(truth.withColumn("true", F.lit(True)), ["tick_seq", "uid", "metric"], "left")
    true = F.coalesce("true", F.lit(False))
    by = d.groupBy("point_id").agg(F.count_if(F.col("said") & true).alias("hits"), F.count_if("said").alias("said"), F.count_if(true).alias("true"))
    return by.withColumn("precision", F.coalesce(F.try_divide("hits", "said"), F.lit(1.0))).withColumn("recall", F.coalesce(F.try_divide("hits", "true"), F.lit(1.0)))


def stream_evidence(samples: DataFrame, last_n: int = 8) -> DataFrame:
    """What each stream's last samples by arrival show: stream_id, uid, metric, kind, type, n, decreases, lowest, highest, first, last, first_us, last_us."""
    order = W.partitionBy("stream_id").orderBy("arrival")
    back = F.row_number().over(W.partitionBy("stream_id").orderBy(F.col("arrival").desc()))
    d = samples.withColumns({"back": back, "fell": F.col("value") < F.lag("value").over(order)}).where(F.col("back") <= last_n)
    own = lambda c, f: f(c, "arrival")
    oldest = F.col("back") == F.max("back").over(W.partitionBy("stream_id"))
    d = d.withColumn("fell", F.col("fell") & ~oldest)  # what stands before the window is not consulted
    return d.groupBy("stream_id").agg(
        *[F.max(c).alias(c) for c in ("uid", "metric", "kind", "type")], F.count(F.lit(1)).alias("n"), F.count_if("fell").alias("decreases"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        own("value", F.min_by).alias("first"), own("value", F.max_by).alias("last"), own("at_us", F.min_by).alias("first_us"), own("at_us", F.max_by).alias("last_us"))


def binding_qa(bindings: DataFrame, samples: DataFrame, max_bytes: float = float(1 << 40), max_ratio: float = 1.5) -> DataFrame:
    """pair, verdict (verified, suspect or failed) and the first test that said so, from what the streams themselves show.

    ``bindings``: pair, uid, metric, entity (scope of the rule), unit of the bar, divisor (metric, or null) and gates
    (active platform gates, or null); ``samples``: stream_id, uid, metric, kind, type, arrival, at_us, value.  What is
    range-checked is the evaluated quantity: a counter under a ratio by its rate, a rule with a divisor by the ratio of
    both streams' latest values.
    """
    per = ["uid", "metric"]
    e = stream_evidence(samples)
    e = e.groupBy(*per).agg(F.count(F.lit(1)).alias("streams"), F.first(F.struct("kind", "type", "n", "decreases", "lowest", "highest", "first", "last", "first_us", "last_us")).alias("s"))
    over = e.select("uid", F.col("metric").alias("divisor"), F.col("streams").alias("d_streams"), F.col("s.last").alias("d_last"))
    d = bindings.join(e, per, "left").join(over, ["uid", "divisor"], "left").withColumn("streams", F.coalesce("streams", F.lit(0)))
    total, counter = F.endswith("metric", F.lit("_total")), F.col("s.type") == "counter"
    derived = F.col("divisor").isNotNull()
    by_rate = ~derived & counter
    seconds = (F.col("s.last_us") - F.col("s.first_us")) / 1e6
    rate = F.when((seconds > 0) & (F.col("s.last") >= F.col("s.first")), (F.col("s.last") - F.col("s.first")) / seconds)
    said = lambda verdict, test: F.struct(F.lit(verdict).alias("verdict"), F.lit(test).cast("string").alias("test"))
    t = (F.when(F.col("uid").isNull(), said("suspect", "no-channel")).when(F.col("streams") == 0, said("suspect", "no-stream")).when(F.col("streams") > 1, said("failed", "ambiguous"))
         .when(F.col("s.kind").isNull(), said("suspect", "no-meta"))
         .when(F.col("entity").isin("Container", "Pod", "Node") & (F.col("s.kind") != F.col("entity")), said("failed", "scope"))
         .when((total & (F.col("s.type") == "gauge")) | (~total & counter), said("failed", "character"))
         .when((counter | total) & (F.col("s.decreases") > 1), said("failed", "decreases"))
         .when((F.col("s.lowest") < 0) | (~derived & (((F.col("unit") == "bytes") & (F.col("s.highest") > max_bytes)) | ((F.col("unit") == "ratio") & ~by_rate & (F.col("s.highest") > max_ratio)))), said("failed", "range"))
         .when(by_rate & (F.col("unit") == "ratio") & (F.col("s.n") >= 2) & (rate > max_ratio), said("failed", "rate-range"))
         .when(derived & (F.coalesce("d_streams", F.lit(0)) != 1), said("suspect", "divisor"))
         .when(derived & ((F.col("d_last") < 0) | ((F.col("d_last") > 0) & (F.col("s.last") / F.nullif(F.col("d_last"), F.lit(0.0)) > max_ratio))), said("failed", "derived-range"))
         .when(F.col("s.n") < 2, said("suspect", "thin-evidence")).when(F.coalesce(F.size("gates"), F.lit(0)) > 0, said("suspect", "gate")).otherwise(said("verified", None)))
    return d.select("pair", t.alias("t")).select("pair", "t.*")


def stream_audit(outcomes: DataFrame, verified: DataFrame) -> DataFrame:
    """One row: resolved, dropped, quarantined, the share of quarantined (orphans), verified streams and their accuracy."""
    c = lambda x: F.count_if(F.col("outcome") == x)
    a = outcomes.agg(c("resolve").alias("resolved"), c("drop").alias("dropped"), c("quarantine").alias("quarantined"))
    a = a.withColumn("orphan_rate", F.coalesce(F.try_divide("quarantined", F.col("resolved") + F.col("quarantined")), F.lit(0.0)))
    right, wrong = F.count_if(F.col("verdict") == "correct"), F.count_if(F.col("verdict") == "misjoin")
    b = verified.agg((right + wrong).alias("verified"), F.coalesce(F.try_divide(right, right + wrong), F.lit(1.0)).alias("accuracy"))
    return a.crossJoin(F.broadcast(b))  # one row each


def outcomes_by_reason(outcomes: DataFrame) -> DataFrame:
    """How many streams were resolved, dropped or quarantined, by reason."""
    return outcomes.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


def coverage_view(coverage: DataFrame, resolved: DataFrame, observability: DataFrame) -> DataFrame:
    """One row of headline figures over rules, resolvability and phenomena."""
    a = coverage.agg(F.count(F.lit(1)).alias("rules"), F.sum("pairs").alias("pairs"), F.count_if(F.col("config_bound") + F.col("default_bound") > 0).alias("rules_bound"))
    c = lambda s: F.count_if(F.col("state") == s).alias(f"phenomena_{s}")
    b = observability.agg(c("full"), c("partial"), c("none"))
    return a.crossJoin(F.broadcast(resolved)).crossJoin(F.broadcast(b))  # one row each


def intake_feeds(candidates: DataFrame, unbounded: DataFrame, failed: DataFrame) -> DataFrame:
    """Three feeds to one shape: recurring unexplained signatures, unbounded metrics (one item each), failed bindings."""
    a = candidates.select(F.lit(0).alias("priority"), F.concat(F.lit("unexplained:"), "signature").alias("signature"), F.col("windows").alias("recurrence"))
    b = unbounded.groupBy("metric").agg(F.count(F.lit(1)).alias("recurrence")).select(F.lit(1).alias("priority"), F.concat(F.lit("unbounded:"), "metric").alias("signature"), "recurrence")
    c = failed.select(F.lit(2).alias("priority"), F.concat_ws(":", F.lit("failed"), "pair", "test").alias("signature"), F.lit(1).cast("long").alias("recurrence"))
    return a.unionByName(b).unionByName(c)
