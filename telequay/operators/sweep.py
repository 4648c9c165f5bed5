"""Replay of recorded inputs at every tick and under every setting of a grid, in one job, and its score against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telequay.functions.ladder import ladder, member_check, well_above_line
from telequay.operators import detect as D
from telequay.operators import signals as S
from telequay.operators.lineage import cut
from telequay.operators.topology import by_tick, edges_among, gathered, paired
from telequay.params import Params

#: What a member's check consults: columns of ``observations``.
SEEN = ("state", "stale", "slope", "slope_samples", "slope_inconclusive", "breached", "inconclusive")


def observations(readings: DataFrame, ticks: DataFrame, levels: DataFrame, ratios: DataFrame, guards: DataFrame, p: Params, epochs: DataFrame | None = None) -> DataFrame:
    """Everything that checks look at, by tick, entity and metric: value, bar, factor, direction and staleness of levels and
    ratios, slopes of gauges, breaches of guards.

    ``levels``: uid, metric, rule_id, bar, factor, unit, direction; ``guards``: uid, metric, rule_id, bar;
    ``ratios``: numerator, divisor, metric, bar, factor, direction.  With ``epochs`` (tick_seq, epoch) levels and guards
    have an epoch, and every tick sees those of its own.
    """
    numbers = ["bar", "factor", "direction"]
    level, key = S.threshold_components(readings, ticks, levels, p, epochs), ["uid", "metric", "rule_id"]
    if epochs is not None:
        level, key = level.join(F.broadcast(epochs), "tick_seq"), [*key, "epoch"]  # a row a tick
    level = level.join(levels.select(*key, "factor", "direction"), key)
    level = level.select("tick_seq", "uid", "metric", "value", *numbers, "stale", "slope", "slope_samples", "slope_inconclusive")
    of = [S.ratio_pair(readings, ticks, r.numerator, r.divisor, p).select("tick_seq", "uid", F.lit(r.metric).alias("metric"), F.col("ratio").alias("value"), F.lit(r.bar).alias("bar"),
                                                                        F.lit(r.factor).cast("double").alias("factor"), F.lit(r.direction).alias("direction"), "stale")
          for r in ratios.collect()]  # a few authored rules
    guard = S.rate_guards(readings, ticks, guards, p, epochs).select("tick_seq", "uid", "metric", "stale", "breached", "inconclusive")
    out = level
    for d in (*of, guard):
        out = out.unionByName(d, allowMissingColumns=True)
    return cut(out)


def settings(seen: DataFrame, grid: DataFrame) -> DataFrame:
    """``observations`` under each setting (point_id, band, well_above): tick_seq becomes ``point|tick``, state the rung there.

    The grid is a handful of settings; every observation is needed once for each.
    """
    d = seen.join(F.broadcast(grid.select("point_id", "band", "well_above")))
    line = well_above_line(F.col("bar"), F.col("factor"), F.col("well_above"), F.col("direction"))
    state = F.when(F.col("value").isNotNull(), ladder(F.col("value"), F.col("bar"), line, F.col("band"), F.col("direction")))
    return d.withColumn("state", state).withColumn("tick_seq", F.concat_ws("|", "point_id", F.col("tick_seq").cast("string")))


def checked(seen: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, members) for matching, with a check in place of each metric.

    ``members``: phenomenon, signal, role, metric (null: no check), facet, expect, min_state, on_scope.  A check is met as its facet says.
    """
    name = F.when(F.col("metric").isNotNull(), F.concat_ws("/", "phenomenon", "signal", "role", "metric"))
    m = members.withColumn("check", name)
    d = seen.join(m.where("check is not null").select("metric", "facet", "expect", "min_state", "check"), "metric")
    result = member_check(*[F.col(c) for c in ("facet", "expect", "min_state", *SEEN)])
    d = d.select("tick_seq", "uid", F.col("check").alias("metric"), result.alias("r"))
    d = d.select("tick_seq", "uid", "metric", F.when(F.col("r.met"), "above").otherwise("below").alias("state"), (~F.col("r.fresh")).alias("stale"))
    return d, m.select("phenomenon", "signal", "role", F.col("check").alias("metric"), "on_scope")


def by_point(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Rows by tick_seq once for each setting, under the key ``point|tick``."""
    return rows.join(F.broadcast(grid.select("point_id"))).withColumn("tick_seq", F.concat_ws("|", "point_id", F.col("tick_seq").cast("string"))).drop("point_id")


def replay(seen: DataFrame, ticks: DataFrame, members: DataFrame, relations: DataFrame, traversed: DataFrame, grid: DataFrame, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, cascades) of every tick under every setting (point_id, band, well_above, floor, cascade_us).

    findings: point_id, tick_seq, now_us, uid, phenomenon, completeness, full, suspect; cascades as ``cascade_pairs``
    gives them, with point_id.  ``runs`` (tick_seq, run_id): a restart begins a run, and no cascade reaches over it.
    """
    components, own = checked(settings(seen, grid), members)
    components, edges = cut(components), cut(gathered(traversed))  # several branches read them
    tick = F.substring_index("tick_seq", "|", -1).cast("long")  # the topology of a tick serves all settings
    found = D.match_around(components, own, cut(paired(by_tick(edges))), tick=tick)
    keys = by_point(ticks, grid).withColumn("point_id", F.substring_index("tick_seq", "|", 1)).join(F.broadcast(grid.select("point_id", "floor", "cascade_us")), "point_id")
    keys = keys.withColumn("tick", F.substring_index("tick_seq", "|", -1).cast("long"))
    if runs is not None:
        keys = keys.join(runs.select(F.col("tick_seq").alias("tick"), F.col("run_id").alias("run")), "tick", "left")
    run = F.coalesce("run", F.lit(0)) if runs is not None else F.lit(0)
    found = cut(found.join(keys, "tick_seq").where(F.col("full") | (F.col("completeness") >= F.col("floor"))))
    widest = grid.agg(F.max("cascade_us")).first()[0]
    timed = found.select(F.concat_ws("|", "point_id", run.cast("string")).alias("run_id"), F.col("tick").alias("tick_seq"), "now_us", "uid", "phenomenon")
    edges = cut(by_tick(edges_among(edges, timed.select(F.col("uid").alias("key")))))  # a cascade relates findings, so both ends have some
    pairs = D.cascade_pairs(timed, relations, edges, widest).withColumn("point_id", F.substring_index("run_id", "|", 1))
    pairs = pairs.join(F.broadcast(grid.select("point_id", "cascade_us")), "point_id").where(F.col("trigger_us") >= F.col("now_us") - F.col("cascade_us"))
    return (found.select("point_id", F.col("tick").alias("tick_seq"), "now_us", "uid", "phenomenon", "completeness", "full", "suspect"),
            pairs.select("point_id", "tick_seq", "now_us", "uid", "downstream", "trigger", "trigger_uid", "trigger_us", "relation"))


def score(findings: DataFrame, cascades: DataFrame, labels: DataFrame, expected: DataFrame, grid: DataFrame) -> DataFrame:
    """point_id, found, right, labels, caught, precision, recall, cascades_expected, cascades_hit, cascades_false of each setting.

    ``labels``: l_id, phenomenon, uid, from_us, to_us; ``expected``: c_id, trigger, downstream, from_us, to_us.  Only
    phenomena that have labels count.  1 where there is nothing to count.
    """
    scope = labels.select("phenomenon").distinct()
    f = findings.join(scope, "phenomenon", "left_semi").withColumn("f_id", F.concat_ws("|", "tick_seq", "uid", "phenomenon"))
    m = f.join(labels, ["phenomenon", "uid"]).where(F.col("now_us").between(F.col("from_us"), F.col("to_us")))
    a = f.groupBy("point_id").agg(F.count(F.lit(1)).alias("found"))
    b = m.groupBy("point_id").agg(F.count_distinct("f_id").alias("right"), F.count_distinct("l_id").alias("caught"))
    c = cascades.withColumn("c_key", F.concat_ws("|", "tick_seq", "uid", "downstream", "trigger", "trigger_uid"))
    hit = c.join(expected, ["trigger", "downstream"]).where(F.col("now_us").between(F.col("from_us"), F.col("to_us")))
    hits = hit.groupBy("point_id").agg(F.count_distinct("c_id").alias("cascades_hit"))
    wrong = c.join(hit.select("point_id", "c_key").distinct(), ["point_id", "c_key"], "left_anti")
    wrong = wrong.join(scope.withColumnRenamed("phenomenon", "s"), F.col("s").isin(F.col("trigger"), F.col("downstream")), "left_semi")
    wrong = wrong.groupBy("point_id").agg(F.count(F.lit(1)).alias("cascades_false"))
    n = labels.agg(F.count_distinct("l_id").alias("labels")).join(F.broadcast(expected.agg(F.count_distinct("c_id").alias("cascades_expected"))))  # one row
    d = grid.select("point_id")
    for x in (a, b, hits, wrong):
        d = d.join(x, "point_id", "left")
    d = d.na.fill(0).join(F.broadcast(n))
    return d.withColumn("precision", F.coalesce(F.try_divide("right", "found"), F.lit(1.0))).withColumn("recall", F.coalesce(F.try_divide("caught", "labels"), F.lit(1.0)))
