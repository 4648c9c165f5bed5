"""Findings: patterns of met conditions on an entity and around it, cascades, coverage, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telequay.operators.lineage import cut
from telequay.operators.topology import SUSPECT, VALID, alike, anchors_in, edge_traverse, holds_containers, marked_around, pod_uid, pods_of, spelled_out, with_anchor

AT = ["tick_seq", "uid"]
#: Types of edges that relate two entities, the first one counts.
RELATING = ("runs-on", "mounts", "selects")


def _one(components: DataFrame) -> DataFrame:
    """Components whose metric occurs once on the entity: two of one metric are no evidence."""
    n = F.count(F.lit(1)).over(W.partitionBy(*AT, "metric"))
    return components.withColumn("n", n).where("n = 1").drop("n")


def evidence(components: DataFrame, members: DataFrame) -> DataFrame:
    """Members (phenomenon, signal, role, metric or null) of the phenomena that a met member points at: met and fresh or null.

    A member is met when its metric's component is fresh and above its bar.  A
    phenomenon without a met member on an entity is no finding there, so only
    those with one are looked at in full.
    """
    c = _one(components).select(*AT, "metric", F.col("state").isin("above", "well-above").alias("above"), "stale")
    met = c.where("above and not stale").join(members.select("metric", "phenomenon").distinct(), "metric").select(*AT, "phenomenon").distinct()
    return _looked_at(met.join(members, "phenomenon"), c)


def _looked_at(asked: DataFrame, c: DataFrame) -> DataFrame:
    """Members asked for at (tick_seq, uid), with what the components there say."""
    fresh = F.coalesce(~F.col("stale"), F.lit(False))
    more = [x for x in ("on_scope",) if x in asked.columns]
    return asked.join(c, [*AT, "metric"], "left").select(
        *AT, "phenomenon", "signal", "role", "metric", *more, fresh.alias("fresh"), (fresh & F.coalesce("above", F.lit(False))).alias("met"))


def match_local(ev: DataFrame, floor: float = 0.0) -> DataFrame:
    """Findings on one entity: tick_seq, uid, phenomenon, completeness, full.

    A required member that is seen and not met kills the match; at least one
    must be met.  Completeness is met over all required members; a match is
    full when none of them is unseen, else it is kept from ``floor`` on.
    """
    need = F.col("role") == "required"
    d = ev.groupBy(*AT, "phenomenon").agg(
        F.count_if(need).alias("n"), F.count_if(need & F.col("met")).alias("met"), F.count_if(need & F.col("fresh") & ~F.col("met")).alias("refuted"),
        F.count_if(need & ~F.col("fresh")).alias("unseen"), F.count_if(~need & F.col("met")).alias("supporting"))
    d = d.where("refuted = 0 and met > 0").withColumn("completeness", F.col("met") / F.col("n")).withColumn("full", F.col("unseen") == 0)
    return d.where(F.col("full") | (F.col("completeness") >= floor)).select(*AT, "phenomenon", "completeness", "full", "supporting")


def match_spanned(components: DataFrame, members: DataFrame, reached: DataFrame, floor: float = 0.0) -> DataFrame:
    """Findings whose members may be met on entities that are reached over the topology.

    ``members`` has on_scope: ``anchor`` (the entity itself), ``neighbour`` (one hop)
    or ``two-hop``; ``reached`` is (tick_seq, key, target, hop, verdict).  At least
    one required member must be met on the anchor, so only such anchors are looked
    at; suspect is true when evidence came over suspect hops only.  A member on a
    neighbour is met where any reached entity meets it.
    """
    c, away, own = _anchored(components, members)
    hops = F.when(F.col("on_scope") == "neighbour", 1).otherwise(2)
    step = reached.select("tick_seq", F.col("key").alias("uid"), "target", "hop", "verdict")
    near = away.withColumn("hop", hops).join(step, [*AT, "hop"])
    near = near.withColumnRenamed("uid", "anchor_uid").withColumnRenamed("target", "uid")
    near = near.join(c, [*AT, "metric"], "left").withColumn("fresh", F.coalesce(~F.col("stale"), F.lit(False))).withColumn("met", F.col("fresh") & F.coalesce("above", F.lit(False)))
    near = near.groupBy("tick_seq", F.col("anchor_uid").alias("uid"), "phenomenon", "signal", "role").agg(
        F.bool_or("met").alias("met"), F.bool_or("fresh").alias("fresh"), F.max(F.when(F.col("met"), F.col("verdict"))).alias("verdict"))
    return _spanned(own, away, near, floor)


def match_around(components: DataFrame, members: DataFrame, pairs: DataFrame, floor: float = 0.0, tick: Column | None = None) -> DataFrame:
    """The findings of ``match_spanned`` over ``topology.paired`` edges, without a list of who reaches whom.

    Of an anchor only whether any entity at the hop is met, seen, and over what, is asked for, so walks are counted
    (``topology.marked_around``): what is held grows with the edges, not with the pairs of a hub's neighbours.  Containers walk from their pod.  ``tick``: the tick of ``pairs`` that a row's tick_seq means, where one
    topology serves several of them.
    """
    c, away, own = _anchored(components, members)
    away = away.withColumn("hop", F.when(F.col("on_scope") == "neighbour", 1).otherwise(2))
    at = F.col("tick_seq") if tick is None else tick
    label = (F.col("metric") if tick is None else F.struct("tick_seq", "metric")).alias("label")
    asked = away.where("metric is not null").select(at.alias("at"), F.col("uid").alias("key"), label, "hop").distinct().withColumnRenamed("at", "tick_seq")
    asked = cut(asked)  # several branches read it
    asked = asked.join(anchors_in(asked, pairs), ["tick_seq", "key"])
    marks = c.where("not stale").join(F.broadcast(members.where("on_scope <> 'anchor' and metric is not null").select("metric").distinct()), "metric", "left_semi").select(
        at.alias("at"), F.col("uid").alias("target"), label, F.coalesce("above", F.lit(False)).alias("met")).withColumnRenamed("at", "tick_seq")
    seen = marked_around(pairs, asked.select("tick_seq", F.col("anchor").alias("key"), "label", "hop"), marks).withColumnRenamed("key", "anchor")
    names = ["tick_seq", F.col("label").alias("metric")] if tick is None else ["label.tick_seq", "label.metric"]
    seen = asked.join(seen, ["tick_seq", "anchor", "label", "hop"]).select(*names, F.col("key").alias("uid"), "hop", "met", "verdict")
    near = away.join(seen, [*AT, "metric", "hop"]).groupBy(*AT, "phenomenon", "signal", "role").agg(F.bool_or("met").alias("met"), F.lit(True).alias("fresh"), F.max("verdict").alias("verdict"))
    return _spanned(own, away, near, floor)


def _anchored(components: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, members asked for away from an anchor, what those on it say) of anchors with a required member met there."""
    c = _one(components).select(*AT, "metric", F.col("state").isin("above", "well-above").alias("above"), "stale")
    anchors = c.where("above and not stale").join(members.where("role = 'required' and on_scope = 'anchor'").select("metric", "phenomenon").distinct(), "metric").select(
        *AT, "phenomenon").distinct()
    asked = anchors.join(members, "phenomenon")
    own = _looked_at(asked.where("on_scope = 'anchor'"), c).select(*AT, "phenomenon", "signal", "role", "met", "fresh", F.lit(2).alias("verdict"), F.lit(True).alias("anchor"))
    return c, asked.where("on_scope <> 'anchor'"), own


def _spanned(own: DataFrame, away: DataFrame, near: DataFrame, floor: float) -> DataFrame:
    """Findings from what members say on the anchor and, where anything is seen there, around it."""
    near = away.select(*AT, "phenomenon", "signal", "role").join(near, [*AT, "phenomenon", "signal", "role"], "left").select(
        *AT, "phenomenon", "signal", "role", F.coalesce("met", F.lit(False)).alias("met"), F.coalesce("fresh", F.lit(False)).alias("fresh"), "verdict", F.lit(False).alias("anchor"))
    need = F.col("role") == "required"
    d = own.unionByName(near).groupBy(*AT, "phenomenon").agg(
        F.count_if(need).alias("n"), F.count_if(need & F.col("met")).alias("met"), F.count_if(need & F.col("fresh") & ~F.col("met")).alias("refuted"),
        F.count_if(need & ~F.col("fresh")).alias("unseen"), F.count_if(need & F.col("met") & F.col("anchor")).alias("on_anchor"),
        F.count_if(F.col("met") & (F.col("verdict") == 1)).alias("suspect"))
    d = d.where("refuted = 0 and on_anchor > 0").withColumn("completeness", F.col("met") / F.col("n")).withColumn("full", F.col("unseen") == 0)
    return d.where(F.col("full") | (F.col("completeness") >= floor)).select(*AT, "phenomenon", "completeness", "full", (F.col("suspect") > 0).alias("suspect"))


def related(pairs: DataFrame, traversed: DataFrame, types: tuple[str, ...] = RELATING) -> DataFrame:
    """How two entities of (tick_seq, a, b) are related, if they are.

    same-entity for equal keys, containers of one pod, or equal anchors (a
    container's anchor is its pod); else the first type with an edge between the
    anchors either way, suspect where none of that type is valid.
    """
    pods = pods_of(traversed)
    d = with_anchor(with_anchor(pairs, "a", pods), "b", pods)
    e = traversed.where(F.col("type").isin(*types)).select("tick_seq", F.least("from_key", "to_key").alias("lo"), F.greatest("from_key", "to_key").alias("hi"), "type", "verdict")
    prio = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("type"))
    e = e.groupBy("tick_seq", "lo", "hi").agg(F.min(F.struct(prio.alias("p"), (-F.col("verdict")).alias("worse"), "type")).alias("r"))
    d = d.withColumn("lo", F.least("a_anchor", "b_anchor")).withColumn("hi", F.greatest("a_anchor", "b_anchor")).join(e, ["tick_seq", "lo", "hi"], "left")
    one_pod = F.coalesce(pod_uid(F.col("a")) == pod_uid(F.col("b")), F.lit(False))
    same = (F.col("a") == F.col("b")) | one_pod | (F.col("a_anchor") == F.col("b_anchor"))
    how = (F.when(same, "same-entity").when(F.col("r.worse") == -1, F.concat("r.type", F.lit(" (suspect)"))).otherwise(F.col("r.type")))
    return d.select("tick_seq", "a", "b", how.alias("relation")).where("relation is not null")


def cascade_pairs(findings: DataFrame, relations: DataFrame, traversed: DataFrame, window_us: int, triggers: DataFrame | None = None) -> DataFrame:
    """Downstream findings with their triggers on related entities.

    ``triggers`` (default: the findings themselves) are looked for instead, as on a stream.

    ``findings``: run_id, tick_seq, now_us, uid, phenomenon.  Of each (trigger
    phenomenon, entity) the latest occurrence counts that is no later than the
    downstream finding and at most ``window_us`` before it, in the same run; a
    finding is never its own trigger.  run_id, tick_seq, now_us, uid, downstream,
    trigger, trigger_uid, trigger_us, relation.

    Candidates come over the edges of the downstream's anchor at its tick, so
    findings meet only those of their neighbours; times are joined by slots as
    wide as the window.
    """
    pods = pods_of(traversed)
    placed = with_anchor(findings.withColumn("place", F.coalesce(pod_uid(F.col("uid")), "uid")), "uid", pods)
    d = placed.withColumnRenamed("phenomenon", "downstream").join(relations.select("trigger", "downstream"), "downstream")
    edges = traversed.select("tick_seq", F.col("from_key").alias("uid_anchor"), F.col("to_key").alias("other")).union(
        traversed.select("tick_seq", "to_key", "from_key"))
    near = d.join(edges, ["tick_seq", "uid_anchor"]).withColumn("by", F.lit("anchor")).unionByName(
        d.withColumn("other", F.col("uid_anchor")).withColumn("by", F.lit("anchor"))).unionByName(d.withColumn("other", F.col("place")).withColumn("by", F.lit("pod")))
    slot = lambda t: F.floor(t / F.lit(window_us))
    of = placed if triggers is None else with_anchor(triggers.withColumn("place", F.coalesce(pod_uid(F.col("uid")), "uid")), "uid", pods)
    t = of.select("run_id", F.col("now_us").alias("t_us"), F.col("uid").alias("trigger_uid"), F.col("phenomenon").alias("trigger"), "uid_anchor", "place", slot(F.col("now_us")).alias("slot"))
    t = t.select("run_id", "t_us", "trigger_uid", "trigger", F.col("uid_anchor").alias("other"), "slot", F.lit("anchor").alias("by")).union(
        t.select("run_id", "t_us", "trigger_uid", "trigger", "place", "slot", F.lit("pod")))
    near = near.withColumn("slot", F.explode(F.array(slot(F.col("now_us")), slot(F.col("now_us")) - 1)))
    key = ["run_id", "tick_seq", "now_us", "uid", "downstream", "trigger", "trigger_uid"]
    found = near.join(t, ["run_id", "trigger", "other", "by", "slot"]).where(
        F.col("t_us").between(F.col("now_us") - window_us, F.col("now_us")) & ((F.col("trigger") != F.col("downstream")) | (F.col("trigger_uid") != F.col("uid"))))
    found = found.groupBy(*key).agg(F.max("t_us").alias("trigger_us"))
    how = related(found.select("tick_seq", F.col("trigger_uid").alias("a"), F.col("uid").alias("b")).distinct(), traversed)
    return found.join(how.withColumnsRenamed({"a": "trigger_uid", "b": "uid"}), ["tick_seq", "trigger_uid", "uid"]).select(*key, "trigger_us", "relation")


def blast_radius(findings: DataFrame, relations: DataFrame, tier_a: DataFrame, near: DataFrame) -> DataFrame:
    """Entities that take part in a downstream phenomenon and are related to the finding's entity now."""
    d = findings.select("tick_seq", F.col("uid").alias("a"), F.col("phenomenon").alias("trigger")).join(relations.select("trigger", "downstream"), "trigger")
    d = d.join(near, ["tick_seq", "a"]).join(tier_a.select(F.col("uid").alias("b"), F.col("phenomenon").alias("downstream")), ["b", "downstream"])
    return d.select("tick_seq", F.col("a").alias("uid"), "trigger", "downstream", F.col("b").alias("at_risk"), "relation").distinct()


def around(findings: DataFrame, traversed: DataFrame) -> DataFrame:
    """tick_seq, a, b, relation: entities of findings with themselves and all that an edge relates them to at the tick."""
    a = findings.select("tick_seq", F.col("uid").alias("a")).distinct()
    e = traversed.select("tick_seq", F.col("from_key").alias("a"), F.col("to_key").alias("b")).union(traversed.select("tick_seq", "to_key", "from_key")).distinct()
    return related(a.withColumn("b", F.col("a")).unionByName(a.join(e, ["tick_seq", "a"])).distinct(), traversed)


def _met_risks(findings: DataFrame, relations: DataFrame, tier_a: DataFrame, edges: DataFrame | None, windows: DataFrame, budget_us: int, few: bool = False) -> DataFrame:
    """tick_seq, uid, trigger, downstream, at_risk, rank: what ``blast_radius`` lists, a row for each edge that relates the two (rank: by type, then verdict), of entities that are no containers.

    An edge brings its ends' findings and phenomena along, so it is looked at in the ticks of those findings only, and no
    list of edges by tick is made.  The last exchange is by uid.  ``few``: findings are a handful (they go to every task).
    Without ``edges`` an entity meets itself only.
    """
    at = F.broadcast(windows.select("tick_seq", "start_us", "end_us"))  # a small authored table
    asks = findings.select("tick_seq", "uid", F.col("phenomenon").alias("trigger")).join(F.broadcast(relations.select("trigger", "downstream")), "trigger").join(at, "tick_seq")
    asks = asks.groupBy("uid").agg(F.collect_set(F.struct("tick_seq", "start_us", "end_us", "trigger", "downstream")).alias("asks"))  # an entity's own findings
    takes = tier_a.groupBy(F.col("uid").alias("at_risk")).agg(F.collect_set("phenomenon").alias("takes"))  # an entity's own phenomena
    none = F.lit(None).cast("long")
    rows = asks.select("uid", F.col("uid").alias("at_risk"), F.lit(0).alias("turn"), none.alias("asserted_us"), none.alias("retracted_us"), none.alias("confirmed_us"))
    if edges is not None:
        turn = F.array_position(F.array(*map(F.lit, RELATING)), F.col("type")).cast("int")
        e = edges.where(F.col("type").isin(*RELATING) & (F.col("from_key") != F.col("to_key")))
        ends = F.explode(F.array(F.struct(F.col("from_key").alias("uid"), F.col("to_key").alias("at_risk")), F.struct(F.col("to_key").alias("uid"), F.col("from_key").alias("at_risk"))))
        rows = rows.unionByName(e.select(ends.alias("e"), turn.alias("turn"), "asserted_us", "retracted_us", "confirmed_us").select("e.*", "turn", "asserted_us", "retracted_us", "confirmed_us"))
    d = rows.join(F.broadcast(asks), "uid").join(takes, "at_risk") if few else rows.join(takes, "at_risk").join(asks, "uid")
    d = d.withColumn("a", F.explode(F.filter("asks", lambda a: F.array_contains(F.col("takes"), a["downstream"]) & F.coalesce(F.col("asserted_us") <= a["end_us"], F.lit(True))
                                             & F.coalesce(F.col("retracted_us") > a["start_us"], F.lit(True)))))
    late = F.col("retracted_us").isNull() & F.coalesce(F.col("a.end_us") - F.col("confirmed_us") > budget_us, F.lit(False))
    return d.select("a.tick_seq", "uid", "a.trigger", "a.downstream", "at_risk", (F.col("turn") * 10 - F.when(late, SUSPECT).otherwise(VALID)).alias("rank"))


def blast_radius_over(findings: DataFrame, relations: DataFrame, tier_a: DataFrame, edges: DataFrame, windows: DataFrame, budget_us: int) -> DataFrame:
    """``blast_radius`` over edge intervals in windows (tick_seq, start_us, end_us), as ``edge_traverse`` takes them; with containers by way of ``around``."""
    if holds_containers(findings.select("uid"), tier_a.select("uid")):
        return blast_radius(findings, relations, tier_a, around(findings, edge_traverse(edges, windows, budget_us)))
    d = _met_risks(findings, relations, tier_a, edges, windows, budget_us)
    d = d.groupBy("tick_seq", "uid", "trigger", "downstream", "at_risk").agg(F.min("rank").alias("rank"))
    # rank: 10 for each place of the type, less the verdict
    kind = F.element_at(F.array(*map(F.lit, RELATING)), F.ceil(F.col("rank") / 10).cast("int"))
    how = F.when(F.col("rank") < 0, "same-entity").when(F.pmod("rank", F.lit(10)) == 10 - SUSPECT, F.concat(kind, F.lit(" (suspect)"))).otherwise(kind)
    return d.select("tick_seq", "uid", "trigger", "downstream", "at_risk", how.alias("relation"))


def any_at_risk(findings: DataFrame, relations: DataFrame, tier_a: DataFrame, edges: DataFrame, windows: DataFrame, budget_us: int) -> DataFrame:
    """Findings with ``risky``: whether their blast radius holds any entity.  Where the entity itself is in it no edge is asked for."""
    key = ["tick_seq", "uid", "phenomenon"]
    if holds_containers(findings.select("uid"), tier_a.select("uid")):
        full = blast_radius(findings, relations, tier_a, around(findings, edge_traverse(edges, windows, budget_us)))
        return with_at_risk(findings, full).withColumn("risky", F.col("at_risk") > 0).drop("at_risk")
    named = lambda d: d.select("tick_seq", "uid", F.col("trigger").alias("phenomenon")).distinct()
    own = named(_met_risks(findings, relations, tier_a, None, windows, budget_us))
    left = findings.join(own, key, "left_anti")
    far = named(_met_risks(left, relations, tier_a, _touching(edges, left.select("uid").distinct()), windows, budget_us))
    return findings.join(own.unionByName(far).withColumn("risky", F.lit(True)), key, "left").na.fill(False, ["risky"])


def _touching(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with an end among keys (uid), each once."""
    end = lambda name: keys.select(F.col("uid").alias(name))
    a = edges.join(end("from_key"), "from_key", "left_semi")
    return a.unionByName(edges.join(end("to_key"), "to_key", "left_semi").join(end("from_key"), "from_key", "left_anti"))


def count_at_risk(findings: DataFrame, relations: DataFrame, tier_a: DataFrame, edges: DataFrame, windows: DataFrame, budget_us: int) -> DataFrame:
    """A handful of findings with at_risk: how many entities their blast radius holds."""
    if holds_containers(findings.select("uid"), tier_a.select("uid")):
        return with_at_risk(findings, blast_radius(findings, relations, tier_a, around(findings, edge_traverse(edges, windows, budget_us))))
    return with_at_risk(findings, _met_risks(findings, relations, tier_a, edges, windows, budget_us, few=True))


def with_at_risk(findings: DataFrame, radius: DataFrame) -> DataFrame:
    """Findings with at_risk: how many entities their blast radius holds."""
    n = radius.groupBy("tick_seq", "uid", F.col("trigger").alias("phenomenon")).agg(F.count_distinct("at_risk").alias("at_risk"))
    return findings.join(n, ["tick_seq", "uid", "phenomenon"], "left").na.fill(0, ["at_risk"])


def latest_triggers(findings: DataFrame, window_us: int) -> DataFrame:
    """What a cascade tracker holds after the newest finding of each run: the latest of each (phenomenon, entity) within the window."""
    rest = [c for c in findings.columns if c not in ("run_id", "phenomenon", "uid")]
    d = findings.groupBy("run_id", "phenomenon", "uid").agg(F.max_by(F.struct(*rest), "now_us").alias("s")).select("run_id", "phenomenon", "uid", "s.*")
    end = findings.groupBy("run_id").agg(F.max("now_us").alias("end"))
    return d.join(end, "run_id").where(F.col("now_us") >= F.col("end") - window_us).select(*findings.columns)


def coverage(ev: DataFrame, findings: DataFrame) -> DataFrame:
    """tick_seq, uid, metric, phenomenon: the met evidence of findings on the entity itself."""
    return ev.where("met").join(findings.select(*AT, "phenomenon"), [*AT, "phenomenon"], "left_semi").select(*AT, "metric", "phenomenon").distinct()


def spanned_coverage(components: DataFrame, members: DataFrame, reached: DataFrame, findings: DataFrame) -> DataFrame:
    """As ``coverage`` for findings of ``match_spanned``: what met a member on the anchor, and on every reached entity that met one."""
    met = _one(components).where("state in ('above', 'well-above') and not stale").select(*AT, "metric")
    asked = findings.select(*AT, "phenomenon").join(members.where("metric is not null").select("phenomenon", "metric", "on_scope").distinct(), "phenomenon")
    own = asked.where("on_scope = 'anchor'").select(*AT, "metric", "phenomenon")
    step = reached.select("tick_seq", F.col("key").alias("uid"), "target", "hop")
    near = asked.where("on_scope <> 'anchor'").withColumn("hop", F.when(F.col("on_scope") == "neighbour", 1).otherwise(2)).join(step, [*AT, "hop"])
    return own.unionByName(near.select("tick_seq", F.col("target").alias("uid"), "metric", "phenomenon")).distinct().join(met, [*AT, "metric"], "left_semi").select(*AT, "metric", "phenomenon")


def coverage_around(components: DataFrame, members: DataFrame, pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """``spanned_coverage`` for findings of ``match_around``: as hops hold both ways, met entities ask for findings around them."""
    met = _one(components).where("state in ('above', 'well-above') and not stale").select(*AT, "metric")
    asked = F.broadcast(members.where("metric is not null").select("phenomenon", "metric", F.when(F.col("on_scope") == "anchor", 0).when(F.col("on_scope") == "neighbour", 1).otherwise(2).alias("hop")).distinct())  # authored
    own = met.join(asked.where("hop = 0"), "metric").join(findings.select(*AT, "phenomenon").distinct(), [*AT, "phenomenon"], "left_semi").select(*AT, "metric", "phenomenon")
    at = findings.select("tick_seq", F.col("uid").alias("key"), F.col("phenomenon").alias("label")).distinct()
    marks = at.join(anchors_in(at, pairs), ["tick_seq", "key"]).select("tick_seq", F.col("anchor").alias("target"), "label", F.lit(True).alias("met"))
    near = met.join(asked.where("hop > 0"), "metric").withColumnsRenamed({"uid": "key", "phenomenon": "label"})
    near = near.join(marked_around(pairs, near, marks, few=True).select("tick_seq", "key", "label", "hop"), ["tick_seq", "key", "label", "hop"], "left_semi")
    return own.unionByName(near.select("tick_seq", F.col("key").alias("uid"), "metric", F.col("label").alias("phenomenon"))).distinct()


def uncovered_loud(loud: DataFrame, covered: DataFrame) -> DataFrame:
    """Loud (tick_seq, uid, metric) that no finding used as met evidence, be it of the entity or of one it was reached from."""
    return loud.select(*AT, "metric").distinct().join(covered.select(*AT, "metric").distinct(), [*AT, "metric"], "left_anti")


def covering_phenomena(cards: DataFrame, members: DataFrame) -> DataFrame:
    """For cards (card_id, metrics): the smallest phenomenon with all metrics, else all that contribute, else none."""
    m = members.where("metric is not null").select("phenomenon", "metric").distinct()
    hits = cards.select("card_id", F.size("metrics").alias("size"), F.explode("metrics").alias("metric")).join(m, "metric").groupBy("card_id", "size", "phenomenon").agg(F.count(F.lit(1)).alias("n"))
    by = hits.groupBy("card_id").agg(F.min(F.when(F.col("n") == F.col("size"), F.col("phenomenon"))).alias("whole"), F.array_sort(F.collect_set("phenomenon")).alias("parts"))
    d = cards.select("card_id").join(by, "card_id", "left")
    return d.select("card_id", F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(F.coalesce("parts", F.array().cast("array<string>"))).alias("phenomena"))


def card_aging(uncovered: DataFrame, ticks: DataFrame, loud: DataFrame | None = None, covered: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Cards of unexplained crossings: tick_seq, uid, signature, status, first_seen, occurrences, superseded_by.

    While an entity's sets at consecutive ticks share a metric it is one card:
    new, then aging.  When the next tick's set shares none (or is empty) the
    card is closed at that tick: superseded where all its metrics are still in
    the entity's whole loud set (``loud``), so that findings cover them now,
    else resolved.  ``superseded_by`` names the smallest phenomenon that covers
    them all (``covered``: tick_seq, uid, metric, phenomenon), else all that
    contribute.  ``runs`` (tick_seq, run_id): a restart forgets open cards.
    """
    numbered = ticks.select("tick_seq", F.row_number().over(W.orderBy("now_us", "tick_seq")).alias("idx"))  # a small authored table
    numbered = numbered.join(runs, "tick_seq", "left").na.fill(0, ["run_id"]) if runs is not None else numbered.withColumn("run_id", F.lit(0))
    sets = uncovered.groupBy(*AT).agg(F.array_sort(F.collect_set("metric")).alias("metrics")).join(F.broadcast(numbered), "tick_seq")
    order = W.partitionBy("uid", "run_id").orderBy("idx")
    follows = (F.lag("idx").over(order) == F.col("idx") - 1) & F.arrays_overlap("metrics", F.lag("metrics").over(order))
    d = sets.withColumn("starts", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("island", F.sum("starts").over(order))
    own = W.partitionBy("uid", "run_id", "island").orderBy("idx")
    d = d.withColumns({"first_seen": F.first("tick_seq").over(own), "occurrences": F.row_number().over(own), "later": F.lead("idx").over(own)})
    signature = F.concat_ws(",", "metrics")
    live = d.select(*AT, signature.alias("signature"), F.when(F.col("occurrences") == 1, "new").otherwise("aging").alias("status"), "first_seen", "occurrences", F.lit("").alias("superseded_by"))
    closing = numbered.select((F.col("idx") - 1).alias("idx"), "run_id", F.col("tick_seq").alias("close_tick"))
    last = d.where("later is null").drop("tick_seq", "later").join(F.broadcast(closing), ["idx", "run_id"]).withColumnRenamed("close_tick", "tick_seq")
    last = last.select(*AT, "metrics", signature.alias("signature"), "first_seen", "occurrences")
    if loud is None:
        return live.unionByName(last.select(*AT, "signature", F.lit("resolved").alias("status"), "first_seen", "occurrences", F.lit("").alias("superseded_by")))
    each = last.select(*AT, "signature", F.size("metrics").alias("size"), F.explode("metrics").alias("metric"))  # one card closes at most per entity and tick
    held = each.join(loud.select(*AT, "metric").distinct(), [*AT, "metric"], "left_semi").groupBy(*AT).agg(F.count(F.lit(1)).alias("held"))
    by = each.join(covered, [*AT, "metric"]).groupBy(*AT, "size", "phenomenon").agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy(*AT).agg(F.min(F.when(F.col("n") == F.col("size"), F.col("phenomenon"))).alias("whole"), F.concat_ws(", ", F.array_sort(F.collect_set("phenomenon"))).alias("parts"))
    still = F.coalesce(F.col("held") == F.size("metrics"), F.lit(False))
    closed = last.join(held, AT, "left").join(by, AT, "left").select(
        *AT, "signature", F.when(still, "superseded").otherwise("resolved").alias("status"), "first_seen", "occurrences", F.when(still, F.coalesce("whole", "parts", F.lit(""))).otherwise("").alias("superseded_by"))
    return live.unionByName(closed)


def entity_ticks(loud: DataFrame, uncovered: DataFrame, covered: DataFrame, ticks: DataFrame) -> DataFrame:
    """What a stream of cards reads: idx, tick_seq, now_us, uid, and arrays of loud and uncovered metrics and of covers (metric and phenomenon, as text)."""
    numbered = ticks.select("tick_seq", "now_us", F.row_number().over(W.orderBy("now_us", "tick_seq")).cast("long").alias("idx"))
    a = loud.groupBy(*AT).agg(F.array_sort(F.collect_set("metric")).alias("loud"))
    b = uncovered.groupBy(*AT).agg(F.array_sort(F.collect_set("metric")).alias("uncovered"))
    c = covered.groupBy(*AT).agg(F.array_sort(F.collect_set(F.concat_ws("\u0001", "metric", "phenomenon"))).alias("covers"))
    none = F.array().cast("array<string>")
    return a.join(b, AT, "left").join(c, AT, "left").join(F.broadcast(numbered), "tick_seq").select(
        "idx", "tick_seq", "now_us", "uid", "loud", F.coalesce("uncovered", none).alias("uncovered"), F.coalesce("covers", none).alias("covers"))


def candidates(cards: DataFrame, min_windows: int, min_entities: int) -> DataFrame:
    """Signatures worth a pattern: seen in so many windows, or on so many entities."""
    d = cards.where("status in ('new', 'aging')").groupBy("signature").agg(
        F.count(F.lit(1)).alias("windows"), F.count_distinct("uid").alias("entities"), F.min("tick_seq").alias("first_seen"), F.max("tick_seq").alias("last_seen"))
    return d.where((F.col("windows") >= min_windows) | (F.col("entities") >= min_entities))


def tier_a(bindings: DataFrame, members: DataFrame) -> DataFrame:
    """Which phenomena an entity takes part in: by its rules' signals or by metrics that back a check; usable bindings only."""
    b = bindings.select("uid", "signal", "metric").distinct()
    by_signal = b.join(members.select("phenomenon", "signal"), "signal").select("uid", "phenomenon")
    by_metric = b.join(members.where("metric is not null").select("phenomenon", "metric"), "metric").select("uid", "phenomenon")
    return by_signal.unionByName(by_metric).distinct()


def selection_records(entities: DataFrame, tier: DataFrame, bindings: DataFrame, stale: DataFrame) -> DataFrame:
    """One record per entity (uid): selected with its number of phenomena, or the first reason why not.

    ``bindings``: uid, usable (bound to a bar, validation not failed).  An entity
    in no phenomenon is no-phenomenon with a usable binding and
    no-evaluable-variable with others only.  One without any is stale where
    bindings are older than the inventory (``stale``: uid), as nothing can be
    said of its kind then, else structural-entity.
    """
    n = tier.groupBy("uid").agg(F.count_distinct("phenomenon").alias("phenomena"))
    b = bindings.groupBy("uid").agg(F.bool_or("usable").alias("usable"))
    d = entities.join(n, "uid", "left").join(b, "uid", "left").join(stale.select("uid", F.lit(True).alias("late")).distinct(), "uid", "left")
    reason = (F.when(F.col("phenomena").isNotNull(), "selected").when(F.col("usable"), "no-phenomenon").when(F.col("usable").isNotNull(), "no-evaluable-variable")
              .when(F.col("late"), "stale").otherwise("structural-entity"))
    return d.select("uid", reason.alias("reason"), F.coalesce("phenomena", F.lit(0)).alias("phenomena"))


def budget_top_k(targets: DataFrame, ceiling: int) -> DataFrame:
    """Targets (uid, metric, precursor) ranked, precursors first; the first ``ceiling`` are budgeted (0 or less: all).

    Only the budgeted are ranked: a top-k that every task cuts to ``ceiling`` rows first.  The others have no rank.
    """
    order = [F.col("precursor").desc(), F.col("uid"), F.col("metric")]
    if ceiling <= 0:
        return targets.withColumn("rank", F.lit(None).cast("int")).withColumn("budgeted", F.lit(True))
    key = ["uid", "metric", "precursor"]
    top = targets.select(*key).distinct().orderBy(*order).limit(ceiling)
    top = top.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # at most ``ceiling`` rows
    return targets.join(F.broadcast(top), key, "left").withColumn("budgeted", F.col("rank").isNotNull())


def closure(tier: DataFrame, spans: DataFrame, traversed: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What lies around selected entities along their phenomena's own edges, and where nothing does.

    ``tier``: uid, phenomenon; ``spans`` (a small authored table): phenomenon,
    depth (0: the entity only, 1 or 2), types (array of edge types, in order);
    ``origins``: tick_seq, key, anchor and note, as ``containment`` gives them.

    Neighbours: tick_seq, uid, target, via (type of the last edge), hop, verdict
    (of that edge), path and phenomena (those that lead there so, in order; path
    and verdict are the first one's).  A phenomenon visits an entity once: at the
    smaller hop, then by the order of types, of the first hop's keys, of types again.
    Gaps: tick_seq, uid, phenomenon, reason, one for each phenomenon that no edge
    at the origin serves.
    """
    spans = F.broadcast(spans.where("depth > 0"))
    at = ["tick_seq", "uid", "phenomenon"]
    start = tier.join(spans, "phenomenon").join(origins.withColumnRenamed("key", "uid"), "uid").select(*at, "depth", "types", "anchor", "note")
    ends = [traversed.select("tick_seq", F.col(a).alias("here"), F.col(b).alias("target"), "type", "verdict") for a, b in (("from_key", "to_key"), ("to_key", "from_key"))]
    near = cut(ends[0].unionByName(ends[1]).groupBy("tick_seq", "here", "target", "type").agg(F.max("verdict").alias("verdict")))
    turn = F.array_position("types", F.col("type"))
    met = start.withColumn("here", F.col("anchor")).join(near, ["tick_seq", "here"]).withColumn("turn", turn).where("turn > 0")
    visited = (F.col("target") != F.col("anchor")) & (F.col("target") != F.col("uid"))
    kinds = F.array_sort(F.collect_set("phenomenon"))  # the entity's own few phenomena
    first = lambda *order: F.min_by(F.struct(F.col("type").alias("via"), "verdict", "turn", "path"), F.struct(*order)).alias("s")
    by_first = lambda d, *key: d.groupBy(*key, "via").agg(F.min_by(F.struct("verdict", "path"), "phenomenon").alias("s"), F.concat_ws(",", kinds).alias("phenomena"))
    one = met.where(visited).withColumn("path", F.concat_ws(">", "here", "type", "target")).groupBy(*at, "target").agg(first("turn")).select(*at, "target", "s.*")
    one = by_first(one, "tick_seq", "uid", "target").select("tick_seq", "uid", "target", "via", F.lit(1).alias("hop"), "s.*", "phenomena")
    # Second hops, for origins that are alike in edges and phenomena at once, to one of the targets that are; a container's own key is no step.
    like = cut(alike(near.select("tick_seq", F.col("here").alias("key"), F.col("target").alias("neighbour"), "type", "verdict")))
    group = ["tick_seq", "origin", "own", "kinds"]
    begin = start.where("depth > 1").groupBy("tick_seq", "uid", "anchor").agg(kinds.alias("kinds")).join(like.select("tick_seq", F.col("key").alias("anchor"), F.col("like").alias("origin")), ["tick_seq", "anchor"])
    begin = begin.withColumn("own", F.when(F.col("uid") != F.col("anchor"), F.array("uid")).otherwise(F.array().cast("array<string>")))
    edges = near.join(like.where("key = like").select("tick_seq", F.col("key").alias("here")), ["tick_seq", "here"], "left_semi")
    walk = begin.select(*group).distinct().withColumn("phenomenon", F.explode("kinds")).join(spans, "phenomenon")
    walk = walk.join(edges.select("tick_seq", F.col("here").alias("origin"), F.col("target").alias("here"), "type", "verdict"), ["tick_seq", "origin"]).withColumn("turn", turn).where("turn > 0")
    served = walk.select(*group, "phenomenon", F.col("here").alias("like"))
    walk = walk.where(~F.array_contains("own", F.col("here"))).withColumn("path", F.concat_ws(">", "type", "here")).groupBy(*group, "phenomenon", "here").agg(first("turn"))
    far = walk.select(*group, "phenomenon", "here", F.col("s.turn").alias("turn_1"), "s.path").join(spans, "phenomenon").join(
        edges.select("tick_seq", F.col("here").alias("like"), F.col("target").alias("here"), "type", "verdict"), ["tick_seq", "here"])
    far = far.withColumn("turn", turn).where("turn > 0").join(served, [*group, "phenomenon", "like"], "left_anti").withColumn("path", F.concat_ws(">", "path", "type"))
    far = by_first(far.groupBy(*group, "phenomenon", "like").agg(first("turn_1", "here", "turn")).select(*group, "phenomenon", "like", "s.*"), *group, "like")
    two = spelled_out(begin.join(far, group).select("tick_seq", "uid", "anchor", "like", "via", "s.*", "phenomena"), like, "uid").where(visited)
    two = two.select("tick_seq", "uid", "target", "via", F.lit(2).alias("hop"), "verdict", F.concat_ws(">", "anchor", "path", "target").alias("path"), "phenomena")
    gaps = start.join(met.select(*at).distinct(), at, "left_anti")
    reason = F.coalesce("note", F.concat(F.lit("no traversable neighbour along "), F.concat_ws("|", "types"), F.lit(" in window")))
    return one.unionByName(two), gaps.select(*at, reason.alias("reason"))


def warning_cards(projected: DataFrame, names: DataFrame, at_risk: DataFrame) -> DataFrame:
    """Projected crossings (uid, metric, crosses_us) with the entity's name and how many entities are at risk, soonest first."""
    risk = at_risk.select("uid", "at_risk").distinct().groupBy("uid").agg(F.count(F.lit(1)).alias("at_risk"))
    d = projected.join(names, "uid", "left").join(risk, "uid", "left")
    return d.select("uid", "metric", "name", "crosses_us", F.coalesce("at_risk", F.lit(0)).alias("at_risk")).orderBy("crosses_us", "uid", "metric")
