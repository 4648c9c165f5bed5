"""The topology at a time: edge intervals, traversal, neighbours, reach over two hops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut
from .signals import first_seen, number_ticks

#: Verdicts by worth; the worst hop decides a path.
SUSPECT, VALID = 1, 2
#: Entities with more edges at a tick than this stand for themselves in ``alike``.
FEW = 64
#: Parts in which the walks that end at equal entities are dealt to tasks.
SLICES = 8


def edge_intervals(events: DataFrame, current_only: bool = True) -> DataFrame:
    """Intervals of edges from events (type, from_key, to_key, op, event_us, seq).

    An assertion confirms the open interval; one strictly after a retraction
    opens a new one; a retraction closes it, not before it began.  With
    ``current_only`` the last interval of each edge.
    """
    key = ["type", "from_key", "to_key"]
    order = W.partitionBy(*key).orderBy("event_us", "seq")
    # An island ends with a retraction; assertions after it begin the next.
    closed = F.coalesce(F.sum(F.when(F.col("op") == "retract", 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = events.withColumn("island", closed)
    asserted = F.col("op") == "assert"
    d = d.groupBy(*key, "island").agg(F.min(F.when(asserted, F.col("event_us"))).alias("asserted_us"), F.max(F.when(asserted, F.col("event_us"))).alias("confirmed_us"),
                                      F.min(F.when(~asserted, F.col("event_us"))).alias("retract_us")).where("asserted_us is not null")
    d = d.withColumn("retracted_us", F.greatest("retract_us", F.when(F.col("retract_us").isNotNull(), F.col("asserted_us")))).drop("retract_us")
    if current_only:
        last = F.row_number().over(W.partitionBy(*key).orderBy(F.col("island").desc()))
        d = d.withColumn("k", last).where("k = 1").drop("k")
    return d.drop("island")


def reconcile_out(snapshots: DataFrame) -> DataFrame:
    """Edge events from full target sets: (type, from_key, to_key, event_us) says all targets of a source at a time.

    A target missing from the source's next snapshot is retracted at that time.
    """
    source = snapshots.select("type", "from_key", "event_us").distinct()
    nxt = source.withColumn("next_us", F.lead("event_us").over(W.partitionBy("type", "from_key").orderBy("event_us")))
    d = snapshots.join(nxt, ["type", "from_key", "event_us"])
    again = snapshots.withColumnRenamed("event_us", "next_us")
    gone = d.where("next_us is not null").join(again, ["type", "from_key", "to_key", "next_us"], "left_anti").select(
        "type", "from_key", "to_key", F.lit("retract").alias("op"), F.col("next_us").alias("event_us"))
    return snapshots.select("type", "from_key", "to_key", F.lit("assert").alias("op"), "event_us").unionByName(gone)


def edge_traverse(edges: DataFrame, windows: DataFrame, budget_us: int) -> DataFrame:
    """Edges that overlap each window (tick_seq, start_us, end_us), suspect where not confirmed within the budget.

    Asserted at the window's end overlaps, retracted at its start does not; a
    retracted edge that overlapped is valid.  Slots of time say at which window's
    end an edge is first and last seen; it meets the windows in between only.
    """
    w = windows.withColumn("idx", F.dense_rank().over(W.orderBy("end_us")))  # a small authored table
    ends = w.select(F.col("idx").alias("tick_seq"), F.col("end_us").alias("now_us")).distinct()
    last, width = windows.agg(F.max("end_us")).scalar(), windows.agg(F.max(F.col("end_us") - F.col("start_us"))).scalar()
    d = edges.select("type", "from_key", "to_key", "asserted_us", "retracted_us", "confirmed_us")
    d = first_seen(d.withColumn("at_us", F.col("asserted_us")), ends).withColumnRenamed("idx", "since")
    d = first_seen(d.withColumn("at_us", F.greatest(F.col("asserted_us"), F.least(F.col("retracted_us") + width, last))), ends)
    d = d.withColumn("idx", F.explode(F.sequence("since", "idx"))).join(F.broadcast(w), "idx")
    late = F.col("retracted_us").isNull() & (F.col("end_us") - F.col("confirmed_us") > budget_us)
    return d.where(F.col("retracted_us").isNull() | (F.col("retracted_us") > F.col("start_us"))).select(
        "tick_seq", "type", "from_key", "to_key", F.when(late, SUSPECT).otherwise(VALID).alias("verdict"))


def gathered(traversed: DataFrame) -> DataFrame:
    """Traversed edges in a row each: type, from_key, to_key, at (4 times the tick_seq, plus the verdict, of each tick)."""
    entry = F.shiftleft(F.col("tick_seq").cast("long"), 2) + F.col("verdict")
    return traversed.groupBy("type", "from_key", "to_key").agg(F.collect_set(entry).alias("at"))  # as many as ticks


def by_tick(edges: DataFrame) -> DataFrame:
    """``gathered`` edges as rows by tick again."""
    d = edges.select("type", "from_key", "to_key", F.explode("at").alias("e"))
    return d.select(F.shiftright("e", 2).alias("tick_seq"), "type", "from_key", "to_key", F.col("e").bitwiseAND(F.lit(3)).cast("int").alias("verdict"))


def edge_health(edges: DataFrame, now_us: int, budget_us: int) -> DataFrame:
    """How many edges of each type are valid, suspect (not confirmed within the budget) or retracted at a time; later ones don't count yet."""
    gone = F.coalesce(F.col("retracted_us") <= now_us, F.lit(False))
    status = F.when(gone, "retracted").when(now_us - F.col("confirmed_us") > budget_us, "suspect").otherwise("valid")
    return edges.where(F.col("asserted_us") <= now_us).groupBy("type", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def neighbours(traversed: DataFrame) -> DataFrame:
    """Both directions: tick_seq, key, neighbour, type, out, verdict."""
    a = traversed.select("tick_seq", F.col("from_key").alias("key"), F.col("to_key").alias("neighbour"), "type", F.lit(True).alias("out"), "verdict")
    b = traversed.select("tick_seq", F.col("to_key").alias("key"), F.col("from_key").alias("neighbour"), "type", F.lit(False).alias("out"), "verdict")
    return a.unionByName(b)


def pod_uid(key) -> F.Column:
    """The pod's uid in a container's key, whose last part is ``<pod uid>/<container>``; null for other keys."""
    last = F.element_at(F.split(key, r"\|"), -1)
    return F.when(F.locate("/", last) > 1, F.substring_index(last, "/", 1))


def pods_of(traversed: DataFrame) -> DataFrame:
    """tick_seq, pod_uid, pod_key of the sources of runs-on edges; of several keys with one uid the smallest."""
    last = F.element_at(F.split("from_key", r"\|"), -1)
    return traversed.where("type = 'runs-on'").groupBy("tick_seq", last.alias("pod_uid")).agg(F.min("from_key").alias("pod_key"))


def with_anchor(rows: DataFrame, column: str, pods: DataFrame) -> DataFrame:
    """Adds <column>_anchor: the pod of a container that the topology knows, else the entity itself.

    What is no container is dealt by its own key, as all of a tick would meet in one task under a null pod.
    """
    p = pods.select("tick_seq", F.lit(True).alias("inside"), F.col("pod_uid").alias(f"{column}_pod"), F.col("pod_key").alias(f"{column}_key"))
    pod = pod_uid(F.col(column))
    d = rows.withColumns({"inside": pod.isNotNull(), f"{column}_pod": F.coalesce(pod, column)}).join(p, ["tick_seq", "inside", f"{column}_pod"], "left")
    return d.withColumn(f"{column}_anchor", F.coalesce(f"{column}_key", column)).drop("inside", f"{column}_pod", f"{column}_key")


def holds_containers(*keys: DataFrame) -> bool:
    """Whether any of these tables of keys (one column each) has a container's key."""
    return any(not d.where(pod_uid(F.col(d.columns[0])).isNotNull()).isEmpty() for d in keys)


def edges_among(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with both ends among ``keys`` (key): all that relates these keys at any time.

    A container is related over its pod, which an edge to anything tells, so where one is among the keys no edge is left out.
    """
    if holds_containers(keys):
        return edges
    end = lambda name: keys.select(F.col("key").alias(name)).distinct()
    return edges.join(end("from_key"), "from_key", "left_semi").join(end("to_key"), "to_key", "left_semi")


def containment(entities: DataFrame, traversed: DataFrame) -> DataFrame:
    """Where walks from an entity (tick_seq, key) start: tick_seq, key, anchor, note.

    A container starts at its pod; one whose pod is no source of a runs-on edge
    reaches no neighbour, and the note says so.
    """
    d = entities.withColumn("pod_uid", pod_uid(F.col("key"))).join(pods_of(traversed), ["tick_seq", "pod_uid"], "left")
    lost = F.col("pod_uid").isNotNull() & F.col("pod_key").isNull()
    anchor = F.when(F.col("pod_uid").isNull(), F.col("key")).otherwise(F.col("pod_key"))
    return d.select("tick_seq", "key", anchor.alias("anchor"), F.when(lost, "containing pod absent from topology").alias("note"))


def alike(near: DataFrame) -> DataFrame:
    """tick_seq, key, like: the smallest entity with the same edges at the tick, the entity itself where no other has them.

    ``near``: tick_seq, key, neighbour, type, verdict, each edge from both ends.  Walks over two hops to and from entities
    that are alike only differ in these ends, so they are worked out for one of them.  An entity with more than ``FEW`` edges
    stands for itself, as does one beside a name with ``>``, which paths are made with.
    """
    at = ["tick_seq", "key"]
    n = near.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    edges = near.join(n.where(F.col("n") <= FEW).select(*at), at, "left_semi").groupBy(*at).agg(F.array_sort(F.collect_set(F.struct("neighbour", "type", "verdict"))).alias("edges"))
    odd = F.exists("edges", lambda e: F.coalesce(F.contains(e["neighbour"], F.lit(">")), F.lit(False)) | F.coalesce(F.contains(e["type"], F.lit(">")), F.lit(False)))
    edges = edges.where(~odd)
    like = edges.groupBy("tick_seq", "edges").agg(F.min("key").alias("like"))
    return n.select(*at).join(edges.join(like, ["tick_seq", "edges"]).select(*at, "like"), at, "left").withColumn("like", F.coalesce("like", "key"))


def spelled_out(walks: DataFrame, like: DataFrame, origin: str) -> DataFrame:
    """Walks (tick_seq, like, ``origin``, ...) to each entity of ``alike``: target in place of like.

    This is where pairs come into being; they are made row by row and dealt out by origin, and nothing sorts or shuffles them.
    """
    at, parts = ["tick_seq", "like", "slice"], int(walks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = walks.withColumn("slice", F.pmod(F.xxhash64(origin), F.lit(SLICES)).cast("int"))
    b = like.select("tick_seq", "like", F.col("key").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    return a.repartition(parts, *at).join(b.repartition(parts, *at), at).drop("like", "slice")


def reach(traversed: DataFrame, origins: DataFrame, depth: int = 2, types: tuple[str, ...] | None = None) -> DataFrame:
    """Entities within ``depth`` (1 or 2) hops of (tick_seq, key): tick_seq, key, target, hop, verdict, path.

    Of several paths the one with the better worst hop wins, then the smaller
    path text.  The origin and what the first hop reaches are not reached again.
    With ``types`` only edges of these types count.  Names of types hold no ``>``.

    The second hop is walked from one to one of the entities that are ``alike``, where paths are compared; what
    lies around a hub is only listed at the end.
    """
    if types is not None:
        traversed = traversed.where(F.col("type").isin(*types))
    n = neighbours(traversed).select("tick_seq", "key", "neighbour", "type", "verdict")
    if depth > 1:
        n = cut(n)
    origins = origins.select("tick_seq", "key").distinct()
    best = lambda end: F.row_number().over(W.partitionBy("tick_seq", "key", end).orderBy(F.col("verdict").desc(), "path"))
    one = n.join(origins, ["tick_seq", "key"]).where("key <> neighbour").select(
        "tick_seq", "key", F.col("neighbour").alias("target"), "verdict", F.concat_ws(">", "key", "type", "neighbour").alias("path"))
    one = one.withColumn("k", best("target")).where("k = 1").drop("k").withColumn("hop", F.lit(1))
    if depth < 2:
        return one
    like = cut(alike(n))
    begin = origins.join(like, ["tick_seq", "key"])
    own = n.join(like.where("key = like").select("tick_seq", "key"), ["tick_seq", "key"], "left_semi")  # edges of those that stand for others
    first = own.join(begin.select("tick_seq", F.col("like").alias("key")).distinct(), ["tick_seq", "key"], "left_semi").where("key <> neighbour").select(
        "tick_seq", "key", F.col("neighbour").alias("via"), "verdict", F.concat_ws(">", "type", "neighbour").alias("path"))
    first = first.withColumn("k", best("via")).where("k = 1").drop("k")
    step = own.select("tick_seq", F.col("neighbour").alias("via"), F.col("key").alias("like"), F.col("type").alias("type2"), F.col("verdict").alias("verdict2"))
    two = first.join(step, ["tick_seq", "via"]).select("tick_seq", "key", "like", F.least("verdict", "verdict2").alias("verdict"), F.concat_ws(">", "path", "type2").alias("way"))
    two = two.join(own.select("tick_seq", "key", F.col("neighbour").alias("like")), ["tick_seq", "key", "like"], "left_anti")
    two = two.withColumn("path", F.concat_ws(">", "way", "like")).withColumn("k", best("like")).where("k = 1").select("tick_seq", F.col("key").alias("begin"), "like", "verdict", "way")
    walks = begin.withColumnRenamed("like", "begin").join(two, ["tick_seq", "begin"]).drop("begin")
    far = spelled_out(walks, like, "key").where("target <> key").select("tick_seq", "key", "target", "verdict", F.concat_ws(">", "key", "way", "target").alias("path"))
    return one.unionByName(far.withColumn("hop", F.lit(2)))


def reach_anchored(traversed: DataFrame, origins: DataFrame, depth: int = 2, types: tuple[str, ...] | None = None) -> DataFrame:
    """``reach`` for entities (tick_seq, key) that may be containers: those walk from their pod, and reach nothing where the topology doesn't know it."""
    a = containment(origins.select("tick_seq", "key"), traversed).where("anchor is not null").select("tick_seq", "key", "anchor")
    walked = reach(traversed, a.select("tick_seq", F.col("anchor").alias("key")).distinct(), depth, types).withColumnRenamed("key", "anchor")
    return a.join(walked, ["tick_seq", "anchor"]).drop("anchor")


def _tick(entry) -> F.Column:
    """The tick_seq of an entry of ``paired``."""
    return F.shiftright(entry, 4)


def paired(traversed: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """Edges as pairs, one row for each two ends: lo, hi, at (an entry for each tick at which an edge joins them).

    An entry is 16 times the tick_seq, plus the verdict (the best of ``types``), plus 4 where lo and 8 where hi is a source of
    runs-on.  A pair that only runs-on edges outside ``types`` join has verdict 0: it tells pods, and no walk goes along it.
    So what is held and shuffled grows with the edges, not with edges times ticks.
    """
    runs, walked = F.col("type") == "runs-on", F.lit(True)
    d = traversed
    if types is not None:
        walked = F.col("type").isin(*types)
        d = d.where(walked | runs)
    lo, hi, none = F.least("from_key", "to_key"), F.greatest("from_key", "to_key"), F.lit(0)
    code = F.when(walked, F.col("verdict")).otherwise(none) + F.when(runs & (F.col("from_key") == lo), 4).otherwise(none) + F.when(runs & (F.col("from_key") == hi), 8).otherwise(none)
    d = d.select(lo.alias("lo"), hi.alias("hi"), (F.shiftleft(F.col("tick_seq").cast("long"), 4) + code).alias("entry"))
    d = d.groupBy("lo", "hi").agg(F.array_sort(F.collect_set("entry")).alias("at"))  # as many as ticks, seldom twice
    ticks = F.array_distinct(F.transform("at", _tick))
    both = lambda x, y: x.bitwiseAND(F.lit(-4)).bitwiseOR(y.bitwiseAND(F.lit(12))) + F.greatest(x.bitwiseAND(F.lit(3)), y.bitwiseAND(F.lit(3)))
    one = F.transform(ticks, lambda t: F.aggregate(F.filter("at", lambda e: _tick(e) == t), F.shiftleft(t, 4), both))
    return d.withColumn("at", F.when(F.size(ticks) == F.size("at"), F.col("at")).otherwise(one))


def _walked(pairs: DataFrame) -> DataFrame:
    """lo, hi, at of pairs that walks go along; entries are 4 times the tick_seq, plus the verdict."""
    at = F.transform(F.filter("at", lambda e: e.bitwiseAND(F.lit(3)) > 0), lambda e: F.shiftleft(_tick(e), 2) + e.bitwiseAND(F.lit(3)))
    return pairs.where("lo <> hi").select("lo", "hi", at.alias("at")).where(F.size("at") > 0)


def _valid(at, tick) -> F.Column:
    return F.array_contains(at, F.shiftleft(tick, 2) + VALID)


def _open(at, tick) -> F.Column:
    return _valid(at, tick) | F.array_contains(at, F.shiftleft(tick, 2) + SUSPECT)


def triangles(walked: DataFrame) -> DataFrame:
    """Three entities of which each two are a pair: a, b, c, and entries ab, bc, ac of the pairs.

    A pair belongs to its end with fewer others, so an entity owns at most about as many as the root of the number of pairs.
    Each pair brings the other end's own ones (as 32-bit hashes, which equality checks later) to those of the first, so the
    pairs of an entity's neighbours are not listed.
    """
    n = walked.select(F.explode(F.array("lo", "hi")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    d = walked.select("lo", "hi").join(n.withColumnsRenamed({"k": "lo", "n": "lo_n"}), "lo").join(n.withColumnsRenamed({"k": "hi", "n": "hi_n"}), "hi")
    first = (F.col("lo_n") < F.col("hi_n")) | ((F.col("lo_n") == F.col("hi_n")) & (F.col("lo") < F.col("hi")))
    own = d.select(F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("u"), F.when(first, F.col("hi")).otherwise(F.col("lo")).alias("x"))
    lists = own.groupBy("u").agg(F.collect_list("x").alias("xs"))
    found = own.join(lists.select(F.col("u").alias("x"), F.transform("xs", lambda y: F.hash(y)).alias("hs")), "x").join(lists, "u")
    found = found.select("u", "x", F.explode(F.filter("xs", lambda y: F.array_contains("hs", F.hash(y)))).alias("y"))
    t = found.select(F.sort_array(F.array("u", "x", "y")).alias("s")).select(F.col("s")[0].alias("a"), F.col("s")[1].alias("b"), F.col("s")[2].alias("c"))
    for x, y in ("ab", "bc", "ac"):
        t = t.join(walked.withColumnsRenamed({"lo": x, "hi": y, "at": x + y}), [x, y])
    return t


def marked_around(pairs: DataFrame, asked: DataFrame, marks: DataFrame, few: bool = False) -> DataFrame:
    """Which of ``asked`` (tick_seq, key, label, hop) have an entity of ``marks`` (tick_seq, target, label, met) at that hop, as ``reach`` counts hops.

    tick_seq, key, label, hop, met (one of them is met), verdict (the best walk to one that is met).  Rows without a mark are left out.
    ``few``: there are less marks than asked ones, so edges meet these first.

    Pairs of entities two hops apart are not listed.  Walks are counted over the entity in between: its marked
    neighbours are summed once, and each of its neighbours adds the sums of its own.  Walks that come back to the
    entity, or that end at a direct neighbour, (``triangles``), are taken off; what is left goes to entities at hop 2.
    A pair brings all its ticks along, as does an entity what it asks for and has.
    """
    asked = cut(asked.select(F.col("tick_seq").cast("long").alias("tick_seq"), "key", "label", "hop").distinct())
    marks = marks.groupBy(F.col("tick_seq").cast("long").alias("tick_seq"), "target", "label").agg(F.bool_or("met").alias("met"))
    walked = _walked(pairs)
    ends = F.explode(F.array(F.struct(F.col("lo").alias("key"), F.col("hi").alias("target")), F.struct(F.col("hi").alias("key"), F.col("lo").alias("target"))))
    near = walked.select("at", ends.alias("e")).select("e.*", "at")
    # What is asked for at a tick gets a number: there are as many as authored, and edges carry numbers only.
    names = asked.groupBy("tick_seq", "label").agg(*[F.bool_or(F.col("hop") == h).alias(f"hop{h}") for h in (1, 2)])
    names = F.broadcast(cut(names.withColumn("id", F.row_number().over(W.orderBy("tick_seq", "label")))))
    at_hop = lambda hop, what: F.collect_list(F.when(hop, what))  # noqa: E731  an entity's own few
    asks = asked.join(names.select("tick_seq", "label", "id"), ["tick_seq", "label"]).groupBy("key").agg(*[at_hop(F.col("hop") == h, F.col("id")).alias(f"asks{h}") for h in (1, 2)])
    has = cut(marks.join(names, ["tick_seq", "label"]).groupBy("target").agg(*[at_hop(F.col(f"hop{h}"), F.struct("id", "tick_seq", "met")).alias(f"marks{h}") for h in (1, 2)]))

    good = lambda m: _valid(F.col("at"), m["tick_seq"])
    opened = lambda name: F.filter(name, lambda m: _open(F.col("at"), m["tick_seq"]))
    hits = lambda name, asks: F.filter(name, lambda m: F.array_contains(asks, m["id"]) & _open(F.col("at"), m["tick_seq"]))
    counts = ("n", "n_met", "n_valid")
    total = lambda d, *key: d.groupBy(*key, "key", "id").agg(*[F.sum(c).alias(c) for c in counts])

    # What lies around an entity in between goes there pair by pair and is summed there: 4 times the number, plus 1 where met, plus 2 over a valid edge.
    each = near.join(has, "target").select("key", F.transform(opened("marks2"), lambda m: m["id"] * 4 + m["met"].cast("int") + good(m).cast("int") * 2).alias("marks")).where(F.size("marks") > 0)
    each = each.repartition("key").select("key", F.explode("marks").alias("e"))
    is_met, is_valid = F.col("e").bitwiseAND(F.lit(1)), F.shiftright(F.col("e").bitwiseAND(F.lit(2)), 1)
    each = total(each.select("key", F.shiftright("e", 2).alias("id"), F.lit(1).alias("n"), is_met.alias("n_met"), (is_met * is_valid).alias("n_valid")))
    sums = each.join(names.select("id", "tick_seq"), "id").groupBy(F.col("key").alias("target")).agg(F.collect_list(F.struct("id", "tick_seq", *counts)).alias("sums"))
    around = has.join(sums, "target", "full")
    d = near.join(around, "target").join(asks, "key") if few else near.join(asks, "key").join(around, "target")
    # One list of what a pair says, so that branches share the joins: 1 marks at one hop, 2 sums over the other end, 3 marks that close a triangle.
    count = lambda k, m, *n: F.struct(F.lit(k).alias("kind"), m["id"].alias("id"), m["tick_seq"].alias("tick_seq"), *[x.cast("long").alias(c) for x, c in zip(n, counts)])
    said = F.array(F.transform(hits("marks1", "asks1"), lambda m: count(1, m, F.lit(1), m["met"], m["met"] & good(m))),
                   F.transform(hits("sums", "asks2"), lambda m: count(2, m, m["n"], m["n_met"], F.when(good(m), m["n_valid"]).otherwise(0))),
                   F.transform(hits("marks2", "asks2"), lambda m: count(3, m, F.lit(1), m["met"], m["met"])))
    d = d.select("key", "target", F.explode(F.flatten(F.filter(said, lambda x: x.isNotNull()))).alias("m"))
    direct = total(d.where("m.kind < 3").select("key", "m.*"), "kind")
    one, two = direct.where("kind = 1").drop("kind"), direct.where("kind = 2").drop("kind")
    valid, met = _valid(F.col("at"), F.col("m.tick_seq")), F.col("m.met").cast("int")
    own = has.withColumnRenamed("target", "key").join(asks, "key").select("key", F.filter("marks2", lambda m: F.array_contains("asks2", m["id"])).alias("marks")).where(F.size("marks") > 0)
    back = near.join(own, "key").select("key", F.explode(opened("marks")).alias("m"), "at").select("key", "m.id", F.lit(-1).alias("n"), (-met).alias("n_met"), (-met * valid.cast("int")).alias("n_valid"))
    # a third side: the walk ends at a neighbour
    side = d.where("m.kind = 3").select("key", "target", "m")
    pair = {frozenset(x): F.col(x) for x in ("ab", "bc", "ac")}
    orders = [F.struct(F.col(k).alias("key"), F.col(t).alias("target"), pair[frozenset(k + v)].alias("at"), pair[frozenset(v + t)].alias("at2")) for k, v, t in ("abc", "acb", "bac", "bca", "cab", "cba")]
    third = triangles(walked).select(F.explode(F.array(*orders)).alias("o")).select("o.*").join(side, ["key", "target"])
    third = third.where(_open(F.col("at"), F.col("m.tick_seq")) & _open(F.col("at2"), F.col("m.tick_seq")))
    less = F.when(valid & _valid(F.col("at2"), F.col("m.tick_seq")), -F.col("m.n_valid")).otherwise(0).alias("n_valid")
    third = third.select("key", "m.id", (-F.col("m.n")).alias("n"), (-F.col("m.n_met")).alias("n_met"), less)
    both = one.withColumn("hop", F.lit(1)).unionByName(total(two.unionByName(back).unionByName(third)).where("n > 0").withColumn("hop", F.lit(2)))
    verdict = F.when(F.col("n_valid") > 0, VALID).when(F.col("n_met") > 0, SUSPECT).alias("verdict")
    return both.join(names.select("id", "tick_seq", "label"), "id").select("tick_seq", "key", "label", "hop", (F.col("n_met") > 0).alias("met"), verdict)


def anchors_in(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """tick_seq, key, anchor: ``containment`` over ``paired`` edges, of entities (tick_seq, key) that walks start from."""
    entities = entities.select("tick_seq", "key").distinct()
    if not holds_containers(entities.select("key")):
        return entities.withColumn("anchor", F.col("key"))
    runs = pairs.select("lo", "hi", F.explode(F.filter("at", lambda e: e.bitwiseAND(F.lit(12)) > 0)).alias("e"))
    source = F.explode(F.filter(F.array(F.when(F.col("e").bitwiseAND(F.lit(4)) > 0, F.col("lo")), F.when(F.col("e").bitwiseAND(F.lit(8)) > 0, F.col("hi"))), lambda x: x.isNotNull()))
    runs = runs.select(_tick("e").alias("tick_seq"), source.alias("from_key"))
    return containment(entities, runs.withColumn("type", F.lit("runs-on"))).where("anchor is not null").drop("note")


def as_of(rows: DataFrame, key: list[str], snapshots: DataFrame) -> DataFrame:
    """The newest row (by event_us, then by its values) of each key at each snapshot (snap_us): snap_us and the row's columns."""
    rest = [c for c in rows.columns if c not in (*key, "event_us")]
    ticks = snapshots.select(F.col("snap_us").alias("tick_seq"), F.col("snap_us").alias("now_us")).distinct()
    d = first_seen(rows.withColumnRenamed("event_us", "at_us"), ticks).groupBy(*key, "idx").agg(F.max(F.struct("at_us", *rest)).alias("s"))
    until = F.coalesce(F.lead("idx").over(W.partitionBy(*key).orderBy("idx")) - 1, ticks.agg(F.count(F.lit(1))).scalar().cast("int"))
    d = d.withColumn("until", until).withColumn("idx", F.explode(F.sequence("idx", "until"))).join(F.broadcast(number_ticks(ticks)), "idx")  # a small authored table
    return d.select(F.col("now_us").alias("snap_us"), *key, F.col("s.at_us").alias("event_us"), *[f"s.{c}" for c in rest])


def derive_edges(pods: DataFrame, slices: DataFrame, leases: DataFrame, instances: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Edges at snapshots (type, from_key, to_key, event_us), full sets as ``reconcile_out`` reads them.

    ``pods``: pod, event_us, node (name; null: not placed), claims (names);
    ``slices``: service, slice, event_us, pods (names); both by update, the newest
    up to a snapshot holds.  A service selects the union of its slices' pods, each
    once.  ``leases``: node, renewed_us; a node's lease is an edge to itself at its
    renewal.  ``instances``: kind (Pod, Node, Claim, Service), name, key, since_us.
    An edge comes at the first snapshot at which both ends are known, and is
    missing before.
    """
    ends = instances.select("kind", "name", "key", "since_us")

    def known(d: DataFrame, kind: str, name: str, key: str, at: str) -> DataFrame:
        e = ends.where(F.col("kind") == kind).select(F.col("name").alias(name), F.col("key").alias(key), "since_us")
        return d.join(e, name).where(F.col("since_us") <= F.col(at)).drop("since_us")

    p = known(as_of(pods, ["pod"], snapshots), "Pod", "pod", "from_key", "snap_us")
    run = known(p, "Node", "node", "to_key", "snap_us")
    mount = known(p.withColumn("claim", F.explode("claims")), "Claim", "claim", "to_key", "snap_us")
    picked = as_of(slices, ["service", "slice"], snapshots).select("snap_us", "service", F.explode("pods").alias("pod")).distinct()
    picked = known(known(picked, "Service", "service", "from_key", "snap_us"), "Pod", "pod", "to_key", "snap_us")
    at = lambda d, name: d.select(F.lit(name).alias("type"), "from_key", "to_key", F.col("snap_us").alias("event_us"))
    alive = known(leases, "Node", "node", "from_key", "renewed_us").select(F.lit("node-lease").alias("type"), "from_key", F.col("from_key").alias("to_key"), F.col("renewed_us").alias("event_us"))
    # Leases are few once each; the others hardly repeat, so they are dealt out before tasks look for equal ones: a task that makes them holds none.
    d = at(run, "runs-on").unionByName(at(mount, "mounts")).unionByName(at(picked, "selects")).unionByName(alive.distinct())
    return d.repartition("type", "from_key", "to_key", "event_us").distinct()
