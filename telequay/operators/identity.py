"""Which instance a name meant at a time: succession of instances, as-of joins, owner chains, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telequay.functions.status import tombstone_tier
from telequay.params import Params


def succession(instances: DataFrame) -> DataFrame:
    """Half-open lives of the instances of each name: one ends at its deletion or when the next is born.

    ``instances``: name, uid, seq, born_us, deleted_us.  Ordered by birth (then
    seq), so a late report of an early birth changes nothing that came after.
    """
    order = W.partitionBy("name").orderBy("born_us", "seq")
    next_born = F.lead("born_us").over(order)
    return instances.select(
        "name", "uid", "seq", "born_us", F.when(F.least("deleted_us", next_born).isNotNull(), F.greatest("born_us", F.least("deleted_us", next_born))).alias("died_us"),
        F.lag("uid").over(order).alias("predecessor"), F.lead("uid").over(order).alias("successor"))


def identity_asof(asked: DataFrame, lives: DataFrame, p: Params) -> DataFrame:
    """For (ask_id, name, at_us, now_us): the uid the name had at that time, and whether it was found through a stub.

    The newest record that covers the time wins; records expired by now_us find
    nothing.  The join is on the name and bounded by time; a hot name's records
    are its lives, which the join streams.
    """
    l = lives.select(F.col("name").alias("l_name"), F.col("uid").alias("l_uid"), "born_us", "died_us", "seq")
    covers = (F.col("name") == F.col("l_name")) & (F.col("at_us") >= F.col("born_us")) & (F.col("died_us").isNull() | (F.col("at_us") < F.col("died_us")))
    tier = tombstone_tier(F.col("died_us"), F.col("now_us"), p.full_tombstone_us, p.stub_tombstone_us)
    d = asked.join(l, covers, "left").withColumn("tier", F.when(F.col("l_uid").isNotNull(), tier))
    usable = F.when(F.col("tier") != "expired", F.struct("born_us", "seq", "l_uid", "tier"))
    best = d.groupBy("ask_id").agg(F.max(usable).alias("b"))
    return best.select("ask_id", F.col("b.l_uid").alias("uid"), F.coalesce(F.col("b.tier") == "stub", F.lit(False)).alias("degraded"))


def identity_asof_bucketed(asked: DataFrame, lives: DataFrame, p: Params, bucket_us: int) -> DataFrame:
    """``identity_asof`` with a time bucket as a second key, for names with very many lives.

    A life is put into every bucket it touches up to the last time asked, so a
    hot name spreads over as many tasks as it has buckets.
    """
    last = asked.agg(F.max("at_us").alias("last_us"))
    spread = lives.crossJoin(F.broadcast(last)).where("born_us <= last_us")
    end = F.least(F.coalesce("died_us", "last_us"), "last_us")
    spread = spread.withColumn("l_bucket", F.explode(F.sequence(F.floor(F.col("born_us") / bucket_us), F.floor(end / bucket_us))))
    l = spread.select(F.col("name").alias("l_name"), F.col("uid").alias("l_uid"), "born_us", "died_us", "seq", "l_bucket")
    d = asked.withColumn("bucket", F.floor(F.col("at_us") / bucket_us))
    covers = ((F.col("name") == F.col("l_name")) & (F.col("bucket") == F.col("l_bucket")) & (F.col("at_us") >= F.col("born_us"))
              & (F.col("died_us").isNull() | (F.col("at_us") < F.col("died_us"))))
    tier = tombstone_tier(F.col("died_us"), F.col("now_us"), p.full_tombstone_us, p.stub_tombstone_us)
    d = d.join(l, covers, "left").withColumn("tier", F.when(F.col("l_uid").isNotNull(), tier))
    best = d.groupBy("ask_id").agg(F.max(F.when(F.col("tier") != "expired", F.struct("born_us", "seq", "l_uid", "tier"))).alias("b"))
    return best.select("ask_id", F.col("b.l_uid").alias("uid"), F.coalesce(F.col("b.tier") == "stub", F.lit(False)).alias("degraded"))


def owner_chain(children: DataFrame, owners: DataFrame, depth: int = 6) -> DataFrame:
    """The topmost controller of each child: (kind, name) climbs ``owners`` at most ``depth`` times.

    Without an owner the child is its own role.  ``owners``: child_kind,
    child_name, owner_kind, owner_name, controller; only controllers count.
    """
    up = owners.where("controller").select(F.col("child_kind").alias("k"), F.col("child_name").alias("n"), "owner_kind", "owner_name")
    d = children.select("kind", "name", F.col("kind").alias("role_kind"), F.col("name").alias("role_name"), F.lit(0).alias("hops"))
    for _ in range(depth):
        d = d.join(up, (F.col("role_kind") == F.col("k")) & (F.col("role_name") == F.col("n")), "left").select(
            "kind", "name", F.coalesce("owner_kind", "role_kind").alias("role_kind"), F.coalesce("owner_name", "role_name").alias("role_name"),
            (F.col("hops") + F.col("owner_kind").isNotNull().cast("int")).alias("hops"))
    return d


def pod_roles(pods: DataFrame, owners: DataFrame, depth: int = 6) -> DataFrame:
    """The role of each pod (ns, name, node, mirror): ns, name, role_kind, role, bare.

    The mirror of a static pod (marked as one, or controlled by a node) has the role StaticPod and its name without the
    node's, so that its instances on all nodes are one role.  A pod without a controller is a role of its own, and bare.
    Any other has its topmost controller: replica sets and jobs may have one above them, other kinds end the chain.

    ``owners``: ns, child_kind, child_name, owner_kind, owner_name, controller; of several controllers the smallest counts.
    Controllers climb among themselves, so pods are joined twice however long the chains are.
    """
    key = ["ns", "child_kind", "child_name"]
    up = owners.where("controller").groupBy(*key).agg(F.min(F.struct("owner_kind", "owner_name")).alias("o")).select(*key, "o.*")
    above = up.where(F.col("child_kind").isin("ReplicaSet", "Job"))
    step = above.select(F.col("ns").alias("s_ns"), F.col("child_kind").alias("k"), F.col("child_name").alias("n"), F.col("owner_kind").alias("k2"), F.col("owner_name").alias("n2"))
    top = above
    for _ in range(depth - 1):
        top = top.join(step, F.col("ns").eqNullSafe(F.col("s_ns")) & (F.col("owner_kind") == F.col("k")) & (F.col("owner_name") == F.col("n")), "left").select(
            *key, F.coalesce("k2", "owner_kind").alias("owner_kind"), F.coalesce("n2", "owner_name").alias("owner_name"))
    own = up.where("child_kind = 'Pod'").select(F.col("ns").alias("p_ns"), F.col("child_name").alias("p_name"), F.col("owner_kind").alias("k1"), F.col("owner_name").alias("n1"))
    top = top.select(F.col("ns").alias("t_ns"), F.col("child_kind").alias("t_kind"), F.col("child_name").alias("t_name"), F.col("owner_kind").alias("k2"), F.col("owner_name").alias("n2"))
    d = pods.join(own, F.col("ns").eqNullSafe(F.col("p_ns")) & (F.col("name") == F.col("p_name")), "left")
    d = d.join(top, F.col("ns").eqNullSafe(F.col("t_ns")) & (F.col("k1") == F.col("t_kind")) & (F.col("n1") == F.col("t_name")), "left")
    static = F.coalesce("mirror", F.lit(False)) | F.coalesce(F.col("k1") == "Node", F.lit(False))
    tail = F.concat(F.lit("-"), "node")
    component = F.when((F.col("node") != "") & F.endswith("name", tail), F.left("name", F.length("name") - F.length(tail))).otherwise(F.col("name"))
    kind = F.when(static, "StaticPod").otherwise(F.coalesce("k2", "k1", F.lit("Pod")))
    role = F.when(static, component).otherwise(F.coalesce("n2", "n1", "name"))
    return d.select("ns", "name", kind.alias("role_kind"), F.concat_ws("/", kind, role).alias("role"), (~static & F.col("k1").isNull()).alias("bare"))


def join_audit(truth: DataFrame, model: DataFrame) -> DataFrame:
    """Each entity (name, uid) of truth against the model's uid: correct, misjoin or missing."""
    d = truth.join(model.select("name", F.col("uid").alias("model_uid")), "name", "left")
    return d.withColumn("verdict", F.when(F.col("model_uid").isNull(), "missing").when(F.col("model_uid") == F.col("uid"), "correct").otherwise("misjoin"))


def join_accuracy(audit: DataFrame, coverage_target: float = 0.95) -> DataFrame:
    """One row: counts, accuracy, coverage (1 without anything checked) and whether the gate passes."""
    c = lambda v: F.count_if(F.col("verdict") == v)
    d = audit.agg(c("correct").alias("correct"), c("misjoin").alias("misjoin"), c("missing").alias("missing"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    checked = F.col("correct") + F.col("misjoin") + F.col("missing")
    d = d.withColumn("accuracy", share(F.col("correct"), F.col("correct") + F.col("misjoin"))).withColumn("coverage", share(F.col("correct"), checked))
    return d.withColumn("passed", (F.col("misjoin") == 0) & (F.col("coverage") >= coverage_target) & (checked > 0))


def verify_streams(streams: DataFrame, pods: DataFrame) -> DataFrame:
    """Streams (stream_id, kind, name, uid) against live pods (name, uid).

    Pods by the uid of their name, containers by their owner's uid being alive,
    other kinds can't be verified; who is gone has vanished.
    """
    by_name = pods.select(F.col("name").alias("t_name"), F.col("uid").alias("t_uid"))
    by_uid = pods.select(F.col("uid").alias("o_uid")).distinct()
    d = streams.join(by_name, F.col("name") == F.col("t_name"), "left").join(by_uid, F.substring_index("uid", "/", 1) == F.col("o_uid"), "left")
    verdict = (F.when(~F.col("kind").isin("Pod", "Container"), "unverifiable")
               .when((F.col("kind") == "Container") & F.col("o_uid").isNotNull(), "correct").when(F.col("kind") == "Container", "vanished")
               .when(F.col("t_uid").isNull(), "vanished").when(F.col("t_uid") == F.col("uid"), "correct").otherwise("misjoin"))
    return d.select("stream_id", "kind", verdict.alias("verdict"))


def identity_health(lives: DataFrame, now_us: int, p: Params) -> DataFrame:
    """Counts of instances by tier at a time, with how many of them succeeded another."""
    d = lives.where(F.col("born_us") <= now_us)
    died = F.when(F.col("died_us") <= now_us, F.col("died_us"))
    return d.groupBy(tombstone_tier(died, F.lit(now_us), p.full_tombstone_us, p.stub_tombstone_us).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.count("predecessor").alias("successions"))
