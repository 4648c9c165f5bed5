"""The authored catalogue against the platform: tools, names, availability, relations, lint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def detect_tools(tools: DataFrame, corpus: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Whether each tool (tool, class, needle: a row for each of its needles) is present.

    native: yes; undetectable: null; runtime: the platform's runtime (``facts``, one row, or none) begins with the tool's
    name; needle: any entry of the corpus (entry, lower case) holds one of its needles, or its name where none is given.
    The tools are an authored table of a few rows, so every entry meets them and is read once.
    """
    sought = tools.where("class = 'needle'").select(F.col("tool").alias("h"), F.coalesce("needle", "tool").alias("n"))
    hits = corpus.join(F.broadcast(sought), F.contains("entry", "n")).select("h").distinct()
    runtime = facts.agg(F.lower(F.max("runtime")).alias("runtime")) if facts is not None else tools.limit(0).agg(F.max("tool").alias("runtime"))
    d = tools.select("tool", "class").distinct().join(hits, F.col("tool") == F.col("h"), "left").join(F.broadcast(runtime))  # one row
    begins = F.coalesce(F.startswith("runtime", F.lower("tool")), F.lit(False))
    return d.select("tool", F.when(F.col("class") == "native", True).when(F.col("class") == "runtime", begins).when(F.col("class") == "needle", F.col("h").isNotNull()).alias("present"))


def resolve_equivalents(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """Metric names (name) to canonical ones by patterns (grp, canonical, variant, pattern).

    Of one group the first fitting variant counts; a name that fits no group is
    outside, one that fits several is ambiguous and never picked.
    """
    hits = names.join(patterns, F.expr("name rlike pattern")).groupBy("name", "grp").agg(
        F.min_by("canonical", "variant").alias("canonical"), F.min("variant").alias("variant"))
    one = hits.groupBy("name").agg(F.count(F.lit(1)).alias("groups"), F.min("canonical").alias("canonical"), F.min("variant").alias("variant"))
    d = names.select("name").distinct().join(one, "name", "left")
    alone = F.col("groups") == 1
    return d.select("name", F.when(F.col("groups").isNull(), "outside").when(alone, "resolved").otherwise("ambiguous").alias("outcome"),
                    F.when(alone, F.col("canonical")).alias("canonical"), F.when(alone, F.col("variant")).alias("variant"))


def signal_obtainability(signals: DataFrame, presence: DataFrame, capabilities: DataFrame) -> DataFrame:
    """ok, indeterminate or out-of-scope for each signal (cluster_id, signal, tools array, capability).

    Any present tool will do, else one that can't be detected leaves it open;
    then the capability's state: out-of-scope before indeterminate.
    """
    t = signals.select("cluster_id", "signal", "capability", F.explode_outer("tools").alias("tool")).join(presence, ["cluster_id", "tool"], "left")
    by = t.groupBy("cluster_id", "signal", "capability").agg(
        F.coalesce(F.bool_or("present"), F.lit(False)).alias("some"), F.count_if(F.col("tool").isNotNull() & F.col("present").isNull()).alias("open"), F.count("tool").alias("n"))
    d = by.join(capabilities.select("cluster_id", "capability", F.col("state").alias("cap")), ["cluster_id", "capability"], "left")
    tool = F.when((F.col("n") == 0) | F.col("some"), "ok").when(F.col("open") > 0, "indeterminate").otherwise("out-of-scope")
    worse = lambda s: (tool == s) | (F.coalesce("cap", F.lit("ok")) == s)
    return d.select("cluster_id", "signal", F.when(worse("out-of-scope"), "out-of-scope").when(worse("indeterminate"), "indeterminate").otherwise("ok").alias("state"))


def phenomenon_observability(members: DataFrame, availability: DataFrame) -> DataFrame:
    """full, partial or none for each phenomenon and cluster by its required members' signals.

    Every cluster is asked for every member; a signal it has no row for is out of scope there.
    """
    clusters = availability.select("cluster_id").distinct()
    asked = members.where("role = 'required'").select("phenomenon", "signal").distinct().join(F.broadcast(clusters))  # a few clusters
    d = asked.join(availability.select("cluster_id", "signal", "state"), ["cluster_id", "signal"], "left")
    c = lambda s: F.count_if(F.coalesce("state", F.lit("out-of-scope")) == s)
    by = d.groupBy("cluster_id", "phenomenon").agg(c("ok").alias("obtainable"), c("indeterminate").alias("indeterminate"), c("out-of-scope").alias("out_of_scope"), F.count(F.lit(1)).alias("n"))
    return by.withColumn("state", F.when(F.col("out_of_scope") == F.col("n"), "none").when(F.col("obtainable") == F.col("n"), "full").otherwise("partial"))


def relation_normalize(relations: DataFrame) -> DataFrame:
    """trigger -> downstream pairs: ``downstream`` on P and ``trigger`` on Q both say P leads to Q; the first of a pair stays."""
    a = relations.where("role = 'downstream'").select(F.col("src").alias("trigger"), F.col("dst").alias("downstream"), "why", "pos")
    b = relations.where("role = 'trigger'").select(F.col("dst").alias("trigger"), F.col("src").alias("downstream"), "why", "pos")
    first = F.row_number().over(W.partitionBy("trigger", "downstream").orderBy("pos", "why"))
    return a.unionByName(b).withColumn("k", first).where("k = 1").drop("k")


#: Fixed value: edges of this type say who looks after what; broken ones are only warned of.
ORGANISATIONAL = ("owned_by_agent",)


def catalogue_lint(edges: DataFrame, nodes: DataFrame, organisational: tuple[str, ...] = ORGANISATIONAL) -> DataFrame:
    """Edges (src, src_type, dst, dst_type, type) whose ends are missing or of another type than declared (null or empty: none declared).

    src, dst, end, problem, level: error, or warn for edges of ``organisational`` types.
    """
    n = nodes.select("id", F.col("type").alias("real"))
    level = F.when(F.col("type").isin(*organisational), "warn").otherwise("error")
    ends = edges.select("src", "dst", level.alias("level"), F.explode(F.array(
        F.struct(F.lit("src").alias("end"), F.col("src").alias("id"), F.col("src_type").alias("want")),
        F.struct(F.lit("dst").alias("end"), F.col("dst").alias("id"), F.col("dst_type").alias("want")))).alias("e")).select("src", "dst", "level", "e.*")
    d = ends.join(n, "id", "left")
    other = (F.coalesce("want", F.lit("")) != "") & (F.col("real") != F.col("want"))
    return d.withColumn("problem", F.when(F.col("real").isNull(), "missing").when(other, "wrong-type")).where("problem is not null").select("src", "dst", "end", "problem", "level")


def declared_totals(nodes: DataFrame, edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Totals (what, n) that a release declares and its content doesn't have: what, declared, parsed; a truncated release shows here.

    nodes_total, edges_total and signals are checked where they are declared.
    """
    n = nodes.agg(F.count(F.lit(1)).alias("nodes_total"), F.count_if(F.col("type") == "Signal").alias("signals"))
    both = n.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges_total"))))  # one row each
    parsed = both.unpivot([], ["nodes_total", "edges_total", "signals"], "what", "parsed")
    return parsed.join(F.broadcast(declared.select("what", F.col("n").alias("declared"))), "what").where("declared <> parsed").select("what", "declared", "parsed")


def register_scan(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Banned phrases (phrase, class) in texts (id, text), whatever their case: id, class, phrase.

    The phrases are an authored list; they are broadcast behind Spark's size check.
    """
    return texts.select("id", F.lower("text").alias("t")).join(phrases, F.expr("contains(t, phrase)")).select("id", "class", "phrase")
