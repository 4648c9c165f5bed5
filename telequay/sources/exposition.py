"""Metric text to samples: payloads of scraped nodes, a line of text at a time in the plan, never in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name, labels, value, time stamp in milliseconds (may be missing)
_SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"
_LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def payload_union(*families: DataFrame) -> DataFrame:
    """Payloads of several exporters (family, node, received_us, body, err); a failed fetch stays a row with ``err``."""
    out = families[0]
    for d in families[1:]:
        out = out.unionByName(d)
    return out


def exposition_rows(payloads: DataFrame) -> DataFrame:
    """Every sample line of every fetched payload with its outcome.

    family, node, metric, type, labels, value, at_us, outcome: ``sample``;
    ``skipped-family`` for histograms and summaries; ``non-finite``; or
    ``malformed``.  The line's own time counts, else the time of receipt; types
    come from the payload's TYPE lines (untyped otherwise).
    """
    lines = payloads.where("err is null").select("family", "node", "received_us", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    typed = F.regexp_extract("line", r"^# TYPE (\S+) (\S+)", 1)
    types = lines.where(F.col("line").startswith("# TYPE ")).select(
        "family", "node", "received_us", typed.alias("t_name"), F.regexp_extract("line", r"^# TYPE (\S+) (\S+)", 2).alias("t_type"))
    own = lines.where("line <> '' and not startswith(line, '#')")
    part = lambda i: F.regexp_extract("line", _SAMPLE, i)
    d = own.select("family", "node", "received_us", "pos", part(1).alias("metric"), part(2).alias("raw"), part(3).alias("text"), part(4).alias("ms"))
    # A histogram's or summary's lines carry suffixes; their TYPE line has the bare name.
    base = F.regexp_replace("metric", "(_bucket|_sum|_count)$", "")
    of_family = types.where(F.col("t_type").isin("histogram", "summary")).select("family", "node", "received_us", F.col("t_name").alias("b_name"), F.col("t_type").alias("b_type"))
    key = ["family", "node", "received_us"]
    d = d.withColumn("base", base)
    d = d.join(types.where(~F.col("t_type").isin("histogram", "summary")).dropDuplicates([*key, "t_name"]).withColumnRenamed("t_name", "metric"), [*key, "metric"], "left")
    d = d.join(of_family.dropDuplicates([*key, "b_name"]).withColumnRenamed("b_name", "base"), [*key, "base"], "left")
    names, values = F.expr(f"regexp_extract_all(raw, r'{_LABEL}', 1)"), F.expr(f"regexp_extract_all(raw, r'{_LABEL}', 2)")
    number = F.when(F.col("text").isin("NaN", "+Inf", "-Inf", "Inf"), F.lit(float("nan"))).otherwise(F.expr("try_cast(text as double)"))
    at = F.when(F.col("ms") != "", F.try_multiply(F.expr("try_cast(ms as bigint)"), F.lit(1000))).otherwise(F.col("received_us"))
    outcome = (F.when(F.col("metric") == "", "malformed").when(F.col("b_type").isNotNull() & F.col("t_type").isNull(), "skipped-family")
               .when(F.col("value").isNull() | F.col("at_us").isNull(), "malformed").when(F.isnan("value") | (F.abs("value") == float("inf")), "non-finite").otherwise("sample"))
    return d.withColumn("value", number).withColumn("at_us", at).withColumn("labels", _labels(names, values)).select(
        "family", "node", "metric", F.coalesce("t_type", "b_type", F.lit("untyped")).alias("type"), "labels", "value", "at_us", outcome.alias("outcome"))


def _labels(names, values) -> F.Column:
    """A map of label names and values; of a name given twice the last value, as a series has one; escapes undone."""
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    last = lambda e, i: F.size(names) - F.array_position(F.reverse(names), e["k"]) == i
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\x01"), F.lit("\\"))
    return F.map_from_entries(F.transform(F.filter(pairs, last), lambda e: F.struct(e["k"], plain(e["v"]))))


def render(readings: DataFrame, node: str = "n0") -> DataFrame:
    """The inverse, for round trips: a payload for each entity from (uid, metric, type, at_us, value)."""
    line = F.concat(F.col("metric"), F.lit('{uid="'), F.col("uid"), F.lit('"} '), F.col("value").cast("string"), F.lit(" "), F.floor(F.col("at_us") / 1000).cast("string"))
    head = F.concat(F.lit("# TYPE "), F.col("metric"), F.lit(" "), F.col("type"))
    body = readings.groupBy("uid").agg(F.concat_ws("\n", F.array_sort(F.collect_set(head)), F.array_sort(F.collect_list(line))).alias("body"))
    return body.select(F.lit("node-exporter").alias("family"), F.concat(F.lit(node), "uid").alias("node"), F.lit(0).cast("long").alias("received_us"), "body", F.lit(None).cast("string").alias("err"))


def ingest_summary(rows: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """Counts by outcome and reason: which part of a line was malformed, which kind of family was skipped; with ``payloads``
    also the fetches that failed (fetch-failed), by their error."""
    bad = F.col("outcome") == "malformed"
    reason = (F.when(bad & (F.col("metric") == ""), "line").when(bad & F.col("value").isNull(), "value").when(bad, "time").when(F.col("outcome") == "skipped-family", F.col("type")))
    d = rows.select("outcome", reason.alias("reason"))
    if payloads is not None:
        d = d.unionByName(payloads.where("err is not null").select(F.lit("fetch-failed").alias("outcome"), F.col("err").alias("reason")))
    return d.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))
