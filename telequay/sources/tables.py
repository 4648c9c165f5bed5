"""Readings as tables: scan, sink in segments, retention, export, recent rows; declared facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_US = 2 * 3600 * 1_000_000


def readings_scan(spark: SparkSession, path: str) -> DataFrame:
    """uid, metric, at_us, value; only these columns are read."""
    return spark.read.parquet(path).select("uid", "metric", "at_us", "value")


def with_segment(readings: DataFrame) -> DataFrame:
    """Readings with the start of their two-hour segment of wall-clock time, the sink's partition."""
    return readings.withColumn("seg_start_us", F.floor(F.col("at_us") / SEGMENT_US) * SEGMENT_US)


def write_readings(readings: DataFrame, path: str) -> None:
    """Append, a folder for each segment; rows of a segment are brought together first, so it has few files."""
    d = with_segment(readings)
    d.repartition("seg_start_us", F.pmod(F.xxhash64("stream_id"), F.lit(16))).write.mode("append").partitionBy("seg_start_us").parquet(path)


def retained(readings: DataFrame, now_us: int, keep_us: int) -> DataFrame:
    """Readings of segments whose end isn't older than the retention."""
    return with_segment(readings).where(F.col("seg_start_us") + SEGMENT_US > now_us - keep_us)


def readings_export(samples: DataFrame, streams: DataFrame) -> DataFrame:
    """Samples beside their stream's description."""
    return samples.join(streams, "stream_id")


def recent(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The most recent rows by last_seen, ties by keys."""
    return rows.orderBy(F.col("last_seen").desc(), *keys).limit(limit)


def platform_facts(nodes: DataFrame) -> DataFrame:
    """One row: versions of the first node by name, and whether kernels are mixed."""
    return nodes.agg(F.min_by("kernel", "name").alias("kernel"), F.min_by("runtime", "name").alias("runtime"), (F.count_distinct("kernel") > 1).alias("mixed_kernels"))


def workload_corpus(pods: DataFrame) -> DataFrame:
    """What tools are looked for in: an entry for each pod (name, images), its name and its containers' images in lower case."""
    return pods.select(F.lower(F.concat_ws(" ", "name", F.array_join(F.coalesce("images", F.array().cast("array<string>")), " "))).alias("entry"))


def scrape_targets(pods: DataFrame, prefix: str) -> DataFrame:
    """Nodes that run a pod of that name prefix."""
    return pods.where(F.col("name").startswith(prefix) & (F.col("phase") == "Running")).select("node").distinct()


def declared_containers(pods: DataFrame) -> DataFrame:
    """A row per container of pods (ns, pod, containers array of name, memory, cpu); an undeclared limit (0) is null."""
    c = pods.select("ns", "pod", F.explode("containers").alias("c"))
    limit = lambda f: F.when(F.col(f) != 0, F.col(f))
    return c.select("ns", "pod", F.col("c.name").alias("container"), limit("c.memory").alias("mem_limit_bytes"), limit("c.cpu").alias("cpu_limit_milli"))


_CATALOGUE = "nodes array<struct<id:string,type:string,label:string,data_type:string>>, edges array<struct<type:string,src:string,dst:string,role:string,temporal_order:string,why:string>>"


def catalogue_scan(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, members (participates_in) and relations (phenomenon_relation) of a catalogue file."""
    raw = spark.read.schema(_CATALOGUE).option("multiLine", True).json(path)
    nodes, edges = raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode("edges").alias("e")).select("e.*")
    return {"nodes": nodes, "members": edges.where("type = 'participates_in'").select(F.col("dst").alias("phenomenon"), F.col("src").alias("signal"), "role", "temporal_order", "why"),
            "relations": edges.where("type = 'phenomenon_relation'").select("src", "dst", "role", "temporal_order", "why")}


def label_scan(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth: phenomenon, entity_contains, from_us, to_us of a labels file."""
    schema = "positives array<struct<phenomenon:string,entityContains:string,from:timestamp,to:timestamp>>"
    p = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("positives").alias("p")).select("p.*")
    return p.select("phenomenon", F.col("entityContains").alias("entity_contains"), F.unix_micros("from").alias("from_us"), F.unix_micros("to").alias("to_us"))


def forecast_events_scan(spark: SparkSession, path: str) -> DataFrame:
    """Ticks with nested traces, a line each, to a row per trace (ticks without one stay)."""
    schema = "tickSeq long, now timestamp, traces array<struct<cei:string,metric:string,basis:timestamp,bar:double,direction:string,point:array<double>,silence:string>>"
    return spark.read.schema(schema).json(path).select("tickSeq", "now", F.explode_outer("traces").alias("t")).select(
        F.col("tickSeq").alias("tick_seq"), F.unix_micros("now").alias("now_us"), "t.cei", "t.metric", F.unix_micros("t.basis").alias("basis_us"), "t.bar", "t.direction", "t.point", "t.silence")
