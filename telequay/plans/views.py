"""The test tables as telemetry: each view as a DataFrame and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telequay.params import DAY, SECOND, SLOW

FIRST_TICK = 1_704_844_800 * SECOND
TICKS = [(i, FIRST_TICK + i * 5 * DAY) for i in range(5)]


class Views:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def readings(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("stream_id"), F.col("user_id").cast("string").alias("uid"),
            F.col("event_type").alias("metric"), F.when(F.col("event_type").isin("purchase", "view"), "counter").otherwise("gauge").alias("type"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_id").alias("arrival"), "value")

    def ticks(self) -> DataFrame:
        return self.spark.createDataFrame(TICKS, "tick_seq long, now_us long")

    def bindings(self) -> DataFrame:
        """A bar for each customer with a positive limit and each metric that has a rule."""
        c = self.table("customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("uid"), (F.col("c_acctbal") * 0.01).alias("bar"))
        rules = self.spark.createDataFrame(RULES, "rule_id string, metric string, factor double, unit string, direction string")
        return c.crossJoin(F.broadcast(rules))

    def edges(self) -> DataFrame:
        """runs-on: customer to nation, from the first order to the last; retracted for every seventh customer."""
        o = self.table("orders").groupBy("o_custkey").agg(
            F.unix_micros(F.min("o_orderdate").cast("timestamp")).alias("asserted_us"), F.unix_micros(F.max("o_orderdate").cast("timestamp")).alias("confirmed_us"))
        c = self.table("customer")
        return c.join(o, c.c_custkey == o.o_custkey).select(
            F.lit("runs-on").alias("type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("from_key"),
            F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("to_key"), "asserted_us", "confirmed_us",
            F.when(F.col("c_custkey") % 7 == 0, F.col("confirmed_us") + DAY).alias("retracted_us"))

    def links(self) -> DataFrame:
        """Edges of three types between customers' ids and suppliers' ids of their orders, days around the ticks."""
        li = self.table("orders").join(self.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).where("o_custkey <> l_suppkey")
        day = lambda n: F.lit(FIRST_TICK) + n * F.lit(DAY)
        d = li.groupBy("o_custkey", "l_suppkey").agg(day(F.min("o_orderkey") % 20 - 10).alias("asserted_us"), day(F.max("o_orderkey") % 40 - 10).alias("late_us"))
        both = F.col("o_custkey") + F.col("l_suppkey")
        kind = F.element_at(F.array(*map(F.lit, LINKS)), (both % 3 + 1).cast("int"))
        d = d.withColumn("confirmed_us", F.greatest("asserted_us", "late_us"))
        return d.select(kind.alias("type"), F.col("o_custkey").cast("string").alias("from_key"), F.col("l_suppkey").cast("string").alias("to_key"),
                        "asserted_us", "confirmed_us", F.when(both % 7 == 0, F.col("confirmed_us") + DAY).alias("retracted_us"))

    def tick_windows(self) -> DataFrame:
        return self.ticks().select("tick_seq", (F.col("now_us") - SLOW.cooccurrence_us).alias("start_us"), F.col("now_us").alias("end_us"))

    def lifecycle(self) -> DataFrame:
        """Orders as successive instances of a customer's name; status F has a deletion 40 days after birth."""
        o = self.table("orders")
        born = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
        return o.select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderkey").alias("seq"),
                        born.alias("born_us"), F.when(F.col("o_orderstatus") == "F", born + 40 * DAY).alias("deleted_us"))


LINKS = ("runs-on", "mounts", "selects")
#: An edge that nothing has confirmed for longer than this is suspect.
LINK_BUDGET = 5 * DAY
#: Rules of the test: metric, factor of the limit, unit and direction.
RULES = [("r-click", "click", 0.5, "native", "above"), ("r-error", "error", 0.0, "native", "below"),
         ("r-purchase", "purchase", 0.9, "millicores", "above"), ("r-signup", "signup", 0.0, "native", "above")]

_VALUES = ", ".join(f"('{a}', '{b}', {c}::DOUBLE, '{d}', '{e}')" for a, b, c, d, e in RULES)
VIEWS = {
    "readings": """SELECT concat(user_id, '|', event_type) AS stream_id, user_id::VARCHAR AS uid, event_type AS metric,
        CASE WHEN event_type IN ('purchase', 'view') THEN 'counter' ELSE 'gauge' END AS type, epoch_us(ts) AS at_us, event_id AS arrival, value FROM events""",
    "ticks": "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in TICKS) + ") t(tick_seq, now_us)",
    "bindings": f"""SELECT c_custkey::VARCHAR AS uid, c_acctbal * 0.01::DOUBLE AS bar, r.* FROM customer,
        (VALUES {_VALUES}) r(rule_id, metric, factor, unit, direction) WHERE c_acctbal > 0""",
    "edges": f"""SELECT 'runs-on' AS type, concat('c', c_custkey) AS from_key, concat('n', c_nationkey) AS to_key, a AS asserted_us, b AS confirmed_us,
        CASE WHEN c_custkey % 7 = 0 THEN b + {DAY} END AS retracted_us FROM customer JOIN
        (SELECT o_custkey, epoch_us(min(o_orderdate)) AS a, epoch_us(max(o_orderdate)) AS b FROM orders GROUP BY 1) o ON c_custkey = o_custkey""",
    "links": f"""SELECT (['runs-on', 'mounts', 'selects'])[((c + s) % 3 + 1)::INT] AS type, c::VARCHAR AS from_key, s::VARCHAR AS to_key, a AS asserted_us, greatest(a, b) AS confirmed_us,
        CASE WHEN (c + s) % 7 = 0 THEN greatest(a, b) + {DAY} END AS retracted_us FROM (SELECT o_custkey AS c, l_suppkey AS s, {FIRST_TICK} + (min(o_orderkey) % 20 - 10) * {DAY} AS a,
        {FIRST_TICK} + (max(o_orderkey) % 40 - 10) * {DAY} AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey GROUP BY ALL)""",
    "linked": f"""SELECT tick_seq, type, from_key, to_key, CASE WHEN retracted_us IS NULL AND now_us - confirmed_us > {LINK_BUDGET} THEN 1 ELSE 2 END AS verdict
        FROM links JOIN ticks ON asserted_us <= now_us AND (retracted_us IS NULL OR retracted_us > now_us - {SLOW.cooccurrence_us})""",
    "lifecycle": f"""SELECT o_custkey::VARCHAR AS name, o_orderkey::VARCHAR AS uid, o_orderkey AS seq, epoch_us(o_orderdate) AS born_us,
        CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) + {40 * DAY} END AS deleted_us FROM orders""",
    "latest": """SELECT * FROM (SELECT tick_seq, now_us, stream_id, uid, metric, type, value, at_us, arrival,
        row_number() OVER (PARTITION BY tick_seq, stream_id ORDER BY at_us DESC, arrival) AS k FROM readings JOIN ticks ON at_us <= now_us) WHERE k = 1""",
    "steps": f"""SELECT *, gap_at IS NULL OR at_us >= gap_at AS in_run,
        CASE WHEN (gap_at IS NULL OR at_us >= gap_at) AND NOT (gap AND at_us = gap_at) THEN value - prev END AS step FROM (
        SELECT *, max(CASE WHEN gap THEN at_us END) OVER (PARTITION BY tick_seq, stream_id) AS gap_at FROM (
        SELECT r.*, tick_seq, now_us, lag(value) OVER w AS prev, coalesce(at_us - lag(at_us) OVER w > {2 * SLOW.interval_us}, false) AS gap
        FROM readings r JOIN ticks ON at_us BETWEEN now_us - {SLOW.rate_window_us} AND now_us
        WINDOW w AS (PARTITION BY tick_seq, stream_id ORDER BY at_us, arrival)))""",
    "rates": """SELECT tick_seq, stream_id, samples, delta, resets, elapsed_us, gap_broken,
        CASE WHEN elapsed_us > 0 THEN delta / (elapsed_us / 1000000.0::DOUBLE) ELSE 0 END AS per_second FROM (
        SELECT tick_seq, stream_id, count(*) AS samples, coalesce(sum(step) FILTER (step >= 0), 0) AS delta, count(*) FILTER (step < 0) AS resets,
        CASE WHEN count(*) FILTER (in_run) >= 2 THEN max(at_us) FILTER (in_run) - min(at_us) FILTER (in_run) ELSE 0 END AS elapsed_us,
        bool_or(gap) AS gap_broken FROM steps GROUP BY ALL)""",
    "slopes": """SELECT tick_seq, stream_id, samples, CASE WHEN samples >= 2 THEN l - f ELSE 0 END AS delta, CASE WHEN samples >= 2 THEN span ELSE 0 END AS elapsed_us,
        CASE WHEN samples >= 2 AND span > 0 THEN (l - f) / (span / 1000000.0::DOUBLE) ELSE 0 END AS per_second, gap_broken, gap_broken AND samples < 2 AS inconclusive FROM (
        SELECT tick_seq, stream_id, count(*) FILTER (in_run) AS samples, last(value ORDER BY at_us, arrival) FILTER (in_run) AS l,
        first(value ORDER BY at_us, arrival) FILTER (in_run) AS f, max(at_us) FILTER (in_run) - min(at_us) FILTER (in_run) AS span, bool_or(gap) AS gap_broken
        FROM steps GROUP BY ALL)""",
    "components": f"""SELECT *, CASE WHEN direction = 'below' THEN CASE WHEN value <= line THEN 'well-above' WHEN value < bar THEN 'above'
            WHEN value <= bar * 1.05::DOUBLE THEN 'at-threshold' ELSE 'below' END
        WHEN value >= line THEN 'well-above' WHEN value >= bar THEN 'above' WHEN value >= bar * 0.95::DOUBLE THEN 'at-threshold' ELSE 'below' END AS state FROM (
        SELECT l.tick_seq, l.uid, b.rule_id, l.metric, l.stream_id, b.bar, b.direction,
        CASE WHEN l.type <> 'counter' THEN l.value WHEN r.elapsed_us > 0 THEN r.per_second * CASE WHEN b.unit = 'millicores' THEN 1000 ELSE 1 END END AS value,
        CASE WHEN direction = 'below' THEN bar / {SLOW.well_above}::DOUBLE WHEN factor > 0 AND factor < 1 THEN bar / factor ELSE bar * {SLOW.well_above}::DOUBLE END AS line,
        now_us - l.at_us > {SLOW.watermark_us} AS stale, CASE WHEN l.type <> 'counter' THEN s.per_second ELSE 0 END AS slope0,
        CASE WHEN l.type <> 'counter' THEN s.samples END AS samples0, CASE WHEN l.type <> 'counter' THEN s.inconclusive END AS inconclusive0
        FROM latest l JOIN bindings b ON l.uid = b.uid AND l.metric = b.metric
        LEFT JOIN rates r ON r.tick_seq = l.tick_seq AND r.stream_id = l.stream_id AND l.type = 'counter'
        LEFT JOIN slopes s ON s.tick_seq = l.tick_seq AND s.stream_id = l.stream_id AND l.type <> 'counter') WHERE value IS NOT NULL""",
    "guards": f"""SELECT l.tick_seq, l.uid, b.rule_id, l.metric, coalesce(r.delta, 0) AS delta, coalesce(r.per_second, 0) AS per_second, coalesce(r.resets, 0) AS resets,
        coalesce(r.gap_broken, false) AS gap_broken, coalesce(r.gap_broken, false) AND coalesce(r.elapsed_us, 0) <= 0 AS inconclusive,
        coalesce(r.delta, 0) >= b.bar AND NOT (coalesce(r.gap_broken, false) AND coalesce(r.elapsed_us, 0) <= 0) AS breached, now_us - l.at_us > {SLOW.watermark_us} AS stale
        FROM latest l JOIN bindings b ON l.uid = b.uid AND l.metric = b.metric LEFT JOIN rates r ON r.tick_seq = l.tick_seq AND r.stream_id = l.stream_id""",
    "loud": """SELECT DISTINCT tick_seq, uid, metric, state AS how FROM components WHERE state IN ('above', 'well-above') AND NOT stale
        UNION SELECT tick_seq, uid, metric, 'breached' FROM guards WHERE breached AND NOT stale AND NOT inconclusive""",
}
_NEEDS = {"linked": ["links", "ticks"], "latest": ["readings", "ticks"], "steps": ["readings", "ticks"], "rates": ["steps"], "slopes": ["steps"],
          "components": ["latest", "bindings", "rates", "slopes"], "guards": ["latest", "bindings", "rates"], "loud": ["components", "guards"]}


def with_views(sql: str, *names: str, **more: str) -> str:
    """``sql`` after the views it names, those they need, and further ones given by name."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({text})" for n, text in more.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
