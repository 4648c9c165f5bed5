"""File scans, sinks and streams on small files."""

import collections
import json

import pytest
from pyspark.sql import functions as F

from telequay.operators import detect
from telequay.sources import exposition, tables
from telequay.streaming import live


def test_metric_text(spark):
    body = "\n".join(["# HELP up x", "# TYPE up gauge", 'up{pod="a",ns="n"} 1 1700000000000', "up 2", "# TYPE lat histogram", 'lat_bucket{le="1"} 3', "lat_sum 4", "lat_count 5", "bare 7.5", "bad NaN", "inf +Inf", "!! what", ""])
    p = spark.createDataFrame([("node-exporter", "n1", 5, body, None), ("cadvisor", "n2", 5, None, "timeout")], "family string, node string, received_us long, body string, err string")
    rows = {(r.metric, r.at_us): r for r in exposition.exposition_rows(p).collect()}
    assert rows["up", 1_700_000_000_000_000].labels == {"pod": "a", "ns": "n"} and rows["up", 5].value == 2.0 and rows["bare", 5].type == "untyped"
    counts = {r.outcome: r.n for r in exposition.ingest_summary(exposition.exposition_rows(p)).collect()}
    assert counts == {"sample": 3, "skipped-family": 3, "non-finite": 2, "malformed": 1}


def test_json_scans(spark, tmp_path):
    labels = {"positives": [{"phenomenon": "p", "entityContains": "x", "from": "2026-01-01T00:00:00Z", "to": "2026-01-01T00:01:00Z"}]}
    (tmp_path / "labels.json").write_text(json.dumps(labels, indent=1))
    r = tables.label_scan(spark, str(tmp_path / "labels.json")).first()
    assert r.to_us - r.from_us == 60_000_000
    events = [{"tickSeq": 1, "now": "2026-01-01T00:00:00Z", "traces": [{"cei": "a", "metric": "m", "bar": 1.0, "point": [1.0, 2.0]}]}, {"tickSeq": 2, "now": "2026-01-01T00:00:15Z", "traces": []}]
    (tmp_path / "events.jsonl").write_text("\n".join(map(json.dumps, events)))
    got = tables.forecast_events_scan(spark, str(tmp_path / "events.jsonl")).orderBy("tick_seq").collect()
    assert [(r.tick_seq, r.cei) for r in got] == [(1, "a"), (2, None)]
    catalogue = {"nodes": [{"id": "s", "type": "Signal"}, {"id": "p", "type": "Phenomenon"}], "edges": [{"type": "participates_in", "src": "s", "dst": "p", "role": "required"}, {"type": "phenomenon_relation", "src": "p", "dst": "q", "role": "downstream"}]}
    (tmp_path / "catalogue.json").write_text(json.dumps(catalogue))
    c = tables.catalogue_scan(spark, str(tmp_path / "catalogue.json"))
    assert c["members"].first().signal == "s" and c["relations"].count() == 1 and c["nodes"].count() == 2


def test_segments(spark, tmp_path):
    d = spark.range(50).select(F.lit("s").alias("stream_id"), F.lit("u").alias("uid"), F.lit("m").alias("metric"), (F.col("id") * 600_000_000).alias("at_us"), F.col("id").cast("double").alias("value"))
    path = str(tmp_path / "readings")
    tables.write_readings(d, path)
    tables.write_readings(d.where("value > 40"), path)
    back = tables.readings_scan(spark, path)
    assert back.count() == 59 and back.columns == ["uid", "metric", "at_us", "value"]
    assert tables.retained(d, 50 * 600_000_000, 2 * 3600 * 1_000_000).agg(F.min("at_us")).first()[0] == 36 * 600_000_000


def test_cards_in_micro_batches_equal_the_batch(spark, tmp_path):
    rows = [(t, "e", m) for t, m in ((0, "a"), (1, "a"), (1, "b"), (2, "b"), (4, "c"))]
    d = spark.createDataFrame(rows, "tick_seq long, uid string, metric string")
    ticks = spark.createDataFrame([(i, i) for i in range(6)], "tick_seq long, now_us long")
    for i, t in enumerate((0, 1, 2, 4)):
        d.where(F.col("tick_seq") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = str(tmp_path / "seen")
    out = []

    def job(batch, epoch):
        batch.write.mode("append").parquet(seen)
        out.append(sorted(map(tuple, detect.card_aging(spark.read.parquet(seen), ticks).collect())))

    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.each_batch(stream, job, str(tmp_path / "cp")).awaitTermination()
    assert len(out) >= 4 and out[-1] == sorted(map(tuple, detect.card_aging(d, ticks).collect()))


def test_a_failed_forecast_is_stated(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "target string, idx long, value double")

    def odd(values, horizon, quantiles):
        if values[0] > 1:
            raise RuntimeError("no model")
        return [[0.0] * (horizon - 1)]

    got = {r.target: r for r in live.forecaster_hook(d, odd, 3, (0.5,)).collect()}
    assert got["b"].error == "no model" and got["a"].error and got["a"].value is None


@pytest.mark.parametrize("mode", ["append", "update", "complete"])
def test_drained_streams_lie_in_files(spark, tmp_path, mode):
    for k in range(3):
        spark.range(k * 4, k * 4 + 4).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = live.file_stream(spark, str(tmp_path / "in/*"), "*.parquet", "id long")
    if mode != "append":
        stream = stream.groupBy((F.col("id") % 2).alias("odd")).agg(F.count("*").alias("n"))
    got = live.drained(stream, mode)
    assert got.inputFiles() and got.columns == stream.columns
    want = {"append": [(i,) for i in range(12)], "update": [(o, n) for o in (0, 1) for n in (2, 4, 6)], "complete": [(0, 6), (1, 6)]}
    assert sorted(map(tuple, got.collect())) == want[mode]


def test_exposition_traps(spark):
    """Numbers that are not finite, times that are no numbers, labels given twice, escapes: no line stops the job."""
    from telequay.sources.exposition import exposition_rows

    lines = ["up 1", "up inf", "up Infinity", "up -INF", "up 1e999", "up nan", "up 1 12345678901234567890", "up 1 9223372036854775807", "up 1 1700000000000",
             'x{a="1",b="2",a="3"} 4', r'y{p="C:\\n\"q\"\n"} 5', "z{} 6", "{bad} 1", "up", "up one"]
    d = spark.createDataFrame([("f", "n", 7, "\n".join(lines), None)], "family string, node string, received_us long, body string, err string")
    got = exposition_rows(d).collect()
    out = collections.Counter((r.outcome, r.at_us) for r in got if r.metric == "up")
    assert out == {("sample", 7): 1, ("sample", 1_700_000_000_000_000): 1, ("non-finite", 7): 5, ("malformed", None): 2, ("malformed", 7): 1}
    labels = {r.metric: r.labels for r in got}
    assert labels["x"] == {"a": "3", "b": "2"} and labels["y"] == {"p": 'C:\\n"q"\n'} and labels["z"] == {}
    assert sum(r.outcome == "non-finite" for r in got) == 5 and sum(r.outcome == "malformed" for r in got) == 5
    assert all(abs(r.value) < float("inf") for r in got if r.outcome == "sample")
