"""Verdicts of the forecast gate over a ramp that crosses its bar, and over one that hovers."""

import pytest

from telequay.operators import gate as T

CADENCE = 15_000_000
HORIZON = 16
G = T.Gate()
KIND = "f_id string, class string, stream string, seq long, basis_us long, bar double, direction string, lo array<double>, hi array<double>, silence string, ttc_us long, earliest_us long, latest_us long"


def ramp(n, change=lambda t: t, future=lambda i: 100.0 + 5.0 * i):
    """Forecasts as of samples 20, 21, ...: right but for two steps of 16, the bar met at step 8."""
    out = []
    for k in range(n):
        basis = 20 + k
        true = [future(basis + 1 + h) for h in range(HORIZON)]
        lo, hi = [x - 20 for x in true], [x + 20 for x in true]
        for h in (2, 12):
            lo[h] = true[h] + 1
        t = {"f_id": str(k), "class": "ws", "stream": "u", "seq": k, "basis_us": basis * CADENCE, "bar": true[8], "direction": "above", "lo": lo, "hi": hi, "silence": None,
             "ttc_us": 9 * CADENCE, "earliest_us": (basis + 1) * CADENCE, "latest_us": (basis + HORIZON) * CADENCE}
        out.append(tuple(change(t).values()))
    return out


def report(spark, traces, values=None):
    values = values or [100.0 + 5.0 * i for i in range(200)]
    samples = spark.createDataFrame([("u", i * CADENCE, x) for i, x in enumerate(values)], "stream string, at_us long, value double")
    return T.forecast_gate(spark.createDataFrame(traces, KIND), samples, G, CADENCE).first()


CASES = {
    "right": (7, {}, "passed", ""),
    "bands elsewhere": (7, {"lo": [1e6] * HORIZON, "hi": [1e6 + 1] * HORIZON}, "failed", "coverage"),
    "silent": (7, {"silence": "flat", "ttc_us": None, "earliest_us": None, "latest_us": None}, "failed", "event-recall"),
    "no crossing": (7, {"bar": 1e9}, "insufficient", "crossing-evidence"),
    "thin": (4, {}, "insufficient", "thin-corpus"),
    "closes early": (7, {"latest_us": 1}, "failed", "in-band"),
    "beyond the horizon": (7, {"latest_us": None}, "passed", ""),
}


@pytest.mark.parametrize("case", CASES)
def test_verdict(spark, case):
    n, change, verdict, reasons = CASES[case]
    r = report(spark, ramp(n, lambda t: t | change))
    assert (r.verdict, r.reasons) == (verdict, reasons) and r.forecasts == n
    if case == "right":
        assert r.coverage == pytest.approx(0.875) and (r.warned, r.in_band, r.false_warnings, r.events, r.events_warned, r.hover_excluded) == (7, 7, 0, 4, 4, 3) and r.median_err == 0  # the first three cross too early to look back
    if case == "no crossing":
        assert r.false_warnings == r.observed == 7
    if case == "silent":
        assert r.missed == r.crossings == 7 and r.events_warned == 0


def test_short_future_is_skipped_and_no_false_warning_without_the_whole_horizon(spark):
    r = report(spark, ramp(7, lambda t: t | {"bar": 1e9}), [100.0 + 5.0 * i for i in range(33)])
    assert (r.forecasts, r.skipped, r.observed, r.false_warnings) == (5, 2, 0, 0)


def test_hovering_is_no_event(spark):
    base = [990.0 + (5.0 if i % 3 == 0 else 0.0) for i in range(60)]
    r = report(spark, ramp(7, lambda t: t | {"bar": 994.0, "silence": "flat", "ttc_us": None}, lambda i: base[i]), base)
    assert r.verdict == "insufficient" and r.events == 0 and r.hover_excluded >= 1 and r.crossings == 7


def test_samples_of_one_time_and_downward_bars(spark):
    values = [200.0 - 2 * i for i in range(80)]
    samples = spark.createDataFrame([("u", i * CADENCE, x) for i, x in enumerate(values)] + [("u", 60 * CADENCE, 300.0)], "stream string, at_us long, value double")
    traces = spark.createDataFrame(ramp(1, lambda t: t | {"basis_us": 45 * CADENCE, "bar": 80.0, "direction": "below"}), KIND)
    r = T.scored(traces, samples, G, CADENCE).first()
    assert (r.place, r.actual_h, r.crossing_us, r.hover) == (46, 14, 60 * CADENCE, False)  # 80 and 300 stand at one time: the smaller is first
    assert {x.lead for x in T.event_ledger(T.scored(traces, samples, G, CADENCE)).collect()} == {15}


def test_origins_equal_those_of_each_prefix(spark):
    values = [3.0, 5.0, 4.0, 9.0, 9.5, 7.0]
    s = spark.createDataFrame([("t", i, i * CADENCE, x) for i, x in enumerate(values)], "target string, idx long, at_us long, value double")
    got = {r.idx: r for r in T.rolling_origins(s, last_n=3).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for i, r in got.items():
        d = [b - a for a, b in zip(values[:i], values[1:i + 1])][-3:]
        m = sum(d) / len(d)
        assert r.drift == pytest.approx(m) and r.sigma == pytest.approx(max((sum((x - m) ** 2 for x in d) / len(d)) ** 0.5, 1e-9)) and r.last == values[i]
