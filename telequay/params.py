"""Settings of the analytics, with the defaults of a live installation.  Durations are microseconds."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND


@dataclass(frozen=True)
class Params:
    interval_us: int = 15 * SECOND
    watermark_us: int = 30 * SECOND
    rate_window_us: int = 5 * MINUTE
    cooccurrence_us: int = 10 * MINUTE
    cascade_us: int = 10 * MINUTE
    band: float = 0.05
    well_above: float = 1.10
    edge_budget_us: int = 5 * MINUTE
    full_tombstone_us: int = 15 * MINUTE
    stub_tombstone_us: int = 24 * HOUR
    budget: int = 50
    horizon: int = 240
    min_context: int = 64
    flat_epsilon: float = 0.005
    max_band_ratio: float = 0.5
    reset_drop: float = 0.4
    max_explained: float = 0.9
    min_completeness: float = 0.0


#: For streams with a sample every other day, as in the test tables.
SLOW = Params(interval_us=2 * DAY, watermark_us=4 * DAY, rate_window_us=14 * DAY, cooccurrence_us=28 * DAY, cascade_us=28 * DAY)
