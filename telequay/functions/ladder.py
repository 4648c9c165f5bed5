"""Thresholds: the line of deep violation, the ladder, staleness, member checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rungs in order of severity.
RUNGS = ("unknown", "below", "at-threshold", "above", "well-above")


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite (NaN compares above every number here, so it is tested first)."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def well_above_line(bar: Column, factor: Column, multiple: Column, direction: Column) -> Column:
    """Above: the raw limit where the bar is a true fraction of one, else a multiple of the bar.  Below: the bar divided."""
    below = F.when(multiple <= 0, bar).otherwise(bar / multiple)
    above = F.when((factor > 0) & (factor < 1), bar / factor).otherwise(bar * multiple)
    return F.when(direction == "below", below).otherwise(above)


def ladder(value: Column, bar: Column, line: Column, band: Column, direction: Column) -> Column:
    """The rung of a value; its order of tests matters.  No finite value: unknown."""
    below = (F.when(value <= line, "well-above").when(value < bar, "above")
             .when(value <= bar * (1 + band), "at-threshold").otherwise("below"))
    above = (F.when(value >= line, "well-above").when(value >= bar, "above")
             .when(value >= bar * (1 - band), "at-threshold").otherwise("below"))
    return F.when(~finite(value), "unknown").when(direction == "below", below).otherwise(above)


def rank(state: Column) -> Column:
    """A rung's place in the order of severity; null or other text is 0."""
    out = F.lit(0)
    for i, name in enumerate(RUNGS[1:], 1):
        out = F.when(state == name, i).otherwise(out)
    return out


def crossed(state: Column) -> Column:
    return state.isin("above", "well-above")


def stale(sample_us: Column, now_us: Column, watermark_us: int) -> Column:
    return now_us - sample_us > F.lit(watermark_us)


def ratio_stale(num_us: Column, den_us: Column, now_us: Column, watermark_us: int) -> Column:
    """A ratio is as fresh as the older of its inputs."""
    return stale(F.least(num_us, den_us), now_us, watermark_us)


def member_check(facet: Column, expect: Column, min_state: Column, state: Column, is_stale: Column, slope: Column,
                 slope_samples: Column, slope_inconclusive: Column, breached: Column, inconclusive: Column) -> Column:
    """struct(met, fresh, seen) of one check against the one component of its metric (null state and breached: none)."""
    no_slope = state.isNull() | is_stale | slope_inconclusive | (slope_samples < 2)
    rises = F.when(expect == "rising", slope > 0).when(expect == "falling", slope < 0).otherwise(F.lit(False))
    slope_met = (rank(state) >= rank(min_state)) & rises
    level_met = expect.isin("crossed", "at-or-above") & crossed(state)
    no_rate = breached.isNull() | is_stale | inconclusive
    result = lambda met, fresh, seen: F.struct(met.alias("met"), fresh.alias("fresh"), seen.alias("seen"))
    no, yes = F.lit(False), F.lit(True)
    return (F.when((facet == "slope") & F.coalesce(no_slope, yes), result(no, no, F.lit("no-slope")))
            .when(facet == "slope", result(F.coalesce(slope_met, no), yes, state))
            .when(facet.isin("level", "ratio") & F.coalesce(state.isNull() | is_stale, yes), result(no, no, F.lit("no-sample")))
            .when(facet.isin("level", "ratio"), result(F.coalesce(level_met, no), yes, state))
            .when((facet == "rate-guard") & F.coalesce(no_rate, yes), result(no, no, F.lit("inconclusive")))
            .when(facet == "rate-guard", result((expect == "breached") & breached, yes, F.lit("measured")))
            .otherwise(result(no, no, F.lit("unknown-facet"))))


def already_crossed(value: Column, bar: Column, direction: Column) -> Column:
    return F.when(direction == "below", value <= bar).otherwise(value >= bar)


def spread(series: Column, last_n: int = 64) -> Column:
    """Population spread of the last values, relative to the last one unless that is 0; nulls don't count, and without a value it is null."""
    tail = F.when(F.size(series) > last_n, F.slice(series, F.lit(-last_n), F.lit(last_n))).otherwise(series)
    tail = F.filter(tail, lambda x: x.isNotNull())
    n = F.nullif(F.size(tail).cast("double"), F.lit(0.0))
    mean = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / n
    last = F.abs(F.try_element_at(series, F.lit(-1)))
    return F.sqrt(F.aggregate(tail, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n) / F.when(last > 0, last).otherwise(F.lit(1.0))


def is_flat(series: Column, epsilon: float, last_n: int = 64) -> Column:
    """The spread of the last values is below epsilon."""
    return spread(series, last_n) < F.lit(epsilon)


def confidence_class(earliest: Column, latest: Column, horizon: Column) -> Column:
    """tight, moderate or wide by band width over horizon; an open band is wide."""
    share = (latest - earliest) / horizon
    return F.when(latest.isNull() | earliest.isNull(), "wide").when(share <= 0.2, "tight").when(share <= 0.45, "moderate").otherwise("wide")
