"""States that follow from a time and a budget: edges, tombstones, findings, operator windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_status(retracted_us: Column, confirmed_us: Column, budget_us: Column, now_us: Column, default_us: int) -> Column:
    """retracted, suspect (not confirmed within the budget) or valid."""
    return (F.when(retracted_us.isNotNull(), "retracted")
            .when(now_us - confirmed_us > F.coalesce(budget_us, F.lit(default_us)), "suspect").otherwise("valid"))


def tombstone_tier(died_us: Column, now_us: Column, full_us: int, stub_us: int) -> Column:
    """alive, full, stub or expired by the time since death."""
    return (F.when(died_us.isNull(), "alive").when(now_us - died_us < full_us, "full")
            .when(now_us - died_us < stub_us, "stub").otherwise("expired"))


def freshness(last_seen_us: Column, as_of_us: Column, stale_after_us: int) -> Column:
    """struct(stale, age_us); an age is never below 0."""
    age = F.greatest(as_of_us - last_seen_us, F.lit(0))
    return F.struct((age > stale_after_us).alias("stale"), age.alias("age_us"))


#: The kinds of operator windows, and those at whose start a series may be cut.
WINDOW_KINDS = ("deploy", "config-change", "incident", "maintenance")
SPLICE_KINDS = ("deploy", "config-change")


def context_window_check(label: Column, kind: Column, author: Column, start_us: Column, end_us: Column) -> Column:
    """struct(error, splice_eligible) of an operator's window; the first failed test names the error."""
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    error = (F.when(blank(label), "no-label").when(~F.coalesce(kind.isin(*WINDOW_KINDS), F.lit(False)), "unknown-kind")
             .when(start_us.isNull(), "no-start").when(end_us < start_us, "ends-before-start").when(blank(author), "no-author"))
    return F.struct(error.alias("error"), F.coalesce(error.isNull() & kind.isin(*SPLICE_KINDS), F.lit(False)).alias("splice_eligible"))
