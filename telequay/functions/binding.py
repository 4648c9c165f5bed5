"""Where an entity's limit comes from, and what a platform can observe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eligibility(path: Column, declared: Column) -> Column:
    """Reason why an entity is out of a rule's scope; null if it is in.  ``declared`` is the value at the path."""
    return F.when(path.isNotNull() & declared.isNull(), F.concat(F.lit("not declared: "), path))


def resolve_bar(kind: Column, path: Column, factor: Column, declared: Column, default_value: Column, direction: Column) -> Column:
    """struct(bar, reason): a nullable bar (kind, source, flagged, value, unit, direction, factor).

    A config-relative bar is the declared value times the factor, none without a
    declared value; absolute and rate bars are the rule's default, flagged.
    """
    unit = F.when(F.contains(path, F.lit("cpu")), "millicores").when(path.isNotNull(), "bytes").otherwise("native")
    bar = lambda source, flagged, value: F.struct(kind.alias("kind"), F.lit(source).alias("source"), F.lit(flagged).alias("flagged"),
                                                  value.cast("double").alias("value"), unit.alias("unit"), direction.alias("direction"), factor.alias("factor"))
    config = (kind == "config-relative")
    return F.struct(
        F.when(config & declared.isNotNull(), bar("config", False, declared * factor))
        .when(~config & default_value.isNotNull(), bar("default", True, default_value)).alias("bar"),
        F.when(config & declared.isNull(), "unbounded").when(~config & default_value.isNull(), "no-default").alias("reason"))


def kernel_at_least(kernel: Column, major: int, minor: int) -> Column:
    """met, unmet, or indeterminate when the version can't be read."""
    got_major = F.nullif(F.regexp_extract(kernel, r"^(\d+)\.(\d+)", 1), F.lit("")).cast("int")
    got_minor = F.nullif(F.regexp_extract(kernel, r"^(\d+)\.(\d+)", 2), F.lit("")).cast("int")
    return (F.when(got_major.isNull(), "indeterminate")
            .when((got_major > major) | ((got_major == major) & (got_minor >= minor)), "met").otherwise("unmet"))


#: Words that mark a data type as no series.
NON_SERIES = (
    "event", "struct", "json", "yaml", "text", "log", "span", "trace",
    "profile", "file", "object", "manifest", "resource", "api", "snapshot",
    "dump", "report", "list", "table", "record", "kv", "key-value",
)


def series_shape(data_type: Column) -> Column:
    """gauge, counter, histogram, several of them joined by +, non-series, or unknown."""
    t = F.lower(F.trim(F.coalesce(data_type, F.lit(""))))
    has = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda m: F.contains(t, m))
    flags = F.concat_ws("+", F.when(has("gauge"), F.lit("gauge")), F.when(has("counter"), F.lit("counter")), F.when(has("histogram", "summary"), F.lit("histogram")))
    return F.when(flags != "", flags).when(has(*NON_SERIES), "non-series").otherwise("unknown")


def capability_state(kind: Column, kernel: Column, present: Column, log_pipeline: Column, kubelet: Column) -> Column:
    """ok, out-of-scope or indeterminate for a capability by its kind.

    kernel: needs 4.19; presence-sufficient: a tool gives it, without one it is
    open; presence-necessary: without the tool it is out, with it open;
    any-log-pipeline; kubelet: needs 1.22; any other kind is indeterminate.
    """
    met = lambda state: F.when(state == "met", "ok").when(state == "unmet", "out-of-scope").otherwise("indeterminate")
    unknown = F.lit("indeterminate")
    return (F.when(kind == "kernel", met(kernel_at_least(kernel, 4, 19)))
            .when(kind == "presence-sufficient", F.when(present, "ok").otherwise(unknown))
            .when(kind == "presence-necessary", F.when(present.isNotNull() & ~present, "out-of-scope").otherwise(unknown))
            .when(kind == "any-log-pipeline", F.when(log_pipeline, "ok").when(~log_pipeline, "out-of-scope").otherwise(unknown))
            .when(kind == "kubelet", met(kernel_at_least(F.regexp_replace(kubelet, "^v", ""), 1, 22))).otherwise(unknown))


def gate_active(gate: Column, kubelet: Column, runtime: Column) -> Column:
    """Whether a distribution gate applies: dockershim from 1.24 on another runtime, k3s and microk8s by the version's text."""
    newer = kernel_at_least(F.regexp_replace(kubelet, "^v", ""), 1, 24) == "met"
    return F.coalesce(F.when(gate == "dockershim", newer & ~F.startswith(runtime, F.lit("docker"))).otherwise(F.contains(F.lower(kubelet), gate)), F.lit(False))
