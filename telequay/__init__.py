"""Spark-native analytics for infrastructure telemetry.

Everything is a function from DataFrames to DataFrames.  Sub-packages:
``sources`` (scans and sinks), ``functions`` (row-local columns), ``operators``
(joins, aggregations, windows), ``plans`` (whole queries over the test tables)
and ``streaming`` (stateful forms of the same operators).
"""
