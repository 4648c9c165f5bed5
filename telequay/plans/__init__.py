"""Whole queries over the test tables, with oracle SQL."""

from . import detection, forecasting, gating, identity, live, platform, replaying, rest, signals, surfaces  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
