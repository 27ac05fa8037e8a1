"""Imports every module that registers queries."""

from tapeworks.plans import ledger, market, reports, signals, streams, trading  # noqa: F401
from tapeworks.plans.registry import ORACLES, QUERIES  # noqa: F401
