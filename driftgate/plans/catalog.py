"""All checks, gathered."""

from driftgate.plans import (  # noqa: F401
    anomaly_checks,
    cdc_checks,
    compare_checks,
    discovery_checks,
    gate_checks,
    risk_checks,
    snapshot_checks,
    stream_checks,
)
from driftgate.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
