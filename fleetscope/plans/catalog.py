"""All registered queries."""

from fleetscope.plans import changing, checking, claiming, keeping, monitoring, planning  # noqa: F401
from fleetscope.plans.registry import ORACLES, RUNS

__all__ = ["ORACLES", "RUNS"]
