"""Table quality profiling on Spark: structure, statistics, health score and findings."""

from .constants import Thresholds
from .plans.profile import Profile

__all__ = ["Profile", "Thresholds"]
