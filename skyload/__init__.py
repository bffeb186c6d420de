"""Flight difficulty analytics on Spark DataFrames."""

from skyload.config import DEFAULT_WEIGHTS, FLIGHT_KEY, FULL_WEIGHTS, LIFT_FEATURES, Settings

__all__ = ["DEFAULT_WEIGHTS", "FLIGHT_KEY", "FULL_WEIGHTS", "LIFT_FEATURES", "Settings"]
