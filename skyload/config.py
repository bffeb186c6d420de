"""Settings of the scoring model: weights, thresholds, windows, keyword lists."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# Column names of the flight key and the daily scaling unit.
FLIGHT_KEY = ("company_id", "flight_number", "scheduled_departure_date_local")
DAY = "scheduled_departure_date_local"
ORIGIN = "scheduled_departure_station_code"
DESTINATION = "scheduled_arrival_station_code"
DEPARTURE = "scheduled_departure_datetime_local"
ARRIVAL = "scheduled_arrival_datetime_local"
ACTUAL_DEPARTURE = "actual_departure_datetime_local"

# Weights used when the caller gives none (they add up to 1).
DEFAULT_WEIGHTS = {
    "ground_time_pressure": 0.15,
    "actual_turn_deficit": 0.07,
    "turn_deficit_ratio": 0.05,
    "total_bags": 0.06,
    "transfer_ratio": 0.06,
    "hot_transfer_count": 0.04,
    "total_pax": 0.08,
    "load_factor": 0.06,
    "basic_economy_ratio": 0.05,
    "booking_lead_days_mean": 0.04,
    "late_booking_ratio": 0.04,
    "children": 0.04,
    "lap_children": 0.03,
    "stroller_users": 0.03,
    "ssr_count": 0.10,
    "is_international": 0.04,
    "widebody_flag": 0.06,
}

# Weights of the full model (they add up to 1.055 and are normalised).
FULL_WEIGHTS = {
    "ground_time_pressure": 0.13,
    "actual_turn_deficit": 0.06,
    "turn_deficit_ratio": 0.05,
    "total_bags": 0.05,
    "transfer_ratio": 0.05,
    "hot_transfer_count": 0.03,
    "total_pax": 0.07,
    "load_factor": 0.05,
    "basic_economy_ratio": 0.04,
    "booking_lead_days_mean": 0.04,
    "late_booking_ratio": 0.04,
    "children": 0.03,
    "lap_children": 0.02,
    "stroller_users": 0.02,
    "ssr_count": 0.08,
    "is_international": 0.04,
    "widebody_flag": 0.05,
    "ssr_mobility_count": 0.02,
    "ssr_special_handling_count": 0.02,
    "bag_issue_lead_mean": 0.02,
    "bag_late_issue_ratio": 0.02,
    "bag_per_seat_ratio": 0.02,
    "destination_base_difficulty": 0.02,
    "load_factor_volatility": 0.015,
    "ground_time_pressure_volatility": 0.015,
    "slot_congestion_count": 0.015,
    "transfer_ground_interaction": 0.015,
    "load_pressure_interaction": 0.015,
    "weather_severity_index": 0.01,
}

# The features compared between difficult and all flights.
LIFT_FEATURES = (
    "ground_time_pressure",
    "total_bags",
    "transfer_ratio",
    "total_pax",
    "load_factor",
    "children",
    "lap_children",
    "stroller_users",
    "ssr_count",
    "is_international",
    "hot_transfer_count",
)


@dataclass(frozen=True)
class Settings:
    """Everything the operators take as a parameter, with the model's defaults."""

    weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    difficult: float = 0.25
    medium: float = 0.75
    destination_window: int = 7
    destination_min_flights: int = 5
    volatility_window: int = 5
    late_booking_days: int = 3
    widebody_seats: int = 250
    mobility_keywords: Sequence[str] = ("WCHR", "WCHS", "WCHC", "MOBILITY")
    special_keywords: Sequence[str] = ("PET", "UMNR", "MEDA", "STRETCHER")
    home_country: str = "US"
    key: Sequence[str] = FLIGHT_KEY
    ssr_mode: str = "locator"

    def __post_init__(self):
        if not self.weights:
            raise ValueError("weights must not be empty")
        if not 0 < self.difficult < self.medium < 1:
            raise ValueError("thresholds must satisfy 0 < difficult < medium < 1")
        if min(self.destination_window, self.volatility_window) < 1:
            raise ValueError("rolling windows must hold at least one row")

    @classmethod
    def from_mapping(cls, config: Mapping | None = None, **overrides) -> "Settings":
        """Read the nested configuration mapping (weights, thresholds, rolling, scalars, keyword lists)."""
        config = dict(config or {})
        thresholds = config.get("thresholds") or {}
        rolling = config.get("rolling") or {}
        found = {
            "weights": config.get("weights"),
            "difficult": thresholds.get("difficult"),
            "medium": thresholds.get("medium"),
            "destination_window": rolling.get("destination_base_window"),
            "destination_min_flights": rolling.get("destination_min_flights"),
            "volatility_window": rolling.get("volatility_window"),
            "late_booking_days": config.get("late_booking_days"),
            "widebody_seats": config.get("widebody_seat_threshold"),
            "mobility_keywords": config.get("mobility_ssr_keywords"),
            "special_keywords": config.get("special_handling_ssr_keywords"),
        }
        known = {name: value for name, value in found.items() if value is not None}
        return cls(**{**known, **overrides})

    def extended_weights(self, extra: Mapping[str, float] | None) -> dict[str, float]:
        """This object's weights updated with others, as the stand-alone scoring job does."""
        return {**self.weights, **(extra or {})}


def normalise_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """Divide by the total over all keys unless the total is already 1."""
    total = sum(weights.values())
    if math.isclose(total, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        return dict(weights)
    return {name: value / total for name, value in weights.items()}


def usable_features(weights: Mapping[str, float], columns: Sequence[str]) -> list[str]:
    """Weighted features that the table has, in the order of the weights."""
    present = set(columns)
    return [name for name in weights if name in present]
