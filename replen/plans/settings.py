"""Thresholds and weights; fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import md5


@dataclass(frozen=True)
class Settings:
    lead_time: float = 1.36
    forecast_time: int = 5
    cv_basic: float = 0.6
    cv_seasonal: float = 1.0
    new_days: int = 365
    z_basic: float = 2.5
    z_regular: float = 1.645
    z_seasonal_in: float = 1.85
    z_seasonal_out: float = 1.5
    z_new: float = 1.8
    in_season: float = 1.2
    recent_days: int = 730
    risk_out: float = 100.0
    risk_below: float = 80.0
    weight_risk: float = 0.5
    weight_revenue: float = 0.3
    weight_demand: float = 0.2
    demand_cap: float = 100.0
    multipliers: dict[str, float] = field(default_factory=lambda: {"new": 1.2, "seasonal": 1.3, "regular": 1.0, "basic": 0.9})
    bestseller: float = 300.0
    overstock: float = 20.0
    delivery_days: int = 42
    lookback_days: int = 60
    min_order: int = 5

    def digest(self) -> str:
        """Identifies results that these settings gave."""
        return md5(repr(self).encode()).hexdigest()
