"""Settings, with the checks that keep them meaningful."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    lookback_days: int = 7
    label_lag_days: int = 3
    min_degree: int = 2
    max_degree: int = 200
    component_fraction: float = 0.5
    component_cap: int = 300
    small_amount: float = 5.0
    smoothing: float = 20.0
    train_share: float = 0.6
    val_share: float = 0.8
    embargo_seconds: int = 86400
    usd_inr: float = 83.0
    velocity_windows: tuple[int, ...] = (3600, 86400)

    def __post_init__(self) -> None:
        if self.lookback_days <= self.label_lag_days:
            raise ValueError("lookback_days must exceed label_lag_days, or component fraud rates are constant")
        if not 1 <= self.min_degree <= self.max_degree:
            raise ValueError("min_degree must be in 1..max_degree")


@dataclass(frozen=True)
class Costs:
    """Costs of a decision, as shares of the amount or in INR."""

    chargeback_fee: float = 1500.0
    false_block: float = 0.15
    block_friction: float = 200.0
    review: float = 250.0
    review_recall: float = 0.85
    daily_capacity: int = 50
    default_fx: float = 83.0
