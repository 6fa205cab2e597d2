"""What the study searches and draws; thresholds of single operators are their arguments' defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    max_lag_days: float = 120.0
    bootstrap_draws: int = 10_000
    bootstrap_seed: int = 123
    alpha: float = 0.05
    # from, to and number of the values that the decay fits try
    decay_rates: tuple[float, float, int] = (0.1, 2.0, 100)
    end_levels: tuple[float, float, int] = (0.7, 1.0, 40)
    log_end_levels: tuple[float, float, int] = (0.6, 1.2, 61)
