"""Thresholds and instants in one place; each can be overridden by an environment variable ``SKEIN_<NAME>``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Prior credibility of each class of source (fixed values).
CREDIBILITY = {"regulator": 1.00, "filing": 0.92, "whistleblower": 0.70, "major_news": 0.60, "analyst": 0.50, "community": 0.20, "anon": 0.10}


@dataclass(frozen=True)
class Settings:
    trusted: float = 0.50
    block_min: float = 80.0
    accept: float = 0.92
    margin: float = 0.10
    near_dup: float = 0.80
    story_overlap: float = 0.40
    story_shared: int = 8
    adjacent_overlap: float = 0.75
    diverse_overlap: float = 0.60
    stance_skew: float = 0.20
    alpha: float = 0.85
    tolerance: float = 1e-10
    most_iterations: int = 300
    half_life_days: float = 10.0
    undated_weight: float = 0.3
    window: int = 90
    as_of: str = "2026-06-29T00:00:00"

    @classmethod
    def from_env(cls) -> Settings:
        """Defaults, with ``SKEIN_ALPHA`` and the like where they are set."""
        return cls(**{f.name: type(f.default)(os.environ[k]) for f in fields(cls) if (k := f"SKEIN_{f.name.upper()}") in os.environ})


DEFAULTS = Settings()
