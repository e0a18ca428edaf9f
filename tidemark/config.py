"""Explicit settings of the operators: weights, windows and thresholds. Nothing reads a clock or a hidden default."""

from __future__ import annotations

from dataclasses import dataclass

METRICS = ("likes", "comments", "shares", "saves", "views")


@dataclass(frozen=True)
class Weights:
    """What one interaction of each kind counts."""

    likes: float = 1.0
    comments: float = 2.0
    shares: float = 10.0
    saves: float = 5.0
    views: float = 3.0

    def of(self, metric: str) -> float:
        return getattr(self, metric)

    @property
    def total(self) -> float:
        return sum(self.of(m) for m in METRICS)


# The weightings in use and the named templates.
RPI = Weights(1.0, 2.0, 10.0, 5.0, 0.01)
SCORE = Weights(1.0, 3.0, 4.0, 5.0, 0.0)
INGEST = Weights(1.0, 2.0, 4.0, 3.0, 0.0)
KPI = Weights(1.0, 2.0, 10.0, 5.0, 3.0)
EVALUATION = Weights(1.0, 2.0, 10.0, 5.0, 0.5)
TEMPLATES = {
    "brand_awareness": Weights(5.0, 2.0, 4.0, 2.0, 8.0),
    "leads_conversions": Weights(1.0, 3.0, 10.0, 12.0, 2.0),
    "community": Weights(2.0, 10.0, 5.0, 4.0, 3.0),
    "viral": Weights(2.0, 3.0, 15.0, 4.0, 6.0),
    "balanced": Weights(4.0, 4.0, 4.0, 4.0, 4.0),
}


@dataclass(frozen=True)
class Normalisation:
    """The relative performance index: history window, least history, and the range of the raw index."""

    window: int = 20
    least: int = 5
    least_niche: int = 10
    lowest: float = 0.01
    highest: float = 100.0
    default_baseline: float = 100.0
    strategy: str = "median"


@dataclass(frozen=True)
class Sampling:
    top: int = 25
    bottom: int = 5
    least_posts: int = 20
