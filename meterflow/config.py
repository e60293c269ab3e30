"""Rules of the telemetry pipeline, as one immutable record."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, replace
from pathlib import Path


@dataclass(frozen=True)
class Rules:
    # fixed values: limits, hours and widths that the results depend on
    timezone: str = "Europe/Berlin"
    gap_s: int = 300
    late_s: int = 300
    max_power_kw: float = 20.0
    spike_ratio: float = 3.0
    spike_min_kw: float = 2.0
    new_meter_kwh: float = 5.0
    long_run_h: float = 2.6
    peak_weekdays: tuple[int, ...] = (1, 2, 3, 4, 5)
    peak_from_hour: int = 7
    peak_to_hour: int = 20
    bucket_s: int = 900
    context_minutes: int = 30

    def __post_init__(self) -> None:
        if not 0 <= self.peak_from_hour <= self.peak_to_hour <= 24:
            raise ValueError("peak hours must lie within a day and be in order")
        if not set(self.peak_weekdays) <= set(range(1, 8)):
            raise ValueError("weekdays are ISO numbers 1 to 7")
        for name in ("gap_s", "late_s", "max_power_kw", "spike_ratio", "bucket_s"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    @classmethod
    def of(cls, settings: dict) -> Rules:
        """Rules from a flat mapping; unknown keys are errors."""
        return replace(cls(), **settings)

    @classmethod
    def from_file(cls, path: str) -> Rules:
        """Rules from a TOML or JSON file of the same keys; lists stand for tuples."""
        text = Path(path).read_text()
        settings = json.loads(text) if path.endswith(".json") else tomllib.loads(text)
        return cls.of({k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})
