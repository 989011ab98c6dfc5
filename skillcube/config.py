"""Settings of a forecasting study, with the defaults of a global 5.625-degree weekly setup."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date, timedelta

PRECIPITATION = "total_precipitation_24hr"


@dataclass(frozen=True)
class Box:
    """Closed latitude and longitude range, in degrees."""

    lat_min: float = 5.0
    lat_max: float = 40.0
    lon_min: float = 65.0
    lon_max: float = 100.0


@dataclass(frozen=True)
class Splits:
    """Closed year ranges; the last `embargo_weeks` of each block but the last belong to none."""

    train: tuple[int, int] = (1979, 2012)
    val: tuple[int, int] = (2013, 2017)
    test: tuple[int, int] = (2018, 2023)
    embargo_weeks: int = 4

    def blocks(self) -> list[tuple[str, date, date]]:
        out = []
        for name in ("train", "val", "test"):
            lo, hi = getattr(self, name)
            end = date(hi, 12, 31)
            out.append((name, date(lo, 1, 1), end if name == "test" else end - timedelta(weeks=self.embargo_weeks)))
        return out


@dataclass(frozen=True)
class Event:
    """A yes-or-no event of a weekly mean: anomaly or physical space, beyond (gt) or below (lt) a threshold."""

    name: str
    variable: str
    space: str = "anomaly"
    comparison: str = "gt"
    threshold: float = 0.0


#: The calibration events, with thresholds of 40 degrees C in kelvin and of 50 mm a day in m.
EVENTS = (
    Event("t2m_anom_positive", "2m_temperature", "anomaly", "gt", 0.0),
    Event("precip_anom_positive", PRECIPITATION, "anomaly", "gt", 0.0),
    Event("extreme_heat_40C", "2m_temperature", "physical", "gt", 313.15),
    Event("heavy_rain_50mm", PRECIPITATION, "physical", "gt", 0.050),
)


@dataclass(frozen=True)
class Config:
    targets: tuple[str, ...] = ("2m_temperature", PRECIPITATION)
    surface_predictors: tuple[str, ...] = ("sea_surface_temperature",)
    level_predictors: tuple[tuple[str, tuple[int, ...]], ...] = (("geopotential", (500,)), ("u_component_of_wind", (850, 200)))
    dev_years: tuple[int, int] | None = None
    box: Box = field(default_factory=Box)
    splits: Splits = field(default_factory=Splits)
    lead_weeks: tuple[int, ...] = (1, 2, 3, 4, 5, 6)
    history_weeks: int = 2
    train_stride_days: int = 1
    climatology_smooth_days: int = 11
    woy_window: int = 3
    fair_crps: bool = True
    gate_leads: tuple[int, ...] = (3, 4)
    gate_metric: str = "crpss_vs_prob"
    gate_threshold: float = 0.0
    reliability_bins: int = 10
    events: tuple[Event, ...] = EVENTS
    members: int = 16
    member_source: str = "auto"
    noise_std: float = 0.1
    grid: tuple[int, int] = (32, 64)
    step_hours: int = 6

    @property
    def target_vars(self) -> tuple[str, ...]:
        return self.targets

    @property
    def predictor_vars(self) -> tuple[str, ...]:
        return self.surface_predictors + tuple(f"{v}_{level}" for v, levels in self.level_predictors for level in levels)

    @property
    def input_vars(self) -> tuple[str, ...]:
        """Targets first, then surface predictors, then levelled ones."""
        return self.target_vars + self.predictor_vars

    @property
    def channels(self) -> tuple[int, int]:
        """Input channels (with the season's) and output channels."""
        return self.history_weeks * len(self.input_vars) + 1, len(self.target_vars)

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)
