"""Typed settings; defaults are the active parameters of the strategy."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class RangeWindow:
    """One detection window: its length in bars and the kind of its ranges."""

    bars: int
    kind: str


@dataclass(frozen=True)
class RangeConfig:
    """Sideways-range detection."""

    windows: tuple[RangeWindow, ...] = (
        RangeWindow(40, "secondary"), RangeWindow(60, "secondary"), RangeWindow(150, "primary"), RangeWindow(250, "primary"), RangeWindow(400, "primary"),
    )
    min_duration_fraction: float = 0.66
    touch_gap_fraction: float = 0.10
    pivot_bars: int = 3
    max_height_atr: float = 8.0
    height_calibrated_on: int = 60
    max_height_pct: float = 1.20
    max_r2: float = 0.3
    max_drift: float = 0.5
    min_containment: float = 0.85
    min_crossings: int = 7
    closes_outside: int = 5
    min_touches: int = 2
    band_atr: float = 1.5
    atr_period: int = 14
    edge_band: float = 0.20
    min_occupancy: float = 0.0
    min_trips: float = 1.0
    free_height_pct: float = 0.30
    pct_per_trip: float = 0.10
    edge_fraction: float = 0.10
    min_edge_bars: int = 20
    min_quality: dict[str, float] = field(default_factory=lambda: {"primary": 0.40, "secondary": 0.70})
    max_overlap: float = 0.10

    def __post_init__(self):
        if not self.windows:
            raise ValueError("at least one window is needed")
        if bad := [w for w in self.windows if w.kind not in self.min_quality]:
            raise ValueError(f"no quality floor for {bad}")

    def height_cap(self, bars: int) -> float:
        return self.max_height_atr * math.sqrt(bars / self.height_calibrated_on)

    def touch_gap(self, bars: int) -> int:
        return max(1, round(bars * self.touch_gap_fraction))

    def edge_bars(self, bars: int) -> int:
        return max(self.min_edge_bars, round(bars * self.edge_fraction))


@dataclass(frozen=True)
class ProfileConfig:
    bins: int = 1000
    value_area: float = 0.70


@dataclass(frozen=True)
class BacktestConfig:
    """Level-touch simulation.  ``None`` turns a rule off."""

    kinds: tuple[str, ...] = ("primary",)
    selection: str = "global"
    min_level_distance: float = 0.005
    first_target_beyond_stop: bool = True
    stop_atr: float = 1.5
    atr_period: int = 14
    shares: tuple[float, ...] = (0.3333, 0.3333, 0.3334)
    break_even_after: int = 2
    fallback_pct: float = 0.05
    fallback_ladder: bool = True
    fallback_stop_is_atr: bool = True
    fallback_stop_pct: float = 0.02
    first_target_max_atr: float | None = 1.0
    first_target_max_pct: float | None = None
    max_target_distance: float | None = 0.05
    cap_from_entry: bool = False
    targets_in_r: tuple[float, ...] | None = None
    max_target_r: float | None = None
    max_positions: int | None = None
    min_impulse: float | None = 1.0
    impulse_bars: int = 6
    value_area_rotation: bool = False
    max_adx: float | None = 35.0
    avoid_squeeze: bool = True
    structure_mode: str = "none"
    min_note: float = 0.0
    cooldown: int = 6
    timeout_bars: int | None = None
    level_life: int | None = None
    maker_fee: float = 0.0002
    taker_fee: float = 0.0005
    slippage: float = 0.0005
    capital: float = 10_000.0
    sizing: str = "fixed_risk"
    risk_per_trade: float = 0.005
    min_rejection: float | None = None
    min_score: int | None = None
    size_steps: dict[int, float] = field(default_factory=lambda: {0: 0.5, 3: 1.0, 5: 2.0})
    max_confluence_signal: int = 2
    divergence_life: int = 12
    stochastic_low: float = 20.0
    stochastic_high: float = 80.0
    optional_signals: tuple[str, ...] = ("ttm_phase",)
    execution_per_decision: int = 4

    def __post_init__(self):
        if self.selection not in ("global", "causal"):
            raise ValueError(f"selection is global or causal, not {self.selection}")
        if self.structure_mode not in ("none", "with", "not_against"):
            raise ValueError(f"unknown structure mode {self.structure_mode}")


def from_yaml(path: str, kind: type):
    """Settings of ``kind`` from a YAML mapping; raises ``KeyError`` for a name
    it doesn't have and ``ValueError`` for a file that is no mapping."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = yaml.safe_load(f)
    if not isinstance(raw, dict):
        raise ValueError(f"{path} holds no mapping")
    known = {f.name for f in fields(kind)}
    if unknown := set(raw) - known:
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    if "windows" in raw and kind is RangeConfig:
        raw["windows"] = tuple(RangeWindow(**w) for w in raw["windows"])
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
