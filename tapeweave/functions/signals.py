"""Signals, scores and multipliers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def step_lookup(score: Column | str, steps: dict[int, float]) -> Column:
    """The value of the largest key at or below ``score``; below all keys that
    of the smallest; 1 without steps."""
    if not steps:
        return F.lit(1.0)
    out = F.lit(float(steps[min(steps)]))
    for key in sorted(steps):
        out = F.when(_col(score) >= key, F.lit(float(steps[key]))).otherwise(out)
    return out


def learned_multiplier(probability: Column | str, reference: Column | float, least: float = 0.5, most: float = 2.0, sensitivity: float = 12.0) -> Column:
    """``1 + sensitivity * (probability - reference)`` within bounds."""
    ref = reference if isinstance(reference, Column) else F.lit(reference)
    raw = 1 + F.lit(sensitivity) * (_col(probability) - ref)
    return F.when(raw.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(least), raw)))


def oriented_funding(rate: Column | str, direction: Column | str) -> Column:
    """Positive where funding pays the position; null stays null."""
    return -_col(rate) * _col(direction)


def extreme(value: Column | str, direction: Column | str, low: float = 20.0, high: float = 80.0) -> Column:
    """Oscillator low for a long, high for a short; false while unknown."""
    return F.coalesce(F.when(_col(direction) > 0, _col(value) <= low).otherwise(_col(value) >= high), F.lit(False))


def phase_favours(phase: Column | str, direction: Column | str) -> Column:
    """The opposite move is losing strength."""
    return F.when(_col(direction) > 0, _col(phase) == "bearish_weak").otherwise(_col(phase) == "bullish_weak")


def with_regime(regime: Column | str, direction: Column | str) -> Column:
    r, d = _col(regime), _col(direction)
    return ((r == "bullish") & (d > 0)) | ((r == "bearish") & (d < 0))


def against_regime(regime: Column | str, direction: Column | str) -> Column:
    return with_regime(regime, -_col(direction))


def permitted(regime: Column | str, direction: Column | str, mode: str) -> Column:
    """The structure gate: ``none``, ``with`` or ``not_against``."""
    if mode == "none":
        return F.lit(True)
    return with_regime(regime, direction) if mode == "with" else ~against_regime(regime, direction)


def active_signals(min_impulse: float = 1.0, max_confluence: int = 2, low: float = 20.0, high: float = 80.0) -> dict[str, Column]:
    """The convergence signals, each over the columns ``impulse, divergence,
    regime, level, confluence, direction, stochastic, ttm_phase``."""
    d = F.col("direction")
    inside = ((F.col("level") == "vah") & (d < 0)) | ((F.col("level") == "val") & (d > 0))
    return {
        "impulse": F.coalesce(F.col("impulse") >= min_impulse, F.lit(False)),
        "divergence": ((F.col("divergence") == "bullish") & (d > 0)) | ((F.col("divergence") == "bearish") & (d < 0)),
        "rotation": ~inside,
        "counter_structure": ~with_regime("regime", d),
        "low_confluence": F.col("confluence") < max_confluence,
        "stochastic": extreme("stochastic", d, low, high),
        "ttm_phase": F.coalesce(F.endswith("ttm_phase", F.lit("strong")), F.lit(False)),
    }


#: Signals that always count, and those that count on request.
CORE = ("impulse", "divergence", "rotation", "counter_structure", "low_confluence")
OPTIONAL = ("stochastic", "ttm_phase")


def score(signals: dict[str, Column], optional: tuple[str, ...] = ()) -> Column:
    """How many signals count."""
    counted = [*CORE, *[o for o in optional if o in OPTIONAL]]
    total = F.lit(0)
    for name in counted:
        total = total + signals[name].cast("int")
    return total


def joined_names(signals: dict[str, Column]) -> Column:
    """Active signals as ``a+b+c``."""
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)).otherwise(F.lit("")) for n, c in signals.items()]), lambda x: x != ""), "+")


def last_target(reached: Column | str, *targets: str) -> Column:
    """The price of the last target reached, null if none was."""
    return F.when(_col(reached) > 0, F.try_element_at(F.array(*targets), F.greatest(_col(reached), F.lit(1)).cast("int")))


def opacity(quality: Column | str, least: float = 0.25, most: float = 0.9) -> Column:
    """Quality from 0 to 1 as an opacity between two bounds."""
    return F.lit(least) + (F.lit(most) - F.lit(least)) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), _col(quality)))
