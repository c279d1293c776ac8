"""Heart-rate zones and training load as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceforge.constants import ZONE_CAP, ZONE_COEFFICIENTS, ZONE_SHARES


DEFAULT_MODEL = "karvonen_hrr"


def karvonen(hr_max: int, hr_rest: int) -> list[int]:
    """Zone limits for plain numbers; raises if there is no reserve."""
    if hr_max <= hr_rest:
        raise ValueError("maximum heart rate must exceed resting heart rate")
    return [round(hr_rest + p * (hr_max - hr_rest)) for p in ZONE_SHARES] + [ZONE_CAP]


def _of_reserve(hr_max: Column, hr_rest: int) -> list[Column]:
    """Shares of the reserve above the resting rate."""
    reserve = F.when(hr_max > hr_rest, (hr_max - hr_rest).cast("double"))
    return [F.bround(hr_rest + F.lit(p) * reserve, 0).cast("long") for p in ZONE_SHARES]


def _of_maximum(hr_max: Column, hr_rest: int) -> list[Column]:
    """Shares of the maximum, whatever the resting rate."""
    top = F.when(hr_max > hr_rest, hr_max.cast("double"))
    return [F.bround(F.lit(p) * top, 0).cast("long") for p in ZONE_SHARES]


#: Zone models: (highest rate, resting rate) to five rising limits, null where the highest is not above the resting rate.
ZONE_MODELS: dict[str, Callable[[Column, int], list[Column]]] = {DEFAULT_MODEL: _of_reserve, "max_share": _of_maximum}


def register_zone_model(name: str, limits: Callable[[Column, int], list[Column]]) -> None:
    """A model of one's own; facts, days and loads then take its name."""
    if name in ZONE_MODELS:
        raise ValueError(f"zone model {name} exists")
    ZONE_MODELS[name] = limits


def zone_bounds(hr_max: Column, hr_rest: int, model: str = DEFAULT_MODEL) -> list[Column]:
    """Zone limits of a model as columns."""
    if model not in ZONE_MODELS:
        raise ValueError(f"unknown zone model: {model}")
    return ZONE_MODELS[model](hr_max, hr_rest)


def band_counts(hr: Column, bounds: Sequence[Column | int]) -> list[Column]:
    """Sample counts of the six bands that five limits make."""
    limits = [b if isinstance(b, Column) else F.lit(b) for b in bounds[:5]]
    tests = [hr < limits[0]]
    tests += [(hr >= a) & (hr < b) for a, b in zip(limits, limits[1:])]
    tests.append(hr >= limits[-1])
    return [F.count_if(t) for t in tests]


def banded_rates(rates: Column, bounds: Sequence[Column | int]) -> list[Column]:
    """band_counts() of an activity's map rate -> seconds: the samples themselves are not needed."""
    limits = [b if isinstance(b, Column) else F.lit(b) for b in bounds[:5]]
    edges = [None, *limits, None]

    def inside(low: Column | None, high: Column | None):
        if low is None:
            return lambda rate, n: rate < high
        return lambda rate, n: (rate >= low) & (rate < high) if high is not None else rate >= low

    none = F.lit(0).cast("long")
    add = lambda total, n: total + n
    return [F.aggregate(F.map_values(F.map_filter(rates, inside(a, b))), none, add) for a, b in zip(edges, edges[1:])]


def banded_load(bands: Sequence[Column]) -> Column:
    """Load points of the six bands' seconds."""
    total = F.lit(0.0)
    for count, coefficient in zip(bands, ZONE_COEFFICIENTS):
        total = total + count * F.lit(coefficient)
    return total


def zone_seconds(hr: Column, bounds: Sequence[Column | int]) -> dict[str, Column]:
    """The five reported zones.  The band below the last limit earns load and lies in no zone."""
    bands = band_counts(hr, bounds)
    return {f"zone{k + 1}_seconds": bands[b] for k, b in enumerate((0, 1, 2, 3, 5))}


def load_points(hr: Column, bounds: Sequence[Column | int]) -> Column:
    """Seconds in each band times its coefficient: multiples of a half, so sums are exact in any order."""
    return banded_load(band_counts(hr, bounds))


def load_of(points: Column) -> Column:
    """Load points to training load, one decimal."""
    return F.bround(points / F.lit(60.0), 1)
