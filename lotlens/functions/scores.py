"""Quality and availability scores of buildings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def banded(value: Column, bands: Sequence[tuple[float, int]], otherwise: int = 0, *, under: bool = False) -> Column:
    """Points of the first band: `value >= edge` from the top, or with `under` the first `value < edge`."""
    out = F.when(F.lit(False), 0)
    for edge, points in bands:
        out = out.when(value < edge if under else value >= edge, points)
    return out.otherwise(otherwise)


# Points of the quality score, at most 100 in all.
AREA_BANDS = ((2000, 25), (1500, 22), (1200, 18), (1000, 15), (800, 10), (600, 5))
COMPLAINT_BANDS = ((1, 22), (3, 18), (5, 12), (10, 5))
NOISE_BANDS = ((0.5, 10), (1, 5))
# Weights of the availability signals.
PERMIT_BANDS = ((200_000, "permit over 200k", 17.7), (50_000, "permit 50k to 200k", 10.2))
WEIGHTS = {
    "small permit": 10.5, "alteration": 16.4, "permit": 8.0, "tenant action": 8.3, "litigation": 6.4, "heavy distress": 7.9, "distress": 7.6,
    "eviction": 6.3, "unpaid fines": 5.0, "agreement": 4.1, "satisfaction": 3.0, "owner changed": 3.3,
}


def quality_parts(area: Column, units: Column, complaints: Column, recent: Column, noise: Column, year: Column, floors: Column, stabilized: Column) -> dict[str, Column]:
    """The six components. Counts are per unit; missing figures count as 0."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    rate = lambda c: F.coalesce(F.try_divide(zero(c), units.cast("double")), F.lit(0.0))
    area, year = zero(area), zero(year)
    is_stable = F.coalesce(stabilized, F.lit(False))
    return {
        "size": banded(area, AREA_BANDS),
        "care": F.when(rate(complaints) == 0, 25).otherwise(banded(rate(complaints), COMPLAINT_BANDS, under=True)) + F.when(rate(recent) == 0, 5).otherwise(0),
        "quiet": F.when(rate(noise) == 0, 15).otherwise(banded(rate(noise), NOISE_BANDS, under=True)),
        "age": F.when(year.between(1880, 1945), 8).when(year >= 2015, 6).otherwise(0),
        "form": F.when(units.between(6, 30), 4).otherwise(0) + F.when(zero(floors) >= 6, 3).otherwise(0),
        "value": F.when(is_stable, 10 + F.when(area >= 1000, 5).otherwise(0)).otherwise(0),
    }


def quality_score(**facts: Column) -> Column:
    return F.least(F.lit(100), sum(quality_parts(**facts).values(), F.lit(0))).cast("int")


def quality_reasons(**facts: Column) -> Column:
    """Names of the components that gave points."""
    return F.array_compact(F.array(*[F.when(points > 0, F.lit(name)) for name, points in quality_parts(**facts).items()]))


def _signal(name: str, weight: float, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(weight).cast("double").alias("weight"), detail.cast("string").alias("detail"))


def availability_signals(permits: Column, permit_cost: Column, alteration: Column, cases: Column, tenant_action: Column, distress: Column, units: Column, evictions: Column, unpaid: Column, agreements: Column, satisfactions: Column, owner_changed: Column) -> Column:
    """Array of (name, weight, detail), one for each category that fires."""
    w = WEIGHTS
    zero = lambda c: F.coalesce(c, F.lit(0))
    per = F.coalesce(F.try_divide(zero(distress).cast("double"), units.cast("double")), F.lit(0.0))
    cost = zero(permit_cost)
    permit = F.when(zero(permits) == 0, None)
    for edge, name, weight in PERMIT_BANDS:
        permit = permit.when(cost >= edge, _signal(name, weight, permit_cost))
    permit = permit.when((cost > 0) & (cost < 10_000), _signal("small permit", w["small permit"], permit_cost)).when(alteration, _signal("alteration", w["alteration"], permits)).otherwise(_signal("permit", w["permit"], permits))
    fired = [
        permit,
        F.when(zero(cases) > 0, F.when(F.coalesce(tenant_action, F.lit(False)), _signal("tenant action", w["tenant action"], cases)).otherwise(_signal("litigation", w["litigation"], cases))),
        F.when((zero(distress) >= 5) & (per >= 0.1), _signal("heavy distress", w["heavy distress"], distress)).when((zero(distress) >= 3) & (per >= 0.05), _signal("distress", w["distress"], distress)),
        F.when(zero(evictions) > 0, _signal("eviction", w["eviction"], evictions)),
        F.when(zero(unpaid) > 0, _signal("unpaid fines", w["unpaid fines"], unpaid)),
        F.when(zero(agreements) > 0, _signal("agreement", w["agreement"], agreements)),
        F.when(zero(satisfactions) > 0, _signal("satisfaction", w["satisfaction"], satisfactions)),
        F.when(F.coalesce(owner_changed, F.lit(False)), _signal("owner changed", w["owner changed"], F.lit("names differ"))),
    ]
    return F.array_compact(F.array(*fired))


def convergence(count: Column) -> Column:
    return F.when(count >= 3, "strong").when(count == 2, "moderate").when(count == 1, "single").otherwise("none")


def top_weight(signals: Column, k: int = 3) -> Column:
    """Sum of the k largest weights."""
    largest = F.slice(F.sort_array(F.transform(signals, lambda s: s["weight"]), asc=False), 1, k)
    return F.aggregate(largest, F.lit(0.0), lambda a, x: a + x)


def availability_score(signals: Column) -> Column:
    """Top three weights, raised where signals converge, as a half-even percentage of 50, at most 100."""
    n = F.size(signals)
    raised = F.when(n >= 3, 1.5).when(n == 2, 1.2).otherwise(1.0)
    return F.least(F.lit(100), F.bround(top_weight(signals) * raised / 50 * 100)).cast("int")


def turnover_percent(traded: Column, units: Column) -> Column:
    return F.coalesce(F.bround(F.try_divide(100.0 * traded, units.cast("double")), 1), F.lit(0.0))
