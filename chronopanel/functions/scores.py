"""Banded severity scores as generated CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score of (low, high) bands with both ends included; what lies between bands scores 0.
EARLY_WARNING = {
    "respiratory_rate": [(None, 8, 3), (9, 11, 1), (12, 20, 0), (21, 24, 2), (25, None, 3)],
    "spo2": [(None, 91, 3), (92, 93, 2), (94, 95, 1), (96, None, 0)],
    "systolic": [(None, 90, 3), (91, 100, 2), (101, 110, 1), (111, 219, 0), (220, None, 3)],
    "heart_rate": [(None, 40, 3), (41, 50, 1), (51, 90, 0), (91, 110, 1), (111, 130, 2), (131, None, 3)],
    "temperature": [(None, 35.0, 3), (35.1, 36.0, 1), (36.1, 38.0, 0), (38.1, 39.0, 1), (39.1, None, 2)],
}


def steps(x: Column, rules: list[tuple[Column, int]]) -> Column:
    """The highest score whose rule holds; 0 if none does, null for null."""
    out = F.lit(0)
    for holds, score in sorted(rules, key=lambda r: r[1]):
        out = F.when(holds, F.lit(score)).otherwise(out)
    return F.when(x.isNotNull(), out)


def respiration(ratio: Column, ventilated: Column) -> Column:
    with_vent = F.coalesce(ventilated, F.lit(0)) == 1
    return steps(ratio, [(ratio < 400, 1), (ratio < 300, 2), ((ratio < 200) & with_vent, 3), ((ratio < 100) & with_vent, 4)])


def platelets(x: Column) -> Column:
    return steps(x, [(x < limit, score) for limit, score in ((150, 1), (100, 2), (50, 3), (20, 4))])


def bilirubin(x: Column) -> Column:
    return steps(x, [(x >= limit, score) for limit, score in ((1.2, 1), (2.0, 2), (6.0, 3), (12.0, 4))])


def coma(x: Column) -> Column:
    return steps(x, [(x < 15, 1), (x <= 12, 2), (x <= 9, 3), (x < 6, 4)])


def creatinine(x: Column) -> Column:
    return steps(x, [(x >= limit, score) for limit, score in ((1.2, 1), (2.0, 2), (3.5, 3), (5.0, 4))])


def urine(x: Column) -> Column:
    return steps(x, [(x < 500, 3), (x < 200, 4)])


def renal(creat: Column, urine_24h: Column) -> Column:
    """The worse of the two that are present."""
    return F.greatest(creatinine(creat), urine(urine_24h))


def cardiovascular(pressure: Column, dopamine: Column, dobutamine: Column, epinephrine: Column, norepinephrine: Column) -> Column:
    """Present if the pressure or any drug is; an absent drug counts as none."""
    dopa, dobu, epi, nor = (F.coalesce(c, F.lit(0.0)) for c in (dopamine, dobutamine, epinephrine, norepinephrine))
    rules = [
        (F.coalesce(pressure < 70, F.lit(False)), 1),
        (((dopa > 0) & (dopa <= 5)) | (dobu > 0), 2),
        (((dopa > 5) & (dopa <= 15)) | ((epi > 0) & (epi <= 0.1)) | ((nor > 0) & (nor <= 0.1)), 3),
        ((dopa > 15) | (epi > 0.1) | (nor > 0.1), 4),
    ]
    return steps(F.coalesce(pressure, dopamine, dobutamine, epinephrine, norepinephrine), rules)


def in_bands(x: Column, bands: list[tuple[float | None, float | None, int]]) -> Column:
    """Score of the first band that holds x; null, and values between bands, score 0."""
    out = F.lit(0)
    for low, high, score in reversed(bands):
        holds = (x >= low if low is not None else F.lit(True)) & (x <= high if high is not None else F.lit(True))
        out = F.when(F.coalesce(holds, F.lit(False)) & x.isNotNull(), F.lit(score)).otherwise(out)
    return out


def early_warning(vitals: dict[str, Column], oxygen_percent: Column, coma_total: Column) -> Column:
    """Sum of vital bands, 2 for supplemental oxygen and 3 for altered consciousness."""
    total = sum((in_bands(vitals[name], bands) for name, bands in EARLY_WARNING.items() if name in vitals), F.lit(0))
    oxygen = F.when(F.coalesce(oxygen_percent > 21, F.lit(False)), 2).otherwise(0)
    awake = F.when(F.coalesce(coma_total < 15, F.lit(False)), 3).otherwise(0)
    return total + oxygen + awake
