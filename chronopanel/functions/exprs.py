"""Scalar expressions. All are Columns made of built-in functions, so they stay in whole-stage code."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inclusive plausible ranges by feature.
PLAUSIBLE = {
    "heart_rate": (20.0, 300.0),
    "respiratory_rate": (1.0, 80.0),
    "spo2": (50.0, 100.0),
    "sbp_arterial": (40.0, 300.0),
    "sbp_noninvasive": (40.0, 300.0),
    "dbp_arterial": (20.0, 200.0),
    "dbp_noninvasive": (20.0, 200.0),
    "map_arterial": (20.0, 250.0),
    "map_noninvasive": (20.0, 250.0),
    "map": (20.0, 250.0),
    "temperature_c": (25.0, 45.0),
    "fio2": (0.21, 1.0),
    "gcs_eye": (1.0, 4.0),
    "gcs_verbal": (1.0, 5.0),
    "gcs_motor": (1.0, 6.0),
    "gcs_total": (3.0, 15.0),
    "mechanical_vent": (0.0, 1.0),
    "lactate": (0.0, 30.0),
    "pao2": (20.0, 800.0),
    "bilirubin": (0.0, 80.0),
    "creatinine": (0.1, 30.0),
    "platelets": (1.0, 2000.0),
    "dopamine": (0.0, 100.0),
    "dobutamine": (0.0, 100.0),
    "epinephrine": (0.0, 10.0),
    "norepinephrine": (0.0, 10.0),
}
# Units of infusion rates as (spellings, multiplier, divisor, per kilogram already), weak rules first.
DOSE_UNITS = [
    (("mcg/kg/min",), 1.0, 1.0, True),
    (("mg/kg/min",), 1000.0, 1.0, True),
    (("mcg/kg/hour", "mcg/kg/hr"), 1.0, 60.0, True),
    (("mg/kg/hour", "mg/kg/hr"), 1000.0, 60.0, True),
    (("mcg/min",), 1.0, 1.0, False),
    (("mg/min",), 1000.0, 1.0, False),
    (("mcg/hour", "mcg/hr"), 1.0, 60.0, False),
    (("mg/hour", "mg/hr"), 1000.0, 60.0, False),
]
# Units that names of drugs give in brackets.
NAMED_UNITS = ("mcg/kg/min", "mg/kg/min", "mcg/kg/hr", "mcg/min", "mg/min", "mcg/hr", "mg/hr")
PRESSORS = ("dopamine", "dobutamine", "epinephrine", "norepinephrine")
# Labels of urine output, and what excludes a label.
URINE_EQUAL = ("urine", "voided amount", "indwelling catheter output", "condom catheter output", "or urine")
URINE_WITHIN = (("urine output",), ("urinary catheter output",), ("urethral catheter", "output"), ("nephrostomy", "output"))
URINE_FIRST = ("output amt-urinary catheter", "foley")
URINE_NOT = "count|occurrence|incontinence|unmeasured|number of|24 hr|total|variance|color|appearance"
# Groups by whole words, the first group that has one.
RACES = [("White", "WHITE|CAUCASIAN"), ("Black", "BLACK|AFRICAN"), ("Asian", "ASIAN"), ("Hispanic/Latino", "HISPANIC|LATINO")]
# Texts that say that no ventilator is in use.
VENTILATOR_OFF = ("", "none", "off", "standby", "not applicable", "other/remarks")


def as_number(c: str | Column) -> Column:
    """Number, or null for text that isn't one and for non-finite values."""
    return finite((F.col(c) if isinstance(c, str) else c).try_cast("double"))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def elapsed_hours(start: Column, end: Column) -> Column:
    """Whole hours from start to end, rounded down also before the start."""
    return F.floor(F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)).cast("long")


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32) * (F.lit(5.0) / F.lit(9.0))


def fio2_fraction(x: Column) -> Column:
    """Fraction of inspired oxygen; values that are neither a fraction from 0.21 nor a percentage are null."""
    return F.when(x.between(0.21, 1.0), x).when((x > 1) & (x <= 100), x / 100)


def fio2_percent(x: Column) -> Column:
    return F.when((x > 0) & (x <= 1), x * 100).otherwise(x)


def ventilated(text: Column) -> Column:
    return (~F.coalesce(F.trim(F.lower(text)), F.lit("")).isin(*VENTILATOR_OFF)).cast("int")


def plausible(value: Column, feature: Column, ranges: Mapping[str, tuple[float, float]] = PLAUSIBLE) -> Column:
    """Null outside the feature's range; features without a range pass."""
    out = value
    for name, (low, high) in ranges.items():
        out = F.when((feature == name) & ~value.between(low, high), F.lit(None)).otherwise(out)
    return out


def dose_per_kg_minute(rate: Column, unit: Column, weight: Column) -> Column:
    """Dose in micrograms per kilogram and minute from any text that holds a unit.

    Later units overwrite earlier ones; those not per kilogram need a weight; without a known unit the dose is null. A
    text that holds a unit per kilogram and minute has none per minute alone.
    """
    u = F.lower(F.coalesce(unit, F.lit("")))
    rules = []
    for spellings, times, over, per_kg in DOSE_UNITS:
        holds = contains_any(u, spellings)
        if spellings in (("mcg/min",), ("mg/min",)):
            holds = holds & ~u.contains(spellings[0].replace("/", "/kg/"))
        rules.append((holds if per_kg else holds & (weight > 0), rate * times / (F.lit(1.0) if per_kg else weight) / over))
    return last_match(rules)


def named_dose(name: Column, rate: Column, weight: Column, lightest: float = 20.0, heaviest: float = 400.0) -> Column:
    """The same dose where the unit stands in brackets in the drug's name; only plausible weights count."""
    n = F.lower(name)
    known = {spelling: unit[1:] for unit in DOSE_UNITS for spelling in unit[0]}
    rules = []
    for u in NAMED_UNITS:
        times, over, per_kg = known[u]
        holds = n.contains(f"({u})")
        rules.append((holds if per_kg else holds & weight.between(lightest, heaviest), rate * times / over / (F.lit(1.0) if per_kg else weight)))
    return last_match(rules)


def pressor(name: Column) -> Column:
    """The drug that a name begins with."""
    n = F.lower(F.trim(name))
    return first_match([(n.startswith(d), d) for d in PRESSORS], None)


def urine_label(label: Column) -> Column:
    """Whether a free-text label is urine output: equal to, holding or beginning with known ones, and not excluded."""
    t = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    within = [reduce(lambda a, b: a & b, [t.contains(w) for w in words]) for words in URINE_WITHIN]
    include = reduce(lambda a, b: a | b, [t.isin(*URINE_EQUAL), *within, *[t.startswith(w) for w in URINE_FIRST]])
    return include & ~t.rlike(URINE_NOT)


def race_group(text: Column) -> Column:
    """Group by whole words, the first that has one."""
    t = F.upper(F.coalesce(text, F.lit("Unknown")))
    return first_match([(t.rlike(rf"\b({words})\b"), name) for name, words in RACES], "Other/Unknown")


def offset_hour(minutes: Column, last_minute: Column) -> Column:
    """Hour of an offset in minutes; null outside the stay."""
    return F.when((minutes >= 0) & (minutes <= last_minute), F.floor(minutes / 60).cast("long"))


def alias_name(text: Column, aliases: Iterable[tuple[str, str]]) -> Column:
    """Display name by the first alias that a text holds; else the text itself."""
    t = F.lower(text)
    return reduce(lambda out, a: F.when(t.contains(a[0]), F.lit(a[1])).otherwise(out), reversed(list(aliases)), text)


def default_by_name(column: str, defaults: Mapping[str, float]) -> float:
    """The value that fills what is never observed: 1 for missingness, 0 for recency and changes, else the feature's."""
    if column.endswith("_is_missing"):
        return 1.0
    if "time_since_last" in column or column.endswith(("_std", "_change", "_slope", "_delta")):
        return 0.0
    return next((float(v) for k, v in defaults.items() if column == k or column.startswith(f"{k}_")), 0.0)


def window_list(hours: Iterable[int]) -> list[int]:
    """Windows in ascending order; they must be positive and differ."""
    out = list(hours)
    if not out or min(out) <= 0 or len(set(out)) < len(out):
        raise ValueError(f"windows must be positive and differ: {out}")
    return sorted(out)


def columns_for_window(columns: Iterable[str], features: Iterable[str], hours: int) -> list[str]:
    """Static and temporal columns of one window, by feature, then by name."""
    names = sorted(columns)
    return [c for f in features for c in names if c == f or (c.startswith(f"{f}_w{hours}h_") or c in (f"{f}_is_missing", f"{f}_time_since_last"))]


def last_match(rules: Iterable[tuple[Column, Column]]) -> Column:
    """The value of the last rule that holds; null if none does."""
    return reduce(lambda out, rule: F.when(rule[0], rule[1]).otherwise(out), rules, F.lit(None))


def first_match(rules: Iterable[tuple[Column, str]], default: str | None) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda out, rule: F.when(rule[0], F.lit(rule[1])).otherwise(out), reversed(list(rules)), F.lit(default))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


# Words of care units in their order, and what each is called.
CARE_UNITS = (
    ("Neuro", ("NEURO",)),
    ("Cardiac", ("CARDIAC", "CORONARY", "CVICU", "CCU")),
    ("Surgical/Trauma", ("SURG", "TRAUMA", "PACU")),
    ("Medical/Mixed", ("MEDICAL", "MEDICINE", "MICU")),
)


def care_unit(text: Column) -> Column:
    """Kind of care unit, the first whose words the text holds."""
    t = F.upper(F.coalesce(text, F.lit("")))
    return first_match([(contains_any(t, words), name) for name, words in CARE_UNITS], "Other")


def status_kept(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit(""))).rlike("rewritten|cancelled|canceled|paused|stopped")


def age_years(text: Column) -> Column:
    """Age as a number; ages written as over 89 are 90."""
    return F.when(F.trim(text) == "> 89", F.lit(90.0)).otherwise(as_number(text))


def null_strict_sum(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols)


def present_count(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])


def filled_sum(*cols: Column, least: int = 0) -> Column:
    """Sum with nulls as 0; null itself if fewer than ``least`` are present."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in cols])
    return F.when(present_count(*cols) >= least, total) if least else total


def guarded_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null, which greatest and least alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def abnormal(x: Column, low: float | None, high: float | None) -> Column:
    """Outside its limits; null and features without limits are not."""
    tests = ([x < low] if low is not None else []) + ([x > high] if high is not None else [])
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def right_closed_band(x: Column, edges: list[float], names: list[str], unknown: str = "Unknown") -> Column:
    """Band (edges[i], edges[i+1]] with open ends at infinity; values below the first edge and null are unknown."""
    out = F.lit(unknown)
    for low, high, name in reversed(list(zip(edges, [*edges[1:], float("inf")], names, strict=True))):
        out = F.when((x > low) & (x <= high), F.lit(name)).otherwise(out)
    return out


def hash_unit(*parts: Column) -> Column:
    """A reproducible number in [0, 2^32) from the parts' texts, the same in any engine that has MD5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def rounded(df, digits: int = 6):
    """Round every double column: sums in another order differ in their last bits."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def below(borders: Column, value: Column, most: int) -> Column:
    """How many of an ascending array's entries, at most ``most``, are less than the value: found by halving. Null for a null
    value."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    step = lambda n, k: n + F.when(F.get(borders, n + k - 1) < value, k).otherwise(0)
    return F.when(value.isNotNull(), F.aggregate(halves, F.lit(0), step))
