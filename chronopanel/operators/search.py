"""Search of parameters: batches of trials scored together, pruned by medians, proposed by density ratios.

A trial is a set of numbers, and its loss in a row an expression of columns and these. A batch's living trials are scored
in one aggregate a rung; rungs are growing shares of the rows by a hash of their key, the last one all rows. After each
rung but the last, a trial goes whose mean loss so far is above the median of all trials that came to that rung. Proposals
after the first batch follow the trials before: a mixture of normal densities around the better ones, over the same around
the rest, is the ratio of which the best of some draws is taken (a tree-structured Parzen estimator of independent
parameters). Chance comes from hashes of seed, trial and parameter, so a search is the same in any run. Only means of
losses reach the driver.
"""

from __future__ import annotations

import hashlib
import math
import statistics
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.exprs import hash_unit

#: Share of trials that count as better, draws of a proposal, least trials before proposals follow them, and every how
#: manieth trial is uniform all the same.
BETTER, DRAWS, LEAST, UNIFORM = 0.25, 4, 8, 8


@dataclass(frozen=True)
class Range:
    """A parameter between two ends, on a logarithmic scale if so said."""

    low: float
    high: float
    log: bool = False

    def place(self, unit: float) -> float:
        """The value at a share of the way."""
        if self.log:
            return math.exp(math.log(self.low) + unit * (math.log(self.high) - math.log(self.low)))
        return self.low + unit * (self.high - self.low)


@dataclass
class Trial:
    number: int
    units: dict[str, float]  # places in their ranges
    values: dict[str, float]
    losses: list[float] = field(default_factory=list)  # by rung
    pruned: bool = False


def unit(*parts: object) -> float:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 16**12


def normal(seed: int, *parts: object) -> float:
    """A standard normal draw by two uniform ones."""
    u, v = max(unit(seed, "u", *parts), 1e-12), unit(seed, "v", *parts)
    return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)


def density(x: float, centres: list[float], width: float) -> float:
    """A uniform density and normal ones around the centres, of equal weight."""
    parts = [1.0, *[math.exp(-0.5 * ((x - c) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for c in centres]]
    return sum(parts) / len(parts)


def proposal(space: dict[str, Range], done: list[Trial], number: int, seed: int) -> Trial:
    """The next trial: uniform at first and now and then, else by the ratio of densities, each parameter by itself."""
    whole = sorted((t for t in done if t.losses), key=lambda t: (-len(t.losses), t.losses[-1], t.number))
    units = {}
    for name in space:
        if len(whole) < LEAST or number % UNIFORM == 0:
            units[name] = unit(seed, number, name)
            continue
        n = max(1, math.ceil(BETTER * len(whole)))
        good, rest = [t.units[name] for t in whole[:n]], [t.units[name] for t in whole[n:]]
        width = max(1.0 / (1 + len(good)), 0.05)
        drawn = []
        for k in range(DRAWS):
            c = good[int(unit(seed, number, name, k, "pick") * len(good))]
            x = abs(c + width * normal(seed, number, name, k)) % 2  # mirrored at both ends
            drawn.append(min(x, 2 - x))
        units[name] = max(drawn, key=lambda x: density(x, good, width) / density(x, rest, width))
    return Trial(number, units, {name: r.place(units[name]) for name, r in space.items()})


def mean_losses(rows: DataFrame, trials: list[Trial], loss: Callable[[dict[str, float]], Column]) -> list[float]:
    """Each trial's mean loss, all from one pass; infinite where it is no number."""
    one = rows.agg(*[F.avg(loss(t.values)).alias(f"t{t.number}") for t in trials]).first()
    return [math.inf if v is None or math.isnan(v) else v for v in one]


def search(rows: DataFrame, key: str, loss: Callable[[dict[str, float]], Column], space: dict[str, Range], trials: int = 32, batch: int = 8,
           rungs: tuple[float, ...] = (0.1, 0.3, 1.0), seed: int = 1, score: Callable | None = None) -> list[Trial]:
    """All trials in their order. ``score`` (trials, share of the rows) gives mean losses; by default one Spark aggregate."""
    share = hash_unit(F.lit(seed), F.col(key)) / F.lit(2.0**32)
    score = score or (lambda live, part: mean_losses(rows if part >= 1 else rows.where(share < part), live, loss))
    done: list[Trial] = []
    while len(done) < trials:
        now = [proposal(space, done, len(done) + i, seed) for i in range(min(batch, trials - len(done)))]
        done += now
        for r, part in enumerate(rungs):
            live = [t for t in now if not t.pruned]
            for t, value in zip(live, score(live, part) if live else [], strict=True):
                t.losses.append(value)
            if r + 1 < len(rungs):
                middle = statistics.median([t.losses[r] for t in done if len(t.losses) > r])
                for t in live:
                    t.pruned = t.losses[r] > middle
    return done


def best(trials: list[Trial], rungs: int) -> Trial:
    """The trial of least loss among those that were scored on all rows."""
    return min((t for t in trials if len(t.losses) == rungs), key=lambda t: (t.losses[-1], t.number))
