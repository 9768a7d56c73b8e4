"""Fits whose every step is one aggregate over the rows: balanced logistic regression, and the losses and gradients of the
rule model with attention.

Only sums reach the driver, as many as there are parameters (their square for Newton steps). Derivatives are closed forms
over columns. Panels that carry values forward hold long runs of equal hours: gradient steps go over runs, once made, and
what a run owes to the windows that it is in is a sum over the few runs that follow it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronopanel.functions.exprs import sigmoid
from chronopanel.operators.metrics import scaled
from chronopanel.operators.quantiles import settled
from chronopanel.operators.rules import EPS, Term


# Balanced logistic regression


@dataclass(frozen=True)
class Logistic:
    """Coefficients of standardised features; a feature that never varies has scale 1, a null counts as its mean."""

    features: list[str]
    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float

    def score(self) -> Column:
        out = F.lit(self.intercept)
        for f, m, s, c in zip(self.features, self.means, self.scales, self.coefficients, strict=True):
            out = out + (F.coalesce(F.col(f).cast("double"), F.lit(m)) - m) / s * c
        return out

    def probability(self) -> Column:
        return sigmoid(self.score())


def logistic(rows: DataFrame, y: str, features: list[str], balanced: bool = True, penalty: float = 0.0, steps: int = 30, tolerance: float = 1e-10) -> Logistic | None:
    """The likelihood's maximum by Newton steps; each one's gradient and Gram matrix are one aggregate. ``balanced`` weights
    make both classes count alike, ``penalty`` is half of the weight of squared coefficients. None with one class only."""
    x = rows.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    x, k = settled(x), len(features)
    stats = x.agg(F.count("*").alias("n"), F.sum("y").alias("pos"), *[g for i in range(k) for g in (F.avg(f"x{i}").alias(f"m{i}"), F.stddev_pop(f"x{i}").alias(f"s{i}"))]).first()
    n, pos = stats["n"], stats["pos"] or 0.0
    if not 0 < pos < n:
        return None
    means, scales = [stats[f"m{i}"] or 0.0 for i in range(k)], [stats[f"s{i}"] or 1.0 for i in range(k)]
    z = [F.lit(1.0), *[(F.coalesce(F.col(f"x{i}"), F.lit(means[i])) - means[i]) / scales[i] for i in range(k)]]
    w = F.when(F.col("y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if balanced else F.lit(1.0)
    b = np.zeros(k + 1)
    for _ in range(steps):
        p = sigmoid(sum((zi * float(c) for zi, c in zip(z[1:], b[1:], strict=True)), F.lit(float(b[0]))))
        named = x.select(*[zi.alias(f"z{i}") for i, zi in enumerate(z)], (w * (F.col("y") - p)).alias("r"), (w * p * (1 - p)).alias("v"))
        upper = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        sums = named.agg(*[F.sum(F.col("r") * F.col(f"z{i}")) for i in range(k + 1)], *[F.sum(F.col("v") * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in upper]).first()
        gradient, gram = np.array(sums[: k + 1]), np.zeros((k + 1, k + 1))
        for (i, j), s in zip(upper, sums[k + 1 :], strict=True):
            gram[i, j] = gram[j, i] = s
        ridge = np.r_[0.0, np.full(k, 2 * penalty)]
        step = np.linalg.lstsq(gram + np.diag(ridge), gradient - ridge * b, rcond=None)[0]
        b = b + step
        if np.abs(step).max() < tolerance:
            break
    return Logistic(features, means, scales, b[1:].tolist(), float(b[0]))


def calibrated(rows: DataFrame, y: str, score: str, name: str) -> DataFrame:
    """Every row with a probability: balanced logistic on the score, or the score between its least and greatest where
    there is only one class to fit on."""
    model = logistic(rows, y, [score])
    return scaled(rows, score, name) if model is None else rows.withColumn(name, model.probability())


# The rule model with attention


@dataclass(frozen=True)
class RuleModel:
    """Features' terms, rules across features by the places of their terms, and attention over the last ``hours`` rows:
    an hour's risk is the features' sum and ``kappa`` times the cross score, a window's is weighted by
    exp(tanh(scale * risk + shift)), the logit is base + gain times that."""

    terms: dict[str, list[Term]]
    cross: list[tuple[dict[str, int], float]]
    kappa: float = 0.2
    scale: float = 0.8
    shift: float = -0.5
    base: float = 0.0
    gain: float = 1.0
    hours: int = 6

    def vector(self) -> np.ndarray:
        """Centres, logarithms of widths and weights by feature and term, cross weights, scale, shift, base, gain."""
        own = [x for ts in self.terms.values() for t in ts for x in (t.centre, math.log(t.sigma), t.weight)]
        return np.array([*own, *[w for _, w in self.cross], self.scale, self.shift, self.base, self.gain])

    def moved(self, v: np.ndarray) -> RuleModel:
        at, terms = iter(v.tolist()), {}
        for f, ts in self.terms.items():
            terms[f] = [Term(t.name, next(at), math.exp(next(at)), next(at)) for t in ts]
        cross = [(places, next(at)) for places, _ in self.cross]
        return replace(self, terms=terms, cross=cross, scale=next(at), shift=next(at), base=next(at), gain=next(at))


@dataclass(frozen=True)
class Weights:
    consistency: float = 0.1
    sparsity: float = 0.01
    drift: float = 0.01
    nonnegative: float = 0.05


def penalties(model: RuleModel, start: RuleModel) -> dict[str, float]:
    """Losses of the parameters alone: mean absolute weights, mean squared moves of every group of parameters from
    ``start``, and mean negative parts of weights."""
    weights = [[t.weight for t in ts] for ts in model.terms.values()] + ([[w for _, w in model.cross]] if model.cross else [])
    groups = [([g(t) for t in ts], [g(t) for t in start.terms[f]]) for f, ts in model.terms.items() for g in (lambda t: t.centre, lambda t: t.sigma, lambda t: t.weight)]
    groups += [([w for _, w in model.cross], [w for _, w in start.cross])] if model.cross else []
    mean = lambda xs: sum(xs) / len(xs)
    return {
        "sparsity": sum(mean([abs(w) for w in ws]) for ws in weights),
        "drift": sum(mean([(a - b) ** 2 for a, b in zip(x, y, strict=True)]) for x, y in groups) / len(groups),
        "nonnegative": sum(mean([max(-w, 0.0) for w in ws]) for ws in weights),
    }


def penalty_gradient(model: RuleModel, start: RuleModel, weights: Weights) -> np.ndarray:
    """Derivatives of the weighted penalties by the entries of ``vector``."""
    n_groups = 3 * len(model.terms) + bool(model.cross)
    out = []

    def of_weight(w: float, n: int) -> float:
        return weights.sparsity * np.sign(w) / n - weights.nonnegative * (w < 0) / n

    for f, ts in model.terms.items():
        n = len(ts)
        pull = lambda a, b: weights.drift * 2 * (a - b) / n / n_groups
        for t, s in zip(ts, start.terms[f], strict=True):
            out += [pull(t.centre, s.centre), pull(t.sigma, s.sigma) * t.sigma, pull(t.weight, s.weight) + of_weight(t.weight, n)]
    n = len(model.cross)
    out += [weights.drift * 2 * (w - w0) / n / n_groups + of_weight(w, n) for (_, w), (_, w0) in zip(model.cross, start.cross, strict=True)]
    return np.array([*out, 0.0, 0.0, 0.0, 0.0])


def _sum(cols: list[Column]) -> Column:
    return sum(cols[1:], cols[0]) if cols else F.lit(0.0)


def _risks(rows: DataFrame, model: RuleModel) -> DataFrame:
    """Adds memberships, risks and the score's exponential."""
    out = rows
    for f, ts in model.terms.items():
        z = {k: (F.col(f) - t.centre) / t.sigma for k, t in enumerate(ts)}
        out = out.withColumns({f"__z_{f}_{k}": c for k, c in z.items()})
        out = out.withColumns({f"__mu_{f}_{k}": F.exp(-0.5 * F.col(f"__z_{f}_{k}") * F.col(f"__z_{f}_{k}")) for k in z})
        out = out.withColumn(f"__m_{f}", _sum([F.col(f"__mu_{f}_{k}") for k in z]) + EPS)
        out = out.withColumns({f"__n_{f}_{k}": F.col(f"__mu_{f}_{k}") / F.col(f"__m_{f}") for k in z})
        out = out.withColumn(f"__r_{f}", _sum([F.col(f"__n_{f}_{k}") * t.weight for k, t in enumerate(ts)]))
    fires = {}
    for r, (places, _) in enumerate(model.cross):
        fire = F.lit(1.0)
        for f, k in places.items():
            fire = fire * F.col(f"__n_{f}_{k}")
        fires[f"__f_{r}"] = fire
    out = out.withColumns(fires) if fires else out
    out = out.withColumn("__fs", _sum([F.col(c) for c in fires]) + EPS)
    out = out.withColumn("__cross", _sum([F.col(f"__f_{r}") / F.col("__fs") * w for r, (_, w) in enumerate(model.cross)]))
    out = out.withColumn("risk", _sum([F.col(f"__r_{f}") for f in model.terms]) + model.kappa * F.col("__cross"))
    return out.withColumn("__a", F.tanh(F.col("risk") * model.scale + model.shift)).withColumn("__e", F.exp("__a"))


def forward(rows: DataFrame, model: RuleModel, entity: str, hour: str) -> DataFrame:
    """Adds memberships, risks, the score's exponential, and by window its attended risk and logit (null until it is full)."""
    out = _risks(rows, model)
    w = Window.partitionBy(entity).orderBy(hour)
    last = w.rowsBetween(-(model.hours - 1), 0)
    total = F.sum("__e").over(last)
    full = F.count("*").over(last) == model.hours
    out = out.withColumns({"__whole": total, "attended": F.when(full, F.sum(F.col("__e") * F.col("risk")).over(last) / total)})
    return out.withColumn("logit", model.base + model.gain * F.col("attended"))


def _log_loss(z: Column, positives: Column, negatives: Column, pos_weight: float) -> Column:
    soft = lambda x: F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))
    return pos_weight * positives * soft(-z) + negatives * soft(z)


def _slope(z: Column, positives: Column, negatives: Column, pos_weight: float) -> Column:
    """The log loss's derivative by the logit."""
    p = sigmoid(z)
    return negatives * p - pos_weight * positives * (1 - p)


def _loss_terms(out: DataFrame, model: RuleModel, y: str, entity: str, hour: str, pos_weight: float) -> DataFrame:
    """Adds each window's weighted log loss and weight, and each pair of hours' consistency penalties by feature."""
    w = Window.partitionBy(entity).orderBy(hour)
    label = F.col(y).cast("double")
    used = F.col("logit").isNotNull() & F.col(y).isNotNull()
    loss = _log_loss(F.col("logit"), label, 1 - label, pos_weight)
    step = lambda c: F.col(c) - F.lag(c).over(w)
    pair = F.col(hour) == F.lag(hour).over(w) + 1
    cols = {"__used": used, "__loss": F.when(used, loss), "__dt": F.when(pair, step("risk"))}
    return out.withColumns(cols | {f"__d_{f}": F.when(pair, step(f"__r_{f}")) for f in model.terms})


def _drop(f: str) -> Column:
    """Penalty of a pair of hours: a feature's risk rises while the total falls."""
    return F.greatest(F.col(f"__d_{f}"), F.lit(0.0)) * F.greatest(-F.col("__dt"), F.lit(0.0))


def losses(rows: DataFrame, model: RuleModel, start: RuleModel, y: str = "y", entity: str = "user_id", hour: str = "hr", pos_weight: float = 1.0, weights: Weights | None = None) -> DataFrame:
    """One row: prediction, consistency, sparsity, drift, nonnegative and the weighted total. ``rows`` have the features
    without nulls, hours in order, and the outcome (null where it is unknown)."""
    weights = weights or Weights()
    out = _loss_terms(forward(rows, model, entity, hour), model, y, entity, hour, pos_weight)
    one = out.agg(F.avg("__loss").alias("prediction"), F.avg(F.when(F.col("__dt").isNotNull(), _sum([_drop(f) for f in model.terms]) / len(model.terms))).alias("consistency"))
    p = penalties(model, start)
    one = one.withColumns({"consistency": F.coalesce("consistency", F.lit(0.0)), **{k: F.lit(v) for k, v in p.items()}})
    total = F.col("prediction") + weights.consistency * F.col("consistency")
    for k in p:
        total = total + getattr(weights, k) * F.col(k)
    return one.withColumn("total", total)


def runs(rows: DataFrame, features: list[str], hours: int, y: str = "y", entity: str = "user_id", hour: str = "hr") -> DataFrame:
    """One row for each run of an entity's consecutive hours with equal features: ``__start`` and ``__length``; whether it
    goes on where the run before it ends; ``__y1``, ...: the outcomes of its first ``hours`` - 1 hours, whose windows begin in
    runs before; sums of outcomes and of their complements in its other hours, whose windows are in the run; and ``__s1``,
    ...: how many rows the last one, two, ... runs before it have, up to ``hours``."""
    w = Window.partitionBy(entity).orderBy(hour)
    label = F.col(y).cast("double")
    on = F.col(hour) == F.lag(hour).over(w) + 1
    for f in features:
        on = on & F.col(f).eqNullSafe(F.lag(f).over(w))
    x = rows.select(entity, hour, *features, label.alias("__y"), F.when(F.coalesce(on, F.lit(False)), None).otherwise(F.col(hour)).alias("__first"))
    x = x.withColumn("__start", F.max("__first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.col(hour) - F.col("__start") + 1
    inner = lambda c: F.coalesce(F.sum(F.when(place >= hours, c)), F.lit(0.0))
    first = {f"__y{j}": F.max(F.when(place == j, F.col("__y"))) for j in range(1, hours)}
    one = x.groupBy(entity, "__start").agg(
        F.count("*").alias("__length"), inner(F.col("__y")).alias("__positives"), inner(1 - F.col("__y")).alias("__negatives"),
        *[F.min(f).alias(f) for f in features], *[c.alias(name) for name, c in first.items()],
    )
    w = Window.partitionBy(entity).orderBy("__start")
    joined = F.coalesce(F.col("__start") == F.lag("__start").over(w) + F.lag("__length").over(w), F.lit(False))
    before = {f"__s{i}": F.coalesce(F.lag("__length", i).over(w), F.lit(0)) for i in range(1, hours)}
    one = one.withColumns({"__joined": joined} | before)
    for i in range(2, hours):
        one = one.withColumn(f"__s{i}", F.col(f"__s{i}") + F.col(f"__s{i - 1}"))
    return one.withColumns({name: F.least(F.col(name), F.lit(hours)).cast("int") for name in before})


def gradient(rows: DataFrame, model: RuleModel, start: RuleModel, y: str = "y", entity: str = "user_id", hour: str = "hr", pos_weight: float = 1.0,
             weights: Weights | None = None) -> tuple[float, np.ndarray]:
    """The total loss and its derivatives by the entries of ``vector``, from one aggregate."""
    return _of_runs(runs(rows, list(model.terms), model.hours, y, entity, hour), model, start, entity, pos_weight, weights or Weights())


def _of_runs(rows: DataFrame, model: RuleModel, start: RuleModel, entity: str, pos_weight: float, weights: Weights) -> tuple[float, np.ndarray]:
    """``gradient`` from the panel's runs.

    With q = d loss / d attended / E of each window, an hour in it owes e * (1 + scale * t * (risk - attended)) * q, where
    t = 1 - tanh^2. The window that ends at a run's j-th hour has j hours of it and so many of each run before it as fit in;
    both sums over the windows that a run is in come from the run itself and the few that follow it. A window within a run
    attends to its risk alone.
    """
    w = Window.partitionBy(entity).orderBy("__start")
    hours = model.hours
    out = _risks(rows, model).withColumn("__er", F.col("__e") * F.col("risk"))
    step = lambda c: F.when(F.col("__joined"), F.col(c) - F.lag(c).over(w))
    past = {f"{c}{i}": F.coalesce(F.lag(c, i).over(w), F.lit(0.0)) for c in ("__e", "__er") for i in range(1, hours)}
    out = out.withColumns({"__dt": step("risk")} | {f"__d_{f}": step(f"__r_{f}") for f in model.terms} | past)

    def upto(i: int, j: int) -> Column:
        return F.least(F.col(f"__s{i}"), F.lit(hours - j)) if i else F.lit(0)

    def share(i: int, j: int) -> Column:
        """Hours of the i-th run before in the window that ends at the run's j-th hour."""
        return upto(i, j) - upto(i - 1, j) if i else F.lit(j)

    whole = {f"__whole{j}": j * F.col("__e") + _sum([share(i, j) * F.col(f"__e{i}") for i in range(1, hours)]) for j in range(1, hours)}
    out = out.withColumns(whole)
    out = out.withColumns({f"__at{j}": (j * F.col("__er") + _sum([share(i, j) * F.col(f"__er{i}") for i in range(1, hours)])) / F.col(f"__whole{j}") for j in range(1, hours)})
    cols = {}
    for j in range(1, hours):
        z, label = model.base + model.gain * F.col(f"__at{j}"), F.col(f"__y{j}")
        used = label.isNotNull() & (upto(hours - 1, j) == hours - j)
        cols[f"__loss{j}"] = F.when(used, _log_loss(z, label, 1 - label, pos_weight))
        cols[f"__delta{j}"] = F.when(used, _slope(z, label, 1 - label, pos_weight)).otherwise(0.0)
    z, inner = model.base + model.gain * F.col("risk"), (F.col("__positives"), F.col("__negatives"))
    out = out.withColumns(cols | {"__loss": _log_loss(z, *inner, pos_weight), "__delta": _slope(z, *inner, pos_weight)})
    q = {j: F.col(f"__delta{j}") * model.gain / F.col(f"__whole{j}") for j in range(1, hours)}
    owed = {f"__q{i}": _sum([share(i, j) * q[j] for j in q]) for i in range(hours)}
    owed |= {f"__qa{i}": _sum([share(i, j) * q[j] * F.col(f"__at{j}") for j in q]) for i in range(hours)}
    out = out.withColumns(owed | {"__t": 1 - F.col("__a") * F.col("__a"), "__pair": F.col("__dt").isNotNull()})
    out = out.withColumns({c: _sum([F.col(f"{c}0"), *[F.coalesce(F.lead(f"{c}{i}", i).over(w), F.lit(0.0)) for i in range(1, hours)]]) for c in ("__q", "__qa")})
    # Consistency: what a pair's steps owe, to its later hour and, with the other sign, to its earlier one.
    falls = F.greatest(-F.col("__dt"), F.lit(0.0))
    rise = {f: F.greatest(F.col(f"__d_{f}"), F.lit(0.0)) for f in model.terms}
    k = len(model.terms)
    by_feature = {f"__cf_{f}": F.coalesce(F.when(F.col(f"__d_{f}") > 0, falls), F.lit(0.0)) / k for f in model.terms}
    by_total = F.coalesce(F.when(F.col("__dt") < 0, -_sum(list(rise.values()))), F.lit(0.0)) / k
    out = out.withColumns(by_feature | {"__ct": by_total})
    both = lambda c: F.col(c) - F.coalesce(F.lead(c).over(w), F.lit(0.0))
    out = out.withColumns({f"__o{c[2:]}": both(c) for c in (*by_feature, "__ct")})
    # Prediction is a mean over windows, consistency one over pairs: both counts are known only with the sums, so each
    # derivative has a sum of either.
    attended = F.col("__e") * ((1 + model.scale * F.col("__t") * F.col("risk")) * F.col("__q") - model.scale * F.col("__t") * F.col("__qa"))
    out = out.withColumn("__rho", attended + F.col("__delta") * model.gain)
    sums: list[tuple[Column, Column]] = []

    def take(f: str | None, by: Column) -> None:
        """Derivative of the risk of a feature (None: of the cross score) by a parameter, as sums of both losses."""
        if f is None:
            sums.append((F.sum(F.col("__rho") * model.kappa * by), F.sum(F.col("__oct") * model.kappa * by)))
        else:
            sums.append((F.sum(F.col("__rho") * by), F.sum((F.col("__oct") + F.col(f"__ocf_{f}")) * by)))

    def by_share(f: str, j: int) -> Column:
        """Derivative of the cross score by the normalised membership of a term."""
        parts = []
        for r, (places, weight) in enumerate(model.cross):
            if places.get(f) == j:
                rest = F.lit(1.0)
                for g, i in places.items():
                    rest = rest if g == f else rest * F.col(f"__n_{g}_{i}")
                parts.append((F.lit(weight) - F.col("__cross")) / F.col("__fs") * rest)
        return _sum(parts)

    # Named, so that a plan holds each once.
    out = out.withColumns({f"__x_{f}_{j}": by_share(f, j) for f, ts in model.terms.items() for j in range(len(ts))})
    mean = {f"__xm_{f}": _sum([F.col(f"__x_{f}_{j}") * F.col(f"__n_{f}_{j}") for j in range(len(ts))]) for f, ts in model.terms.items()}
    out = out.withColumns(mean)
    for f, ts in model.terms.items():
        for j, t in enumerate(ts):
            own = (F.lit(t.weight) - F.col(f"__r_{f}")) / F.col(f"__m_{f}")
            across = (F.col(f"__x_{f}_{j}") - F.col(f"__xm_{f}")) / F.col(f"__m_{f}")
            mu, zc = F.col(f"__mu_{f}_{j}"), F.col(f"__z_{f}_{j}")
            for slope in (mu * zc / t.sigma, mu * zc * zc):  # by centre, by the width's logarithm
                sums.append((F.sum(F.col("__rho") * (own + model.kappa * across) * slope),
                             F.sum(((F.col("__oct") + F.col(f"__ocf_{f}")) * own + F.col("__oct") * model.kappa * across) * slope)))
            take(f, F.col(f"__n_{f}_{j}"))
    for r in range(len(model.cross)):
        take(None, F.col(f"__f_{r}") / F.col("__fs"))
    # Scale and shift act by the exponentials alone; an hour's share of them is as above, without the risk's own.
    tilt = F.col("__e") * F.col("__t") * (F.col("risk") * F.col("__q") - F.col("__qa"))
    none = F.sum(F.lit(0.0))
    sums += [(F.sum(tilt * F.col("risk")), none), (F.sum(tilt), none), (F.sum(_sum([F.col("__delta"), *[F.col(f"__delta{j}") for j in q]])), none)]
    sums += [(F.sum(_sum([F.col("__delta") * F.col("risk"), *[F.col(f"__delta{j}") * F.col(f"__at{j}") for j in q]])), none)]
    windows = _sum([F.col("__positives") + F.col("__negatives"), *[F.col(f"__loss{j}").isNotNull().cast("double") for j in q]])
    lost = _sum([F.col("__loss"), *[F.coalesce(F.col(f"__loss{j}"), F.lit(0.0)) for j in q]])
    pairs = F.sum(F.col("__length") - 1 + F.col("__pair").cast("long"))
    counts = [F.sum(windows), pairs, F.sum(lost), F.sum(F.when(F.col("__pair"), _sum([_drop(f) for f in model.terms]) / k))]
    got = out.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts)], *[c.alias(f"s{i}_{j}") for i, two in enumerate(sums) for j, c in enumerate(two)]).first()
    n, m = max(got["c0"] or 0, 1), max(got["c1"] or 0, 1)
    values = np.array([(got[f"s{i}_0"] or 0.0) / n + weights.consistency * (got[f"s{i}_1"] or 0.0) / m for i in range(len(sums))])
    p = penalties(model, start)
    total = (got["c2"] or 0.0) / n + weights.consistency * (got["c3"] or 0.0) / m + sum(getattr(weights, name) * v for name, v in p.items())
    return total, values + penalty_gradient(model, start, weights)


def fit_rules(rows: DataFrame, start: RuleModel, steps: int = 10, rate: float = 0.05, pos_weight: float | None = None, weights: Weights | None = None, **columns: str) -> tuple[RuleModel, list[float]]:
    """The model after so many steps of Adam, each one aggregate over the panel's runs, and the total loss before each step
    and after the last.

    Centres move in units of their term's width. ``pos_weight`` defaults to negatives by positives.
    """
    entity = columns.get("entity", "user_id")
    of = settled(runs(rows, list(start.terms), start.hours, **columns))
    if pos_weight is None:
        first = [F.col(f"__y{j}") for j in range(1, start.hours)]
        sums = lambda c, own: F.sum(_sum([F.col(c), *[F.coalesce(x, F.lit(0.0)) for x in own]]))
        pos, neg = of.agg(sums("__positives", first), sums("__negatives", [1 - x for x in first])).first()
        pos_weight = neg / pos if pos else 1.0
    at = lambda model: _of_runs(of, model, start, entity, pos_weight, weights or Weights())
    model, seen = start, []
    unit = np.array([u for ts in start.terms.values() for t in ts for u in (t.sigma, 1.0, 1.0)] + [1.0] * (len(start.cross) + 4))
    first, second = np.zeros_like(unit), np.zeros_like(unit)
    for step in range(1, steps + 1):
        total, g = at(model)
        seen.append(total)
        g = g * unit
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        model = model.moved(model.vector() - move * unit)
    seen.append(at(model)[0])
    return model, seen
