"""Fuzzy-rule scoring and explanation in closed form, as array expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from chronopanel.operators.quantiles import quantile_values

EPS = 1e-8


@dataclass(frozen=True)
class Term:
    """A linguistic term: centre, width and weight of its membership."""

    name: str
    centre: float
    sigma: float
    weight: float


def membership(x: Column, term: Term) -> Column:
    z = (x - term.centre) / term.sigma
    return F.exp(-0.5 * z * z)


def normalised(x: Column, terms: list[Term]) -> list[Column]:
    mus = [membership(x, t) for t in terms]
    total = sum(mus[1:], mus[0]) + EPS
    return [m / total for m in mus]


def feature_risk(x: Column, terms: list[Term]) -> Column:
    parts = [m * t.weight for m, t in zip(normalised(x, terms), terms, strict=True)]
    return sum(parts[1:], parts[0])


def firing(memberships: list[Column]) -> Column:
    """Product of the antecedents' memberships."""
    out = memberships[0]
    for m in memberships[1:]:
        out = out * m
    return out


def cross_score(firings: list[Column], weights: list[float]) -> Column:
    """Weights averaged by the rules' shares of all firing."""
    total = sum(firings[1:], firings[0]) + EPS
    parts = [f / total * w for f, w in zip(firings, weights, strict=True)]
    return sum(parts[1:], parts[0])


def softmax(a: Column) -> Column:
    """Softmax of an array, stable for large entries."""
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def attention(risk: str, scale: float, shift: float, n: int, late: int, w: WindowSpec) -> dict[str, Column]:
    """Attention over the last n rows by the scorer tanh(scale * risk + shift), as window sums: the risk that it weights
    together, its entropy as a share of the most possible, and how much of it is on the last ``late`` rows.

    The scorer is bounded, so its exponentials need no maximum taken off.
    """
    score = F.tanh(F.col(risk) * scale + shift)
    e, t = F.exp(score), w.rowsBetween(-(n - 1), 0)
    total = F.sum(e).over(t)
    return {
        "attended": F.sum(e * F.col(risk)).over(t) / total,
        "entropy": (F.log(total) - F.sum(e * score).over(t) / total) / F.log(F.lit(float(n))),
        "late_mass": F.sum(e).over(w.rowsBetween(-(late - 1), 0)) / total,
    }


# Temporal signals that a rule may ask for, and from where on one holds.
SIGNAL_THRESHOLDS = {"risk_slope": 0.02, "short_term_change": 0.05, "window_change": 0.10, "abnormal_duration": 0.50, "abnormal_frequency": 0.50}


@dataclass(frozen=True)
class Candidate:
    """A rule of terms that hold now and a signal of one of their features."""

    rule_id: str
    antecedents: tuple[tuple[str, str], ...]
    feature: str
    signal: str
    cross: bool
    weight: float
    alignment: float


def candidates(initial: dict[str, list[Term]], trained: dict[str, list[Term]], signal_weights: dict[str, dict[str, float]],
               cross: list[tuple[str, tuple[tuple[str, str], ...], float]], scale: float, cross_scale: float) -> list[Candidate]:
    """For each feature its strongest risk term with its two strongest signals, for each cross rule its strongest signal.

    A rule's weight is the mean of its terms' weights, its signal's scaled weight and the cross rule's; its alignment is
    the share of these whose sign is that of the guideline. All from a rule base, which is small.
    """
    weight = {(f, t.name): t.weight for f, terms in trained.items() for t in terms}
    first = {(f, t.name): t.weight for f, terms in initial.items() for t in terms}
    strongest = {f: sorted(SIGNAL_THRESHOLDS, key=lambda s: -signal_weights[f][s]) for f in trained}

    def made(name, terms, feature, signal, cross_weight):
        total = sum(weight[t] for t in terms) / len(terms) + signal_weights[feature][signal] * scale / len(trained) ** 0.5
        checks = [first[t] > 0 and weight[t] >= 0 for t in terms] + [signal_weights[feature][signal] >= 0]
        if cross_weight is not None:
            total += cross_weight * cross_scale
            checks.append(cross_weight >= 0)
        return Candidate(name, tuple(terms), feature, signal, cross_weight is not None, max(total, 0.0), sum(checks) / len(checks))

    out = []
    for f, terms in initial.items():
        risky = [t.name for t in terms if t.weight > 0]
        if risky:
            term = max(risky, key=lambda name: weight[f, name])
            out += [made(f"single::{f}::{term}::{s}", [(f, term)], f, s, None) for s in strongest[f][:2]]
    for name, terms, cross_weight in cross:
        feature = max((f for f, _ in terms), key=lambda f: signal_weights[f][strongest[f][0]])
        out.append(made(f"cross::{name}::{feature}::{strongest[feature][0]}", list(terms), feature, strongest[feature][0], cross_weight))
    return out


def support(rows: DataFrame, rules: list[Candidate], memberships: dict[tuple[str, str], Column], signals: dict[tuple[str, str], Column], y: Column,
            least: float, least_cross: float) -> DataFrame:
    """One row a rule: weight as a share of the greatest, rows in which all terms and the signal hold, positives among
    them, lift, and a rank by weight times the root of support. One pass over the rows, whatever the number of rules."""
    aggs = [F.count("*").alias("n"), F.sum(y).alias("pos")]
    for i, r in enumerate(rules):
        hit = signals[r.feature, r.signal] >= SIGNAL_THRESHOLDS[r.signal]
        for term in r.antecedents:
            hit = hit & (memberships[term] >= (least_cross if r.cross else least))
        aggs += [F.sum(hit.cast("long")).alias(f"s{i}"), F.sum((hit & (y == 1)).cast("long")).alias(f"p{i}")]
    one, most = rows.agg(*aggs), max((r.weight for r in rules), default=1.0)
    parts = []
    for i, r in enumerate(rules):
        s, p, n = F.col(f"s{i}"), F.col(f"p{i}"), F.col("n")
        w = r.weight / max(most, 1e-8)
        parts.append(F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.signal).alias("signal"), F.lit(w).alias("weight"), F.lit(r.alignment).alias("alignment"), s.alias("support"), p.alias("positives"),
            F.when(s > 0, p / s / (F.col("pos") / n)).alias("lift"), (F.lit(w) * F.sqrt(s / n)).alias("ranking")))
    return one.select(F.inline(F.array(*parts)))


def rubric(rules: DataFrame, k: int, n_cross: int = 3) -> DataFrame:
    """Direction checks of the top k rules, of which up to three are cross rules: static, temporal, cross, and their mean
    over those that apply. ``rules`` is a rule base with its ranking, which is small."""
    place = Window.orderBy(F.col("ranking").desc(), F.col("weight").desc(), "rule_id")
    cross = F.col("rule_id").startswith("cross::")
    x = rules.withColumns({"place": F.row_number().over(place), "cross": cross})
    x = x.withColumn("nth", F.row_number().over(Window.partitionBy("cross").orderBy("place")))
    x = x.withColumn("chosen", F.col("cross") & (F.col("nth") <= n_cross))
    x = x.withColumn("few", F.sum(F.col("chosen").cast("int")).over(Window.partitionBy()))
    x = x.where((F.col("place") <= F.greatest(k - F.col("few"), F.lit(1))) | F.col("chosen"))
    x = x.withColumn("head", F.col("place") <= F.greatest(k - F.col("few"), F.lit(1)))
    x = x.withColumn("rank", F.row_number().over(Window.orderBy(F.col("head").desc(), "place")).cast("long")).where(F.col("rank") <= k)
    checks = {
        "static_ok": (F.col("alignment") > 0).cast("double"), "temporal_ok": F.col("signal").isin(*SIGNAL_THRESHOLDS).cast("double"),
        "cross_ok": F.when(F.col("cross"), F.lit(1.0)),
    }
    x = x.withColumns(checks)
    there = sum((F.col(c).isNotNull().cast("int") for c in checks), F.lit(0))
    return x.withColumn("score", sum((F.coalesce(c, F.lit(0.0)) for c in checks), F.lit(0.0)) / there).select("rank", "rule_id", *checks, "score")


def membership_drift(spark: SparkSession, initial: dict[str, list[Term]], trained: dict[str, list[Term]]) -> DataFrame:
    """How far each term's centre, width and weight moved in training."""
    rows = [(f, a.name, a.centre, b.centre, a.sigma, b.sigma, a.weight, b.weight) for f in initial for a, b in zip(initial[f], trained[f], strict=True)]
    x = spark.createDataFrame(rows, "feature string, term string, c0 double, c1 double, s0 double, s1 double, w0 double, w1 double")
    width = F.greatest(F.col("s0"), F.lit(1e-6))
    return x.select("feature", "term", (F.col("c1") - F.col("c0")).alias("centre_shift"), (F.abs(F.col("c1") - F.col("c0")) / width).alias("shift_in_sigma"),
                    (F.abs(F.col("s1") - F.col("s0")) / width).alias("sigma_shift"), F.abs(F.col("w1") - F.col("w0")).alias("weight_shift"))


def fitted_terms(rows: DataFrame, column: str, terms: list[Term], y: Column) -> list[Term]:
    """Where the data would put each term: mean and deviation of the values and rate of the outcome, rows weighted by their
    normalised membership. One aggregate; a term without any membership stays where it is."""
    x = F.col(column)
    aggs = []
    for m in normalised(x, terms):
        n = F.nullif(F.sum(m), F.lit(0.0))
        mean = F.sum(m * x) / n
        aggs += [mean, F.sqrt(F.greatest(F.sum(m * x * x) / n - mean * mean, F.lit(0.0))), F.sum(m * y) / n]
    got = rows.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()  # three numbers a term
    return [t if got[3 * i] is None else Term(t.name, got[3 * i], got[3 * i + 1], got[3 * i + 2]) for i, t in enumerate(terms)]


def data_terms(rows: DataFrame, column: str, names: list[str], seed: int) -> list[Term]:
    """Terms drawn from the data: centres at quantiles, jittered and dealt at random within the 1st and 99th percentile.

    Chance comes from hashes of the seed, the column and the place, so it is the same everywhere. A few numbers a column
    come to the driver.
    """
    import hashlib

    def unit(what: str, i: int) -> float:
        return int(hashlib.md5(f"{seed}|{column}|{what}|{i}".encode()).hexdigest()[:8], 16) / 2**32

    n = len(names)
    places = [0.01, 0.99, *[0.05 + 0.9 * i / max(n - 1, 1) for i in range(n)]]
    low, high, *centres = quantile_values(rows, column, [*places, 0.0, 1.0])
    *centres, least, most = centres
    if low is None:
        low, high, centres = 0.0, 1.0, [i / max(n - 1, 1) for i in range(n)]
    elif high <= low:
        low, high = least, most + 1.0
    gap = max(high - low, 1e-3) / max(n - 1, 1)
    moved = [min(max(c + gap * 0.3 * (unit("jitter", i) - 0.5), low), high) for i, c in enumerate(centres)]
    dealt = [moved[i] for i in sorted(range(n), key=lambda i: unit("order", i))]
    return [Term(name, dealt[i], min(max(gap * (0.75 + 0.75 * unit("sigma", i)), 1e-3), 80.0), 0.5 * unit("weight", i)) for i, name in enumerate(names)]


def masked(rows: DataFrame, mode: str, values: dict[str, float], channels: list[str]) -> DataFrame:
    """Inputs with a part of them hidden: ``full``, ``no_missingness`` (its channels are 0) or ``missingness_only`` (values
    are their defaults)."""
    if mode == "full":
        return rows
    if mode == "no_missingness":
        return rows.withColumns({c: F.lit(0.0) for c in channels})
    if mode == "missingness_only":
        return rows.withColumns({c: F.lit(float(v)) for c, v in values.items()})
    raise ValueError(f"unknown mode {mode}")


def entropy(weights: Column) -> Column:
    """Entropy of weights, as a share of the most possible."""
    h = F.aggregate(weights, F.lit(0.0), lambda s, w: s - F.when(w > 0, w * F.log(w)).otherwise(0.0))
    return F.when(F.size(weights) > 1, h / F.log(F.size(weights)))


def by_variable(a: Column, mapping: list[int], n: int) -> Column:
    """Entries added up by the variable that each place belongs to."""
    places = {v: [i for i, to in enumerate(mapping) if to == v] for v in range(n)}
    return F.array(*[sum((F.coalesce(F.get(a, F.lit(i)), F.lit(0.0)) for i in at), F.lit(0.0)) for at in places.values()])


def normalise_l1(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    return F.transform(a, lambda x: F.abs(x) / (total + 1e-12))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_places(a: Column, k: int) -> Column:
    """Places (from 0) of the k largest entries by size, ties to the earlier one."""
    placed = F.transform(a, lambda x, i: F.struct((-F.abs(x)).alias("x"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(placed), 1, k), lambda s: s["i"])


def effective_count(a: Column, mass: float) -> Column:
    """How many of the largest entries hold the given share of the total; ties of the share count as not yet there."""
    shares = F.sort_array(normalise_l1(a), asc=False)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    step = lambda s, x: F.when(s["sum"] < mass, F.struct((s["sum"] + x).alias("sum"), (s["n"] + 1).alias("n"))).otherwise(s)
    return F.aggregate(shares, start, step)["n"]
