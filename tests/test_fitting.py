"""Fits against brute-force likelihoods, losses against plain loops, gradients against differences."""

from __future__ import annotations

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import fitting as L
from chronopanel.operators.rules import Term

START = L.RuleModel({"v": [Term("low", 2.0, 1.5, 0.2), Term("high", 6.0, 2.0, 1.1)], "e": [Term("calm", 1.0, 1.0, 0.1), Term("mid", 3.0, 1.2, -0.3), Term("alarm", 5.0, 1.5, 0.9)]},
                    [({"v": 1, "e": 2}, 1.2), ({"v": 0, "e": 0}, -0.1)], base=-0.4, gain=0.7, hours=3)
NOW = START.moved(START.vector() + np.linspace(-0.2, 0.25, len(START.vector())))


def table(seed, entities=6, hours=14):
    rng = random.Random(seed)
    out = []
    for u in range(entities):
        h = 0
        for _ in range(hours):
            h += rng.choice([1, 1, 1, 2])
            v, e = rng.uniform(0, 8), rng.uniform(0, 6)
            out.append((u, h, v, e, rng.choice([0, 1, int(v > 4), None])))
    return out


def brute(rows, m, start, pos_weight, w):
    """Losses by plain loops."""
    risk = {}
    for u, h, v, e, y in rows:
        n = {}
        for f, x in (("v", v), ("e", e)):
            mu = [math.exp(-0.5 * ((x - t.centre) / t.sigma) ** 2) for t in m.terms[f]]
            n[f] = [a / (sum(mu) + 1e-8) for a in mu]
        r = {f: sum(a * t.weight for a, t in zip(n[f], m.terms[f], strict=True)) for f in n}
        fires = [math.prod(n[f][k] for f, k in places.items()) for places, _ in m.cross]
        cross = sum(a / (sum(fires) + 1e-8) * weight for a, (_, weight) in zip(fires, m.cross, strict=True))
        risk.setdefault(u, []).append((h, sum(r.values()) + m.kappa * cross, r, y))
    loss, pairs = [], []
    for series in risk.values():
        series.sort(key=lambda x: x[0])
        for i, (h, t, r, y) in enumerate(series):
            if i and h == series[i - 1][0] + 1:
                pairs.append(sum(max(r[f] - series[i - 1][2][f], 0) * max(series[i - 1][1] - t, 0) for f in r) / len(r))
            if i >= m.hours - 1 and y is not None:
                last = [x[1] for x in series[i - m.hours + 1 : i + 1]]
                e = [math.exp(math.tanh(m.scale * x + m.shift)) for x in last]
                z = m.base + m.gain * sum(a * b for a, b in zip(e, last, strict=True)) / sum(e)
                loss.append(-(pos_weight * y * math.log(1 / (1 + math.exp(-z))) + (1 - y) * math.log(1 / (1 + math.exp(z)))))
    p = L.penalties(m, start)
    out = {"prediction": sum(loss) / len(loss), "consistency": sum(pairs) / len(pairs), **p}
    return out | {"total": out["prediction"] + w.consistency * out["consistency"] + w.sparsity * p["sparsity"] + w.drift * p["drift"] + w.nonnegative * p["nonnegative"]}


def test_losses_and_gradients(spark):
    rows, w = table(3), L.Weights(0.7, 0.05, 0.3, 0.4)
    df = spark.createDataFrame(rows, "user_id long, hr long, v double, e double, y long").repartition(3)
    want = brute(rows, NOW, START, 1.7, w)
    got = L.losses(df, NOW, START, pos_weight=1.7, weights=w).first().asDict()
    assert got == pytest.approx(want)
    total, g = L.gradient(df, NOW, START, pos_weight=1.7, weights=w)
    assert total == pytest.approx(want["total"])
    v, step = NOW.vector(), 1e-6
    for i in range(len(v)):
        up, down = v.copy(), v.copy()
        up[i] += step
        down[i] -= step
        numeric = (brute(rows, NOW.moved(up), START, 1.7, w)["total"] - brute(rows, NOW.moved(down), START, 1.7, w)["total"]) / (2 * step)
        assert g[i] == pytest.approx(numeric, abs=2e-6), i


def held(seed, entities=8):
    """Hours whose features are carried forward, in runs of one to twenty, with gaps, one feature alone changing, and few hours."""
    rng = random.Random(seed)
    out = []
    for u in range(entities):
        h, v, e = 0, 1.0, 2.0
        for _ in range(rng.choice([1, 2, 4, 9, 14])):
            v, e = (rng.choice([v, rng.uniform(0, 8)]), rng.uniform(0, 6))
            for k in range(rng.choice([1, 1, 2, 3, 5, 6, 7, 20])):
                h += 3 if k and rng.random() < 0.05 else 1
                out.append((u, h, v, e, rng.choice([0, 1, int(v > 4), None])))
    return out


@pytest.mark.parametrize("hours", [1, 2, 6])
def test_steps_go_over_runs_of_equal_hours(spark, hours):
    rows, w, now = held(hours), L.Weights(0.7, 0.05, 0.3, 0.4), replace(NOW, hours=hours)
    df = spark.createDataFrame(rows, "user_id long, hr long, v double, e double, y long").repartition(3)
    of = L.runs(df, ["v", "e"], hours)
    assert of.count() < len(rows) / 2 and of.agg(F.sum("__length")).first()[0] == len(rows)
    total, g = L.gradient(df, now, START, pos_weight=1.7, weights=w)
    assert total == pytest.approx(brute(rows, now, START, 1.7, w)["total"])
    v, step = now.vector(), 1e-6
    for i in range(len(v)):
        up, down = v.copy(), v.copy()
        up[i] += step
        down[i] -= step
        numeric = (brute(rows, now.moved(up), START, 1.7, w)["total"] - brute(rows, now.moved(down), START, 1.7, w)["total"]) / (2 * step)
        assert g[i] == pytest.approx(numeric, abs=2e-6), i
    pos, n = sum(r[4] or 0 for r in rows), sum(r[4] is not None for r in rows)
    model, seen = L.fit_rules(df, now, steps=1)
    for at, total in ((now, seen[0]), (model, seen[1])):
        assert total == pytest.approx(brute(rows, at, now, (n - pos) / pos, L.Weights())["total"])


def test_penalties():
    p = L.penalties(START.moved(START.vector() + 1), START)
    assert p["nonnegative"] == 0 and p["sparsity"] == pytest.approx((1.2 + 2.1) / 2 + (1.1 + 0.7 + 1.9) / 3 + (2.2 + 0.9) / 2)
    assert L.penalties(START, START)["drift"] == 0 and L.penalties(START, START)["nonnegative"] == pytest.approx(0.1 + 0.05)


def test_the_total_falls(spark):
    df = spark.createDataFrame([(u, h, v, e, None if y is None else int(v > 4)) for u, h, v, e, y in table(5, 10, 20)], "user_id long, hr long, v double, e double, y long")
    model, seen = L.fit_rules(df, START, steps=10)
    assert len(seen) == 11 and all(b < a for a, b in zip(seen, seen[1:], strict=False))
    assert (model.vector() != START.vector()).all()
    assert L.losses(df.limit(0), START, START).first()["consistency"] == 0


@pytest.mark.parametrize("balanced", [True, False])
def test_logistic_is_the_likelihoods_maximum(spark, balanced):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 4)) * [1, 5, 0.1, 2] + [0, 3, 1, -2]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] - 0.4 * x[:, 1] + x[:, 3] + 1)))).astype(int)
    rows = [(int(t), *map(float, r)) for t, r in zip(y, x, strict=True)]
    names = ["a", "b", "c", "d", "same"]
    df = spark.createDataFrame([(*r, 3.0) for r in rows], "y int, a double, b double, c double, d double, same double").repartition(4)
    m = L.logistic(df, "y", names, balanced)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
    # Weighted residuals are orthogonal to every feature only at the maximum.
    s = m.intercept + ((x - m.means[:4]) / m.scales[:4]) @ np.array(m.coefficients[:4])
    r = w * (y - 1 / (1 + np.exp(-s)))
    assert np.abs(np.r_[r.sum(), ((x - m.means[:4]) / m.scales[:4]).T @ r]).max() < 1e-6 and m.coefficients[4] == pytest.approx(0, abs=1e-9)
    got = [t["p"] for t in df.select(m.probability().alias("p")).collect()]
    assert sorted(got) == pytest.approx(sorted(1 / (1 + np.exp(-s))), abs=1e-6)


def test_logistic_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None)], "y int, x double")
    assert L.logistic(df, "y", ["x"]) is None and L.logistic(df.limit(0), "y", ["x"]) is None
    both = spark.createDataFrame([(1, 2.0), (0, None), (1, None), (0, 1.0), (None, 9.0), (0, 3.0), (1, 1.5)], "y int, x double")
    assert 0 < both.select(L.logistic(both, "y", ["x"], penalty=0.1).probability().alias("p")).agg({"p": "min"}).first()[0] < 1


def test_calibrator_falls_back_to_scaling(spark):
    one = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 3.0)], "y int, p double")
    assert sorted(r["c"] for r in L.calibrated(one, "y", "p", "c").collect()) == [0.0, 0.5, 1.0]
    two = spark.createDataFrame([(int(i > 6 or i == 2), float(i)) for i in range(12)], "y int, p double")
    got = [r["c"] for r in L.calibrated(two, "y", "p", "c").orderBy("p").collect()]
    assert got == sorted(got) and 0 < got[0] < got[-1] < 1
