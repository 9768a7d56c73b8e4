"""Search of parameters against a loop over trials."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from chronopanel.functions.exprs import hash_unit
from chronopanel.operators import search as S

SPACE = {"a": S.Range(-3, 3), "b": S.Range(0.01, 10, log=True)}


def loss(v):
    return F.abs(F.col("y") - F.lit(v["a"]) * F.col("x")) + F.lit(abs(math.log(v["b"])))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(i, x := rng.uniform(-1, 1), 1.7 * x + rng.gauss(0, 0.05)) for i in range(400)], "id long, x double, y double").repartition(3).cache()


def test_equals_a_loop_over_trials(data):
    got = S.search(data, "id", loss, SPACE, trials=24, batch=6, seed=5)
    rows = data.select("x", "y", (hash_unit(F.lit(5), F.col("id")) / F.lit(2.0**32)).alias("u")).collect()

    def loop(live, part):
        some = [r for r in rows if part >= 1 or r["u"] < part]
        return [sum(abs(r["y"] - t.values["a"] * r["x"]) + abs(math.log(t.values["b"])) for r in some) / len(some) for t in live]

    want = S.search(data, "id", loss, SPACE, trials=24, batch=6, seed=5, score=loop)
    assert [(t.units, t.pruned, len(t.losses)) for t in got] == [(t.units, t.pruned, len(t.losses)) for t in want]
    assert all(a.losses == pytest.approx(b.losses) for a, b in zip(got, want, strict=True))
    assert 0 < sum(t.pruned for t in got) < 24 and S.search(data, "id", loss, SPACE, trials=6, seed=6)[0].units != got[0].units


def test_proposals_are_better_than_chance(data, monkeypatch):
    score = lambda live, part: [abs(t.values["a"] - 1.7) * 0.5 + abs(math.log(t.values["b"])) for t in live]

    def mean_best():
        runs = [S.search(data, "id", loss, SPACE, trials=40, seed=s, score=score) for s in range(12)]
        assert all(0 <= u <= 1 for r in runs for t in r for u in t.units.values())
        assert all(0.01 * 0.999 <= t.values["b"] <= 10 * 1.001 for r in runs for t in r)
        return sum(S.best(r, 3).losses[-1] for r in runs) / len(runs)

    guided = mean_best()
    monkeypatch.setattr(S, "UNIFORM", 1)
    assert guided < 0.75 * mean_best()
