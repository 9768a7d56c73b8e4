"""Exact quantiles against sorting, in groups of any size and with few ordered rows at a time."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from chronopanel.operators.quantiles import quantile_columns, quantile_values, quantiles

PROBS = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]


def plain(values, p):
    v = sorted(values)
    at = (len(v) - 1) * p
    a, b = v[math.floor(at)], v[math.ceil(at)]
    return a if a == b else a * (1 - (at - math.floor(at))) + b * (at - math.floor(at))


def samples(seed):
    rng = random.Random(seed)
    return {
        "normal": [rng.gauss(0, 1) for _ in range(3000)], "ties": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(2000)], "same": [4.0] * 1500,
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(2500)], "few": [3.0, 1.0], "one": [5.0], None: [rng.random() for _ in range(700)],
        "infinite": [float("inf")] * 400 + [-float("inf")] * 400 + [rng.random() for _ in range(800)],
    }


@pytest.mark.parametrize("limit", [40, 100_000])
def test_groups(spark, limit):
    data = samples(1)
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("none", None), ("few", None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r["q"] for r in quantiles(df, "v", PROBS, ["k"], limit=limit).collect()}
    assert set(got) == {*data, "none"} and all(x is None for x in got.pop("none") or [None])
    for k, q in got.items():
        assert q == pytest.approx([plain(data[k], p) for p in PROBS], rel=1e-9), k


@pytest.mark.parametrize("limit", [30, 100_000])
def test_weights_are_repeated_rows(spark, limit):
    rng = random.Random(3)
    rows = [(float(i % 300) + i / 1000, rng.choice([1, 1, 2, 50])) for i in range(900)]
    df = spark.createDataFrame(rows, "v double, n int")
    every = [v for v, n in rows for _ in range(n)]
    assert quantile_values(df, "v", PROBS, weight="n", limit=limit) == pytest.approx([plain(every, p) for p in PROBS])


@pytest.mark.parametrize("limit", [10, 100_000])
def test_nothing_and_names(spark, limit):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", None, 4.0), (None, 1, 8.0)] + [("b", 2, float(i)) for i in range(50)], "a string, b int, v double")
    assert quantile_values(df.limit(0), "v", [0.5], limit=limit) == [None]
    assert quantile_values(df.where("v < 0"), "v", [0.5, 0.1], limit=limit) == [None, None]
    got = {(r["a"], r["b"]): (r["low"], r["mid"]) for r in quantile_columns(df, "v", {"low": 0.0, "mid": 0.5}, ["a", "b"], limit=limit).collect()}
    assert got == {("a", 1): (2.0, 2.0), ("a", None): (4.0, 4.0), (None, 1): (8.0, 8.0), ("b", 2): (0.0, 24.5)}


def test_a_million_distinct_values_in_one_group(spark):
    n = 1_000_000
    df = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    got = quantile_values(df, "v", [0.0, 0.001, 0.5, 0.75, 1.0], limit=1000)
    assert got == pytest.approx([0, (n - 1) * 0.001, (n - 1) * 0.5, (n - 1) * 0.75, n - 1])


def test_borders_that_differ_from_run_to_run(spark, monkeypatch):
    """Approximate quantiles depend on the order in which parts arrive; here they do so by far."""
    loose, n = F.udf(lambda b: [x + random.uniform(-300, 300) for x in b], "array<double>").asNondeterministic(), 6000
    approximate = F.percentile_approx
    monkeypatch.setattr("chronopanel.operators.quantiles.F.percentile_approx", lambda *a: loose(approximate(*a)))
    df = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    assert quantile_values(df, "v", [0.1, 0.25, 0.5, 0.75, 0.9], limit=1000) == pytest.approx([(n - 1) * p for p in (0.1, 0.25, 0.5, 0.75, 0.9)])
